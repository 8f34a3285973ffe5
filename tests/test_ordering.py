"""Global order at a size where two samples of range boundaries would differ."""

import random

import pytest
from pyspark.sql import functions as F

from wordmill.operators.evaluation import train_val_split
from wordmill.operators.ordering import dense_order_rank, successors

N = 50_000


@pytest.mark.parametrize("partitions", [1, 4])
def test_every_position_once(spark, partitions):
    rows = spark.range(N).repartition(partitions).select("id", F.md5(F.col("id").cast("string")).alias("key"))
    got = dense_order_rank(rows, F.col("key")).select("key", "pos").collect()
    by_key = sorted(got, key=lambda r: r.key)
    assert [r.pos for r in by_key] == list(range(N))


@pytest.mark.parametrize("partitions", [1, 4])
def test_split_is_exact(spark, partitions):
    queries = spark.range(N).repartition(partitions).select(F.col("id").alias("query_id"),
                                                            F.concat(F.lit("q"), F.col("id")).alias("query"))
    counts = dict(train_val_split(queries).groupBy("split").count().collect())
    assert counts == {"train": int(N * 0.7), "validation": N - int(N * 0.7)}


def test_successors_with_a_hot_group_and_a_payload(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.5 else rng.randint(1, 900), k, rng.randint(0, 9), f"p{k}") for k in range(20_000)]
    df = spark.createDataFrame(rows, "g long, k long, v long, payload string").repartition(4)
    got = {r.k: (r.next, r.payload) for r in successors(df, "g", ["k"], "v").collect()}
    following = {}
    for g, k, v, payload in sorted(rows, reverse=True):
        assert got[k] == (following.get(g), payload)
        following[g] = v
