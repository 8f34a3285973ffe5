"""Search scores against matrix products over a small generated corpus, in memory and from a stored index."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordmill.functions.scoring import order_free_sum
from wordmill.operators.indexing import append_to_index, build_index, write_index
from wordmill.operators.retrieval import candidate_scores, search

RNG = np.random.default_rng(8)
VOCABULARY = np.array([f"term{k:02d}" for k in range(40)])
TF = RNG.poisson(0.4, (60, 40))               # documents by terms
QTF = RNG.poisson(0.12, (25, 40))             # queries by terms
RANK = np.where(np.arange(60) % 3 == 0, RNG.uniform(0, 20, 60), 0.0)


def _texts(counts):
    return [(k, f"t{k}", " ".join(np.repeat(VOCABULARY, row))) for k, row in enumerate(counts)]


def _expected(min_df):
    df = (TF > 0).sum(0)
    known = df > max(min_df, 0)
    n, q, tf, df = len(TF), QTF[:, known], TF[:, known].astype(float), df[known]
    idf, idf_bm = np.log10(n / df), np.log10((n - df + 0.5) / (df + 0.5))
    dot, norm = q @ (tf * idf * idf).T, np.sqrt(q @ ((tf * idf) ** 2).T)
    cosine = np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)
    bm = q @ (idf_bm * 2.5 * tf / (1.5 + tf)).T
    score = 0.5 * cosine * (1 + 0.1 * np.log10(RANK + 1)) + 0.5 * bm
    reached = (q @ tf.T) > 0
    return {(i, j): score[i, j] for i, j in zip(*np.nonzero(reached), strict=True)}


@pytest.fixture
def frames(spark):
    docs = spark.createDataFrame(_texts(TF), "doc_id long, title string, text string")
    queries = spark.createDataFrame([(k, t) for k, _, t in _texts(QTF)], "query_id long, query string")
    ranks = spark.createDataFrame([(k, float(r)) for k, r in enumerate(RANK) if r > 0], "id long, pagerank double")
    return docs, queries, ranks


def _weights(ranking):
    return ranking.w_tfidf, ranking.w_bm25


@pytest.mark.parametrize("min_df", [0, 15])
@pytest.mark.parametrize("form", ["raw", "stored", "stored ranks", "appended ranks"])
def test_scores(spark, scratch, frames, min_df, form):
    from wordmill.operators.retrieval import Ranking

    docs, queries, ranks = frames
    ranking = Ranking(n=60, w_tfidf=0.5, w_bm25=0.5)
    if form == "raw":
        index, joined = build_index(docs, min_df=min_df), ranks
    elif form == "stored":
        index, joined = write_index(docs, f"{scratch}/i", min_df=min_df), ranks
    elif form == "stored ranks":
        index, joined = write_index(docs, f"{scratch}/i", min_df=min_df, pagerank=ranks), None
    else:
        write_index(docs.where("doc_id < 30"), f"{scratch}/a", min_df=min_df, pagerank=ranks)
        index, joined = append_to_index(f"{scratch}/a", docs.where("doc_id >= 30"), f"{scratch}/b", pagerank=ranks), None
        assert index.doc_lengths.count() == 60 and "pr" in index.postings.columns
    got = {(r.query_id, r.doc_id): r.score for r in search(queries, index, joined, ranking).collect()}
    want = _expected(min_df)
    assert got.keys() == want.keys() and len(got) > 100
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("form", ["raw", "stored"])
def test_scores_do_not_depend_on_partitions(spark, scratch, frames, form):
    """The same bits for any partitioning of the postings and of the shuffles."""
    docs, queries, ranks = frames
    index = build_index(docs, min_df=0) if form == "raw" else write_index(docs, f"{scratch}/i", min_df=0)
    column = "all_postings" if form == "raw" else "postings"
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (1, 7, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            dealt = replace(index, **{column: getattr(index, column).orderBy(F.rand(parts)).repartition(parts)})
            rows = candidate_scores(queries, dealt, ranks).select("query_id", "doc_id", "tfidf", "bm25", "score").collect()
            seen.append({(r.query_id, r.doc_id): (r.tfidf.hex(), r.bm25.hex(), r.score.hex()) for r in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 100


def test_order_free_sum(spark):
    values = [(k % 3, float(x)) for k, x in enumerate(RNG.normal(0, 1e4, 3000))] + [(0, None), (4, None), (5, -0.25), (5, 0.25)]
    df = spark.createDataFrame(values, "k int, x double")
    sums = [{r.k: r.s for r in df.orderBy(F.rand(seed)).repartition(seed).groupBy("k").agg(
        order_free_sum(F.col("x")).alias("s")).collect()} for seed in (2, 9)]
    assert sums[0] == sums[1] and sums[0][4] is None and sums[0][5] == 0.0
    for k in range(3):
        assert abs(sums[0][k] - math.fsum(x for j, x in values if j == k and x is not None)) < 1e-9


def test_scoring_tasks_grow_with_the_pairs(spark, frames, monkeypatch):
    """One task sums a bounded number of pairs, all of a document, and the scores stay the same."""
    from wordmill.operators import retrieval

    docs, queries, *_ = frames
    index = build_index(docs, min_df=0)
    want = sorted(map(tuple, candidate_scores(queries, index).collect()))
    pairs = sum(r["df"] for r in retrieval.query_terms(queries, index).collect())
    monkeypatch.setattr(retrieval, "HITS_PER_TASK", 64)
    scored = candidate_scores(queries, index)
    assert scored.rdd.getNumPartitions() == -(-pairs // 64) > 8
    assert sorted(map(tuple, scored.collect())) == want
    placed = scored.withColumn("p", F.spark_partition_id()).groupBy("doc_id").agg(F.countDistinct("p").alias("n"))
    assert placed.where("n > 1").isEmpty()
