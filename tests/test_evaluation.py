import pytest

from wordmill.operators import evaluation as ev

R = range
# Fixed values: (metric, true, pred, k, value), the published examples of these metrics.
CASES = [
    ("precision", R(10), [1, 2, 3], 2, 1.0),
    ("recall", R(10), [10, 5, 3], 2, 0.1),
    ("precision", R(10), [], 2, 0.0),
    ("precision", [], [1, 2, 3], 5, 0.0),
    ("recall", [], [10, 5, 3], 2, 1.0),
    ("recall", R(10), [], 2, 0.0),
    ("f1", [], [1, 2, 3], 5, 0.0),
    ("f1", R(10), [], 2, 0.0),
    ("f1", R(10), [0, 1, 2], 2, 0.333),
    ("f1", R(50), R(5), 30, 0.182),
    ("f1", R(50), R(10), 30, 0.333),
    ("f1", R(50), R(30), 30, 0.75),
    ("quality", R(50), R(5), None, 0.308),
    ("quality", R(50), R(10), None, 0.5),
    ("quality", R(50), R(30), None, 0.857),
    ("quality", R(50), [-1] * 5 + list(R(5, 30)), None, 0.0),
]


def _frames(spark, true, pred):
    q = spark.createDataFrame([(0,)], "query_id long")
    res = spark.createDataFrame([(0, i + 1, d) for i, d in enumerate(pred)], "query_id long, rank long, doc_id long")
    rel = spark.createDataFrame([(0, d) for d in true], "query_id long, doc_id long")
    return q, res, rel


@pytest.mark.parametrize("metric,true,pred,k,value", CASES)
def test_reference_metric_asserts(spark, metric, true, pred, k, value):
    q, res, rel = _frames(spark, list(true), list(pred))
    if metric == "precision":
        got = ev.precision_at_k(q, res, rel, k).first()[1]
    elif metric == "recall":
        got = ev.recall_at_k(q, res, rel, k).first()[1]
    elif metric == "f1":
        got = ev.f1_at_k(q, res, rel, k).first()[1]
    else:
        got = ev.results_quality(q, res, rel).first()[1]
    assert got == value


def test_average_precision_and_overlap(spark):
    q, res, rel = _frames(spark, [1, 3, 5, 5], [1, 2, 3, 4, 5, 1])
    # hits at ranks 1, 3, 5, 6 -> (1/1 + 2/3 + 3/5 + 4/6) / 4
    assert ev.average_precision(q, res, rel, 40).first()[1] == round((1 + 2 / 3 + 3 / 5 + 4 / 6) / 4, 3)
    assert ev.overlap_at_k(q, res, rel, 40).first()[1] == 3
    q2, res2, rel2 = _frames(spark, [9], [1, 2])
    assert ev.average_precision(q2, res2, rel2, 40).first()[1] == 0.0


def test_report_and_split(spark):
    queries = spark.createDataFrame([(i, f"query {i}") for i in range(30)], "query_id long, query string")
    split = ev.train_val_split(queries)
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert counts == {"train": 21, "validation": 9}
    res = spark.createDataFrame([(0, 1, 7)], "query_id long, rank long, doc_id long")
    rel = spark.createDataFrame([(0, 7), (1, 8)], "query_id long, doc_id long")
    rep = {r["query_id"]: r for r in ev.query_report(queries, res, rel).collect()}
    assert len(rep) == 30
    assert rep[0]["precision_at_5"] == 1.0 and rep[0]["n_returned"] == 1
    assert rep[1]["n_relevant"] == 1 and rep[1]["results_quality"] == 0.0
    assert rep[2]["n_relevant"] == 0
    mq = {r["split"]: r for r in ev.mean_quality(ev.query_report(queries, res, rel), split).collect()}
    assert sum(r["n_queries"] for r in mq.values()) == 30


def test_dense_rank_is_global(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 500).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("k"))
    ranked = ev.dense_order_rank(df, F.col("k"))
    got = [r["id"] for r in ranked.orderBy("pos").collect()]
    want = [r["id"] for r in df.orderBy("k").collect()]
    assert got == want
    assert sorted(r["pos"] for r in ranked.collect()) == list(range(500))


def test_successors_match_lead_with_a_hot_group(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from wordmill.operators.ordering import successors

    # Group 0 holds most rows, so it spans several range partitions.
    rows = [(0 if i % 4 else i % 7, i // 3, (i * 37) % 101) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, o long, v long")
    got = sorted(tuple(r) for r in successors(df, "g", ["o", "v"], "v").select("g", "o", "v", "next").collect())
    w = Window.partitionBy("g").orderBy("o", "v")
    want = sorted(tuple(r) for r in df.select("g", "o", "v", F.lead("v").over(w).alias("next")).collect())
    assert got == want
