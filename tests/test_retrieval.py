import pytest

from wordmill.operators.indexing import build_index, write_index
from wordmill.operators.retrieval import candidate_scores, search, top_n

TOY = [
    (10, "Apple banana apple cherry"),
    (11, "banana cherry the date"),
    (12, "cherry date, date; date fig"),
    (13, "fig fig apple"),
    (14, "grape cherry"),
    (15, "Cherry kiwi"),
    (16, "grape kiwi"),
    (17, "lemon cherry"),
]
RANKS = [(10, 3.0), (13, 0.5), (16, 9.0)]

# query -> [(doc, boosted tfidf, bm25, score)] best first
GOLDEN = {
    "apple banana": [(10, 0.856379530, 1.007792417, 0.932085973), (13, 0.612661742, 0.414973348, 0.513817545),
                     (11, 0.602059991, 0.414973348, 0.508516670)],
    "apple apple banana": [(10, 1.063846024, 1.600611485, 1.332228755), (13, 0.866434544, 0.829946696, 0.848190620),
                           (11, 0.602059991, 0.414973348, 0.508516670)],
    "grape kiwi": [(16, 0.936585546, 0.829946696, 0.883266121), (14, 0.602059991, 0.414973348, 0.508516670),
                   (15, 0.602059991, 0.414973348, 0.508516670)],
    "kiwi grape": [(16, 0.936585546, 0.829946696, 0.883266121), (15, 0.602059991, 0.414973348, 0.508516670),
                   (14, 0.602059991, 0.414973348, 0.508516670)],
    "cherry": [(10, 0.132460798, -0.414973348, -0.141256275)]
    + [(d, 0.124938737, -0.414973348, -0.145017306) for d in (11, 12, 14, 15, 17)],
    "date fig apple": [(12, 0.761552344, 1.106595595, 0.934073969), (13, 0.821971981, 1.007792417, 0.914882199),
                       (10, 0.638307615, 0.592819069, 0.615563342), (11, 0.602059991, 0.414973348, 0.508516670)],
    "zzz the": [],
    "": [],
}


def _corpus(spark, rows):
    return spark.createDataFrame([(d, f"T{d}", t) for d, t in rows], "doc_id long, title string, text string")


def _run(spark, index, queries, ranks=RANKS):
    qdf = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    pr = spark.createDataFrame(ranks, "id long, pagerank double") if ranks else None
    rows = search(qdf, index, pr).orderBy("query_id", "rank").collect()
    out = {q: [] for q in queries}
    for r in rows:
        out[queries[r["query_id"]]].append(r)
    return out


@pytest.mark.parametrize("stored", [False, True])
def test_toy_goldens(spark, scratch, stored):
    c = _corpus(spark, TOY)
    index = write_index(c, f"{scratch}/toy", min_df=0, num_buckets=8) if stored else build_index(c, min_df=0)
    queries = list(GOLDEN)
    got = _run(spark, index, queries)
    for q in queries:
        rows = got[q]
        assert [r["doc_id"] for r in rows] == [g[0] for g in GOLDEN[q]], q
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        for r, (d, tb, bm, sc) in zip(rows, GOLDEN[q]):
            assert r["tfidf_boosted"] == pytest.approx(tb, abs=1e-8)
            assert r["bm25"] == pytest.approx(bm, abs=1e-8)
            assert r["score"] == pytest.approx(sc, abs=1e-8)
            assert r["title"] == f"T{d}"


def test_df_equal_n_gives_zero_tfidf(spark):
    index = build_index(_corpus(spark, [(1, "common alpha"), (2, "common beta")]), min_df=0)
    rows = _run(spark, index, ["common"], ranks=None)["common"]
    assert [r["doc_id"] for r in rows] == [1, 2]
    assert all(r["tfidf"] == 0.0 for r in rows)
    assert rows[0]["score"] == pytest.approx(-0.349485002, abs=1e-8)


def test_top_n_cut_and_min_df(spark):
    rows = [(i, "shared word%d" % i) for i in range(1, 151)]
    c = _corpus(spark, rows)
    got = _run(spark, build_index(c, min_df=0), ["shared"], ranks=None)["shared"]
    assert len(got) == 100 and [r["doc_id"] for r in got] == list(range(1, 101))
    # With a cut of 150, "shared" (df 150) is not kept: no results.
    assert _run(spark, build_index(c, min_df=150), ["shared"], ranks=None)["shared"] == []


def test_search_plan_is_jvm_only_and_limits_per_group(spark, scratch):
    c = _corpus(spark, TOY)
    index = write_index(c, f"{scratch}/plan", min_df=0, num_buckets=8)
    qdf = spark.createDataFrame([(0, "apple banana")], "query_id long, query string")
    plan = top_n(candidate_scores(qdf, index))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    assert "EvalPython" not in plan and "MapInPandas" not in plan


@pytest.mark.parametrize("stored", [False, True])
def test_length_normalised_bm25(spark, scratch, stored):
    import math

    from wordmill.operators.retrieval import Ranking

    c = _corpus(spark, TOY)
    index = write_index(c, f"{scratch}/bm", min_df=0, num_buckets=8) if stored else build_index(c, min_df=0)
    qdf = spark.createDataFrame([(0, "kiwi")], "query_id long, query string")
    got = {r["doc_id"]: r["bm25"] for r in search(qdf, index, None, Ranking(length_norm=True)).collect()}
    lens = {d: len(t.split()) for d, t in TOY}
    avg = sum(lens.values()) / len(lens)
    n, df = 8, 2
    idf = math.log10((n - df + 0.5) / (df + 0.5))
    want = {d: idf * 2.5 * 1 / (1.5 * (0.25 + 0.75 * lens[d] / avg) + 1) for d in (15, 16)}
    assert set(got) == set(want)
    for d in want:
        assert got[d] == pytest.approx(want[d], abs=1e-12)


def test_rank_stored_in_postings_matches_rank_join(spark, scratch):
    c = _corpus(spark, TOY)
    pr = spark.createDataFrame(RANKS, "id long, pagerank double")
    embedded = write_index(c, f"{scratch}/emb", min_df=0, num_buckets=8, pagerank=pr)
    assert "pr" in embedded.postings.columns
    queries = list(GOLDEN)
    qdf = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    rows = search(qdf, embedded).orderBy("query_id", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(queries[r["query_id"]], []).append(r)
    for q in queries:
        want = GOLDEN[q]
        assert [r["doc_id"] for r in got.get(q, [])] == [g[0] for g in want], q
        for r, (d, tb, bm, sc) in zip(got.get(q, []), want):
            assert r["score"] == pytest.approx(sc, abs=1e-8)
    plan = search(qdf, embedded, with_titles=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "pagerank" not in plan
