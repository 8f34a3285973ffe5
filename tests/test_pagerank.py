import pytest

from wordmill.operators.pagerank import pagerank

EDGES = [(1, 2), (1, 3), (2, 3), (3, 1), (3, 4), (5, 3), (6, 6), (4, 7)]
GOLDEN = {1: 0.882783559, 2: 0.684115384, 3: 1.489850077, 4: 0.882783559, 5: 0.253835498,
          6: 1.692236652, 7: 1.114395271}


def _graph(spark, edges):
    e = spark.createDataFrame(edges, "src long, dst long")
    ids = sorted({x for ed in edges for x in ed})
    v = spark.createDataFrame([(i,) for i in ids], "id long")
    return e, v


@pytest.mark.parametrize("hot_degree", [None, 1])
def test_toy_golden(spark, hot_degree):
    e, v = _graph(spark, EDGES + [(1, 2)])  # a duplicate edge counts once
    got = {r["id"]: r["pagerank"] for r in pagerank(e, v, hot_degree=hot_degree).collect()}
    assert set(got) == set(GOLDEN)
    for k, want in GOLDEN.items():
        assert got[k] == pytest.approx(want, abs=1e-9)
    assert sum(got.values()) == pytest.approx(7.0, abs=1e-9)


def test_isolated_vertex_gets_reset_mass(spark):
    e = spark.createDataFrame([(1, 2)], "src long, dst long")
    v = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = {r["id"]: r["pagerank"] for r in pagerank(e, v, iterations=1).collect()}
    raw = {1: 0.15, 2: 0.15 + 0.85, 3: 0.15}
    total = sum(raw.values())
    for k in raw:
        assert got[k] == pytest.approx(raw[k] * 3 / total, abs=1e-12)


def test_hot_source_split_matches_plain_rounds(spark):
    # One source with 12,000 out-edges is "hot" under the default threshold.
    star = [(0, i) for i in range(1, 12001)] + [(i, 0) for i in range(1, 50)] + [(5, 7), (7, 5)]
    e, v = _graph(spark, star)
    default = {r["id"]: r["pagerank"] for r in pagerank(e, v).collect()}
    plain = {r["id"]: r["pagerank"] for r in pagerank(e, v, hot_degree=10**9).collect()}
    assert default.keys() == plain.keys()
    for k in plain:
        assert default[k] == pytest.approx(plain[k], rel=1e-12)


def test_many_hot_sources_are_not_broadcast(spark, monkeypatch):
    """A low ``hot_degree`` makes every source hot: beyond the bound they are joined by shuffle, with equal ranks."""
    from wordmill.operators import pagerank as module

    edges = spark.createDataFrame([(a, (a * k + 1) % 40) for a in range(40) for k in range(1, 5)], "src long, dst long")
    vertices = edges.selectExpr("src AS id").union(edges.selectExpr("dst AS id")).distinct()
    want = {r.id: r.pagerank for r in module.pagerank(edges, vertices).collect()}
    monkeypatch.setattr(module, "DEFAULT_BROADCAST_BYTES", 100)
    got = {r.id: r.pagerank for r in module.pagerank(edges, vertices, hot_degree=1).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
