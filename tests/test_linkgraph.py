from wordmill.operators.linkgraph import html_edges, html_vertices, link_edges, link_vertices


def test_nested_anchor_graph(spark):
    pages = spark.createDataFrame(
        [(1, [(2, "a"), (3, "b"), (2, "again")]), (2, [(2, "self")]), (4, [])],
        "id long, anchor_text array<struct<id:long,text:string>>")
    assert sorted(tuple(r) for r in link_edges(pages).collect()) == [(1, 2), (1, 3), (2, 2)]
    assert sorted(r[0] for r in link_vertices(pages).collect()) == [1, 2, 3, 4]


def test_html_links_resolve_to_pages_or_url_ids(spark):
    pages = spark.createDataFrame([
        (1, "http://a.example.com/x/y?p=1", '<a href="/z">z</a> <a class="c" href="http://b.example.com/q">q</a>'),
        (2, "http://a.example.com/z", '<a href="rel">r</a><a href="//b.example.com/q">q</a>'),
        (3, "http://c.example.com/", None),
    ], "page_id long, url string, html string")
    edges = sorted(tuple(r) for r in html_edges(pages).collect())
    ids = {r[0] for r in html_vertices(pages).collect()}
    assert (1, 2) in edges  # /z resolves to page 2's URL
    targets = {d for s, d in edges if d not in (1, 2, 3)}
    assert len(targets) == 2  # http://b.example.com/q (twice, one id) and http://a.example.com/rel
    assert {1, 2, 3} | targets == ids


def test_nested_form_per_row(spark):
    from wordmill.operators.linkgraph import html_anchor_pages

    pages = spark.createDataFrame([
        (1, "http://a.example.com/p", '<a href="/q">q</a><a href="/q">again</a>'),
        (1, "http://a.example.com/p", '<a href="/r">r</a>'),  # a copy sharing the id
        (2, "http://a.example.com/q", "no links"),
    ], "page_id long, url string, html string")
    rows = sorted((r["id"], sorted(x["text"] for x in r["anchor_text"])) for r in html_anchor_pages(pages).collect())
    assert rows == [(1, ["http://a.example.com/q", "http://a.example.com/q"]), (1, ["http://a.example.com/r"]),
                    (2, [])]
    known = {x["id"] for r in html_anchor_pages(pages).collect() for x in r["anchor_text"]
             if x["text"].endswith("/q")}
    assert known == {2}


URL_CASES = [  # base, href as in the markup, canonical target
    ("http://a.ex/x/y?p=1#t", "../q", "http://a.ex/q"), ("http://a.ex/x/y/z", "../../../q", "http://a.ex/q"),
    ("http://a.ex/x/y", "q#s", "http://a.ex/x/q"), ("http://a.ex/x/y", "#s", "http://a.ex/x/y"),
    ("http://a.ex/x/y?p=1#t", "", "http://a.ex/x/y?p=1"), ("http://a.ex/x/y?p=1", "?a=1&amp;b=2", "http://a.ex/x/y?a=1&b=2"),
    ("http://a.ex/x/", "./a/./b/..", "http://a.ex/x/a/"), ("http://a.ex/x/y", ".", "http://a.ex/x/"),
    ("http://a.ex/x", "http://b.ex/a/../c?u=/../d#e", "http://b.ex/c?u=/../d"), ("http://a.ex/x", "//b.ex/.h/..i", "http://b.ex/.h/..i"),
    ("http://a.ex/x", "mailto:me@b.ex", "mailto:me@b.ex"), ("http://a.ex/x", "/et.", "http://a.ex/et."),
    ("http://a.ex/x", "/a//b/../c", "http://a.ex/a//c"), ("http://a.ex/x", "&amp;lt;", "http://a.ex/&lt;")]


def test_url_identity(spark):
    from pyspark.sql import functions as F

    from wordmill.operators.linkgraph import resolve_href

    cases = spark.createDataFrame(URL_CASES, "base string, href string, want string")
    got = cases.withColumn("got", resolve_href(F.col("base"), F.col("href"))).collect()
    assert [(r.base, r.href, r.got) for r in got] == URL_CASES


def test_url_identity_sql(spark, scratch):
    """The oracle's own rule gives the same edges, and a page crawled twice gets one."""
    import duckdb

    from wordmill.plans.oracle import LINKS

    rows = [(k, base, f'<a href="{href}">x</a>') for k, (base, href, _) in enumerate(URL_CASES)]
    rows += [(100, "http://a.ex/q", ""), (101, "http://a.ex/q#again", ""), (102, "http://a.ex/x/../q", '<a href="q">x</a>'),
             (103, "http://b.ex/c?u=/../d", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = sorted(tuple(r) for r in html_edges(pages).collect())
    assert [d for s, d in edges if s in (0, 1, 102)] == [100, 100, 100] and (8, 103) in edges
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert sorted(con.sql(f"WITH {LINKS} SELECT src, dst FROM edges").fetchall()) == edges
