"""Link graph: edges and vertices from anchor arrays or from raw HTML pages."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How links are found in HTML and how a link target gets an id.
HREF_PATTERN = r'<a [^>]*href="([^"]*)"'
ID_HEX_DIGITS = 15  # 60-bit ids from md5 of the target URL


def link_edges(pages: DataFrame, id_col: str = "id", links_col: str = "anchor_text") -> DataFrame:
    """Distinct ``src, dst`` edges from ``id, anchor_text array<struct<id, text>>`` (self links kept)."""
    exploded = pages.select(F.col(id_col).cast("long").alias("src"),
                            F.explode(F.col(f"{links_col}.id")).alias("dst"))
    return exploded.select("src", F.col("dst").cast("long").alias("dst")).where(F.col("dst").isNotNull()).distinct()


def link_vertices(pages: DataFrame, id_col: str = "id", links_col: str = "anchor_text") -> DataFrame:
    """Distinct ``id`` over pages and link targets (link-only targets and linkless pages included)."""
    sources = pages.select(F.col(id_col).cast("long").alias("id"))
    targets = pages.select(F.explode(F.col(f"{links_col}.id")).alias("id")).select(F.col("id").cast("long"))
    return sources.unionByName(targets).where(F.col("id").isNotNull()).distinct()


def url_id(url: Column) -> Column:
    """Stable 60-bit id of a URL (md5 prefix), for link targets that are not known pages."""
    return F.conv(F.substring(F.md5(url), 1, ID_HEX_DIGITS), 16, 10).cast("long")


def _without_dots(path: Column) -> Column:
    """A path less its ``.`` and ``..`` segments, folded from left to right; ``..`` stops at the root."""
    def step(kept: Column, s: Column) -> Column:
        return F.when(s == ".", kept).when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))) \
            .otherwise(F.concat(kept, F.array(s)))

    # A dot segment at the end leaves the slash before it.
    whole = F.regexp_replace(path, r"/\.{1,2}$", "$0/")
    folded = F.aggregate(F.slice(F.split(whole, "/"), 2, F.length(whole) + 1), F.array().cast("array<string>"), step)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(folded, "/"))).otherwise(path)


def canonical_url(url: Column) -> Column:
    """The URL that names a page: no fragment, no dot segments in its path."""
    plain = F.regexp_replace(url, r"(?s)#.*", "")
    origin = F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1)
    rest = F.substring(plain, F.length(origin) + 1, F.length(plain))
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    return F.when(origin == "", plain).otherwise(
        F.concat(origin, _without_dots(path), F.substring(rest, F.length(path) + 1, F.length(rest))))


def decode_references(href: Column) -> Column:
    """Character references that an attribute of a URL holds, decoded once."""
    for name, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        href = F.replace(href, F.lit(name), F.lit(character))
    return href


def known_pages(pages: DataFrame) -> DataFrame:
    """``target_url, known_id``: one page (the smallest id) per URL, however often it was crawled."""
    return pages.where(F.col("url").isNotNull()).groupBy(canonical_url(F.col("url")).alias("target_url")).agg(
        F.min(F.col("page_id").cast("long")).alias("known_id"))


def resolve_href(base_url: Column, href: Column) -> Column:
    """Absolute canonical URL of ``href``, as it stands in the markup, relative to the page at ``base_url``."""
    return canonical_url(_absolute(base_url, F.regexp_replace(decode_references(href), r"(?s)#.*", "")))


def _absolute(base_url: Column, href: Column) -> Column:
    origin = F.regexp_extract(base_url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base_url, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    directory = F.regexp_replace(F.regexp_replace(base_url, r"[?#].*$", ""), r"[^/]*$", "")
    return (F.when(href == "", base_url)
            .when(href.startswith("?"), F.concat(F.regexp_replace(base_url, r"(?s)[?#].*", ""), href))
            .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, href))
            .when(href.startswith("/"), F.concat(origin, href))
            .otherwise(F.concat(directory, href)))


def html_links(pages: DataFrame) -> DataFrame:
    """``src, target_url`` for every ``<a href>`` of ``page_id, url, html`` pages (repeats kept)."""
    hrefs = pages.select(
        F.col("page_id").cast("long").alias("src"), "url",
        F.explode(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(HREF_PATTERN), 1)).alias("href"))
    return hrefs.select("src", resolve_href(F.col("url"), F.col("href")).alias("target_url"))


def html_anchor_pages(pages: DataFrame) -> DataFrame:
    """Pages as ``id, anchor_text array<struct<id, text>>``, the nested link form.

    A target that is the URL of a known page takes that page's id; any other
    target gets the md5 id of its URL.  Links are regrouped per page *row*
    (not per id), so each array holds one row's links even when many copies
    of a page share an id; pages without links keep an empty array.
    """
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), F.col("page_id").cast("long").alias("id"),
                        "url", "html")
    hrefs = rows.select(
        "_row", "id", "url",
        F.explode_outer(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(HREF_PATTERN), 1))
        .alias("href"))
    links = hrefs.select("_row", "id", F.when(F.col("href").isNotNull(), resolve_href(F.col("url"), F.col("href")))
                         .alias("target_url"))
    known = known_pages(pages)
    resolved = links.join(known, "target_url", "left").select(
        "_row", "id", F.when(F.col("target_url").isNotNull(), F.struct(
            F.coalesce("known_id", url_id(F.col("target_url"))).alias("id"),
            F.col("target_url").alias("text"))).alias("link"))
    return resolved.groupBy("_row", "id").agg(F.collect_list("link").alias("anchor_text")).select("id", "anchor_text")


def html_edges(pages: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` edges of HTML pages, flat (no nested round trip).

    Links are made distinct per page before the URL lookup, so a navigation
    link repeated on every page costs one row per page, and a target URL
    shared by a third of all pages is a skewed join key that AQE splits.
    """
    links = html_links(pages).distinct()
    known = known_pages(pages)
    return links.join(known, "target_url", "left").select(
        "src", F.coalesce("known_id", url_id(F.col("target_url"))).alias("dst")).distinct()


def html_vertices(pages: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Distinct vertex ids: every page plus every link target."""
    edges = html_edges(pages) if edges is None else edges
    return (pages.select(F.col("page_id").cast("long").alias("id"))
            .unionByName(edges.select(F.col("dst").alias("id"))).distinct())


def link_graph(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(edges, vertices)`` of HTML pages, with the edges extracted once.

    The edges (two ids per row) are persisted, so the HTML is scanned and
    matched a single time although both outputs read them.
    """
    edges = html_edges(pages).persist(StorageLevel.MEMORY_AND_DISK)
    return edges, html_vertices(pages, edges)
