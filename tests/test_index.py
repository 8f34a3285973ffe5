from collections import Counter

from wordmill.operators.indexing import (
    append_to_index,
    build_index,
    doc_freq,
    drop_versions,
    merge_index,
    posting_lists,
    posting_lookup,
    read_index,
    term_counts,
    term_stats,
    write_index,
)
from wordmill.sources.corpus import corpus_from_tokens

DOCS = [
    (1, "T1", "apple banana apple cherry"),
    (2, "T2", "banana cherry the date"),
    (3, "T3", "cherry date, date; date fig"),
    (4, "T4", "fig fig apple"),
    (5, "T5", None),
]


def corpus(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, title string, text string")


def test_term_counts_and_stats(spark):
    c = corpus(spark)
    counts = {(r["term"], r["doc_id"]): r["tf"] for r in term_counts(c).collect()}
    assert counts[("apple", 1)] == 2 and counts[("date", 3)] == 3 and ("the", 2) not in counts
    assert sum(counts.values()) == 4 + 3 + 5 + 3  # kept tokens
    df = {r["term"]: r["df"] for r in doc_freq(term_counts(c)).collect()}
    assert df == {"apple": 2, "banana": 2, "cherry": 3, "date": 2, "fig": 2}
    st = {r["term"]: (r["df"], r["term_total"]) for r in term_stats(term_counts(c), min_df=2).collect()}
    assert st == {"cherry": (3, 3)}


def test_term_counts_match_python_counter(spark):
    rows = [(i, "", " ".join(["wd%d" % (j % 7) for j in range(i * 13)])) for i in range(1, 30)]
    got = Counter({(r["term"], r["doc_id"]): r["tf"] for r in term_counts(corpus(spark, rows)).collect()})
    want = Counter()
    for i, _, t in rows:
        for w, n in Counter(t.split()).items():
            want[(w, i)] = n
    assert got == want


def test_posting_lists_sorted(spark):
    pl = {r["term"]: [(p["doc_id"], p["tf"]) for p in r["postings"]]
          for r in posting_lists(term_counts(corpus(spark))).collect()}
    assert pl["cherry"] == [(1, 1), (2, 1), (3, 1)]
    assert pl["fig"] == [(3, 1), (4, 2)]


def test_write_read_roundtrip_and_lookup(spark, scratch):
    c = corpus(spark)
    idx = write_index(c, f"{scratch}/idx", min_df=1, num_buckets=8)
    got = sorted((r["term"], r["doc_id"], r["tf"]) for r in idx.postings.select("term", "doc_id", "tf").collect())
    lazy = build_index(c, min_df=1, num_buckets=8)
    want = sorted((r["term"], r["doc_id"], r["tf"]) for r in lazy.postings.select("term", "doc_id", "tf").collect())
    assert got == want and {g[0] for g in got} == {"apple", "banana", "cherry", "date", "fig"}
    again = read_index(spark, f"{scratch}/idx")
    assert again.n_docs() == 5 and again.num_buckets == 8 and again.min_df == 1
    assert [(r["doc_id"], r["tf"]) for r in posting_lookup(again, "date").collect()] == [(2, 1), (3, 3)]
    assert posting_lookup(again, "zzz").count() == 0
    plan = posting_lookup(again, "date")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,date)" in plan


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def same_index(a, b):
    assert rows_of(a.terms, "term", "df", "term_total", "bucket") == rows_of(b.terms, "term", "df", "term_total", "bucket")
    assert rows_of(a.postings, "term", "doc_id", "tf", "bucket") == rows_of(b.postings, "term", "doc_id", "tf", "bucket")
    assert rows_of(a.titles, "doc_id", "title") == rows_of(b.titles, "doc_id", "title")
    assert rows_of(a.doc_lengths, "doc_id", "doc_len") == rows_of(b.doc_lengths, "doc_id", "doc_len")
    assert a.corpus_stats.first().asDict() == b.corpus_stats.first().asDict()


def test_append_equals_full_build(spark, scratch):
    """Parts, and parts merged beyond a number of them, hold what one build does."""
    write_index(corpus(spark, DOCS[:2]), f"{scratch}/0", min_df=0, num_buckets=8)
    files = sorted(read_index(spark, f"{scratch}/0").postings.inputFiles())
    arrivals = [DOCS[2:3], DOCS[3:] + DOCS[:1]]  # document 1 comes a second time
    for k, rows in enumerate(arrivals, 1):
        parts = append_to_index(f"{scratch}/{k - 1}", corpus(spark, rows), f"{scratch}/{k}")
    assert set(files) <= set(parts.postings.inputFiles())
    full = write_index(corpus(spark, DOCS + DOCS[:1]), f"{scratch}/full", min_df=0, num_buckets=8)
    same_index(parts, full)
    same_index(read_index(spark, f"{scratch}/2"), full)
    merged = append_to_index(f"{scratch}/1", corpus(spark, arrivals[1]), f"{scratch}/merged", max_parts=2)
    same_index(merged, full)
    assert not set(files) & set(merged.postings.inputFiles())
    assert read_index(spark, f"{scratch}/1").n_docs() == 3


def test_index_from_tokens(spark, scratch):
    rows = [(1, ["b", "a", "b", None]), (2, None), (3, [])]
    tokens = corpus_from_tokens(spark.createDataFrame(rows, "doc_id long, tokens array<string>"))
    idx = write_index(tokens, f"{scratch}/a", min_df=0, num_buckets=8)
    assert rows_of(idx.postings, "term", "doc_id", "tf") == [("a", 1, 1), ("b", 1, 2)]
    assert rows_of(build_index(tokens, min_df=0).postings, "term", "doc_id", "tf") == [("a", 1, 1), ("b", 1, 2)]
    more = corpus_from_tokens(spark.createDataFrame([(4, ["The", "b"])], "doc_id long, tokens array<string>"))
    both = append_to_index(f"{scratch}/a", more, f"{scratch}/b")
    assert rows_of(both.terms, "term", "df", "term_total") == [("The", 1, 1), ("a", 1, 1), ("b", 2, 3)]
    assert both.corpus_stats.first().asDict() == {"n_docs": 4, "avg_dl": 5 / 4, "n_rows": 4, "total_len": 5}


def test_posting_blocks_are_cut_by_count(spark):
    """Sparse ids, a hot term over all partitions, and terms at the block size."""
    from pyspark.sql import functions as F

    rows = spark.range(5_000).select(F.explode(F.array(
        F.lit("hot"), F.when(F.col("id") < 500, F.lit("sparse")), F.when(F.col("id") < 64, F.lit("full")),
        F.when(F.col("id") < 65, F.lit("over")))).alias("term"), (F.col("id") * 1_000_000_007).alias("doc_id"),
        (F.col("id") % 7 + 1).alias("tf")).where("term is not null")
    lists = {(r.term, r.block): [tuple(p) for p in r.postings] for r in posting_lists(rows, block_size=64).collect()}
    want = {}
    for term, n in (("hot", 5_000), ("sparse", 500), ("full", 64), ("over", 65)):
        for k in range(0, n, 64):
            want[term, k // 64] = [(i * 1_000_000_007, i % 7 + 1) for i in range(k, min(k + 64, n))]
    assert lists == want


def test_rank_within_repeats_and_small_groups(spark):
    from wordmill.operators.ordering import rank_within

    rows = [("a" if k % 3 else f"g{k}", k // 4) for k in range(3_000)]
    got = rank_within(spark.createDataFrame(rows, "g string, x long"), ["g"], ["x"], "r").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.r, r.x))
    for g, pairs in by.items():
        assert [x for _, x in sorted(pairs)] == sorted(x for k, x in rows if k == g)
        assert sorted(r for r, _ in pairs) == list(range(len(pairs)))


def cut_corpora():
    """Two batches: terms over the cut in one, in the other, in both together only, and in neither."""
    first = [(k, f"t{k}", " ".join(["every"] + ["early"] * (k < 4) + ["pair"] * (k < 2) + [f"own{k}"])) for k in range(6)]
    more = [(k, f"t{k}", " ".join(["every"] + ["late"] * (k < 10) + ["pair"] * (k < 8) + [f"own{k}"])) for k in range(6, 12)]
    return first, more


def rare_of(index):
    return rows_of(index.rare_terms, "term", "df", "term_total", "bucket"), \
        rows_of(index.rare_postings, "term", "doc_id", "tf", "bucket")


def test_append_to_cut_index_equals_full_build(spark, scratch):
    first, more = cut_corpora()
    last = [(20 + k, "z", "own1 own1 own7 pair new") for k in range(4)]
    write_index(corpus(spark, first), f"{scratch}/i", min_df=3, num_buckets=8, block_size=2)
    for rows, so_far in ((more, first + more), (last, first + more + last)):
        grown = append_to_index(f"{scratch}/i", corpus(spark, rows), f"{scratch}/i")
        full = write_index(corpus(spark, so_far), f"{scratch}/full", min_df=3, num_buckets=8, block_size=2)
        same_index(grown, full)
        assert rare_of(grown) == rare_of(full)
    assert {"pair", "own1", "own7", "new", "every", "early", "late"} == {t for t, *_ in rows_of(grown.terms, "term")}
    merged = merge_index(spark, f"{scratch}/i", f"{scratch}/m")
    same_index(merged, full)
    assert rare_of(merged) == rare_of(full) and rows_of(merged.blocks, *full.blocks.columns) == rows_of(
        full.blocks, *full.blocks.columns)


def test_append_needs_the_rare_terms(spark, scratch):
    import pytest

    write_index(corpus(spark, DOCS[:2]), f"{scratch}/cut", min_df=1, num_buckets=8, keep_rare=False)
    with pytest.raises(ValueError):
        append_to_index(f"{scratch}/cut", corpus(spark, DOCS[2:]), f"{scratch}/out")


def test_failed_rebuild_leaves_the_index(spark, scratch, monkeypatch):
    """Whichever write fails, in a build, an append or a merge, readers find the old index; then it can be repeated."""
    import pytest
    from pyspark.sql import DataFrameWriter

    path, first, more = f"{scratch}/i", *cut_corpora()
    write_index(corpus(spark, first), path, min_df=3, num_buckets=1)
    written = DataFrameWriter.parquet
    works = {"build": lambda: write_index(corpus(spark, more), path, min_df=3, num_buckets=1),
             "append": lambda: append_to_index(path, corpus(spark, more), path),
             "merge": lambda: merge_index(spark, path, path)}
    for name, work in works.items():
        before = read_index(spark, path)
        terms, postings = rows_of(before.terms, "term", "df"), rows_of(before.postings, "term", "doc_id", "tf")
        for k in range(30):
            left = [k]

            def failing(self, target, *a, left=left, **kw):
                if target.startswith(path):
                    left[0] -= 1
                    if left[0] < 0:
                        raise OSError("no more writes")
                return written(self, target, *a, **kw)
            monkeypatch.setattr(DataFrameWriter, "parquet", failing)
            try:
                work()
                break
            except OSError:
                monkeypatch.setattr(DataFrameWriter, "parquet", written)
                now = read_index(spark, path)
                assert rows_of(now.terms, "term", "df") == terms, (name, k)
                assert rows_of(now.postings, "term", "doc_id", "tf") == postings
        monkeypatch.setattr(DataFrameWriter, "parquet", written)
        assert k >= 6
    # In the end: the second build, appended to and merged.
    full = write_index(corpus(spark, more + more), f"{scratch}/full", min_df=3, num_buckets=1)
    same_index(read_index(spark, path), full)
    assert drop_versions(spark, path) and not drop_versions(spark, path)
    same_index(read_index(spark, path), full)
    with pytest.raises(ValueError):
        read_index(spark, f"{scratch}/nothing")


def test_corpus_stats(spark):
    s = build_index(corpus(spark), min_df=0).corpus_stats.first()
    assert s["n_docs"] == 5 and s["n_rows"] == 5
    assert abs(s["avg_dl"] - (4 + 4 + 5 + 3 + 0) / 5) < 1e-12


def test_reference_style_corpus(spark):
    from wordmill.operators.linkgraph import link_edges, link_vertices
    from wordmill.operators.pagerank import pagerank
    from wordmill.sources.corpus import corpus_from_pages

    pages = spark.createDataFrame(
        [(1, "Alpha", "apple banana", [(2, "b")]), (2, "Beta", None, [(1, "a"), (3, "c")]), (3, None, "cherry", [])],
        "id long, title string, text string, anchor_text array<struct<id:long,text:string>>")
    c = corpus_from_pages(pages)
    assert sorted(tuple(r) for r in c.collect()) == [(1, "Alpha", "apple banana"), (2, "Beta", ""), (3, "", "cherry")]
    idx = build_index(c, min_df=0)
    assert sorted(r["term"] for r in idx.terms.collect()) == ["apple", "banana", "cherry"]
    ranks = pagerank(link_edges(pages), link_vertices(pages))
    assert ranks.count() == 3


def test_write_without_keeping_the_token_frame(spark, scratch):
    c = corpus(spark)
    a = write_index(c, f"{scratch}/kept", min_df=0, num_buckets=8)
    b = write_index(c, f"{scratch}/unkept", min_df=0, num_buckets=8, keep=None)
    key = lambda df: sorted(tuple(r) for r in df.select("term", "doc_id", "tf").collect())
    assert key(a.postings) == key(b.postings)
    assert a.corpus_stats.first()["n_docs"] == b.corpus_stats.first()["n_docs"]


def test_postings_are_written_in_bounded_chunks(spark, scratch, monkeypatch):
    """A hot term's bucket lies in several tasks' files, its blocks are cut by count, and the rows are all there."""
    from pyspark.sql import functions as F

    from wordmill.operators import indexing

    docs = [(1_000 - 3 * k if k else None, f"t{k}", "hot " + " ".join(f"word{j}" for j in range(40) if k % (j + 2) == 0))
            for k in range(300)]
    want = rows_of(write_index(corpus(spark, docs), f"{scratch}/a", min_df=20, num_buckets=4).postings,
                   "term", F.coalesce("doc_id", F.lit(-1)), "tf", "bucket")
    monkeypatch.setattr(indexing, "POSTINGS_PER_TASK", 64)
    index = write_index(corpus(spark, docs), f"{scratch}/b", min_df=20, num_buckets=4, block_size=32)
    held = index.postings.select("*", F.input_file_name().alias("file")).collect()
    assert sorted((r.term, -1 if r.doc_id is None else r.doc_id, r.tf, r.bucket) for r in held) == want
    assert len({r.file for r in held if r.term == "hot"}) >= 4
    assert max(sum(r.file == f for r in held) for f in {r.file for r in held}) < 300
    hot = sorted((r.block, -1 if r.doc_id is None else r.doc_id) for r in held if r.term == "hot")
    assert [d for _, d in hot] == sorted(d for _, d in hot) and [b for b, _ in hot] == [k // 32 for k in range(300)]
    blocks = {(r.term, r.block): r.n for r in index.blocks.collect()}
    assert blocks["hot", 0] == 32 and blocks["hot", 9] == 12


def test_a_build_holds_nothing_of_the_corpus_in_memory(spark, scratch, monkeypatch):
    """No write of a build finds a persisted frame of its own; what is stored meanwhile is gone in the end, also of a failed build."""
    import os

    import pytest
    from pyspark.sql import DataFrameWriter

    from wordmill.session import checkpoint_dir

    kept = checkpoint_dir(spark).removeprefix("file:")
    meanwhile = lambda: {f for f in os.listdir(kept) if f.startswith(("wordmill-counts-", "wordmill-documents-"))}
    held, there, written = [], set(), DataFrameWriter.parquet
    persisted = lambda: len(spark.sparkContext._jsc.getPersistentRDDs())
    before, stored_before = persisted(), meanwhile()

    def watching(self, target, *a, **kw):
        out = written(self, target, *a, **kw)
        held.append(persisted())
        there.update(meanwhile() - stored_before)
        return out

    ranks = spark.createDataFrame([(1, 2.0), (3, 0.5), (99, 7.0)], "id long, pagerank double")
    docs = [*DOCS, (1, "again", "apple fig"), (None, "none", "cherry kiwi")]
    monkeypatch.setattr(DataFrameWriter, "parquet", watching)
    index = write_index(corpus(spark, docs), f"{scratch}/i", min_df=1, num_buckets=4, pagerank=ranks)
    assert max(held) <= before and len(there) == 2 and meanwhile() == stored_before
    got = sorted((r.term, -1 if r.doc_id is None else r.doc_id, r.tf, r.pr) for r in index.postings.collect())
    of = {1: 2.0, 3: 0.5}
    texts = [(d, t) for d, _, t in docs if t]
    want = sorted((w, -1 if d is None else d, t.replace(",", "").replace(";", "").lower().split().count(w), of.get(d, 0.0))
                  for d, t in texts for w in set(t.replace(",", "").replace(";", "").lower().split()) - {"the", "kiwi"})
    assert got == want

    def failing(self, target, *a, **kw):
        if target.startswith(f"{scratch}/i"):
            raise OSError("no more writes")
        return written(self, target, *a, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    with pytest.raises(OSError):
        write_index(corpus(spark, docs), f"{scratch}/i", min_df=1, num_buckets=4)
    assert meanwhile() == stored_before
