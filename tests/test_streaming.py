import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wordmill.operators.indexing import build_index
from wordmill.operators.retrieval import search
from wordmill.sources.corpus import corpus_from_documents
from wordmill.streaming.incremental import append_batch, index_stream, level_of, read_stream_index

SF = "/root/testdata/sf0.001"


def test_stream_append_equals_batch_build(spark, scratch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    src = f"{scratch}/incoming"
    # Three arrivals of documents, one file each.
    for i, (lo, hi) in enumerate([(0, 70), (70, 140), (140, 10**9)]):
        docs.where((F.col("doc_id") >= lo) & (F.col("doc_id") < hi)).coalesce(1) \
            .write.mode("append").parquet(src)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = index_stream(stream, f"{scratch}/idx", f"{scratch}/ckpt", num_buckets=16, merge_every=2) \
        .trigger(availableNow=True).start()
    q.awaitTermination(300)
    idx = read_stream_index(spark, f"{scratch}/idx")
    full = build_index(corpus_from_documents(docs), min_df=0, num_buckets=16)
    key = lambda df: sorted(tuple(r) for r in df.select("term", "df", "term_total").collect())
    assert key(idx.terms) == key(full.terms)
    held = lambda df: sorted(tuple(r) for r in df.select("term", "doc_id", "tf", "bucket").collect())
    assert held(idx.postings) == held(full.postings)
    named = lambda df: sorted(tuple(r) for r in df.select("doc_id", "title").collect())
    assert named(idx.titles) == named(full.titles)
    assert abs(idx.avg_dl() - full.avg_dl()) < 1e-9
    assert idx.n_docs() == docs.count() and idx.num_buckets == 16
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    a = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in search(queries, idx, with_titles=False).collect())
    b = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in search(queries, full, with_titles=False).collect())
    assert a == b and len(a) > 0


def test_batches_count_once_committed_and_may_be_retried(spark, scratch):
    def batch(*rows):
        return spark.createDataFrame(rows, "doc_id long, title string, text string")

    def terms():
        return {r["term"]: (r["df"], r["term_total"]) for r in read_stream_index(spark, scratch).terms.collect()}

    append_batch(batch(), scratch, 0, 8, merge_every=2)
    assert terms() == {} and read_stream_index(spark, scratch).n_docs() == 0
    append_batch(batch((1, "a", "apple apple")), scratch, 1, 8, merge_every=2)
    # A batch that failed before its commit: its tables are there, but not seen.
    lost = batch((2, "b", "apple pear"))
    append_batch(lost, scratch, 2, 8, merge_every=2)
    shutil.rmtree(f"{scratch}/commits/batch=2")
    assert terms() == {"apple": (1, 2)}
    append_batch(lost, scratch, 2, 8, merge_every=2)
    append_batch(batch((3, "c", None)), scratch, 3, 8, merge_every=2)
    assert terms() == {"apple": (2, 3), "pear": (1, 1)}
    idx = read_stream_index(spark, scratch)
    assert idx.n_docs() == 3 and idx.postings.count() == 3 and idx.avg_dl() == 4 / 3


def _batch(spark, k):
    texts = [f"apple word{k} word{k % 7}", f"pear apple extra{k % 3} extra{k % 3}"]
    return spark.createDataFrame([(2 * k + j, f"t{k}", t) for j, t in enumerate(texts)], "doc_id long, title string, text string")


def _rows(index):
    held = [index.postings.select("term", "doc_id", "tf", "bucket"), index.terms.select("term", "df", "term_total", "bucket"),
            index.titles.select("doc_id", "title"), index.doc_lengths.select("doc_id", "doc_len")]
    return [sorted(map(tuple, df.collect())) for df in held] + [index.n_docs(), index.avg_dl()]


def _segments(root):
    return {p.name.split("=")[1] for t in ("postings", "docs", "terms") for p in Path(root, t).glob("segment=*")}


def test_many_batches_leave_few_files_and_the_same_rows(spark, scratch):
    n, opened, files = 30, None, []
    for k in range(n):
        append_batch(_batch(spark, k), scratch, k, 2, merge_every=3)
        files.append(sum(1 for p in Path(scratch).rglob("*.parquet")))
        if k in (7, 25):  # the next append merges: two levels at 8, three at 26
            opened = read_stream_index(spark, scratch)
            before = _rows(opened)
        elif k in (8, 26):
            assert _rows(opened) == before  # opened before the merge, read after it
    union = _batch(spark, 0)
    for k in range(1, n):
        union = union.unionByName(_batch(spark, k))
    full = build_index(union, min_df=0, num_buckets=2)
    last = read_stream_index(spark, scratch)
    assert [r for r in _rows(last)[:3]] == [sorted(map(tuple, df.collect())) for df in (
        full.postings.select("term", "doc_id", "tf", "bucket"), full.terms.select("term", "df", "term_total", "bucket"),
        full.titles.select("doc_id", "title"))]
    live = spark.read.parquet(f"{scratch}/commits").orderBy(F.desc("batch")).first()["live"]
    assert [level_of(s) for s in live] == [3, 1]  # 30 = 27 + 3
    # Fewer than three segments of each level are live, plus those of the commits kept.
    assert len(_segments(scratch)) <= 12 and max(files[15:]) <= 2 * max(files[:15])
    assert len(list(Path(scratch, "commits").glob("batch=*"))) == 3


@pytest.mark.parametrize("step", ["_write_segment", "compact", "clean"])
def test_a_failed_step_changes_nothing_that_readers_see(spark, scratch, monkeypatch, step):
    from wordmill.streaming import incremental

    for k in range(2):
        append_batch(_batch(spark, k), scratch, k, 2, merge_every=3)
    before, real = _rows(read_stream_index(spark, scratch)), getattr(incremental, step)

    def fails(*args, **kwargs):
        if step != "clean":
            real(*args, **kwargs)  # all written, and nothing committed
        raise RuntimeError("lost")

    monkeypatch.setattr(incremental, step, fails)
    with pytest.raises(RuntimeError, match="lost"):
        append_batch(_batch(spark, 2), scratch, 2, 2, merge_every=3)
    monkeypatch.undo()
    committed = step == "clean"
    assert (_rows(read_stream_index(spark, scratch)) == before) is not committed
    append_batch(_batch(spark, 2), scratch, 2, 2, merge_every=3)  # the retry, with or without a commit of its own
    once = _rows(read_stream_index(spark, scratch))
    assert once[4] == 6 and once[1] == sorted(map(tuple, build_index(
        _batch(spark, 0).unionByName(_batch(spark, 1)).unionByName(_batch(spark, 2)), min_df=0, num_buckets=2)
        .terms.select("term", "df", "term_total", "bucket").collect()))
    # What the failed attempt wrote is gone.
    kept = {s for r in spark.read.parquet(f"{scratch}/commits").select("live").collect() for s in r["live"]}
    assert _segments(scratch) <= kept


@pytest.mark.parametrize("files", [1, 3])
def test_the_stream_query_reads_a_file_and_a_folder(spark, scratch, files):
    """Written tables are folders; the test data's are single files."""
    from wordmill.plans.registry import q_stream_index

    rows = [(k, f"Title {k}\napple word{k} apple", "en", "web", 20) for k in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(files).write.parquet(f"{scratch}/written")
    if files == 1:
        part = next(Path(scratch, "written").glob("part-*.parquet"))
        shutil.copy(part, f"{scratch}/documents.parquet")
    else:
        shutil.copytree(f"{scratch}/written", f"{scratch}/documents.parquet")
    got = {(r["term"], r["doc_id"], r["tf"], r["df"]) for r in q_stream_index(spark, scratch).collect()}
    assert got == {x for k in range(7) for x in (("title", k, 1, 7), ("apple", k, 2, 7), (f"word{k}", k, 1, 1))}
