"""Incremental indexing with Structured Streaming (documents arrive over time).

The index is a set of *segments*, and a commit names the live ones.  Each
micro-batch ``e`` of new documents is indexed on its own:

* ``postings/segment=s/bucket=b``, ``docs/segment=s`` (``doc_id, title, doc_len``)
  and ``terms/segment=s`` hold one segment.  Every attempt of a batch writes a
  segment of a new name, so no file that a reader may hold is ever replaced;
* segments have a level.  A batch is of level 0; when the last ``merge_every`` live
  segments are of one level, they are merged into one of the next (again and again,
  so a posting is rewritten once a level).  After ``n`` batches fewer than
  ``merge_every`` segments of each of about ``log(n)`` levels are live;
* ``commits/batch=e``, written last: one row with the rows and length of the whole
  index, its bucket count, and the live segments in order.

Readers open what the newest commit names, so a batch or a merge that failed halfway is
invisible.  After a commit, commits but the newest ``KEEP_COMMITS`` are deleted, with
the segments that none of those names: what a reader opened stays readable for
``KEEP_COMMITS - 1`` more batches.  The index has no df cut (``min_df=0``), which
is what makes appends exact.  One writer at a time.

Defined results: a batch that is retried, also after its commit, counts once; an empty
batch adds an empty segment; ids that come again in a later batch are further rows of
their document, as in a batch build.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from wordmill.operators.indexing import NUM_BUCKETS, Index, term_counts, term_stats, with_bucket
from wordmill.sources.corpus import corpus_from_documents, doc_len

MERGE_EVERY = 10
KEEP_COMMITS = 3
TABLES = ("postings", "docs", "terms")
POSTINGS = "term string, doc_id long, tf long, segment string, bucket int"
DOCS = "doc_id long, title string, doc_len long, segment string"
TERMS = "term string, df long, term_total long, bucket int, segment string"
COMMIT = "n_rows long, total_len long, num_buckets int, live array<string>, batch int"


def _last_commit(spark: SparkSession, root: str, before: int | None = None) -> Row | None:
    """The newest commit (before batch ``before``), or None."""
    try:
        found = spark.read.schema(COMMIT).parquet(f"{root}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    found = found if before is None else found.where(F.col("batch") < before)
    return found.orderBy(F.col("batch").desc()).first()


def _replace(df: DataFrame, *partition_cols: str):
    """A writer that replaces only the partitions ``df`` contains (retry-safe)."""
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols)


def _read(spark: SparkSession, root: str, table: str, schema: str, live: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/{table}").where(F.col("segment").isin(live))


def _sum_terms(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term", "bucket").agg(F.sum("df").alias("df"), F.sum("term_total").alias("term_total")) \
        .select("term", "df", "term_total", "bucket")


def _write_segment(root: str, level: int, batch_id: int, postings: DataFrame, docs: DataFrame, terms: DataFrame) -> str:
    """Writes the three tables of a segment and returns its name, which begins with its level."""
    name = f"{level}-{batch_id}-{uuid.uuid4().hex[:12]}"
    segment = F.lit(name)
    _replace(postings.withColumn("segment", segment).hint("rebalance", "bucket")
             .sortWithinPartitions("bucket", "term", "doc_id"), "segment", "bucket").parquet(f"{root}/postings")
    _replace(docs.withColumn("segment", segment), "segment").parquet(f"{root}/docs")
    _replace(terms.withColumn("segment", segment).repartitionByRange("bucket", "term")
             .sortWithinPartitions("bucket", "term"), "segment").parquet(f"{root}/terms")
    return name


def level_of(segment: str) -> int:
    return int(segment.split("-", 1)[0])


def compact(spark: SparkSession, root: str, live: list[str], batch_id: int, merge_every: int = MERGE_EVERY) -> list[str]:
    """The live segments after merging: no ``merge_every`` last ones of one level are left.

    Only writes new segments; it takes effect with the commit that names them.
    """
    live = list(live)
    while len(live) >= merge_every and len({level_of(s) for s in live[-merge_every:]}) == 1:
        tail = live[-merge_every:]
        postings = _read(spark, root, "postings", POSTINGS, tail).select("term", "doc_id", "tf", "bucket")
        docs = _read(spark, root, "docs", DOCS, tail).drop("segment")
        # Sizes the files by the bytes they hold, not by the segments they come from.
        docs = docs.hint("rebalance")
        terms = _sum_terms(_read(spark, root, "terms", TERMS, tail))
        live[-merge_every:] = [_write_segment(root, level_of(tail[0]) + 1, batch_id, postings, docs, terms)]
    return live


def clean(spark: SparkSession, root: str, keep_commits: int = KEEP_COMMITS) -> list[str]:
    """Deletes commits but the newest ``keep_commits`` and the segments these do not name; returns those segments."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path
    files = folder(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(table: str, key: str) -> list[str]:
        path = folder(f"{root}/{table}")
        found = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        return [n.split("=", 1)[1] for n in found if n.startswith(f"{key}=")]

    # Commits go first: a failure in between leaves segments without a commit, never the reverse.
    old = sorted((int(b) for b in names("commits", "batch")), reverse=True)[keep_commits:]
    for b in old:
        files.delete(folder(f"{root}/commits/batch={b}"), True)
    kept = spark.read.schema(COMMIT).parquet(f"{root}/commits").select("live").collect()  # at most keep_commits rows
    used = {s for row in kept for s in row["live"]}
    gone = {s for table in TABLES for s in names(table, "segment") if s not in used}
    for table in TABLES:
        for s in gone:
            files.delete(folder(f"{root}/{table}/segment={s}"), True)
    return sorted(gone)


def append_batch(docs: DataFrame, root: str, batch_id: int, num_buckets: int = NUM_BUCKETS,
                 merge_every: int = MERGE_EVERY, keep_commits: int = KEEP_COMMITS) -> None:
    """Index one batch of ``doc_id, title, text`` (or ``tokens``) into the streaming index at ``root``.

    ``keep_commits`` is at least 2: a batch may be retried after its commit, and then
    builds on the one before.
    """
    if merge_every < 2 or keep_commits < 2:
        raise ValueError("merge_every and keep_commits must be 2 or more")
    spark = docs.sparkSession
    last = _last_commit(spark, root, batch_id)
    docs = docs.persist(StorageLevel.MEMORY_AND_DISK)
    counts = with_bucket(term_counts(docs), num_buckets).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        lengths = docs.select("doc_id", "title", doc_len(docs).alias("doc_len"))
        terms = with_bucket(term_stats(counts), num_buckets).select("term", "df", "term_total", "bucket")
        own = _write_segment(root, 0, batch_id, counts, lengths, terms)
        live = compact(spark, root, [*(last["live"] if last else []), own], batch_id, merge_every)
        sums = lengths.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len"))
        commit = sums.select(
            (F.col("n_rows") + F.lit(last["n_rows"] if last else 0)).alias("n_rows"),
            (F.col("total_len") + F.lit(last["total_len"] if last else 0)).alias("total_len"),
            F.lit(num_buckets).alias("num_buckets"), F.array(*[F.lit(s) for s in live]).alias("live"),
            F.lit(batch_id).alias("batch"))
        _replace(commit.coalesce(1), "batch").parquet(f"{root}/commits")
    finally:
        counts.unpersist()
        docs.unpersist()
    clean(spark, root, keep_commits)


def index_stream(stream: DataFrame, root: str, checkpoint_location: str, num_buckets: int = NUM_BUCKETS,
                 to_corpus=corpus_from_documents, merge_every: int = MERGE_EVERY) -> DataStreamWriter:
    """A stream writer that appends every micro-batch of ``stream`` to the index at ``root``.

    ``to_corpus`` maps the stream's rows to ``doc_id, title, text`` (or
    ``tokens``).  The caller picks the trigger and starts it.
    """
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        append_batch(to_corpus(batch), root, int(batch_id), num_buckets, merge_every)

    return (stream.writeStream.foreachBatch(per_batch)
            .option("checkpointLocation", checkpoint_location))


def read_stream_index(spark: SparkSession, root: str) -> Index:
    """The committed state of a streaming index as an ``Index``, with the bucket count it was written with."""
    last = _last_commit(spark, root)
    if last is None:
        raise ValueError(f"no committed batch under {root}")
    live = last["live"]
    postings = _read(spark, root, "postings", POSTINGS, live).drop("segment")
    docs = _read(spark, root, "docs", DOCS, live)
    n, total = last["n_rows"], last["total_len"]
    # Rows and lengths come from the commit; ids may repeat across batches, so distinct ones are counted when asked for.
    stats = docs.agg(F.countDistinct("doc_id").alias("n_docs")).select(
        "n_docs", F.lit(total / n if n else None).cast("double").alias("avg_dl"),
        F.lit(n).alias("n_rows"), F.lit(total).alias("total_len"))
    return Index(postings, _sum_terms(_read(spark, root, "terms", TERMS, live)), docs.groupBy("doc_id").agg(
        F.min("title").alias("title")), stats, int(last["num_buckets"]), min_df=0,
        doc_lengths=docs.select("doc_id", "doc_len"))
