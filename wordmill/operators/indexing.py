"""Inverted index: term counts, document frequency, postings, index tables.

Tables (all flat; postings are never materialised as per-term arrays except in
``posting_lists``):

* ``postings``  ``term, doc_id, tf, block`` (+ ``tier, bucket`` on disk)
* ``vocabulary`` ``term, df, term_total, bucket`` (+ ``tier``; sorted by bucket, term)
* ``blocks``    ``bucket, term, block`` with the count and the largest tf and rank of the block
* ``titles``    ``doc_id, title``
* ``doc_lengths`` ``doc_id, doc_len``
* ``corpus_stats`` one row ``n_docs, avg_dl, n_rows, total_len``

Terms above the df cut are the tier ``main``, which searches read.  Those under it
wait in the tier ``rare``; an append that lifts a term over the cut copies what
waited into its own main tier, so a cut index grows exactly like one built anew.

A corpus is ``doc_id, title, text``, or ``doc_id, title, tokens`` if it is
tokenized already (``sources.corpus.corpus_from_tokens``).  An index that was
appended to consists of parts, one per append, each with these tables; nothing
that an earlier part holds is written again to add documents.

Every build writes a folder of its own below the index path and, when all its
tables are there, one row in ``commits`` that names it (with the earlier parts).
Readers open what the newest row names, so a build that fails leaves the index
as it was.
"""

from __future__ import annotations

import uuid
from contextlib import ExitStack
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from wordmill.functions.text import run_lengths, run_starts, term_bucket, tokenize
from wordmill.operators.joins import DEFAULT_BROADCAST_BYTES, bounded_broadcast, frame_bytes, spread
from wordmill.operators.ordering import rank_within
from wordmill.session import stored, stored_meanwhile
from wordmill.sources.corpus import corpus_stats, doc_len, doc_lengths, titles

NUM_BUCKETS = 124
MIN_DF = 50
MAX_PARTS = 16  # parts of an index before an append merges them


def doc_tokens(corpus: DataFrame, stop_words: bool = True) -> DataFrame:
    """``doc_id, tokens``: kept tokens of every document, in text order."""
    return spread(corpus).select("doc_id", tokenize("text", stop_words).alias("tokens"))


def sorted_doc_tokens(corpus: DataFrame) -> DataFrame:
    """``doc_id, s``: each document's kept tokens, sorted (equal tokens adjacent)."""
    return spread(corpus).select("doc_id", _sorted_tokens(corpus).alias("s"))


def _sorted_tokens(corpus: DataFrame) -> Column:
    return F.sort_array(F.col("tokens") if "tokens" in corpus.columns else tokenize("text"))


def counts_from_sorted(sorted_toks: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``term, doc_id, tf`` (+ ``carry`` columns) from ``doc_id, s`` (see ``run_starts``/``run_lengths``)."""
    with_runs = sorted_toks.select("doc_id", *carry, "s", run_starts("s").alias("starts"))
    return with_runs.select("doc_id", *carry, F.inline(run_lengths("s", "starts"))) \
        .select("term", "doc_id", "tf", *carry)


def term_counts(corpus: DataFrame) -> DataFrame:
    """``term, doc_id, tf`` for every distinct kept term of every document row.

    Counted inside each row (sort + run lengths), so this is a narrow,
    shuffle-free transformation of the scan however large the corpus is.
    """
    return counts_from_sorted(sorted_doc_tokens(corpus))


def doc_freq(postings: DataFrame) -> DataFrame:
    """``term, df``: posting-list length per term (partial aggregation before the shuffle)."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_stats(postings: DataFrame, min_df: int = 0) -> DataFrame:
    """``term, df, term_total`` for terms with ``df > min_df``."""
    stats = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("term_total"))
    return stats.where(F.col("df") > min_df) if min_df > 0 else stats


def min_df_filter(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the terms kept in ``terms`` (left semi join on term).

    The vocabulary is stored first, so that its real size decides the join and
    a term in a third of the corpus is split by the skew join.
    """
    return postings.join(bounded_broadcast(stored(terms.select("term"), "terms")), "term", "left_semi")


POSTING_BLOCK = 65536


def posting_blocks(postings: DataFrame, frequent: DataFrame, block_size: int = POSTING_BLOCK) -> DataFrame:
    """``postings`` with ``block``: a posting's rank in its term's list over ``block_size``.

    ``frequent`` (``term``) names the terms with more than ``block_size`` postings.
    Only those are ranked; every other term is one block, without a shuffle.
    """
    frequent = stored(frequent.select("term"), "frequent")
    if frequent.isEmpty():
        return postings.withColumn("block", F.lit(0).cast("long"))
    rare = postings.join(frequent, "term", "left_anti").withColumn("block", F.lit(0).cast("long"))
    ranked = rank_within(postings.join(frequent, "term", "left_semi"), ["term"], ["doc_id"], "block")
    return rare.unionByName(ranked.withColumn("block", F.expr(f"block div {int(block_size)}")))


def posting_lists(postings: DataFrame, block_size: int = POSTING_BLOCK) -> DataFrame:
    """``term, block, postings array<struct<doc_id, tf>>`` sorted by doc_id (a view for export).

    A term's list is cut by count: every block but its last holds exactly
    ``block_size`` postings, however its ids are spaced, so no array (and no task)
    holds more, even for a term found in a third of the corpus.  Blocks of a term,
    concatenated in block order, are its full sorted list.
    """
    postings = stored(postings, "postings")  # read four times below, made once
    frequent = doc_freq(postings).where(F.col("df") > block_size)
    return posting_blocks(postings, frequent, block_size).groupBy("term", "block").agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("postings")
    )


def with_bucket(df: DataFrame, num_buckets: int = NUM_BUCKETS) -> DataFrame:
    return df.withColumn("bucket", term_bucket("term", num_buckets))


@dataclass
class Index:
    """The index tables as DataFrames (lazy until written or read back)."""

    postings: DataFrame
    terms: DataFrame
    titles: DataFrame
    corpus_stats: DataFrame
    num_buckets: int = NUM_BUCKETS
    min_df: int = MIN_DF
    # Unfiltered term counts when the index is declared over a raw corpus
    # (not written); search then filters through ``terms`` instead.
    all_postings: DataFrame | None = None
    # Document ids of a raw corpus, so N is a distinct count of ids alone
    # rather than the full statistics row (which measures every text).
    doc_ids: DataFrame | None = None
    # ``doc_id, doc_len`` (whitespace words), for length-normalised BM25.
    doc_lengths: DataFrame | None = None
    # Of a stored index: its posting blocks, and the tier under the df cut.
    blocks: DataFrame | None = None
    rare_terms: DataFrame | None = None
    rare_postings: DataFrame | None = None

    def n_docs(self) -> int:
        if self.doc_ids is not None:
            return int(self.doc_ids.agg(F.countDistinct("doc_id")).first()[0])
        return int(self.corpus_stats.first()["n_docs"])

    def avg_dl(self) -> float:
        v = self.corpus_stats.first()["avg_dl"]
        return float(v) if v is not None else 0.0


def build_index(corpus: DataFrame, min_df: int = MIN_DF, num_buckets: int = NUM_BUCKETS) -> Index:
    """Declare the index over ``corpus`` (``doc_id, title, text``) without running it.

    Plan: scan → tokenize + count in-row → ``terms`` by partial aggregation →
    postings semi-joined with the kept terms.  Nothing is collected.
    """
    counts = term_counts(corpus)
    terms = with_bucket(term_stats(counts, min_df), num_buckets)
    postings = counts.join(terms.select("term", "bucket"), "term") if min_df > 0 else with_bucket(counts, num_buckets)
    return Index(postings, terms, titles(corpus), corpus_stats(corpus), num_buckets, min_df,
                 all_postings=counts, doc_ids=corpus.select("doc_id"), doc_lengths=doc_lengths(corpus))


COMMIT = ("version long, part string, earlier array<string>, min_df long, num_buckets long, block_size long, "
          "rare boolean, ranks boolean")
TERM_COLUMNS = ["term", "df", "term_total", "bucket"]


def write_index(corpus: DataFrame, path: str, min_df: int = MIN_DF, num_buckets: int = NUM_BUCKETS,
                pagerank: DataFrame | None = None, keep: bool | None = True,
                block_size: int = POSTING_BLOCK, keep_rare: bool = True) -> Index:
    """Build and write the index under ``path`` and return it read back.

    The corpus text is tokenized once: the term counts are stored, flat, and feed the
    vocabulary and the postings; a second scan stores id, title and length, which feed
    the titles and the statistics.  The vocabulary is written first; the postings
    join then reads it back, so the optimizer sees its real on-disk size and
    only broadcasts it when that is small.  Postings are rebalanced on
    ``bucket`` (AQE splits a hot bucket, coalesces small ones) and sorted by
    ``term, doc_id`` so each file covers a narrow term range and parquet
    min/max statistics prune row groups on lookup.

    An index that is already at ``path`` is replaced when the new one is whole;
    its folder stays until ``drop_versions``.

    With ``keep`` these two are Parquet in the shared checkpoint folder until the build
    ends, so nothing of the corpus waits in the executors' memory.  Without, the text is
    tokenized once per output instead, for a corpus larger than that folder.

    With ``pagerank`` (``id, pagerank``), each posting also stores its
    document's rank as ``pr`` (0.0 when unranked): search then reads the boost
    from the postings it already scans instead of joining the rank table.  The ranks
    of the documents are broadcast where they are small, else the tokens are shuffled once.

    ``block_size`` postings of a term make a block (``posting_blocks``).  Without
    ``keep_rare`` terms under the cut are dropped; such an index cannot be appended to.
    """
    spark = corpus.sparkSession
    last = _last_commit(spark, path)
    new = Row(version=last["version"] + 1 if last else 0, part=f"part-{uuid.uuid4().hex}", earlier=[], min_df=min_df,
              num_buckets=num_buckets, block_size=block_size, rare=keep_rare and min_df > 0, ranks=pagerank is not None)
    _write_part(corpus, f"{path}/{new.part}", new, pagerank, keep)
    return _commit(spark, path, new)


def _last_commit(spark: SparkSession, path: str) -> Row | None:
    """The newest row of ``commits``, or None where there is no index."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{path}/commits").orderBy(F.desc("version"), F.desc("part")).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _commit(spark: SparkSession, path: str, new: Row) -> Index:
    """Adds the row that makes a written part the index: one new file, which readers see whole or not at all."""
    spark.createDataFrame([new], COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return read_index(spark, path)


def _write_part(corpus: DataFrame, part: str, new: Row, pagerank: DataFrame | None, keep: bool | None,
                old: Index | None = None) -> None:
    """The tables of one part; ``old`` is the index it adds to."""
    dealt = spread(corpus)
    docs = dealt.select("doc_id", "title", doc_len(corpus).alias("doc_len"))
    tokens = dealt.select("doc_id", _sorted_tokens(corpus).alias("s"))
    carry = ("pr",) if new.ranks else ()
    if pagerank is not None:
        ranks = pagerank.select(F.col("id").alias("doc_id"), F.col("pagerank").alias("pr"))
        ranks = stored(ranks.join(corpus.select("doc_id"), "doc_id", "left_semi"), "own-ranks")
        tokens = tokens.join(bounded_broadcast(ranks), "doc_id", "left").withColumn("pr", F.coalesce("pr", F.lit(0.0)))
    elif new.ranks:
        tokens = tokens.withColumn("pr", F.lit(0.0))
    counts = counts_from_sorted(tokens, carry)
    with ExitStack() as kept:
        if keep:
            counts = kept.enter_context(stored_meanwhile(counts, "counts"))
            docs = kept.enter_context(stored_meanwhile(docs, "documents"))
        stats = with_bucket(term_stats(counts), new.num_buckets)
        waiting = None
        if old is None or new.min_df == 0:
            tiered = stats.withColumn("tier", _tier(F.col("df"), new.min_df))
        else:
            tiered, waiting = _promote(stats, old, new)
        _write_vocabulary(tiered if new.rare else tiered.where("tier = 'main'"), part)
        rows = _tiered(counts, _vocabulary(docs.sparkSession, part), new)
        if waiting is not None:
            rows = rows.unionByName(waiting.select("term", "doc_id", "tf", *carry, "bucket", F.lit("main").alias("tier")))
        _write_postings(rows, part, new.block_size, docs.select("doc_id"))
        titles(docs).write.parquet(f"{part}/titles")
        docs.select("doc_id", "doc_len").write.parquet(f"{part}/doc_lengths")
        stats = docs.agg(F.countDistinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_rows"),
                         F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len"))
        stats = stats.select("n_docs", (F.col("total_len") / F.col("n_rows")).alias("avg_dl"), "n_rows", "total_len")
        _write_stats(stats if old is None else _added_stats(stats, part, old), part)


def _tier(df: Column, min_df: int) -> Column:
    return F.when(df > min_df, F.lit("main")).otherwise(F.lit("rare"))


def _tiered(counts: DataFrame, vocabulary: DataFrame, new: Row) -> DataFrame:
    """Term counts with ``bucket`` and ``tier``; without ``rare``, those of the main tier alone."""
    if new.min_df == 0:
        return with_bucket(counts, new.num_buckets).withColumn("tier", F.lit("main"))
    main = vocabulary.where("tier = 'main'").select("term", F.col("bucket").alias("main"))
    if frame_bytes(main) > DEFAULT_BROADCAST_BYTES:
        return counts.join(vocabulary.select("term", "bucket", "tier"), "term")
    # The terms above the cut are few; what meets none of them is rare, and no posting is shuffled to know it.
    found = counts.join(F.broadcast(main), "term", "left" if new.rare else "inner")
    return found.withColumn("bucket", F.coalesce("main", term_bucket("term", new.num_buckets))) \
        .withColumn("tier", F.when(F.col("main").isNotNull(), "main").otherwise("rare")).drop("main")


def _promote(stats: DataFrame, old: Index, new: Row) -> tuple[DataFrame, DataFrame]:
    """A batch's vocabulary by tier, and the waiting postings of the terms that it lifts over the cut.

    Only the batch's own terms can cross, so the old vocabulary is read for those.
    A lifted term's row also counts its waiting postings, which move with it.
    """
    own = stored(stats, "batch-terms")
    names = own.select("bucket", "term")
    known = old.terms.join(names, ["bucket", "term"], "left_semi").select("bucket", "term", F.lit(True).alias("known"))
    rare = old.rare_terms.join(names, ["bucket", "term"], "left_semi") \
        .select("bucket", "term", F.col("df").alias("waiting"), F.col("term_total").alias("waiting_total"))
    both = own.join(known, ["bucket", "term"], "left").join(rare, ["bucket", "term"], "left")
    total = F.col("df") + F.coalesce("waiting", F.lit(0))
    lifted = F.col("known").isNull() & (total > new.min_df)
    both = stored(both.withColumn("lifted", lifted & F.col("waiting").isNotNull()).select(
        "term", F.when(lifted, total).otherwise(F.col("df")).alias("df"),
        F.when(lifted, F.col("term_total") + F.coalesce("waiting_total", F.lit(0))).otherwise(F.col("term_total"))
        .alias("term_total"),
        "bucket", F.when(F.col("known") | (total > new.min_df), F.lit("main")).otherwise(F.lit("rare")).alias("tier"),
        "lifted"), "tiered")
    up = both.where("lifted").select("bucket", "term")
    buckets = [r["bucket"] for r in up.select("bucket").distinct().collect()]  # at most num_buckets
    waiting = old.rare_postings.where(F.col("bucket").isin(buckets)).join(up, ["bucket", "term"], "left_semi")
    return both.drop("lifted"), waiting


def _write_vocabulary(terms: DataFrame, part: str) -> None:
    # The vocabulary is small next to the postings: one sorted run of files
    # (bucket, term), whose row-group statistics serve bucket/term filters,
    # instead of a folder per bucket.
    (terms.select(*TERM_COLUMNS, "tier").repartitionByRange("tier", "bucket", "term")
     .sortWithinPartitions("tier", "bucket", "term").write.partitionBy("tier").parquet(f"{part}/vocabulary"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table whose folder may be missing because it has no rows."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


VOCABULARY = "term string, df long, term_total long, bucket int"


def _vocabulary(spark: SparkSession, part: str) -> DataFrame:
    return _read(spark, f"{part}/vocabulary", f"{VOCABULARY}, tier string")


POSTINGS_PER_TASK = 1 << 19


def _write_postings(rows: DataFrame, part: str, block_size: int, ids: DataFrame) -> None:
    """The postings (with ``bucket`` and ``tier``) of a part in blocks, and the table of its blocks.

    One shuffle: a tier's bucket is cut into chunks of about ``POSTINGS_PER_TASK`` by ranges of
    the documents' ``ids``, so a task sorts a bounded number however large the corpus is.
    Files are sorted by term and id, chunk after chunk.
    """
    spark = rows.sparkSession
    terms = _vocabulary(spark, part)
    sizes = {r["bucket"]: r["n"] for r in terms.groupBy("bucket").agg(F.sum("df").alias("n")).collect()}  # one a bucket
    n, chunks = sum(sizes.values()), [max(1, -(-sizes.get(b, 0) // POSTINGS_PER_TASK)) for b in range(1 + max(sizes, default=0))]
    tasks = max(1, -(-n // POSTINGS_PER_TASK), min(int(spark.conf.get("spark.sql.shuffle.partitions")),
                                                   -(-n // (POSTINGS_PER_TASK >> 5))))
    chunk = F.lit(0).cast("long")
    if max(chunks) > 1:
        own = F.array(*[F.lit(k) for k in chunks])[F.col("bucket")]
        chunk = F.floor(_slice(F.col("doc_id"), _cuts(ids, max(chunks))) * own / max(chunks)).cast("long")
    rows = rows.withColumn("chunk", chunk)
    frequent = stored(terms.where((F.col("tier") == "main") & (F.col("df") > block_size)).select("term"), "frequent")
    place = ["tier", "bucket", "chunk"]
    if frequent.isEmpty():
        rows = rows.repartition(tasks, *place).withColumn("block", F.lit(0).cast("long"))
    else:
        # A posting's rank in its term's list: the term's postings in earlier chunks, and its place in its own.
        held = rows.join(bounded_broadcast(frequent), "term", "left_semi").groupBy("term", "chunk").agg(
            F.count(F.lit(1)).alias("n"))
        earlier = Window.partitionBy("term").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        before = stored(held.select("term", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "before")
        here = Window.partitionBy(*place, "term").orderBy("doc_id")
        rows = rows.join(bounded_broadcast(before), ["term", "chunk"], "left").repartition(tasks, *place) \
            .withColumn("place", F.row_number().over(here) - 1) \
            .withColumn("block", F.coalesce(F.expr(f"(before + place) div {int(block_size)}"), F.lit(0).cast("long"))) \
            .drop("before", "place")
    (rows.sortWithinPartitions(*place, "term", "doc_id").drop("chunk")
     .write.partitionBy("tier", "bucket").parquet(f"{part}/postings"))
    ranks = "pr" in rows.columns
    schema = _posting_schema(rows.schema["doc_id"].dataType.simpleString(), ranks)
    main = _read(spark, f"{part}/postings/tier=main", schema)
    per_block = main.groupBy("bucket", "term", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
        F.max("tf").alias("max_tf"), (F.max("pr") if ranks else F.lit(0.0)).alias("max_pr"))
    per_block.repartitionByRange("bucket", "term", "block").sortWithinPartitions("bucket", "term", "block") \
        .write.parquet(f"{part}/blocks")


def _cuts(ids: DataFrame, slices: int) -> list:
    """At most ``slices - 1`` ids that cut all ids into about equal ranges (found in a sample; any cuts give the same rows)."""
    if slices < 2:
        return []
    ids = ids.where(F.col("doc_id").isNotNull())
    drawn = ids.sample(min(1.0, 200 * slices / max(1, ids.count())), 7).orderBy("doc_id").collect()
    return [r["doc_id"] for r in drawn[max(1, len(drawn) // slices)::max(1, -(-len(drawn) // slices))]][:slices - 1]


def _slice(doc_id: Column, cuts: list) -> Column:
    """The number of cuts up to an id (0 for null, which sorts first)."""
    def found(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(doc_id < F.lit(cuts[middle]), found(low, middle)).otherwise(found(middle + 1, high))

    return F.when(doc_id.isNull(), 0).otherwise(found(0, len(cuts)))


def _posting_schema(id_type: str, ranks: bool) -> str:
    return f"term string, doc_id {id_type}, tf long, {'pr double, ' if ranks else ''}block long, bucket int"


def _write_stats(stats: DataFrame, part: str) -> None:
    stats.coalesce(1).write.parquet(f"{part}/corpus_stats")  # one row


def _added_stats(own: DataFrame, part: str, old: Index) -> DataFrame:
    """The statistics of the whole index: sums, and the ids of the new documents that the old ones lack."""
    spark = own.sparkSession
    before, own = old.corpus_stats.first(), own.first()
    ids = spark.read.parquet(f"{part}/titles").select("doc_id")
    n_new = ids.join(old.titles.select("doc_id"), "doc_id", "left_anti").count()
    n_rows, total_len = before["n_rows"] + own["n_rows"], before["total_len"] + own["total_len"]
    return spark.createDataFrame([(before["n_docs"] + n_new, total_len / n_rows if n_rows else None, n_rows, total_len)],
                                 "n_docs long, avg_dl double, n_rows long, total_len long")


def read_index(spark: SparkSession, path: str) -> Index:
    """Open the index that the newest commit under ``path`` names, with all its parts.

    Vocabulary rows of several parts are summed as they are read.  Filters and
    semi-joins on the term and its bucket reach the scan of every part.
    """
    commit = _last_commit(spark, path)
    if commit is None:
        raise ValueError(f"no index under {path}")
    parts = [*commit["earlier"], f"{path}/{commit['part']}"]
    id_type = spark.read.parquet(f"{parts[-1]}/titles").schema["doc_id"].dataType.simpleString()
    postings_schema = _posting_schema(id_type, commit["ranks"])

    def table(name: str, schema: str | None = None) -> DataFrame:
        read = [spark.read.parquet(f"{p}/{name}") if schema is None else _read(spark, f"{p}/{name}", schema)
                for p in parts]
        if name.startswith(("postings", "blocks")):  # blocks are numbered by part
            read = [t.withColumn("part", F.lit(k)) for k, t in enumerate(read)]
        return reduce(DataFrame.unionByName, read)

    def vocabulary(tier: str) -> DataFrame:
        terms = table(f"vocabulary/tier={tier}", VOCABULARY)
        return terms if len(parts) == 1 else terms.groupBy("term", "bucket").agg(
            F.sum("df").alias("df"), F.sum("term_total").alias("term_total")).select(*TERM_COLUMNS)

    terms, named = vocabulary("main"), table("titles")
    rare_terms = rare_postings = None
    if commit["min_df"] == 0 or commit["rare"]:
        rare_terms, rare_postings = vocabulary("rare"), table("postings/tier=rare", postings_schema).drop("part")
        if len(parts) > 1:
            # What an append lifted stays in the earlier part's rare tier; it counts there no more.
            rare_terms = rare_terms.join(terms, ["bucket", "term"], "left_anti").select(*TERM_COLUMNS)
            rare_postings = rare_postings.join(terms, ["bucket", "term"], "left_anti")
        named = titles(named) if len(parts) > 1 else named
    return Index(
        postings=table("postings/tier=main", postings_schema),
        terms=terms,
        titles=named,
        corpus_stats=spark.read.parquet(f"{parts[-1]}/corpus_stats"),
        num_buckets=int(commit["num_buckets"]),
        min_df=int(commit["min_df"]),
        doc_lengths=table("doc_lengths"),
        blocks=table("blocks"),
        rare_terms=rare_terms,
        rare_postings=rare_postings,
    )


def drop_versions(spark: SparkSession, path: str) -> list[str]:
    """Deletes the folders below ``path`` that its newest commit does not name, and returns their names.

    Those are earlier versions and failed builds.  Not while a build or a reader of
    an earlier version is at work, nor where another index names them as its parts.
    """
    commit = _last_commit(spark, path)
    used = {p.rstrip("/").rsplit("/", 1)[-1] for p in [*commit["earlier"], commit["part"]]} if commit else set()
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [f.getPath() for f in files.listStatus(root)
            if f.getPath().getName().startswith("part-") and f.getPath().getName() not in used]
    for folder in gone:
        files.delete(folder, True)
    return sorted(f.getName() for f in gone)


def posting_lookup(index: Index, term: str) -> DataFrame:
    """``term, doc_id, tf`` of one term, ordered by doc_id; empty for an unknown term.

    States the bucket so the scan prunes to one partition folder, and the
    pushed ``term = …`` filter skips row groups by their min/max statistics.
    """
    b = index.postings.sparkSession.range(1).select(term_bucket(F.lit(term), index.num_buckets)).first()[0]
    return (index.postings.where((F.col("bucket") == F.lit(b)) & (F.col("term") == F.lit(term)))
            .select("term", "doc_id", "tf").orderBy("doc_id"))


def append_to_index(path: str, new_corpus: DataFrame, out_path: str, pagerank: DataFrame | None = None,
                    max_parts: int = MAX_PARTS) -> Index:
    """The index at ``path`` and new documents, as an index at ``out_path`` (which may be ``path``).

    Only the new documents are read and written: they become a part of their
    own under ``out_path``, which names the earlier parts (so those must stay
    where they are).  Document frequencies, totals and lengths are additive;
    of the earlier parts the ids are read, to count distinct documents, and under
    a df cut the vocabulary and the waiting postings of the terms that the new
    documents lift over it.  The index at ``path`` stays as it is until the last
    row is written.  Beyond ``max_parts`` parts they are merged into one.

    Ranks stored in the postings stay; new documents get theirs from
    ``pagerank`` (0.0 without one).  A cut index needs the terms under its cut
    (``write_index(..., keep_rare=True)``, the default).
    """
    spark = new_corpus.sparkSession
    old, commit = read_index(spark, path), _last_commit(spark, path)
    if commit["min_df"] > 0 and not commit["rare"]:
        raise ValueError("append to a cut index needs its rare terms (keep_rare)")
    there = commit if out_path == path else _last_commit(spark, out_path)
    earlier = [*commit["earlier"], f"{path}/{commit['part']}"]
    new = Row(**commit.asDict() | {"version": there["version"] + 1 if there else 0, "earlier": earlier,
                                   "part": f"part-{uuid.uuid4().hex}"})
    _write_part(new_corpus, f"{out_path}/{new.part}", new, pagerank if new.ranks else None, True, old)
    index = _commit(spark, out_path, new)
    return merge_index(spark, out_path, out_path) if len(earlier) >= max_parts else index


def merge_index(spark: SparkSession, path: str, out_path: str) -> Index:
    """An index of several parts written again as one of a single part."""
    old, commit = read_index(spark, path), _last_commit(spark, path)
    there = commit if out_path == path else _last_commit(spark, out_path)
    new = Row(**commit.asDict() | {"version": there["version"] + 1 if there else 0, "earlier": [],
                                   "part": f"part-{uuid.uuid4().hex}"})
    part = f"{out_path}/{new.part}"
    terms, postings = old.terms.withColumn("tier", F.lit("main")), old.postings.drop("block", "part") \
        .withColumn("tier", F.lit("main"))
    if old.rare_terms is not None:
        terms = terms.unionByName(old.rare_terms.withColumn("tier", F.lit("rare")))
        postings = postings.unionByName(old.rare_postings.drop("block").withColumn("tier", F.lit("rare")))
    _write_vocabulary(terms, part)
    _write_postings(postings, part, new.block_size, old.titles.select("doc_id"))
    old.titles.write.parquet(f"{part}/titles")
    old.doc_lengths.write.parquet(f"{part}/doc_lengths")
    _write_stats(old.corpus_stats, part)
    return _commit(spark, out_path, new)
