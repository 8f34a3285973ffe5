"""Batch search: a table of queries against the index, best-first results.

For each query the kept tokens (repeats and order kept) are matched to the
index vocabulary, their postings are read, and every reached document gets

    tfidf = Σ tf·a·a / sqrt(Σ (tf·a)²),  a = log10(N/df)
    bm25  = Σ b·(k1+1)·tf / (k1·B + tf),  b = log10((N-df+.5)/(df+.5)),  B = 1
    score = w_tfidf · tfidf · (1 + boost·log10(pr+1)) + w_bm25 · bm25

summed over query-token occurrences.  The sums are of fixed-point numbers, so a
score has the same bits however the postings are partitioned.  Scores that agree
to ``SCORE_DIGITS`` places tie (documents equal by the formula may differ in the
last bit of the cosine's division); ties order by the first query position that
reached the document, then doc_id.  At most ``n`` results per query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmill.functions.scoring import bm25_idf, bm25_term, order_free_sum, pagerank_factor, tfidf_idf
from wordmill.functions.text import term_bucket, tokenize
from wordmill.operators.indexing import Index
from wordmill.operators.joins import DEFAULT_BROADCAST_BYTES, bounded_broadcast
from wordmill.session import checkpoint_dir, stored

SCORE_DIGITS = 9  # scores are compared at this precision when ranking


@dataclass
class Ranking:
    """Ranking constants; defaults are the reference configuration."""

    k1: float = 1.5
    b: float = 0.75
    length_norm: bool = False  # reference uses a length factor of 1
    boost: float = 0.1
    w_tfidf: float = 0.5
    w_bm25: float = 0.5
    n: int = 100


def query_tokens(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """``query_id, term, qtf, first_pos``: kept query tokens, repeats counted."""
    exploded = queries.select("query_id", F.posexplode(tokenize(query_col)).alias("pos", "term"))
    return exploded.groupBy("query_id", "term").agg(
        F.count(F.lit(1)).alias("qtf"), F.min("pos").alias("first_pos"))


def _query_terms(queries: DataFrame, index: Index, query_col: str,
                 max_broadcast_bytes: int) -> tuple[DataFrame, bool, list[int] | None]:
    """(query terms with df, whether they are small enough to broadcast, bucket list or None)."""
    qtok = query_tokens(queries, query_col).withColumn("bucket", term_bucket("term", index.num_buckets))
    # One small job over the query side proves its size before it is broadcast
    # and lists the buckets it touches (at most ``num_buckets`` values).
    stats = qtok.agg(F.sum(F.octet_length("term") + 48).alias("bytes"), F.collect_set("bucket").alias("buckets")).first()
    small = int(stats["bytes"] or 0) <= max_broadcast_bytes
    wanted = qtok.select("bucket", "term").distinct()
    buckets = None
    if small:
        wanted = F.broadcast(wanted)
    if index.all_postings is not None:
        # Declared over a raw corpus: restrict the term counts to the query's
        # terms *before* aggregating, so only their document frequencies are
        # computed (and the bucket hash runs on those few terms, not per posting).
        words = wanted.select("term")
        counted = index.all_postings.join(words, "term", "left_semi").groupBy("term").agg(
            F.count(F.lit(1)).alias("df"))
        if index.min_df > 0:
            counted = counted.where(F.col("df") > index.min_df)
        side = F.broadcast(qtok) if small else qtok
        # Join on the term alone: a join on the bucket expression would make the
        # optimizer infer a bucket filter (an md5) on every posting row.
        return side.join(counted, "term"), small, None
    else:
        vocab = index.terms
        touched = sorted(stats["buckets"] or [])
        if small and len(touched) < index.num_buckets:
            buckets = touched
            vocab = vocab.where(F.col("bucket").isin(buckets))
        vocab = vocab.join(wanted, ["bucket", "term"], "left_semi")
    vocab = vocab.select("bucket", "term", "df")
    side = F.broadcast(qtok) if small else qtok
    # Each query token matches at most one vocabulary row, so the result keeps the bound.
    return side.join(vocab, ["bucket", "term"]), small, buckets


def query_terms(queries: DataFrame, index: Index, query_col: str = "query",
                max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """``query_id, term, qtf, first_pos, bucket, df``: query tokens known to the index.

    Unknown terms drop out of the inner join.  The vocabulary is semi-joined
    with the query's terms first, so only their statistics are read (or, for
    an index declared over a raw corpus, only their postings are aggregated).
    """
    return _query_terms(queries, index, query_col, max_broadcast_bytes)[0]


def term_weights(qterms: DataFrame, n_docs: int) -> DataFrame:
    """Adds ``idf_tfidf`` and ``idf_bm25`` to query terms."""
    n = F.lit(n_docs).cast("double")
    return qterms.withColumn("idf_tfidf", tfidf_idf(n, F.col("df"))).withColumn(
        "idf_bm25", bm25_idf(n, F.col("df")))


def candidate_scores(queries: DataFrame, index: Index, pagerank: DataFrame | None = None,
                     ranking: Ranking | None = None, query_col: str = "query",
                     doc_lengths: DataFrame | None = None,
                     max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """``query_id, doc_id, first_pos, tfidf, bm25, pr, tfidf_boosted, score`` for every reached doc."""
    weighted = weighted_terms(queries, index, query_col, max_broadcast_bytes)
    return _scores(index, weighted, pagerank, ranking or Ranking(), doc_lengths)


def weighted_terms(queries: DataFrame, index: Index, query_col: str = "query",
                   max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> tuple[DataFrame, bool, list[int] | None]:
    """(query terms with df and weights, whether they are small enough to broadcast, bucket list or None)."""
    qterms, small, buckets = _query_terms(queries, index, query_col, max_broadcast_bytes)
    return term_weights(qterms, index.n_docs()), small, buckets


HITS_PER_TASK = 1 << 20  # (query term, document) pairs that one task sums


def _score_tasks(qterms: DataFrame) -> int:
    """Tasks that score: as many as the pairs that the terms' document frequencies add up to need."""
    hits = int(qterms.agg(F.sum("df")).first()[0] or 0)
    most = int(qterms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-hits // HITS_PER_TASK), min(most, -(-hits // (HITS_PER_TASK >> 6))))


def _scores(index: Index, weighted: tuple[DataFrame, bool, list[int] | None], pagerank: DataFrame | None, r: Ranking,
            doc_lengths: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """``candidate_scores`` of weighted query terms; with ``among`` (``query_id, doc_id``), of those pairs alone."""
    qterms, small, buckets = weighted
    if among is None:
        qterms = stored(qterms, "query-terms")  # summed here and joined below
        tasks = _score_tasks(qterms)
    side = F.broadcast(qterms) if small else qterms

    def by_document(postings: DataFrame) -> DataFrame:
        # Postings of the query terms, dealt by document before they meet the queries: all
        # pairs of a document are made and summed in one task, without another shuffle.
        words = F.broadcast(qterms.select("term").distinct())
        return postings.join(words, "term", "left_semi").repartition(tasks, "doc_id")

    if index.all_postings is not None:
        # Declared over a raw corpus: match the unfiltered counts on term alone;
        # the query terms already carry the df cut.
        postings, on = index.all_postings.select("term", "doc_id", "tf"), ["term"]
        side = side.drop("bucket")
    else:
        # Stored index: a static bucket list (bounded by the bucket count) prunes
        # partition folders of the postings scan before the broadcast join.
        with_rank = "pr" in index.postings.columns and pagerank is None
        postings = index.postings.select("bucket", "term", "doc_id", "tf", *(["pr"] if with_rank else []))
        if buckets is not None:
            postings = postings.where(F.col("bucket").isin(buckets))
        if among is not None:
            # Postings of other documents go where they are read, before any pair is made of them.
            postings = postings.join(bounded_broadcast(among.select("doc_id").distinct()), "doc_id", "left_semi")
        on = ["bucket", "term"]
    if among is not None:
        hits = postings.join(side, on).join(bounded_broadcast(among), ["query_id", "doc_id"], "left_semi")
    elif small:
        hits = by_document(postings).join(side, on)
    else:
        hits = postings.join(side, on).repartition(tasks, "doc_id")
    tf = F.col("tf").cast("double")
    w = tf * F.col("idf_tfidf")
    if r.length_norm:
        lengths = doc_lengths if doc_lengths is not None else index.doc_lengths
        if lengths is None:
            raise ValueError("length-normalised BM25 needs document lengths (doc_id, doc_len)")
        avg_dl = index.avg_dl()
        hits = hits.join(lengths.select("doc_id", "doc_len"), "doc_id", "left")
        length_factor = F.lit(1.0 - r.b) + F.lit(r.b) * F.coalesce(F.col("doc_len"), F.lit(avg_dl)) / F.lit(avg_dl)
    else:
        length_factor = 1.0  # the reference's B = 1 - b + b·1
    stored_rank = "pr" in hits.columns
    per_hit = hits.select(
        "query_id", "doc_id", "first_pos", *(["pr"] if stored_rank else []),
        (F.col("qtf") * w * F.col("idf_tfidf")).alias("dot"),
        (F.col("qtf") * w * w).alias("sq"),
        (F.col("qtf") * bm25_term(F.col("idf_bm25"), tf, r.k1, length_factor)).alias("bm"),
    )
    agg = per_hit.groupBy("query_id", "doc_id").agg(
        order_free_sum(F.col("dot")).alias("dot"), order_free_sum(F.col("sq")).alias("sq"),
        order_free_sum(F.col("bm")).alias("bm25"),
        F.min("first_pos").alias("first_pos"), *([F.max("pr").alias("pr")] if stored_rank else []))
    tfidf = F.coalesce(F.try_divide(F.col("dot"), F.sqrt("sq")), F.lit(0.0))
    scored = agg.select("query_id", "doc_id", "first_pos", tfidf.alias("tfidf"), "bm25",
                        *(["pr"] if stored_rank else []))
    if not stored_rank:
        if pagerank is not None:
            pr = pagerank.select(F.col("id").alias("doc_id"), F.col("pagerank").alias("pr"))
            scored = scored.join(bounded_broadcast(pr), "doc_id", "left")
        else:
            scored = scored.withColumn("pr", F.lit(None).cast("double"))
    boosted = F.col("tfidf") * pagerank_factor(F.col("pr"), r.boost)
    return scored.select(
        "query_id", "doc_id", "first_pos", "tfidf", "bm25",
        F.coalesce(F.col("pr"), F.lit(0.0)).alias("pr"),
        boosted.alias("tfidf_boosted"),
        (F.lit(r.w_tfidf) * boosted + F.lit(r.w_bm25) * F.col("bm25")).alias("score"),
    )


def top_n(scored: DataFrame, n: int = 100, materialize: bool = False) -> DataFrame:
    """Best ``n`` per query with a dense ``rank`` 1..n (stable tie order).

    ``row_number() <= n`` is planned as a WindowGroupLimit, which keeps only n
    rows per query in each task before the shuffle, so a query matching a
    third of the corpus still ships at most n rows per task.
    """
    order = Window.partitionBy("query_id").orderBy(
        F.round("score", SCORE_DIGITS).desc(), F.col("first_pos").asc(), F.col("doc_id").asc())
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    if materialize:
        # At most n rows per query: cut the lineage in the shared checkpoint
        # folder so later joins (titles) do not recompute the scoring.
        checkpoint_dir(best.sparkSession)
        best = best.checkpoint(eager=True)
    return best


def attach_titles(results: DataFrame, titles: DataFrame, max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Left join titles onto results (missing title → ``""``).

    Titles are first semi-joined with the result ids, so a title table as large
    as the corpus is only filtered, never shuffled whole.
    """
    ids = bounded_broadcast(results.select("doc_id").distinct(), max_broadcast_bytes)
    needed = titles.join(ids, "doc_id", "left_semi")
    return results.join(needed, "doc_id", "left").withColumn("title", F.coalesce(F.col("title"), F.lit("")))


def search(queries: DataFrame, index: Index, pagerank: DataFrame | None = None,
           ranking: Ranking | None = None, query_col: str = "query", with_titles: bool = True,
           doc_lengths: DataFrame | None = None, prune: bool = False) -> DataFrame:
    """``query_id, rank, doc_id, title, score`` (plus component scores), best first.

    With ``prune`` (a stored index), documents that upper bounds keep out of the best
    ``n`` are never scored (``operators.pruning``): the same rows, for queries that
    reach a large part of a large index.
    """
    r = ranking or Ranking()
    if prune:
        from wordmill.operators.pruning import pruned_scores

        scored = pruned_scores(queries, index, pagerank, r, query_col, doc_lengths)
    else:
        scored = candidate_scores(queries, index, pagerank, r, query_col, doc_lengths)
    best = top_n(scored, r.n, materialize=with_titles)
    if with_titles:
        best = attach_titles(best, index.titles)
    return best
