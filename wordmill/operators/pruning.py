"""Pruned search: upper bounds keep documents out of the best ``n`` before they are scored.

A query's terms are put in order of document frequency.  Every reached document has
one *lead*, the rarest query term it holds, and can hold only this and the more
frequent ones.  For a document led by term t with frequency tf and rank pr,

* the cosine part is at most ``sqrt(Σ qtf·a²)`` over t and the terms after it (the
  Cauchy-Schwarz inequality), times the boost of pr;
* the BM25 part is at most t's own summand plus ``(k1+1)·qtf·b`` of each term after
  it with b > 0; terms with b ≤ 0 add nothing above 0.

A block of postings has the same bound with its largest tf and pr.  So:

1. the blocks with the greatest bounds, until they hold twice ``n`` postings, give a
   first set of documents per query; their exact scores give a threshold, the n-th best;
2. blocks under the threshold are left out, and of the others the postings under it;
3. the documents that are left, each with all its postings, are scored as always.

A posting that is not its document's lead has a bound too (it may keep a document
that its lead drops, which costs time and no result).  A document below the threshold
by its lead cannot be among the best ``n``, so the result is that of the full search.
What is aggregated is a few times ``n`` per query, however many documents the terms reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmill.functions.scoring import bm25_term, pagerank_factor
from wordmill.operators.indexing import Index
from wordmill.operators.joins import bounded_broadcast
from wordmill.operators.retrieval import SCORE_DIGITS, Ranking, _scores, weighted_terms
from wordmill.session import stored

MARGIN = 10.0 * 10 ** -SCORE_DIGITS  # bounds and scores differ by rounding; ranks compare rounded scores
BLOCK = ["bucket", "term", "part", "block"]


def bound_terms(weighted: DataFrame, r: Ranking) -> DataFrame:
    """Adds to query terms ``cos_cap`` and ``later_cap``: what t and later terms, and later terms alone, can add."""
    order = Window.partitionBy("query_id").orderBy("df", "term")
    here_on = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    most = F.greatest(F.lit(0.0), F.col("qtf") * F.col("idf_bm25") * F.lit(r.k1 + 1.0))
    square = F.col("qtf") * F.col("idf_tfidf") * F.col("idf_tfidf")
    return weighted.withColumn("cos_cap", F.sqrt(F.sum(square).over(here_on))) \
        .withColumn("later_cap", F.coalesce(F.sum(most).over(after), F.lit(0.0)))


def upper_bound(tf: Column, pr: Column, r: Ranking) -> Column:
    """The most that a document led by a posting of this tf and pr can score."""
    least_factor = 1.0 - r.b if r.length_norm else 1.0
    own = F.when(F.col("idf_bm25") > 0, F.col("qtf") * bm25_term(F.col("idf_bm25"), tf.cast("double"), r.k1, least_factor)) \
        .otherwise(F.lit(0.0))
    return F.lit(r.w_tfidf) * F.col("cos_cap") * pagerank_factor(pr, r.boost) + F.lit(r.w_bm25) * (own + F.col("later_cap"))


def reached(queries: DataFrame, index: Index, pagerank: DataFrame | None = None, ranking: Ranking | None = None,
            query_col: str = "query", doc_lengths: DataFrame | None = None) -> DataFrame:
    """``query_id, doc_id``: the documents that the bounds do not keep out of the best ``n``."""
    weighted = weighted_terms(queries, index, query_col)
    return _reached(weighted, index, pagerank, ranking or Ranking(), doc_lengths)


def _reached(weighted: tuple[DataFrame, bool, list[int] | None], index: Index, pagerank: DataFrame | None, r: Ranking,
             doc_lengths: DataFrame | None) -> DataFrame:
    if index.blocks is None:
        raise ValueError("pruned search needs a stored index with posting blocks")
    if min(r.w_tfidf, r.w_bm25, r.boost, r.k1) < 0 or not 0 <= r.b <= 1:
        raise ValueError("bounds hold for weights of 0 or more and b from 0 to 1")
    terms, small, buckets = weighted
    bounded = bound_terms(terms, r)
    bounded = F.broadcast(bounded) if small else bounded
    blocks, postings = index.blocks, index.postings
    if buckets is not None:
        blocks, postings = (t.where(F.col("bucket").isin(buckets)) for t in (blocks, postings))
    stored_rank = "pr" in postings.columns and pagerank is None
    if stored_rank:
        block_pr, row_pr = F.col("max_pr"), F.col("pr")
    else:
        # Ranks of a table of their own: the greatest of all bounds each.
        top = pagerank.agg(F.max("pagerank")).first()[0] if pagerank is not None else None
        block_pr = row_pr = F.lit(float(top or 0.0))
    capped = stored(blocks.join(bounded, ["bucket", "term"]).select(
        "query_id", *BLOCK, "n", "qtf", "idf_bm25", "cos_cap", "later_cap",
        upper_bound(F.col("max_tf"), block_pr, r).alias("cap")), "block-caps")

    def postings_of(chosen: DataFrame, *more: str) -> DataFrame:
        side = bounded_broadcast(chosen.select("query_id", *BLOCK, "qtf", "idf_bm25", "cos_cap", "later_cap", *more))
        return postings.join(side, BLOCK).withColumn("cap", upper_bound(F.col("tf"), row_pr, r))

    best_blocks = Window.partitionBy("query_id").orderBy(F.desc("cap"), "term", "part", "block") \
        .rowsBetween(Window.unboundedPreceding, -1)
    first = capped.withColumn("before", F.coalesce(F.sum("n").over(best_blocks), F.lit(0))).where(F.col("before") < 2 * r.n)
    best_rows = Window.partitionBy("query_id").orderBy(F.desc("cap"), "doc_id")
    sample = postings_of(first).withColumn("place", F.row_number().over(best_rows)).where(F.col("place") <= 2 * r.n)
    sample = stored(sample.select("query_id", "doc_id").distinct(), "first-docs")  # at most 2 n per query
    scores = _scores(index, weighted, pagerank, r, doc_lengths, among=sample)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"))
    floor = stored(scores.withColumn("place", F.row_number().over(by_score)).where(F.col("place") == r.n)
                   .select("query_id", (F.col("score") - F.lit(MARGIN)).alias("floor")), "floors")  # one row per query

    # A query that reached fewer than n documents so far has no floor, and keeps all.
    kept = capped.join(bounded_broadcast(floor), "query_id", "left") \
        .where(F.col("floor").isNull() | (F.col("cap") >= F.col("floor")))
    rows = postings_of(kept, "floor").where(F.col("floor").isNull() | (F.col("cap") >= F.col("floor")))
    return stored(rows.select("query_id", "doc_id").distinct(), "reached")


def pruned_scores(queries: DataFrame, index: Index, pagerank: DataFrame | None = None, ranking: Ranking | None = None,
                  query_col: str = "query", doc_lengths: DataFrame | None = None) -> DataFrame:
    """``candidate_scores`` of the documents that may be among the best ``n`` (all of those are there)."""
    r = ranking or Ranking()
    weighted = weighted_terms(queries, index, query_col)
    # The few query terms are used five times over: fixed once.
    weighted = (stored(weighted[0], "query-terms"), *weighted[1:])
    return _scores(index, weighted, pagerank, r, doc_lengths,
                   among=_reached(weighted, index, pagerank, r, doc_lengths))
