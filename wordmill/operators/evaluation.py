"""Ranking metrics over ``results(query_id, rank, doc_id)`` and ``qrels(query_id, doc_id)``.

Every metric starts from the query table, so queries with no results or no
relevant documents still get a row.  Values are rounded half-to-even to three
places at every stage (the F1 of rounded precision and recall, and so on).

* precision@k = hits in the first k / number of results in the first k; 0 if none
* recall@k    = hits in the first k / distinct relevant; 1.0 if none relevant
* f1@k        = harmonic mean of rounded P@k and R@k; 0 if either is 0
* results_quality = harmonic mean of rounded P@5 and F1@30
* average_precision@k = mean over hits in the first k of (hits so far / rank)
* overlap@k   = distinct relevant documents among the first k
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmill.functions.scoring import harmonic_or_zero, round3
from wordmill.operators.ordering import dense_order_rank


def judged_results(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """``query_id, rank, doc_id, hit``: each result flagged if it is relevant."""
    truth = qrels.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    return results.select("query_id", "rank", "doc_id").join(truth, ["query_id", "doc_id"], "left") \
        .select("query_id", "rank", "doc_id", F.coalesce("hit", F.lit(0)).alias("hit"))


def per_query_counts(results: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 30, 40),
                     ap_k: int = 40, overlap_k: int = 40) -> DataFrame:
    """One pass over judged results: per query ``n_k``/``h_k`` (results and hits
    in the first k), ``ap_sum``/``ap_hits`` (average precision parts),
    ``overlap`` and ``n_returned``.

    The running hit count is a window over one query's ranked list, which the
    search caps at ``n`` rows, so no window partition grows with the corpus.
    """
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    judged = judged_results(results, qrels).withColumn("hits_so_far", F.sum("hit").over(running))
    aggs = []
    for k in sorted(set(ks)):
        in_k = F.col("rank") <= k
        aggs += [F.sum(F.when(in_k, 1).otherwise(0)).alias(f"n_{k}"),
                 F.sum(F.when(in_k, F.col("hit")).otherwise(0)).alias(f"h_{k}")]
    ap_hit = (F.col("rank") <= ap_k) & (F.col("hit") == 1)
    aggs += [F.sum(F.when(ap_hit, F.col("hits_so_far") / F.col("rank"))).alias("ap_sum"),
             F.sum(F.when(ap_hit, 1).otherwise(0)).alias("ap_hits"),
             F.countDistinct(F.when((F.col("rank") <= overlap_k) & (F.col("hit") == 1), F.col("doc_id")))
             .alias("overlap"),
             F.count(F.lit(1)).alias("n_returned")]
    return judged.groupBy("query_id").agg(*aggs)


def _truth_sizes(qrels: DataFrame) -> DataFrame:
    return qrels.select("query_id", "doc_id").distinct().groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_relevant"))


def precision_col(k: int) -> F.Column:
    return F.when(F.coalesce(F.col(f"n_{k}"), F.lit(0)) == 0, F.lit(0.0)).otherwise(
        round3(F.col(f"h_{k}") / F.col(f"n_{k}")))


def recall_col(k: int) -> F.Column:
    return F.when(F.coalesce(F.col("n_relevant"), F.lit(0)) == 0, F.lit(1.0)).otherwise(
        round3(F.coalesce(F.col(f"h_{k}"), F.lit(0)) / F.col("n_relevant")))


def f1_col(k: int) -> F.Column:
    return harmonic_or_zero(precision_col(k), recall_col(k))


def ap_col() -> F.Column:
    return F.when(F.coalesce(F.col("ap_hits"), F.lit(0)) == 0, F.lit(0.0)).otherwise(
        round3(F.col("ap_sum") / F.col("ap_hits")))


def _base(queries: DataFrame, results: DataFrame, qrels: DataFrame, ks: tuple[int, ...],
          ap_k: int = 40, overlap_k: int = 40) -> DataFrame:
    """Every query (from the query table), its counts, and its truth size."""
    return (queries.select("query_id")
            .join(per_query_counts(results, qrels, ks, ap_k, overlap_k), "query_id", "left")
            .join(_truth_sizes(qrels), "query_id", "left"))


def precision_at_k(queries: DataFrame, results: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    return _base(queries, results, qrels, (k,)).select("query_id", precision_col(k).alias(f"precision_at_{k}"))


def recall_at_k(queries: DataFrame, results: DataFrame, qrels: DataFrame, k: int = 30) -> DataFrame:
    return _base(queries, results, qrels, (k,)).select("query_id", recall_col(k).alias(f"recall_at_{k}"))


def f1_at_k(queries: DataFrame, results: DataFrame, qrels: DataFrame, k: int = 30) -> DataFrame:
    return _base(queries, results, qrels, (k,)).select("query_id", f1_col(k).alias(f"f1_at_{k}"))


def results_quality(queries: DataFrame, results: DataFrame, qrels: DataFrame) -> DataFrame:
    base = _base(queries, results, qrels, (5, 30))
    return base.select("query_id", harmonic_or_zero(precision_col(5), f1_col(30)).alias("results_quality"))


def average_precision(queries: DataFrame, results: DataFrame, qrels: DataFrame, k: int = 40) -> DataFrame:
    """Mean of precision at each hit in the first ``k`` (divisor: hits found; 0 if none)."""
    base = _base(queries, results, qrels, (k,), ap_k=k)
    return base.select("query_id", ap_col().alias(f"average_precision_at_{k}"))


def overlap_at_k(queries: DataFrame, results: DataFrame, qrels: DataFrame, k: int = 40) -> DataFrame:
    base = _base(queries, results, qrels, (k,), overlap_k=k)
    return base.select("query_id", F.coalesce("overlap", F.lit(0)).cast("long").alias(f"overlap_at_{k}"))


def query_report(queries: DataFrame, results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per query: relevant and returned counts, P@5, F1@30, quality, AP@40, overlap@40 (one pass)."""
    base = _base(queries, results, qrels, (5, 30, 40))
    return base.select(
        "query_id",
        F.coalesce("n_relevant", F.lit(0)).cast("long").alias("n_relevant"),
        F.coalesce("n_returned", F.lit(0)).cast("long").alias("n_returned"),
        precision_col(5).alias("precision_at_5"),
        f1_col(30).alias("f1_at_30"),
        harmonic_or_zero(precision_col(5), f1_col(30)).alias("results_quality"),
        ap_col().alias("average_precision_at_40"),
        F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap_at_40"),
    )


def train_val_split(queries: DataFrame, ratio: float = 0.7, seed: int = 42, key_col: str = "query") -> DataFrame:
    """``query_id, split``: the first ``int(n·ratio)`` queries in md5(seed ‖ query) order are train."""
    n = queries.count()
    cut = int(n * ratio)
    order_key = F.md5(F.concat(F.lit(str(seed)), F.coalesce(F.col(key_col), F.lit(""))))
    ranked = dense_order_rank(queries.select("query_id", key_col), F.concat(order_key, F.format_string(
        "%020d", F.col("query_id"))))
    return ranked.select("query_id", F.when(F.col("pos") < cut, "train").otherwise("validation").alias("split"))


def mean_quality(report: DataFrame, split: DataFrame) -> DataFrame:
    """``split, n_queries, mean_quality`` (rounded); an empty split has no row."""
    return report.join(split, "query_id").groupBy("split").agg(
        F.count(F.lit(1)).alias("n_queries"), round3(F.avg("results_quality")).alias("mean_quality"))


def _ids(entries: F.Column, most: int) -> F.Column:
    """The ids of the first ``most`` entries (place, id), space-joined."""
    return F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(entries)), 1, most),
                                    lambda x: x["doc_id"].cast("string")), " ")


def report_details(queries: DataFrame, results: DataFrame, qrels: DataFrame, top: int = 10,
                   k: int = 40) -> DataFrame:
    """``query_id, truth_sample, top_ids, overlap_ids`` of every query, at most ``top`` ids each.

    The smallest relevant ids, the best predicted ones, and the relevant ones
    among the first ``k`` results, best first.
    """
    entry = F.struct("rank", "doc_id")
    shown = judged_results(results, qrels).where(F.col("rank") <= k).groupBy("query_id").agg(
        _ids(entry, top).alias("top_ids"), _ids(F.when(F.col("hit") == 1, entry), top).alias("overlap_ids"))
    by_id = Window.partitionBy("query_id").orderBy("doc_id")
    truth = qrels.select("query_id", "doc_id").distinct().withColumn("rank", F.row_number().over(by_id)) \
        .where(F.col("rank") <= top).groupBy("query_id").agg(_ids(entry, top).alias("truth_sample"))
    base = queries.select("query_id").join(shown, "query_id", "left").join(truth, "query_id", "left")
    return base.select("query_id", *[F.coalesce(c, F.lit("")).alias(c)
                                     for c in ("truth_sample", "top_ids", "overlap_ids")])


def debug_query(queries: DataFrame, results: DataFrame, qrels: DataFrame,
                seed: int = 42, key_col: str = "query", top: int = 10) -> DataFrame:
    """The first query of the shuffled order (the one a split run inspects first):
    its details (see ``report_details``), overlap@40, P@5, F1@30 and quality."""
    order_key = F.md5(F.concat(F.lit(str(seed)), F.coalesce(F.col(key_col), F.lit(""))))
    first = dense_order_rank(queries.select("query_id", key_col), F.concat(order_key, F.format_string(
        "%020d", F.col("query_id")))).where(F.col("pos") == 0).select("query_id")
    own_results = results.join(first, "query_id", "left_semi")
    own_qrels = qrels.join(first, "query_id", "left_semi")
    report = query_report(first, own_results, own_qrels)
    return report.join(report_details(first, own_results, own_qrels, top), "query_id").select(
        "query_id", "truth_sample", "top_ids", "overlap_ids", "overlap_at_40", "precision_at_5", "f1_at_30",
        "results_quality")
