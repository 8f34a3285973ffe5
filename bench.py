"""Headline timings on the driver tables at ``$BENCH_SF_DIR`` (default sf0.1).

Stages (seconds each, wall clock, one local session on ``local[$BENCH_CPUS]``):

* ``pagerank``     link graph of ``pages`` + 6 PageRank rounds, written
* ``index_build``  tokenize ``documents``, write postings (with ranks)/terms/titles/stats
* ``search``       all ``benchmark`` items as one batch against the written index
* ``search_single`` one ``benchmark`` item (the reference's per-request mode)
* ``posting_lookup`` one term's postings from the written index
* ``qrels``        passage-containment relevance of ``benchmark`` over ``documents``
* ``evaluate``     per-query report (P@5, F1@30, quality, AP@40) and split means

Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from wordmill.operators import evaluation as ev  # noqa: E402
from wordmill.operators.indexing import MIN_DF, posting_lookup, read_index, write_index  # noqa: E402
from wordmill.operators.linkgraph import link_graph  # noqa: E402
from wordmill.operators.pagerank import pagerank  # noqa: E402
from wordmill.operators.relevance import passage_qrels  # noqa: E402
from wordmill.operators.retrieval import search  # noqa: E402
from wordmill.plans.tables import benchmark_queries, corpus, table  # noqa: E402
from wordmill.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    out = tempfile.mkdtemp(prefix="wordmill-bench-")
    timings: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        res = fn()
        timings[name] = round(time.time() - t0, 3)
        return res

    # Untimed warm-up on the small query table: starts the executors and lets
    # the JVM compile the scan, tokenizer and aggregation paths once.
    from wordmill.operators.retrieval import query_tokens

    query_tokens(benchmark_queries(spark, sf_dir)).groupBy("term").count().collect()
    docs = corpus(spark, sf_dir)

    def rank():
        edges, vertices = link_graph(table(spark, sf_dir, "pages"))
        pagerank(edges, vertices).write.mode("overwrite").parquet(f"{out}/pagerank")
        edges.unpersist()

    timed("pagerank", rank)
    pr = spark.read.parquet(f"{out}/pagerank")
    # Ranks are stored with the postings, so search needs no rank-table join.
    timed("index_build", lambda: write_index(docs, f"{out}/index", min_df=MIN_DF, pagerank=pr))

    index = read_index(spark, f"{out}/index")
    queries = benchmark_queries(spark, sf_dir)

    def run_search():
        search(queries, index).write.mode("overwrite").parquet(f"{out}/results")

    timed("search", run_search)

    def run_single():
        # The reference answers one query per request: time one item alone.
        one = queries.orderBy("query_id").limit(1)
        search(one, index).collect()

    timed("search_single", run_single)

    def run_lookup():
        # One term's postings by bucket + pushed term filter (most frequent kept term).
        term = index.terms.orderBy(F.col("df").desc(), "term").select("term").first()["term"]
        posting_lookup(index, term).collect()

    timed("posting_lookup", run_lookup)

    def run_qrels():
        passages = table(spark, sf_dir, "benchmark").select(
            F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
        passage_qrels(passages, docs).write.mode("overwrite").parquet(f"{out}/qrels")

    timed("qrels", run_qrels)

    def run_eval():
        res = spark.read.parquet(f"{out}/results")
        qr = spark.read.parquet(f"{out}/qrels")
        report = ev.query_report(queries, res, qr)
        report.write.mode("overwrite").parquet(f"{out}/report")
        ev.mean_quality(spark.read.parquet(f"{out}/report"), ev.train_val_split(queries)).collect()

    timed("evaluate", run_eval)
    spark.stop()
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "total_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
