"""Write PLANS.md: executed (AQE final) physical plans of the key operators.

Usage: python tools/plans.py [sf_dir]   (default /root/testdata/sf0.1)
"""

from __future__ import annotations

import re
import sys
import tempfile

sys.path.insert(0, ".")
from pyspark.sql import functions as F  # noqa: E402

from wordmill.operators.indexing import posting_lookup, read_index, term_counts, write_index  # noqa: E402
from wordmill.operators.relevance import passage_qrels  # noqa: E402
from wordmill.operators.retrieval import candidate_scores, top_n  # noqa: E402
from wordmill.plans.tables import benchmark_queries, corpus, table  # noqa: E402
from wordmill.session import local_session  # noqa: E402

NOTES = {
    "term_counts": "Per-document term frequencies are counted inside the row: no Exchange between the scan and the "
                   "Generate. The only exchange is the round-robin spread of a single-row-group input file.",
    "posting_lookup": "A single-term lookup prunes to one bucket folder (PartitionFilters) and pushes "
                      "EqualTo(term) into the parquet reader, where the (term, doc_id) order makes row-group "
                      "statistics selective.",
    "search_scores": "A 200-query batch: query terms are broadcast after a counted bound, the vocabulary is "
                     "semi-joined, and both scores come from one partial/final aggregate. row_number() <= n "
                     "becomes WindowGroupLimit before and after the shuffle. This batch touches every bucket, so "
                     "no bucket list is added.",
    "search_one_query": "One short query: the static bucket IN-list (bounded by the bucket count) prunes the "
                        "postings scan to the query's bucket folders and filters the sorted vocabulary by "
                        "row-group statistics.",
    "qrels_candidates": "Passage containment: the two rarest interior tokens per passage, an equi-join of anchors "
                        "with document terms (broadcast after a counted bound) and a per-document count, then "
                        "contains() only on candidates.",
}


def clean(plan: str) -> str:
    plan = re.sub(r"INSET [^,]+(, [^,\]\)]+){20,}", "INSET <200 stop words>", plan)
    plan = re.sub(r"#\d+L?", "", plan)
    return plan


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    out = tempfile.mkdtemp(prefix="wordmill-plans-")
    idx = write_index(corpus(spark, sf), f"{out}/idx", min_df=50)
    idx = read_index(spark, f"{out}/idx")
    frames = {
        "term_counts": term_counts(corpus(spark, sf)).groupBy().agg(F.sum("tf")),
        "posting_lookup": posting_lookup(idx, idx.terms.orderBy(F.col("df").desc()).first()["term"]),
        "search_scores": top_n(candidate_scores(benchmark_queries(spark, sf), idx), 100),
        "search_one_query": top_n(candidate_scores(
            spark.createDataFrame([(0, " ".join(r["term"] for r in idx.terms.orderBy(F.col("df").desc(), "term")
                                                .limit(2).collect()))], "query_id long, query string"), idx), 100),
        "qrels_candidates": passage_qrels(
            table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"),
                                                 F.col("text").alias("passage")), corpus(spark, sf)),
    }
    lines = ["# Physical plans of the key operators", "",
             f"Generated by `tools/plans.py` on `{sf}` (local[8], AQE on). Plans are the executed "
             "(final adaptive) plans; attribute ids and the 200-word stop list are elided.", ""]
    for name, df in frames.items():
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines += [f"## {name}", "", NOTES[name], "", "```", clean(plan).rstrip(), "```", ""]
    with open("PLANS.md", "w") as f:
        f.write("\n".join(lines))
    spark.stop()


if __name__ == "__main__":
    main()
