"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Roles of the driver tables: ``documents`` is the corpus (title = first
line), ``benchmark`` the query set, ``pages`` the web-link graph and
``lineitem`` a cyclic part-succession graph for PageRank.  Relevance: a
document is relevant to a benchmark item iff its text contains the item's text.
Scores are emitted rounded to 6 places (ranking itself uses 9).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.functions.text import is_stop_word, raw_tokens, tokenize
from wordmill.operators import evaluation as ev
from wordmill.operators.ordering import successors
from wordmill.operators.indexing import (
    MIN_DF,
    POSTING_BLOCK,
    Index,
    append_to_index,
    build_index,
    doc_freq,
    min_df_filter,
    posting_lists,
    posting_lookup,
    term_counts,
    term_stats,
    write_index,
)
from wordmill.operators.linkgraph import html_anchor_pages, link_edges, link_graph, link_vertices
from wordmill.operators.pagerank import pagerank, write_ranks
from wordmill.operators.relevance import passage_qrels
from wordmill.operators.retrieval import Ranking, candidate_scores, query_terms, search, term_weights, top_n
from wordmill.plans.tables import benchmark_queries, corpus, table
from wordmill.session import checkpoint_dir
from wordmill.streaming.incremental import index_stream, read_stream_index
from wordmill.sources.corpus import (
    corpus_from_documents,
    corpus_stats,
    doc_lengths,
    read_corpus,
    read_relevance_json,
    relevance_from_json_column,
    titles,
)

SCORE_ROUND = 6


def _index(spark: SparkSession, sf_dir: str) -> Index:
    return build_index(corpus(spark, sf_dir), min_df=MIN_DF)


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/wordmill-{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- corpus & text

def q_corpus_scan(spark, sf_dir):
    return read_corpus(spark, f"{sf_dir}/doc*.parquet").select("doc_id", "text", "lang", "source", "n_chars")


def q_titles(spark, sf_dir):
    return titles(corpus(spark, sf_dir))


def q_corpus_stats(spark, sf_dir):
    s = corpus_stats(corpus(spark, sf_dir))
    return s.select("n_docs", F.round("avg_dl", SCORE_ROUND).alias("avg_dl"))


def q_doc_lengths(spark, sf_dir):
    return doc_lengths(corpus(spark, sf_dir))


def q_tokenize(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return docs.select(
        "doc_id",
        F.size(raw_tokens("text")).cast("long").alias("n_raw"),
        F.size(tokenize("text")).cast("long").alias("n_kept"),
        F.array_join(tokenize("text"), " ").alias("tokens"),
    )


def q_term_counts(spark, sf_dir):
    return term_counts(corpus(spark, sf_dir))


def q_doc_freq(spark, sf_dir):
    return doc_freq(term_counts(corpus(spark, sf_dir)))


def q_term_stats(spark, sf_dir):
    return term_stats(term_counts(corpus(spark, sf_dir)))


def q_min_df_filter(spark, sf_dir):
    counts = term_counts(corpus(spark, sf_dir))
    return min_df_filter(counts, term_stats(counts, MIN_DF))


def q_vocab_size(spark, sf_dir):
    idx = _index(spark, sf_dir)
    return idx.terms.agg(F.count(F.lit(1)).alias("n_terms"))


def q_term_sample(spark, sf_dir):
    idx = _index(spark, sf_dir)
    return idx.terms.select("term", "df").orderBy("term").limit(20)


def q_title_preview(spark, sf_dir):
    """The first two titles by id (the reference prints two arbitrary ones)."""
    return titles(corpus(spark, sf_dir)).orderBy("doc_id").limit(2)


def q_posting_lists(spark, sf_dir):
    lists = posting_lists(q_min_df_filter(spark, sf_dir))
    as_text = F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"].cast("string"),
                                                                         p["tf"].cast("string"))), ",")
    return lists.select("term", "block", F.size("postings").cast("long").alias("n_postings"),
                        as_text.alias("postings"))


def q_term_buckets(spark, sf_dir):
    idx = _index(spark, sf_dir)
    return idx.terms.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings"))


def q_index_roundtrip(spark, sf_dir):
    idx = write_index(corpus(spark, sf_dir), _scratch(spark, "index"), min_df=MIN_DF)
    return idx.postings.select("term", "doc_id", "tf", "bucket")


def q_posting_lookup(spark, sf_dir):
    idx = write_index(corpus(spark, sf_dir), _scratch(spark, "index"), min_df=MIN_DF)
    # The most frequent kept term (ties: smallest term) is looked up by bucket.
    top = idx.terms.orderBy(F.col("df").desc(), F.col("term")).select("term").first()
    return posting_lookup(idx, top["term"] if top else "")


def q_index_append(spark, sf_dir):
    return _appended(spark, sf_dir, 0)


def q_index_append_cut(spark, sf_dir):
    """The same over the reference's df cut: terms that only both arrivals together lift over it are found."""
    return _appended(spark, sf_dir, MIN_DF)


def _appended(spark, sf_dir, min_df):
    # Two arrivals: English documents first, then all others (the filter is
    # pushed into the documents scan; together they are the whole table).
    docs = table(spark, sf_dir, "documents")
    is_en = F.coalesce(F.col("lang") == "en", F.lit(False))
    first = corpus_from_documents(docs.where(is_en))
    rest = corpus_from_documents(docs.where(~is_en))
    base = _scratch(spark, "append")
    write_index(first, f"{base}/a", min_df=min_df)
    return _contents(append_to_index(f"{base}/a", rest, f"{base}/ab"))


def _contents(idx: Index) -> DataFrame:
    """Every posting with its term's statistics, its document's title, and the number of documents."""
    return idx.postings.join(idx.terms.select("term", "df", "term_total"), "term").join(idx.titles, "doc_id").select(
        "term", "doc_id", "tf", "df", "term_total", "title", F.lit(idx.n_docs()).cast("long").alias("n_docs"),
        F.lit(idx.num_buckets).cast("long").alias("num_buckets"))


def q_stream_index(spark, sf_dir):
    """``documents`` arriving as a file stream, appended batch by batch to a
    streaming index; returns its committed contents."""
    root = _scratch(spark, "stream")
    schema = table(spark, sf_dir, "documents").schema
    # The table is a file or a folder of files; as a pattern, both are streamed.
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    query = index_stream(stream, f"{root}/index", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return _contents(read_stream_index(spark, f"{root}/index"))


# ---------------------------------------------------------------- relevance

def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("passage"))
    return passage_qrels(passages, corpus(spark, sf_dir))


def _packed_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements as JSON objects {query: [ids as strings]}, one per query and block
    of doc ids, so no object grows with the corpus."""
    return qrels(spark, sf_dir).withColumn("block", F.floor(F.col("doc_id") / F.lit(POSTING_BLOCK))) \
        .groupBy("query_id", "block").agg(
        F.to_json(F.create_map(F.col("query_id").cast("string"),
                               F.array_sort(F.collect_list(F.col("doc_id").cast("string"))))).alias("json"))


def q_qrels_explode(spark, sf_dir):
    parsed = relevance_from_json_column("json", _packed_qrels(spark, sf_dir))
    return parsed.select(F.col("query").cast("long").alias("query_id"), "doc_id")


def q_qrels_files(spark, sf_dir):
    """The judgements written as JSON Lines files and read as a relevance set."""
    path = _scratch(spark, "qrels")
    _packed_qrels(spark, sf_dir).select("json").write.text(path)
    read = read_relevance_json(spark, path, whole_file=False)
    return read.select(F.col("query").cast("long").alias("query_id"), "doc_id")


# ---------------------------------------------------------------- link graph

def pages_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nested = html_anchor_pages(table(spark, sf_dir, "pages"))
    return link_edges(nested), link_vertices(nested)


def pages_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, vertices = link_graph(table(spark, sf_dir, "pages"))
    ranks = pagerank(edges, vertices)
    edges.unpersist()
    return ranks


def q_link_edges(spark, sf_dir):
    return pages_graph(spark, sf_dir)[0]


def q_link_edges_files(spark, sf_dir):
    """Edges of nested links (``id, anchor_text``) read from the Parquet files of a folder."""
    path = _scratch(spark, "links")
    html_anchor_pages(table(spark, sf_dir, "pages")).write.parquet(path)
    return link_edges(read_corpus(spark, f"{path}*").select("id", "anchor_text"))


def q_link_vertices(spark, sf_dir):
    return pages_graph(spark, sf_dir)[1]


def part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Part-succession graph of ``lineitem``: within an order, each part links to the next.

    Lines are ordered by (line number, part key).  The graph is cyclic and has
    self-loops; parts that are only ever last in an order are sinks.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    nxt = successors(li, "l_orderkey", ["l_linenumber", "l_partkey"], "l_partkey")
    edges = nxt.select(F.col("l_partkey").alias("src"), F.col("next").alias("dst")) \
        .where(F.col("dst").isNotNull()).distinct()
    vertices = li.select(F.col("l_partkey").alias("id")).distinct()
    return edges, vertices


def q_pagerank(spark, sf_dir):
    edges, vertices = part_graph(spark, sf_dir)
    return pagerank(edges, vertices).select("id", F.round("pagerank", 9).alias("pagerank"))


def q_pagerank_preview(spark, sf_dir):
    """Five best-ranked pages of the link graph, and how many pages were ranked."""
    ranks = pages_rank(spark, sf_dir).select("id", F.round("pagerank", 9).alias("pagerank"))
    n = ranks.count()
    return ranks.orderBy(F.col("pagerank").desc(), "id").limit(5).withColumn("n_ranked", F.lit(n).cast("long"))


def q_pagerank_links(spark, sf_dir):
    return pages_rank(spark, sf_dir).select("id", F.round("pagerank", 9).alias("pagerank"))


# ---------------------------------------------------------------- retrieval

def q_query_terms(spark, sf_dir):
    qt = query_terms(benchmark_queries(spark, sf_dir), _index(spark, sf_dir))
    return qt.select("query_id", "term", "qtf", F.col("first_pos").cast("long").alias("first_pos"), "df")


def q_idf(spark, sf_dir):
    idx = _index(spark, sf_dir)
    qt = term_weights(query_terms(benchmark_queries(spark, sf_dir), idx), idx.n_docs())
    return qt.select("query_id", "term", "df", F.round("idf_tfidf", 9).alias("idf_tfidf"),
                     F.round("idf_bm25", 9).alias("idf_bm25"))


def _scores(spark, sf_dir, with_rank=True):
    pr = pages_rank(spark, sf_dir) if with_rank else None
    return candidate_scores(benchmark_queries(spark, sf_dir), _index(spark, sf_dir), pr)


def _best(scored: DataFrame, by: str) -> DataFrame:
    """The best 100 documents of each query by one score, as a search returns them."""
    return top_n(scored.withColumn("score", F.col(by)), Ranking().n)


def q_score_tfidf(spark, sf_dir):
    return _best(_scores(spark, sf_dir, False), "tfidf").select("query_id", "doc_id", F.round("tfidf", SCORE_ROUND).alias("tfidf"))


def q_score_bm25(spark, sf_dir):
    return _best(_scores(spark, sf_dir, False), "bm25").select(
        "query_id", "doc_id", F.round("bm25", SCORE_ROUND).alias("bm25"))


def q_pagerank_boost(spark, sf_dir):
    return _best(_scores(spark, sf_dir), "tfidf_boosted").select(
        "query_id", "doc_id", F.round("pr", 9).alias("pr"),
        F.round("tfidf_boosted", SCORE_ROUND).alias("tfidf_boosted"))


def q_score_combined(spark, sf_dir):
    return _best(_scores(spark, sf_dir), "score").select(
        "query_id", "doc_id", F.round("score", SCORE_ROUND).alias("score"))


def q_top_n(spark, sf_dir):
    best = top_n(_scores(spark, sf_dir), 10)
    return best.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id",
                       F.round("score", SCORE_ROUND).alias("score"))


def q_search(spark, sf_dir):
    return _result_columns(search(benchmark_queries(spark, sf_dir), _index(spark, sf_dir), pages_rank(spark, sf_dir)))


def _result_columns(res: DataFrame) -> DataFrame:
    return res.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "title",
                      F.round("score", SCORE_ROUND).alias("score"))


def q_search_stored(spark, sf_dir):
    """The same search over an index written and opened again, ranks joined from their own table."""
    idx = write_index(corpus(spark, sf_dir), _scratch(spark, "index"), min_df=MIN_DF)
    ranks = write_ranks(pages_rank(spark, sf_dir), _scratch(spark, "ranks"))
    return _result_columns(search(benchmark_queries(spark, sf_dir), idx, ranks))


def q_search_stored_ranks(spark, sf_dir):
    """The same search over an index whose postings carry their document's rank."""
    idx = write_index(corpus(spark, sf_dir), _scratch(spark, "index"), min_df=MIN_DF,
                      pagerank=pages_rank(spark, sf_dir))
    return _result_columns(search(benchmark_queries(spark, sf_dir), idx))


def q_search_pruned(spark, sf_dir):
    """The same search without scoring what upper bounds keep out of the best 100."""
    idx = write_index(corpus(spark, sf_dir), _scratch(spark, "index"), min_df=MIN_DF,
                      pagerank=pages_rank(spark, sf_dir), block_size=1024)
    return _result_columns(search(benchmark_queries(spark, sf_dir), idx, prune=True))


def q_pagerank_roundtrip(spark, sf_dir):
    ranks = write_ranks(pages_rank(spark, sf_dir), _scratch(spark, "ranks"))
    return ranks.select("id", F.round("pagerank", 9).alias("pagerank"))


def q_search_empty(spark, sf_dir):
    """Rows returned for three variants of every benchmark item: its text, the
    stop words it contains (nothing left after stop-word removal), and nothing."""
    bench = table(spark, sf_dir, "benchmark")
    stops_only = F.array_join(F.filter(raw_tokens("text"), lambda t: is_stop_word(t)), " ")
    variants = bench.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.array(
        F.struct(F.lit("text").alias("variant"), F.col("text").alias("q")),
        F.struct(F.lit("stop_words").alias("variant"), stops_only.alias("q")),
        F.struct(F.lit("empty").alias("variant"), F.lit("").alias("q")),
    )).alias("v")).select("item_id", "v.variant", "v.q")
    queries = variants.select(
        (F.col("item_id") * 3 + F.when(F.col("variant") == "text", 0).when(F.col("variant") == "stop_words", 1)
         .otherwise(2)).alias("query_id"), "item_id", "variant", F.col("q").alias("query"))
    res = search(queries.select("query_id", "query"), _index(spark, sf_dir), None, with_titles=False)
    counts = res.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_results"))
    return queries.join(counts, "query_id", "left").select(
        "item_id", "variant", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"))


# ---------------------------------------------------------------- evaluation

def _eval_inputs(spark, sf_dir):
    return benchmark_queries(spark, sf_dir), q_search_stored_ranks(spark, sf_dir), qrels(spark, sf_dir)


def q_precision_at_k(spark, sf_dir):
    return ev.precision_at_k(*_eval_inputs(spark, sf_dir), k=5)


def q_recall_at_k(spark, sf_dir):
    return ev.recall_at_k(*_eval_inputs(spark, sf_dir), k=30)


def q_f1_at_k(spark, sf_dir):
    return ev.f1_at_k(*_eval_inputs(spark, sf_dir), k=30)


def q_results_quality(spark, sf_dir):
    return ev.results_quality(*_eval_inputs(spark, sf_dir))


def q_average_precision(spark, sf_dir):
    return ev.average_precision(*_eval_inputs(spark, sf_dir), k=40)


def q_overlap_at_40(spark, sf_dir):
    return ev.overlap_at_k(*_eval_inputs(spark, sf_dir), k=40)


def q_query_report(spark, sf_dir):
    return ev.query_report(*_eval_inputs(spark, sf_dir))


def q_report_details(spark, sf_dir):
    return ev.report_details(*_eval_inputs(spark, sf_dir))


def q_debug_query(spark, sf_dir):
    return ev.debug_query(*_eval_inputs(spark, sf_dir))


def q_train_val_split(spark, sf_dir):
    return ev.train_val_split(benchmark_queries(spark, sf_dir))


def q_mean_quality(spark, sf_dir):
    queries, found, truth = _eval_inputs(spark, sf_dir)
    return ev.mean_quality(ev.query_report(queries, found, truth), ev.train_val_split(queries))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "corpus_scan": q_corpus_scan,
    "titles": q_titles,
    "corpus_stats": q_corpus_stats,
    "doc_lengths": q_doc_lengths,
    "tokenize": q_tokenize,
    "term_counts": q_term_counts,
    "doc_freq": q_doc_freq,
    "term_stats": q_term_stats,
    "min_df_filter": q_min_df_filter,
    "vocab_size": q_vocab_size,
    "term_sample": q_term_sample,
    "title_preview": q_title_preview,
    "posting_lists": q_posting_lists,
    "term_buckets": q_term_buckets,
    "index_roundtrip": q_index_roundtrip,
    "posting_lookup": q_posting_lookup,
    "index_append": q_index_append,
    "index_append_cut": q_index_append_cut,
    "stream_index": q_stream_index,
    "qrels_explode": q_qrels_explode,
    "qrels_files": q_qrels_files,
    "link_edges": q_link_edges,
    "link_edges_files": q_link_edges_files,
    "link_vertices": q_link_vertices,
    "pagerank": q_pagerank,
    "pagerank_links": q_pagerank_links,
    "pagerank_preview": q_pagerank_preview,
    "query_terms": q_query_terms,
    "idf": q_idf,
    "score_tfidf": q_score_tfidf,
    "score_bm25": q_score_bm25,
    "pagerank_boost": q_pagerank_boost,
    "score_combined": q_score_combined,
    "top_n": q_top_n,
    "search": q_search,
    "search_stored": q_search_stored,
    "search_stored_ranks": q_search_stored_ranks,
    "search_pruned": q_search_pruned,
    "pagerank_roundtrip": q_pagerank_roundtrip,
    "search_empty": q_search_empty,
    "precision_at_k": q_precision_at_k,
    "recall_at_k": q_recall_at_k,
    "f1_at_k": q_f1_at_k,
    "results_quality": q_results_quality,
    "average_precision": q_average_precision,
    "overlap_at_40": q_overlap_at_40,
    "query_report": q_query_report,
    "report_details": q_report_details,
    "debug_query": q_debug_query,
    "train_val_split": q_train_val_split,
    "mean_quality": q_mean_quality,
}
