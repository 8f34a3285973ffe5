"""Corpus and relevance-set sources, and the small corpus-level sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.functions.text import title_of, whitespace_word_count


def read_corpus(spark: SparkSession, *paths: str, glob: str = "*.parquet") -> DataFrame:
    """Scan a parquet corpus from one or more folders or files.

    Folders are listed with ``pathGlobFilter`` so stray non-parquet objects in
    the same folder are skipped.
    """
    return spark.read.option("pathGlobFilter", glob).parquet(*paths)


def corpus_from_documents(documents: DataFrame) -> DataFrame:
    """Normalise the driver ``documents`` table to ``doc_id, title, text`` (title: the text's first line)."""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        title_of("text").alias("title"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def corpus_from_pages(pages: DataFrame) -> DataFrame:
    """Normalise a reference-style corpus ``id, title, text`` to ``doc_id, title, text``."""
    return pages.select(
        F.col("id").cast("long").alias("doc_id"),
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def corpus_from_tokens(tokens: DataFrame) -> DataFrame:
    """A corpus that is tokenized already: ``doc_id, tokens`` (and ``title``, if there is one).

    Tokens are taken as they are, without stop words or lower case; null tokens drop out.
    """
    title = F.coalesce("title", F.lit("")) if "title" in tokens.columns else F.lit("")
    kept = F.array_compact(F.coalesce("tokens", F.array().cast("array<string>")))
    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), title.alias("title"), kept.alias("tokens"))


def doc_len(corpus: DataFrame) -> Column:
    """Length of each row: its tokens, or the whitespace words of its text."""
    return F.size("tokens").cast("long") if "tokens" in corpus.columns else whitespace_word_count("text")


def titles(corpus: DataFrame) -> DataFrame:
    """``doc_id, title``: one title per id (the smallest, so duplicates resolve deterministically)."""
    return corpus.groupBy("doc_id").agg(F.min("title").alias("title"))


def doc_lengths(corpus: DataFrame) -> DataFrame:
    """``doc_id, doc_len``: the length of each row."""
    return corpus.select("doc_id", doc_len(corpus).alias("doc_len"))


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """One row ``n_docs, avg_dl, n_rows, total_len``.

    ``n_docs`` counts distinct ids (the N of idf); ``avg_dl`` is the mean
    whitespace length of the text rows.  ``n_rows`` and ``total_len`` make the
    mean additive when documents are appended.
    """
    stats = corpus.agg(
        F.countDistinct("doc_id").alias("n_docs"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(doc_len(corpus)).alias("total_len"),
    )
    return stats.select(
        "n_docs",
        (F.col("total_len") / F.col("n_rows")).alias("avg_dl"),
        "n_rows",
        F.coalesce("total_len", F.lit(0)).alias("total_len"),
    )


RELEVANCE_SCHEMA = "map<string,array<string>>"


def relevance_from_json_column(json_col: str, df: DataFrame) -> DataFrame:
    """Explode JSON objects ``{query: [doc ids as strings]}`` into ``query, doc_id``."""
    parsed = df.select(F.explode(F.from_json(F.col(json_col), RELEVANCE_SCHEMA)).alias("query", "ids"))
    return parsed.select("query", F.explode("ids").alias("doc_id")).select(
        "query", F.col("doc_id").cast("long").alias("doc_id")
    )


def read_relevance_json(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """Relevance set ``query, doc_id`` from JSON.

    ``whole_file=True`` reads files holding one object each (the query-set
    format); ``False`` reads JSON Lines, one object per line, which splits
    across tasks for large sets.
    """
    raw = spark.read.text(path, wholetext=whole_file)
    return relevance_from_json_column("value", raw)
