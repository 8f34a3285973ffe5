"""A corpus pipeline over ``documents``: each stage applies one operator of ``wordmill.llm``.

A stage takes ``(spark, docs, sf_dir)`` and works on all documents its
predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordmill.llm.common import materialize, prepare, scratch_path
from wordmill.llm.decontaminate import remove_contaminated
from wordmill.llm.jaccard_join import keep_one
from wordmill.llm.mix_sources import mix
from wordmill.llm.quality_rules import apply_quality_rules
from wordmill.llm.queries import tokenizer_path
from wordmill.llm.token_files import read_documents, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules or are depleted go; boilerplate lines go from the rest."""
    return apply_quality_rules(docs, chars_col="n_chars" if "n_chars" in docs.columns else None)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links join (five-word shingles, similarity 0.8), the first stays."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by the raked weight of their source, language and topic."""
    return mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files are written; each document's place, length and checksum are read back from them."""
    path = scratch_path(docs, "tokens")
    write_tokens(docs, path, tokenizer_path(), end_id=0)
    return read_documents(spark, path)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", one_of_each),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_files", token_files),
]

# Token ids have no SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's result written as Parquet and read again by the next."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
