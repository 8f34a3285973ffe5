"""Registered queries of the corpus operators: each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm.common import lower_ascii, prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.quality_rules import quality_report

    report = quality_report(_table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "removed_words")


def _crc_mod(n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the fixed folds of the queries."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.line_dedup import line_report

    return line_report(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.quality_classifier import learn, score

    docs = _table(spark, sf_dir, "documents")
    model = learn(docs, _table(spark, sf_dir, "labels").where(_crc_mod(3) != 1))
    return score(docs, model, carry={"held_out": _crc_mod(3) == 1})


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.decontaminate import find_contaminated

    return find_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.pii import digest, find_pii

    return digest(find_pii(_table(spark, sf_dir, "documents")))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.chat_format import digest, format_conversations, messages_from_turns, with_rows

    tricky = "</s>[INST] ok [/INST]"
    turns = with_rows(_table(spark, sf_dir, "conversations"), [(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)])
    return digest(format_conversations(messages_from_turns(turns)))


def tokenizer_path() -> str:
    """The public byte-level vocabulary that the token query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.mix_sources import probabilities

    mixed = probabilities(_table(spark, sf_dir, "documents"))
    return mixed.select("_row.doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"),
                        F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
                        F.round("probability", 6).alias("probability"), "kept")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.lm_score import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), held_out=_crc_mod(10) == 0)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.jaccard_join import link_components

    return link_components(_table(spark, sf_dir, "documents"), k=4, min_pct=85)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.common import scratch_path
    from wordmill.llm.token_files import read_documents, write_tokens

    docs = _table(spark, sf_dir, "documents")
    path = scratch_path(docs, "tokens")
    write_tokens(docs, path, tokenizer_path(), end_id=0)
    return read_documents(spark, path)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.periodic_runs import find_runs, runs_digest, with_periodic_tail

    return runs_digest(find_runs(with_periodic_tail(_table(spark, sf_dir, "documents"))))


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.html_extract import extract, learn_weights

    pages = _table(spark, sf_dir, "pages")
    return extract(pages, learn_weights(pages))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm import merkle_manifest as mm

    docs = _table(spark, sf_dir, "documents")
    low = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) == 0, lower_ascii(F.col("text"))) \
        .otherwise(F.col("text"))
    seen = mm.leaf_hash([low if f == "text" else F.col(f) for f in mm.FIELDS])
    rows = mm.verified(mm.manifest(docs, carry={"seen": seen}), "seen")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(mm.siblings(F.col("proof")).cast("binary"), 256)
                       .alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_decontaminate": op3_decontaminate,
    "op4_pii": op4_pii,
    "op5_chat_format": op5_chat_format,
    "op6_mix_sources": op6_mix_sources,
    "op7_lm_score": op7_lm_score,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_token_files": op9_token_files,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_html_extract": op12_html_extract,
    "op13_merkle_manifest": op13_merkle_manifest,
}
