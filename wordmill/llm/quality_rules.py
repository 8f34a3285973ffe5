"""Quality rules by cross-document line frequency (DataFrame functions only).

A line that very many different documents of one host (``source``) carry is
boilerplate.  Lines are normalised and hashed, the distinct documents that hold
each of them are counted per host, lines above the limits are removed, and a
document is rejected when it is depleted, that is when the removed lines held
more than a given share of its words.  In-row rules (too few words, repeated
three-word windows) reject documents on their own.

Defined results
* null text counts as empty; empty and very short texts fail the in-row rules.
* null host is a host of its own; null ids sort last among documents.
* Documents of one host with the same text count once towards a line's count,
  and the first document of the host that holds a line (smallest id) keeps it,
  so no content is lost altogether.  Rows that repeat id, host and text share
  one verdict and all stay.
* A line on the limit is removed (the limits are inclusive).
* The share of a host's documents counts only up to ``MAX_LINE_DOCS``: the limit
  of a large host does not grow with it.
* Empty tables give empty results; other columns, whatever their names, pass
  through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import NOT_SPACE, SPACE, let, materialize, text_of, without_positions, words

MIN_WORDS = 50          # fewer words: rejected
MAX_REPEAT_PCT = 50     # more than this share of words in repeated windows: rejected
MIN_LINE_DOCS = 5       # a boilerplate line is in at least so many distinct documents of its host
MIN_LINE_PCT = 5        # ... and in at least this share of them
MAX_LINE_DOCS = 50      # ... but in so many it is boilerplate whatever the share
MAX_REMOVED_PCT = 50    # more than this share of words in removed lines: depleted


def count_repeat_words(w: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the array ``w``.

    Every window becomes one long: the high bits of its hash, the low bits its
    position.  Sorted, equal windows are neighbours; neighbours whose high bits
    agree are compared word by word, so hash collisions do not count.
    """
    none = F.lit(0).cast("long")

    def of(w: Column) -> Column:
        n = F.size(w)
        low = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("long")
        return let(F.struct(w.alias("w"), low.alias("m")), lambda s: windows(s["w"], s["m"]))

    def windows(w: Column, m: Column) -> Column:
        codes = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(-m)
            .bitwiseOR(i.cast("long")))
        return let(F.sort_array(codes), lambda s: covered(starts(w, m, s)))

    def same(w: Column, m: Column, a: Column, b: Column) -> Column:
        i, j = a.bitwiseAND(m - 1).cast("int"), b.bitwiseAND(m - 1).cast("int")
        equal = F.lit(True)
        for o in range(3):
            equal = equal & (F.get(w, i + o) == F.get(w, j + o))
        return F.coalesce((a.bitwiseAND(-m) == b.bitwiseAND(-m)) & equal, F.lit(False))

    def starts(w: Column, m: Column, s: Column) -> Column:
        hit = F.filter(s, lambda x, k: same(w, m, x, F.get(s, k - 1)) | same(w, m, x, F.get(s, k + 1)))
        return F.sort_array(F.transform(hit, lambda x: x.bitwiseAND(m - 1)))

    def covered(p: Column) -> Column:
        return let(p, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3).cast("long"),
                                                F.coalesce(F.get(p, k + 1) - x, F.lit(3).cast("long")))),
            none, lambda a, b: a + b))

    return let(w, lambda w: F.when(F.size(w) < 4, none).otherwise(of(w)))


def text_stats(text: Column) -> Column:
    """Struct of the in-row figures of a text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    return let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        count_repeat_words(w).alias("n_repeat_words")))


def fails_rules(stats: Column, min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT) -> Column:
    return (stats["n_words"] < min_words) | (
        stats["n_repeat_words"] * 100 > stats["n_words"] * max_repeat_pct)


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), SPACE, " "), "[0-9]", "0"))


def _lines(keyed: DataFrame) -> DataFrame:
    """``_id, _host, _key, _pos, _line, _n``: each non-blank line's normalised hash and word count."""
    each = keyed.select("_id", "_host", "_key", F.posexplode(F.split("_text", "\n")).alias("_pos", "_raw")) \
        .where(F.col("_raw").rlike(NOT_SPACE))
    return each.select("_id", "_host", "_key", "_pos", F.xxhash64(normal_line(F.col("_raw"))).alias("_line"),
                       F.size(words(F.col("_raw"))).cast("long").alias("_n"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    # The whole input row is kept in one struct, so that its names cannot clash.
    return docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(host_col).alias("_host"),
                       text_of(text_col).alias("_text")) \
        .withColumn("_key", F.xxhash64("_text"))


def boilerplate_lines(keyed: DataFrame, min_docs: int, min_pct: int, max_docs: int) -> DataFrame:
    """``_host, _line, _first``: lines above the limits of their host and the document that keeps them.

    Counting is two partial aggregations: first per (host, line, text), which
    folds equal documents, then per (host, line).  No group is ever collected.
    """
    per_text = _lines(keyed).groupBy("_host", "_line", "_key").agg(F.min("_id").alias("_id"))
    per_line = per_text.groupBy("_host", "_line").agg(
        F.count(F.lit(1)).alias("_docs"), F.min(F.struct(F.col("_id").isNull(), "_id", "_key")).alias("_first"))
    hosts = keyed.groupBy("_host", "_key").agg(F.lit(1).alias("_one")) \
        .groupBy("_host").agg(F.count(F.lit(1)).alias("_host_docs"))
    often = per_line.where(F.col("_docs") >= min_docs).alias("l").join(
        hosts.alias("h"), F.col("l._host").eqNullSafe(F.col("h._host")))
    share = F.least(F.col("_host_docs") * min_pct, F.lit(max_docs * 100))
    return often.where(F.col("_docs") * 100 >= share) \
        .select(F.col("l._host").alias("_host"), "_line", "_first")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  min_docs: int = MIN_LINE_DOCS, min_pct: int = MIN_LINE_PCT,
                  max_docs: int = MAX_LINE_DOCS) -> DataFrame:
    """``_id, _host, _key, _pos, _n``: every line occurrence that the limits remove."""
    keyed = _keyed(docs, id_col, text_col, host_col).drop("_row")
    limits = materialize(boilerplate_lines(keyed, min_docs, min_pct, max_docs), "lines")
    lines = _lines(keyed)
    hit = lines.alias("l").join(limits.alias("b"), (F.col("l._line") == F.col("b._line"))
                                & F.col("l._host").eqNullSafe(F.col("b._host")))
    keeps = F.col("l._id").eqNullSafe(F.col("_first._id")) & (F.col("l._key") == F.col("_first._key"))
    # The same row given twice yields each position twice; it counts once.
    return hit.where(~keeps).select("l._id", "l._host", "l._key", "l._pos", "l._n")


def _verdict(stats: Column, removed_words: Column, max_removed_pct: int) -> Column:
    return ~fails_rules(stats) & (removed_words * 100 <= stats["n_words"] * max_removed_pct)


def _match(left: str, right: str) -> Column:
    return (F.col(f"{left}._key") == F.col(f"{right}._key")) & \
        F.col(f"{left}._id").eqNullSafe(F.col(f"{right}._id")) & \
        F.col(f"{left}._host").eqNullSafe(F.col(f"{right}._host"))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                   min_docs: int = MIN_LINE_DOCS, min_pct: int = MIN_LINE_PCT,
                   max_removed_pct: int = MAX_REMOVED_PCT, max_docs: int = MAX_LINE_DOCS) -> DataFrame:
    """One row per document: id, in-row figures, words in removed lines, and the verdict ``kept``."""
    gone = removed_lines(docs, id_col, text_col, host_col, min_docs, min_pct, max_docs)
    removed = gone.groupBy("_id", "_host", "_key", "_pos").agg(F.first("_n").alias("_n")) \
        .groupBy("_id", "_host", "_key").agg(F.sum("_n").alias("_removed"))
    keyed = _keyed(docs, id_col, text_col, host_col)
    stats = keyed.select("_id", "_host", "_key", text_stats(F.col("_text")).alias("_s"))
    out = stats.alias("d").join(removed.alias("r"), _match("d", "r"), "left")
    n = F.coalesce("_removed", F.lit(0).cast("long"))
    return out.select(F.col("d._id").alias(id_col), "_s.*", fails_rules(F.col("_s")).alias("base_failed"),
                      n.alias("removed_words"), _verdict(F.col("_s"), n, max_removed_pct).alias("kept"))


def apply_quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                        chars_col: str | None = None, min_docs: int = MIN_LINE_DOCS, min_pct: int = MIN_LINE_PCT,
                        max_removed_pct: int = MAX_REMOVED_PCT, max_docs: int = MAX_LINE_DOCS) -> DataFrame:
    """The documents that pass, in their own columns, without the removed lines.

    ``chars_col``, if given, is set to the length of the new text.  Texts that
    lose no line stay byte for byte as they were.
    """
    gone = removed_lines(docs, id_col, text_col, host_col, min_docs, min_pct, max_docs)
    # A document's own removed positions: never more than it has lines.
    cut = gone.groupBy("_id", "_host", "_key", "_pos").agg(F.first("_n").alias("_n")) \
        .groupBy("_id", "_host", "_key").agg(F.sum("_n").alias("_removed"),
                                             F.sort_array(F.collect_list("_pos")).alias("_cut"))
    keyed = _keyed(docs, id_col, text_col, host_col)
    rows = keyed.where(~fails_rules(text_stats(F.col("_text")))).alias("d").join(cut.alias("r"), _match("d", "r"),
                                                                                "left")
    n_words = F.size(words(F.col("_text")))
    rows = rows.where(F.col("_removed").isNull() | (F.col("_removed") * 100 <= n_words * max_removed_pct))

    clean = F.when(F.col("_cut").isNull(), F.col(f"_row.`{text_col}`")).otherwise(
        F.array_join(let(F.split("_text", "\n"), lambda x: without_positions(x, F.col("_cut"))), "\n"))
    changed = {text_col: clean}
    if chars_col:
        changed[chars_col] = F.when(F.col("_cut").isNull(), F.col(f"_row.`{chars_col}`")).otherwise(
            F.length(clean).cast(docs.schema[chars_col].dataType))
    return rows.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
