"""Relevance judgements from passages: a document is relevant to a passage
query iff its text contains the passage verbatim.

No cross join: if text T contains passage P, every token of P that lies
strictly between P's first and last whitespace is also a token of T (the
tokenizer restarts after whitespace, and whitespace bounds the token on both
sides).  So each passage picks its few rarest such *interior* tokens as
anchors; candidates are the documents holding all of them (an equi-join of
anchors with the documents' terms plus a per-document count), and only
candidates are checked with ``contains``.  Passages without an interior token
(at most two words, or only stop words inside) find their candidates by an
equi-join on their first ``RUN`` characters, which a containing text has as a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.functions.text import TOKEN_PATTERN_JAVA, is_stop_word
from wordmill.operators.indexing import term_counts
from wordmill.operators.joins import DEFAULT_BROADCAST_BYTES, bounded_broadcast
from wordmill.session import stored, stored_meanwhile

_WS = r"\t\n\x0B\f\r "
INTERIOR = rf"(?s)^[^{_WS}]*[{_WS}](.*)[{_WS}][^{_WS}]*$"


def interior_terms(passages: DataFrame) -> DataFrame:
    """``query_id, term``: distinct non-stop tokens strictly inside each passage."""
    inner = F.regexp_extract(F.lower(F.coalesce(F.col("passage"), F.lit(""))), INTERIOR, 1)
    toks = F.filter(F.regexp_extract_all(inner, F.lit(TOKEN_PATTERN_JAVA), 0), lambda t: ~is_stop_word(t))
    return passages.select("query_id", F.explode(F.array_distinct(toks)).alias("term"))


def passage_qrels(passages: DataFrame, corpus: DataFrame, vocabulary: DataFrame | None = None,
                  max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, anchors: int = 2) -> DataFrame:
    """``query_id, doc_id`` for every document whose text contains the query's passage.

    ``passages``: ``query_id, passage``; ``corpus``: ``doc_id, text``.  When a
    ``vocabulary`` (``term, df`` over all terms) is given it ranks anchors;
    otherwise document frequencies are computed for passage terms only.
    """
    inner = interior_terms(passages)
    wanted = bounded_broadcast(inner.select("term").distinct(), max_broadcast_bytes)
    found = term_counts(corpus).select("term", "doc_id").join(wanted, "term", "left_semi")
    texts = corpus.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    inner = bounded_broadcast(inner, max_broadcast_bytes)
    anchorless = passages.join(inner.select("query_id").distinct(), "query_id", "left_anti")
    short = _short_candidates(anchorless, texts, max_broadcast_bytes)
    # The passages' terms in the documents feed both the anchor statistics and the
    # candidate join; they are stored once instead of tokenizing the corpus twice.
    with stored_meanwhile(found, "passage-terms") as counts:
        if vocabulary is None:
            df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        else:
            df = vocabulary.join(wanted, "term", "left_semi").select("term", "df")
        # The ``anchors`` rarest interior terms per passage (a term absent from the
        # corpus has df 0, which correctly yields no candidates).  A containing
        # document has all of them, so candidates are documents matching every
        # anchor of the passage: a conjunctive filter, far tighter than one term.
        ranked = inner.join(df, "term", "left").select(
            "query_id", "term", F.coalesce("df", F.lit(0)).alias("df"))
        picked = ranked.groupBy("query_id").agg(
            F.slice(F.array_sort(F.collect_list(F.struct("df", "term"))), 1, anchors).alias("a"))
        chosen = picked.select("query_id", F.size("a").alias("n_anchors"), F.explode("a").alias("x")).select(
            "query_id", "n_anchors", F.col("x.term").alias("term"))
        chosen = bounded_broadcast(chosen, max_broadcast_bytes)
        # Distinct anchors per document (at most ``anchors`` terms), so repeated
        # document ids cannot fake or hide a full match.
        hits = counts.join(chosen, "term").groupBy("query_id", "doc_id").agg(
            F.size(F.collect_set("term")).alias("n"), F.first("n_anchors").alias("n_anchors"))
        candidates = hits.where(F.col("n") == F.col("n_anchors")).select("query_id", "doc_id")
        candidates = stored(candidates if short is None else candidates.unionByName(short), "candidates").distinct()
    # Texts are filtered by the candidates' ids before any passage is attached to them.
    ids = bounded_broadcast(candidates.select("doc_id").distinct(), max_broadcast_bytes)
    pairs = texts.join(ids, "doc_id", "left_semi").join(candidates, "doc_id")
    matched = pairs.join(passages.select("query_id", F.coalesce("passage", F.lit("")).alias("passage")), "query_id") \
        .where(F.col("text").contains(F.col("passage")))
    return stored(matched.select("query_id", "doc_id").distinct(), "qrels")


RUN = 8  # characters of a short passage that a text must have for the two to be compared


def _runs(chars: Column, width: int) -> Column:
    """All runs of ``width`` characters."""
    if not width:
        return F.array(F.lit(""))
    none = F.array().cast("array<string>")
    return F.when(F.size(chars) >= width, F.transform(
        F.sequence(F.lit(1), F.size(chars) - width + 1),
        lambda i: F.array_join(F.slice(chars, i, F.lit(width)), ""))).otherwise(none)


def _short_candidates(short: DataFrame, texts: DataFrame, max_broadcast_bytes: int) -> DataFrame | None:
    """``query_id, doc_id`` of the texts that hold the first ``RUN`` characters of a passage; None without passages.

    Runs leave a text one by one, with nothing but its id, and meet the (checked)
    broadcast of the passages' runs in the same stage.
    """
    first = F.substring(F.coalesce("passage", F.lit("")), 1, RUN)
    wanted = stored(short.select("query_id", first.alias("run")), "short")
    widths = sorted(r[0] for r in wanted.select(F.length("run")).distinct().collect())  # at most RUN + 1 values
    if not widths:
        return None
    # The characters are split once per text: an array of one, so the lambda gets them computed.
    runs = F.flatten(F.transform(F.array(F.split("text", "")), lambda c: F.array_distinct(
        F.flatten(F.array(*[_runs(c, w) for w in widths])))))
    return texts.select("doc_id", F.explode(runs).alias("run")).join(
        bounded_broadcast(wanted, max_broadcast_bytes), "run").select("query_id", "doc_id")
