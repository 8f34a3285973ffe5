"""Mixing sources to target weights (DataFrame functions only).

Iterative proportional fitting: the token weights of the (source, language,
topic) cells are scaled to the target totals of each source, each language and
each topic in turn, until every total agrees with its target.  A cell never
weighs more than the tokens it has, so nothing need be repeated: what is scaled
is its unbounded weight, of which up to its tokens count, and the scale of a
value is what its cells below their tokens need to make up the rest.  A document
is then kept with the probability weight / tokens of its cell, decided by a hash
of its id.

Without given targets, a margin's targets are its token shares to the power
``temper`` (large sources count less than in proportion), out of ``fraction``
of all tokens.  No target is above ``MAX_RATE`` of the value's own tokens, given
or not: what is cut there goes to the other values by their shares.  Targets that
each margin can meet may still not be met together; then the sweeps end at
``MAX_SWEEPS``, and ``margins`` shows what is missing.

Defined results: null source and language are values of their own; null text has
no words; a cell without words is kept whole; rows that repeat an id share its
decision (null ids share one); other columns pass through ``mix`` untouched;
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import materialize, text_of, words

FRACTION = 0.8
TEMPER = 0.7
MAX_RATE = 0.95    # of a value's tokens, at most
TOLERANCE = 0.002  # of a target: largest difference of a total when the sweeps end
MAX_SWEEPS = 60
STEP = 2.0         # a value's weights change by this factor at most, or by what its total lacks
SEED = "mix-1"
MARGINS = ("_source", "_lang", "_topic")


def topic_of(text: Column) -> Column:
    """A coarse topic by form: tables, emphasis and symbols, figures, or prose."""
    return F.when(text.contains("|"), "table").when(text.rlike("[!#$%&*]{2}"), "emphatic") \
        .when(text.rlike("[0-9]"), "figures").otherwise("prose")


def _measured(docs: DataFrame, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.struct("*").alias("_row"), F.col(source_col).alias("_source"),
                       F.col(lang_col).alias("_lang"), topic_of(text).alias("_topic"),
                       F.size(words(text)).cast("long").alias("_tokens"))


def _on(left: str, right: str, keys: tuple[str, ...]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def _targets(cells: DataFrame, margin: str, fraction: float, temper: float,
             given: dict[str | None, float] | None) -> DataFrame:
    """``margin, target``: tokens wanted of each value, none above ``MAX_RATE`` of its own."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("s"))
    if given is not None:
        share = F.lit(0.0)
        for value, wanted in given.items():
            share = F.when(F.col(margin).eqNullSafe(F.lit(value)), F.lit(float(wanted))).otherwise(share)
    else:
        share = F.pow("s", F.lit(temper))
    raw = materialize(sums.select(margin, (F.col("s") * MAX_RATE).alias("most"), share.alias("r")), "targets")
    wanted = (raw.agg(F.sum("most")).first()[0] or 0.0) / MAX_RATE * fraction
    # Tokens per share: what the values at their most leave, over the shares of the others, until none is added.
    level, last = 0.0, None
    while level != last:
        over = F.col("r") * F.lit(level) > F.col("most")
        taken, shares = raw.agg(F.sum(F.when(over, F.col("most")).otherwise(0.0)),
                                F.sum(F.when(over, 0.0).otherwise(F.col("r")))).first()
        last, level = level, max(level, (wanted - taken) / shares) if shares else level
    return raw.select(margin, F.least(F.col("r") * F.lit(level), "most").alias(f"target{margin}"))


def _scale(goal: Column) -> Column:
    """The factor of a value's weights, from the tokens of its cells at their most (``full``) and the rest (``free``)."""
    total = F.col("full") + F.col("free")
    even = F.try_divide(goal, total)
    step = F.when((goal > F.col("full")) & (F.col("free") > 0), (goal - F.col("full")) / F.col("free")).otherwise(even)
    bounded = F.least(F.greatest(step, F.least(F.lit(1 / STEP), even)), F.greatest(F.lit(STEP), even))
    return F.when((total > 0) & (goal > 0), bounded).otherwise(0.0)


def _totals(state: DataFrame) -> DataFrame:
    """``margin, value, tokens, target, weight`` of every value of every margin."""
    weight = F.least("weight", F.col("tokens").cast("double"))
    each = [state.groupBy(m).agg(F.sum("tokens").alias("tokens"), F.first(f"target{m}").alias("target"),
                                 F.sum(weight).alias("weight"))
            .select(F.lit(m.lstrip("_")).alias("margin"), F.col(m).cast("string").alias("value"), "tokens", "target", "weight")
            for m in MARGINS]
    return each[0].unionByName(each[1]).unionByName(each[2])


def _rake(measured: DataFrame, fraction: float = FRACTION, temper: float = TEMPER, max_sweeps: int = MAX_SWEEPS,
          tolerance: float = TOLERANCE, targets: dict[str, dict] | None = None) -> DataFrame:
    """The cells with their targets and unbounded weights."""
    cells = materialize(measured.groupBy(*MARGINS).agg(F.sum("_tokens").alias("tokens")), "cells")
    state = cells.withColumn("weight", F.col("tokens").cast("double"))
    for m in MARGINS:
        goal = _targets(cells, m, fraction, temper, (targets or {}).get(m.lstrip("_")))
        state = state.alias("c").join(goal.alias("g"), _on("c", "g", (m,))).select("c.*", f"target{m}")
    state = materialize(state, "cells")
    full = F.col("weight") >= F.col("tokens")
    for _ in range(max_sweeps):
        for m in MARGINS:
            sums = state.groupBy(m).agg(F.sum(F.when(full, F.col("tokens").cast("double")).otherwise(0.0)).alias("full"),
                                        F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free"))
            state = state.alias("c").join(sums.alias("s"), _on("c", "s", (m,))).select(
                *[F.col(f"c.{c}").alias(c) for c in state.columns if c != "weight"],
                (F.col("weight") * _scale(F.col(f"target{m}"))).alias("weight"))
        state = materialize(state, "cells")
        error = _totals(state).where("target > 0").agg(F.max(F.abs(F.col("weight") - F.col("target")) / F.col("target")))
        if (error.first()[0] or 0.0) <= tolerance:
            break
    return state


def fit_cells(measured: DataFrame, **fit) -> DataFrame:
    """``_source, _lang, _topic, tokens, weight``: the raked weight of every cell."""
    return _rake(measured, **fit).select(*MARGINS, "tokens", F.least("weight", F.col("tokens").cast("double")).alias("weight"))


def margins(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", **fit) -> DataFrame:
    """``margin, value, tokens, target, weight, error`` of every source, language and topic.

    ``error`` is what the raked weight differs from the target, as a part of it (null for a target of 0).
    """
    totals = _totals(_rake(_measured(docs, text_col, source_col, lang_col), **fit))
    return totals.withColumn("error", F.when(F.col("target") > 0, (F.col("weight") - F.col("target")) / F.col("target")))


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by the id: the leading 52 bits of its digest."""
    text = F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16 ** 13)


def probabilities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  lang_col: str = "lang", seed: str = SEED, **fit) -> DataFrame:
    """``_row, _source, _lang, _topic, _tokens, probability, kept`` of every document."""
    measured = _measured(docs, text_col, source_col, lang_col)
    cells = fit_cells(measured, **fit)
    p = F.when(F.col("tokens") > 0, F.least(F.col("weight") / F.col("tokens"), F.lit(1.0))).otherwise(1.0)
    joined = measured.alias("d").join(cells.alias("f"), _on("d", "f", MARGINS))
    return joined.select("_row", *[F.col(f"d.{m}").alias(m) for m in MARGINS], "_tokens", p.alias("probability")) \
        .withColumn("kept", uniform(F.col(f"_row.`{id_col}`"), seed) < F.col("probability"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents, in their own columns."""
    return probabilities(docs, **options).where("kept").select("_row.*")
