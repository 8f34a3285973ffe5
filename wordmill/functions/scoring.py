"""Scalar scoring expressions: idf variants, boost, staged metric rounding."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def tfidf_idf(n_docs: Column, df: Column) -> Column:
    """``log10(N / df)``."""
    return F.log10(n_docs.cast("double") / df)


def bm25_idf(n_docs: Column, df: Column) -> Column:
    """``log10((N - df + 0.5) / (df + 0.5))``; negative when df > N/2 (kept)."""
    return F.log10((n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def bm25_term(idf: Column, tf: Column, k1: float = 1.5, length_factor: Column | float = 1.0) -> Column:
    """One BM25 summand ``idf * (k1+1) tf / (k1 B + tf)``; ``B`` is the length factor."""
    lf = length_factor if isinstance(length_factor, Column) else F.lit(float(length_factor))
    return idf * F.lit(k1 + 1.0) * tf / (F.lit(k1) * lf + tf)


# Binary places kept of a summand: 3e-14, and no overflow below half a million summands a group.
SUM_BITS = 44


def order_free_sum(x: Column) -> Column:
    """Sum of doubles that is the same in any order, so also for any partitioning.

    Each summand is split at the binary point, and both halves are summed as whole
    numbers, exactly; only the summand's bits below ``SUM_BITS`` are rounded away.
    """
    whole = F.floor(x)
    part = F.rint((x - whole) * F.lit(2.0 ** SUM_BITS)).cast("long")
    return F.sum(whole).cast("double") + F.sum(part).cast("double") / F.lit(2.0 ** SUM_BITS)


def pagerank_factor(pagerank: Column, weight: float = 0.1) -> Column:
    """TF-IDF boost ``1 + weight * log10(pr + 1)``; missing rank counts as 0."""
    return F.lit(1.0) + F.lit(weight) * F.log10(F.coalesce(pagerank, F.lit(0.0)) + F.lit(1.0))


# Three-place ties q / 2000 (odd q) that Python does not round to the even
# neighbour, because the double nearest to the tie lies off it.
OFF_TIES = [q for q in range(1, 2000, 2)
            if round(q / 2000, 3) != float((Decimal(q) / 2000).quantize(Decimal("0.001"), ROUND_HALF_EVEN))]


def round3(x: Column) -> Column:
    """Python's ``round(x, 3)`` on metric values in [0, 1].

    Half to even, but for the ties in ``OFF_TIES``: there the other neighbour
    (both add up to twice the tie).
    """
    def rounded(v: Column) -> Column:
        even, q = F.bround(v, 3), F.round(v * 2000)
        off = (q / 2000 == v) & q.cast("int").isin(OFF_TIES)
        return F.when(off, F.bround(q / 1000 - even, 3)).otherwise(even)

    # Bound once, so that nested metrics do not multiply the expression.
    return F.element_at(F.transform(F.array(x), rounded), 1)


def harmonic_or_zero(a: Column, b: Column) -> Column:
    """``0`` if either input is 0, else ``2 / (1/a + 1/b)`` rounded to 3 places."""
    return F.when((a == 0.0) | (b == 0.0), F.lit(0.0)).otherwise(
        round3(F.lit(2.0) / (F.lit(1.0) / a + F.lit(1.0) / b))
    )
