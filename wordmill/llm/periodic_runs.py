"""Periodic run detection: repetitions of a block of words, by descending-LCP Kruskal.

A run is a stretch of words with smallest period q (words q apart are equal) of
at least ``min_length`` words and ``min_exponent`` periods that neither neighbour
extends.  Suffixes of a text that begin alike form classes.  The edges between
neighbours in suffix order are taken by decreasing common prefix; a union-find
joins their classes, each of which keeps its positions in order.  When positions
i < j become neighbours in their class at common prefix l, and j - i is at most l,
the words from i to j + l have period j - i: a seed.  For a run that starts at s,
s and s + q become neighbours at the very prefix that ends with the run (a position
between them would give a smaller period), so the leftmost seed of a period and an
end is the whole run, and no run is missed.

A text is one row and is worked on by one task.  Only positions whose first words
(as many as a run must repeat) come up again in the text enter the classes; a class
whose closest positions lie farther apart than its longest common prefix has no
seeds and is left out.  Both cuts are exact.

Defined results
* Words are compared as they are, with case; a null text has no words.
* Runs come by start, then period; the collapsed text keeps, of every run, the
  first period, and joins the words that stay by one space.
* Null ids, repeated ids and equal texts are rows like any other: one row out for
  each row in.  Empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import let, map_arrow, words

MIN_LENGTH = 6
MIN_EXPONENT = 4
CHUNK_CHARS = 2_000_000  # texts are worked on together up to this size
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def shortest_overlap(min_length: int, min_exponent: int) -> int:
    """The least common prefix of s and s + q over all runs: length less q, for the worst q."""
    return min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1))


def _shared_windows(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray, g: int) -> np.ndarray:
    """Positions whose g words may come up again in their text (equal hashes)."""
    n = len(ids) - g + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = (doc[:n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for t in range(g):
        h = (h ^ ids[t:t + n].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    inside = np.flatnonzero(np.arange(n) + g <= ends[doc[:n]])
    h = h[inside]
    s = np.sort(h)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    return inside[twice[at] == h]


def _dense(sorted_cols: list[np.ndarray]) -> np.ndarray:
    """True where a sorted row differs from the one before."""
    new = np.ones(len(sorted_cols[0]), bool)
    new[1:] = False
    for c in sorted_cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def suffix_edges(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray, g: int) -> tuple[np.ndarray, ...]:
    """``i, j, lcp, class`` for neighbours in suffix order that share at least ``g`` words of one text."""
    act = _shared_windows(ids, doc, ends, g)
    m = len(act)
    none = np.empty(0, np.int64)
    if m < 2:
        return none, none, none, none
    place = np.full(len(ids) + 1, -1, np.int64)
    place[act] = np.arange(m)
    cols = [doc[act]] + [ids[act + t] for t in range(g)]
    sa = np.lexsort(cols[::-1])
    slots = np.arange(m)

    def heads(new: np.ndarray, slots: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(new, slots, 0))

    new = _dense([c[sa] for c in cols])
    rank = np.empty(m, np.int64)
    rank[sa] = heads(new, slots)
    ranks, step = [rank], 1
    # Prefix doubling over the windows; a position whose window is its own ends every common prefix.
    open_ = ~(new & np.append(new[1:], True))
    while open_.any():
        slots = slots[open_]
        members = sa[slots]
        after = place[np.minimum(act[members] + step, len(ids))]
        second = np.where(after >= 0, rank[after], -1 - members) + m
        key = rank[members] * (2 * m + 1) + second
        o = np.argsort(key)
        sa[slots] = members[o]
        new = _dense([key[o]])
        rank = rank.copy()
        rank[members[o]] = heads(new, slots)
        ranks.append(rank)
        step *= 2
        open_ = ~(new & np.append(new[1:], True))
    x, y = sa[:-1], sa[1:]
    together = ranks[0][x] == ranks[0][y]
    x, y = x[together], y[together]
    i, j, long = act[x], act[y], np.zeros(len(x), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        p, q = place[np.minimum(i + long, len(ids))], place[np.minimum(j + long, len(ids))]
        equal = (p >= 0) & (q >= 0)
        equal[equal] = ranks[k][p[equal]] == ranks[k][q[equal]]
        long += equal * (1 << k)
    return i, j, long + g - 1, ranks[0][x]


def _hopeful(i: np.ndarray, j: np.ndarray, lcp: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Edges of the classes whose closest positions are no farther apart than their longest common prefix."""
    at, of = np.concatenate([i, j]), np.concatenate([cls, cls])
    o = np.lexsort((at, of))
    at, of = at[o], of[o]
    gap = np.where((of[1:] == of[:-1]) & (at[1:] > at[:-1]), at[1:] - at[:-1], np.iinfo(np.int64).max)
    top = int(cls.max()) + 1
    least, most = np.full(top, np.iinfo(np.int64).max), np.zeros(top, np.int64)
    np.minimum.at(least, of[1:], gap)
    np.maximum.at(most, cls, lcp)
    return least[cls] <= most[cls]


def kruskal_seeds(i: np.ndarray, j: np.ndarray, lcp: np.ndarray, min_length: int,
                  min_exponent: int) -> list[tuple[int, int, int]]:
    """``(end, period, start)`` of every pair that becomes adjacent in its class and repeats long enough."""
    order = np.argsort(-lcp, kind="stable")
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    seeds = []

    def find(a: int) -> int:
        root = a
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[a] != root:
            parent[a], a = root, parent[a]
        return root

    for a, b, l in zip(i[order].tolist(), j[order].tolist(), lcp[order].tolist(), strict=True):  # noqa: E741
        a, b = find(a), find(b)
        big, small = members.get(a) or [a], members.get(b) or [b]
        if len(big) < len(small):
            a, b, big, small = b, a, small, big
        before = -1
        for k, s in enumerate(small):
            at = bisect_left(big, s)
            # Neighbours across the two sets; between two of one set nothing is new.
            if at and big[at - 1] > before:
                d = s - big[at - 1]
                if l + d >= min_length and l + d >= min_exponent * d:
                    seeds.append((s + l, d, s - d))
            if at < len(big) and (k + 1 == len(small) or small[k + 1] > big[at]):
                d = big[at] - s
                if l + d >= min_length and l + d >= min_exponent * d:
                    seeds.append((s + d + l, d, s))
            before = s
        if len(small) < 8:
            for s in small:
                insort(big, s)
        else:
            big += small
            big.sort()  # two sorted stretches: merged in linear time
        parent[b] = a
        members[a] = big
        members.pop(b, None)
    return seeds


def runs_of(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray, min_length: int = MIN_LENGTH,
            min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows ``start, length, period`` (over all the texts' words) by start, then period."""
    i, j, lcp, cls = suffix_edges(ids, doc, ends, shortest_overlap(min_length, min_exponent))
    if not len(i):
        return np.empty((0, 3), np.int64)
    use = _hopeful(i, j, lcp, cls)
    seeds = kruskal_seeds(i[use], j[use], lcp[use], min_length, min_exponent)
    if not seeds:
        return np.empty((0, 3), np.int64)
    end, period, start = np.array(seeds, np.int64).T
    o = np.lexsort((start, period, end))
    o = o[_dense([end[o], period[o]])]                     # the leftmost seed of a period and an end
    end, period, start = end[o], period[o], start[o]
    o = np.lexsort((period, end, start))
    o = o[_dense([start[o], end[o]])]                      # multiples of a period cover the same stretch
    found = np.stack([start[o], end[o] - start[o], period[o]], axis=1)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _chunk(texts: list[str | None], min_length: int, min_exponent: int) -> tuple[list, list, list]:
    """Word counts, runs and collapsed texts of some texts."""
    each = [_WORD.findall(t) if t else [] for t in texts]
    number = defaultdict(count().__next__)
    sizes = np.array([len(w) for w in each], np.int64)
    ends = np.cumsum(sizes)
    ids = np.fromiter((number[x] for w in each for x in w), np.int64, int(ends[-1]))
    doc = np.repeat(np.arange(len(each)), sizes)
    found = runs_of(ids, doc, ends, min_length, min_exponent)
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, found[:, 0] + found[:, 2], 1)
    np.add.at(step, found[:, 0] + found[:, 1], -1)
    keep = np.cumsum(step)[:-1] == 0
    of = doc[found[:, 0]] if len(found) else np.empty(0, np.int64)
    edges = np.searchsorted(of, np.arange(len(each) + 1))
    runs, texts_out = [], []
    for k, w in enumerate(each):
        begin = int(ends[k] - sizes[k])
        own = found[edges[k]:edges[k + 1]]
        runs.append([{"start": s - begin, "length": n, "period": p} for s, n, p in own.tolist()])
        if len(own):
            w = [w[x] for x in np.flatnonzero(keep[begin:begin + len(w)]).tolist()]
        texts_out.append(" ".join(w))
    return sizes.tolist(), runs, texts_out


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
              min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """One row per document: id, ``n_words``, ``runs`` (start, length, period in words) and ``collapsed`` text."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run repeats its period at least once: min_exponent and min_length are 2 or more")
    id_type = docs.schema[id_col].dataType
    schema = f"`id` {id_type.simpleString()}, n_words bigint, runs {RUNS}, collapsed string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            cut, held = [0], 0
            for k, t in enumerate(texts):
                if held and held + len(t or "") > CHUNK_CHARS:
                    cut.append(k)
                    held = 0
                held += len(t or "")
            for a, b in zip(cut, cut[1:] + [len(texts)], strict=True):
                if a < b:
                    n, runs, kept = _chunk(texts[a:b], min_length, min_exponent)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(runs, _RUN_ARROW),
                         pa.array(kept, pa.string())], ["id", "n_words", "runs", "collapsed"])

    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_arrow(narrow, scan, schema).withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period; ties: smallest start, then period.  Null without runs."""
    # Runs come by start, then period, so only a strictly greater exponent takes over.
    better = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.element_at(runs, 1), better))


def runs_digest(found: DataFrame) -> DataFrame:
    """``find_runs`` rows with the strongest run and digests in place of runs and text."""
    lines = F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"),
        F.lit("\n")))
    best = found.withColumn("_best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("(_best.length * 1000) div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def with_periodic_tail(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: every tenth text (by crc32 of its id) repeats a block of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.expr("crc32(cast(cast(doc_id AS string) AS binary)) div 10")

    def tail(w: Column) -> Column:
        n = F.size(w)
        return let(F.struct((g % n).alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).alias("p")),
                   lambda s: F.transform(w, lambda x, i: F.when(i < s["a"], x).otherwise(
                       F.get(w, (s["a"] + (i - s["a"]) % s["p"]).cast("int")))))

    made = let(words(F.col("text")), lambda w: F.when(F.size(w) > 0, F.array_join(tail(w), " ")).otherwise(F.lit("")))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), made)
                       .otherwise(F.col("text")).alias("text"))
