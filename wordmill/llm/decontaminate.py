"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document when the document holds at least 80 % of the
item's distinct five-word shingles, however long the document is.  Items are
partitioned by size (powers of two).  Within a partition every item keeps a
MinHash sketch of one length: its shingles with the smallest hash values.  The
length follows from the threshold and the partition's largest item: one more
than the shingles that a matching document may lack.  So each matching document
shares at least one sketch value with the item, and the search misses nothing;
documents are not sketched, which would lose short items in long texts.
Every candidate is verified by exact shingle containment.

Items are taken in blocks of bounded size; a block's sketches and shingles go
to every task, and the documents are streamed past them without a shuffle.

Defined results: words are lower-cased (A-Z); an item of fewer than five words
has one shingle, its whole sequence; items and documents without words match
nothing; null ids and repeated rows are reported like others; other columns pass
through ``remove_contaminated`` untouched; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import map_arrow, positional
from wordmill.llm.shingles import pieces, shingle_hashes, word_hashes

SHINGLE = 5
MIN_PCT = 80                 # of an item's shingles
BLOCK_CHARS = 16_000_000     # of item text in a block
FILTER_BITS = 22


class Items:
    """Sketches and shingle sets of a block of items, by shingle width."""

    def __init__(self, ids: pa.Array, texts: pa.Array, min_pct: int = MIN_PCT):
        words, off = word_hashes(texts)
        hashes, edges = shingle_hashes(words, off, SHINGLE)
        width = np.minimum(np.diff(off), SHINGLE)
        self.min_pct, self.ids = min_pct, ids
        self.sets = [np.unique(hashes[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        sizes = np.array([len(s) for s in self.sets])
        spare = sizes - -(-sizes * min_pct // 100)  # shingles a match may lack
        part = np.floor(np.log2(np.maximum(sizes, 1))).astype(int)
        self.by_width: dict[int, tuple] = {}
        for w in sorted(set(width.tolist()) - {0}):
            values, owners = [], []
            for p in set(part[width == w].tolist()):
                own = np.flatnonzero((width == w) & (part == p))
                length = int(spare[own].max()) + 1
                for i in own:
                    values.append(self.sets[i][:length])  # sorted: the smallest hash values
                    owners.append(np.full(len(values[-1]), i))
            value, owner = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(value, kind="stable")
            rough = np.zeros(1 << FILTER_BITS, bool)
            rough[value >> np.uint64(64 - FILTER_BITS)] = True
            self.by_width[w] = (value[order], owner[order], rough)

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, shingles in common) of every containment."""
        for first, some in pieces(texts):
            words, off = word_hashes(some)
            for w, (value, owner, rough) in self.by_width.items():
                hashes, edges = shingle_hashes(words, off, w)
                at = np.flatnonzero(rough[hashes >> np.uint64(64 - FILTER_BITS)])
                left = np.searchsorted(value, hashes[at], "left")
                right = np.searchsorted(value, hashes[at], "right")
                at, left, right = at[left < right], left[left < right], right[left < right]
                rows = np.searchsorted(edges, at, "right") - 1
                for row in np.unique(rows):
                    mine = rows == row
                    found = {int(owner[k]) for a, b in set(zip(left[mine].tolist(), right[mine].tolist(), strict=True))
                             for k in range(a, b)}
                    own = np.unique(hashes[edges[row]:edges[row + 1]])
                    for i in sorted(found):
                        s = self.sets[i]
                        place = np.minimum(np.searchsorted(own, s), len(own) - 1)
                        common = int((own[place] == s).sum())
                        if 100 * common >= self.min_pct * len(s):
                            yield first + int(row), i, common


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[pa.Table]:
    """The items in blocks of about ``block_chars`` characters."""
    rows = items.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    n = -(-chars // block_chars)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield part.toArrow()


def find_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_id_col: str = "item_id", item_text_col: str = "text", min_pct: int = MIN_PCT) -> DataFrame:
    """``id, item id, n_common, n_item``: every document and item whose containment reaches the threshold."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " \
             f"`{item_id_col}` {items.schema[item_id_col].dataType.simpleString()}, n_common long, n_item long"

    def search(block: pa.Table) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(block.column("id").combine_chunks(), block.column("text").combine_chunks(), min_pct)
            for b in batches:
                hits = list(known.matches(b.column("_text")))
                if hits:
                    row, item, common = (np.array(x) for x in zip(*hits, strict=True))
                    yield pa.record_batch(
                        [b.column("_id").take(pa.array(row)), known.ids.take(pa.array(item)), pa.array(common),
                         pa.array([len(known.sets[i]) for i in item])],
                        names=[id_col, item_id_col, "n_common", "n_item"])
        return map_arrow(rows, find, schema)

    found = [search(t) for t in item_blocks(items, item_id_col, item_text_col)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                        item_text_col: str = "text", min_pct: int = MIN_PCT) -> DataFrame:
    """The documents, in their own columns, in which no item is found."""
    place = docs.columns.index(text_col)

    def without(block: pa.Table):
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(block.column("id").combine_chunks(), block.column("text").combine_chunks(), min_pct)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[row for row, _, _ in known.matches(b.column(place))]] = False
                yield b.filter(pa.array(keep))
        return clean

    plain = positional(docs)
    for block in item_blocks(items, item_id_col, item_text_col):
        plain = map_arrow(plain, without(block), plain.schema)
    return plain.toDF(*docs.columns)
