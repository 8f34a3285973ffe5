"""Counts of very many keys over the whole corpus, known where the texts are.

Texts are dealt into blocks of bounded size.  A block reports its sorted
distinct keys with their local counts, cut into buckets by the keys' leading
bits.  A bucket adds up what all blocks report and answers each block with the
totals alone, in the order of the block's keys; the block, which can list its
keys again, needs nothing else.  Every key leaves a block once, so a key that
fills a third of the corpus is as light as any other, and the way back costs
about a byte per key.

Keys are 64-bit hashes.  Those of a kind in ``SHORT`` travel by their leading 48
bits (the low 32 of them as such, the rest as counts per prefix).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import prepare, shuffle_partitions

BLOCK_CHARS = 8_000_000
_U = np.uint64
REPORT = "block int, kind int, bucket int, n int, prefixes binary, low binary, counts binary"
REPORT_ARROW = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()),
                          ("prefixes", pa.binary()), ("low", pa.binary()), ("counts", pa.binary())])


def narrow(x: np.ndarray) -> bytes:
    """The numbers in the fewest bytes each that hold the largest."""
    top = int(x.max()) if len(x) else 0
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if top < 1 << (8 * int(k[2])))
    return x.astype(kind).tobytes()


def wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def plan_blocks(docs: DataFrame, text_col: str, block_chars: int = BLOCK_CHARS, least: int = 1) -> tuple[int, int]:
    """Number of blocks for this corpus and the bits that name a bucket.

    There are about as many buckets as blocks, so a bucket gets about as many keys
    as a block has, at every size; a block reports a row for each bucket in which it
    has keys, so at most one per key.
    """
    prepare(docs.sparkSession)
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    blocks = max(least, shuffle_partitions(docs), math.ceil(chars / block_chars))
    return blocks, max(1, (blocks - 1).bit_length())


def report(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, bits: int, short: bool) -> list[tuple]:
    """Rows of ``REPORT``: sorted distinct keys and their counts, by bucket."""
    if short:
        keys = keys >> _U(16)
    shift = _U((48 if short else 64) - bits)
    buckets, edges = np.unique(keys >> shift, return_index=True)
    edges = np.append(edges, len(keys))
    rows = []
    for b, start, stop in zip(buckets.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = keys[start:stop]
        if short and bits >= 16:  # the bucket and the low 32 bits are the whole key
            prefixes, low = b"", own.astype("<u4").tobytes()
        elif short:
            upper = ((own & ((_U(1) << shift) - _U(1))) >> _U(32)).astype(np.int64)
            prefixes, low = narrow(np.bincount(upper, minlength=1 << (16 - bits))), own.astype("<u4").tobytes()
        else:
            prefixes, low = b"", own.astype("<u8").tobytes()
        rows.append((block, kind, b, len(own), prefixes, low, narrow(counts[start:stop])))
    return rows


def reported_keys(row: dict, bits: int) -> np.ndarray:
    """The keys of a row, less the bucket's own bits where they are short."""
    if not row["prefixes"]:
        return np.frombuffer(row["low"], f"<u{len(row['low']) // row['n']}").astype(_U)
    upper = wide(row["prefixes"], 1 << (16 - bits))
    return (np.repeat(np.arange(len(upper), dtype=_U), upper) << _U(32)) | np.frombuffer(row["low"], "<u4").astype(_U)


def distinct_keys(keys: np.ndarray, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (as they are reported) and each key's place among them."""
    if short:
        keys = keys & ~_U(0xFFFF)
    return np.unique(keys, return_inverse=True)


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def answers(rows: pa.Table, kind: int, column: str) -> np.ndarray:
    """One column's totals of a kind, in the order of the block's sorted distinct keys."""
    own = sorted((r for r in rows.to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"])
    parts = [wide(r[column], r["n"]) for r in own]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def totals_of(rows: list[dict], bits: int) -> list[tuple]:
    """Answers ``(block, kind, bucket, n, totals)`` to the reports of one kind in one bucket."""
    counts = np.concatenate([wide(r["counts"], r["n"]) for r in rows])
    keys, at = np.unique(np.concatenate([reported_keys(r, bits) for r in rows]), return_inverse=True)
    totals, out, edge = np.bincount(at, counts, len(keys)).astype(np.int64), [], 0
    for r in rows:
        out.append((r["block"], r["kind"], r["bucket"], r["n"], narrow(totals[at[edge:edge + r["n"]]])))
        edge += r["n"]
    return out
