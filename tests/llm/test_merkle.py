"""The hash tree against plain Python, over several sizes, blocks and groups."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from wordmill.llm import merkle_manifest as mm


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """The root and each node's proof: (left, right) by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = p // 8 * 8
            proofs[k].append(("".join(nodes[run:p]), "".join(nodes[p + 1:run + 8])))
        nodes = [h(*nodes[k:k + 8]) for k in range(0, len(nodes), 8)]
        at = [p // 8 for p in at]
    return nodes[0], proofs


def plain(rows):
    """``{(id, lang, leaf): [(proof, subroot, root)]}`` of ``(id, text, lang, source, n_chars)``."""
    by = {}
    for i, text, lang, source, n in rows:
        by.setdefault(lang, []).append((i is not None, i or 0, h(*map(part, (i, source, lang, n, text))), i))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: tree([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in langs}
    root, ups = tree([subs[g][0] for g in langs]) if langs else (None, [])
    out = []
    for g, up in zip(langs, ups, strict=True):
        for x, p in zip(sorted(by[g], key=lambda x: x[:3]), subs[g][1], strict=True):
            out.append((x[3], g, x[2], p + up, subs[g][0], root))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "doc_id long, text string, lang string, source string, n_chars long, _g int, `a.b` string")
    got = mm.manifest(df).collect()
    return sorted(((r.doc_id, r.lang, r.leaf, [tuple(s) for s in r.proof], r.subroot, r.root) for r in got), key=str)


@pytest.mark.parametrize("sizes", [{}, {"en": 1}, {"en": 8, "de": 9, None: 1}, {"en": 4096, "": 4097, "é": 64, "z": 65},
                                   {f"l{k}": 1 + k % 3 for k in range(70)}])
def test_tree_equals_plain(spark, sizes):
    rows, k = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            k += 1
            rows.append((k * 7919 % 100_003, f"text {k}", lang, "s", 5))
    assert run(spark, rows) == sorted(plain(rows), key=str)


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, "a", None, None, None), (None, "b", None, "s", 1), (3, None, "en", "s", None), (3, "", "en", "s", 0),
            (4, "x", "en", "s", 1), (4, "x", "en", "s", 1), (5, "é" * 300_000, "en", "s", 300_000)]
    assert run(spark, rows) == sorted(plain(rows), key=str)


def test_blocks_beyond_two_rounds(spark, monkeypatch):
    monkeypatch.setattr(mm, "LEVELS", 1)
    monkeypatch.setattr(mm, "BLOCK", 8)
    rows = [(k, f"t{k}", "en" if k % 3 else "de", "s", 1) for k in range(700)]
    assert run(spark, rows) == sorted(plain(rows), key=str)


def test_tampering_is_seen(spark):
    df = spark.createDataFrame([(k, "Some Text" if k % 2 else "some text", "en", "s", 9) for k in range(100)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    seen = mm.leaf_hash([F.lower(f) if f == "text" else F.col(f) for f in mm.FIELDS])
    rows = mm.verified(mm.manifest(df, carry={"seen": seen}), "seen").collect()
    assert {r.doc_id for r in rows if r.verified} == set(range(0, 100, 2))
    assert all((r.folded_root == r.root) == r.verified for r in rows)


def test_crc32_sql():
    import duckdb

    from wordmill.llm.oracle import crc32_sql
    for s in ("0", "-12", "999999"):
        assert duckdb.sql(f"SELECT {crc32_sql(repr(s))}").fetchall()[0][0] == zlib.crc32(s.encode())
