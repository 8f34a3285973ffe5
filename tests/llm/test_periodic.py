"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from wordmill.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, min_length=6, min_exponent=4):
    """Every run: for each period, the maximal stretches; a stretch counts for its smallest period."""
    n, best = len(w), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(min_length, min_exponent * q):
                best.setdefault((i, length), q)
            i = j
    return sorted((s, n, q) for (s, n), q in best.items())


def collapse(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def test_shortest_overlap():
    assert periodic_runs.shortest_overlap(6, 4) == 5
    assert periodic_runs.shortest_overlap(2, 2) == 1


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (4, 3), (10, 2)])
def test_runs_equal_brute_force(limits):
    r = random.Random(1)
    texts = []
    for _ in range(400):
        w = []
        while len(w) < r.randint(0, 120):
            block = [r.choice("abc"[:r.randint(1, 3)]) for _ in range(r.randint(1, 9))]
            w += block * r.choice([1, 1, 2, 4, 5, 9]) + block[:r.randint(0, len(block))]
        texts.append(" ".join(w))
    texts += ["", None, "a", "a " * 300, "a b " * 200 + "a"]
    n, runs, kept = periodic_runs._chunk(texts, *limits)
    for k, t in enumerate(texts):
        w = WORD.findall(t or "")
        want = brute(w, *limits)
        assert n[k] == len(w)
        assert [tuple(x.values()) for x in runs[k]] == want
        assert kept[k] == collapse(w, want)


def test_long_periodic_text():
    ids = np.tile(np.arange(7), 30_000)
    assert periodic_runs.runs_of(ids, np.zeros(len(ids), np.int64), np.array([len(ids)])).tolist() == [[0, 210_000, 7]]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, digest("".join("%d,%d,%d\n" % r for r in runs)), digest(collapse(w, runs)))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert got == {d.doc_id: expected(d.doc_id, d.text) for d in docs}
    assert sum(r[1] > 0 for r in got.values()) > 5


def test_edges(make):
    # A no-break space is part of a word.
    rows = [(1, None), (2, ""), (None, "x y " * 9), (4, "z " * 20), (4, "z " * 20), (5, " \t\n"), (6, "é\xa0a " * 50_000)]
    found = periodic_runs.find_runs(make(rows)).collect()
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found), key=str)
    want = [(i, len(WORD.findall(t or "")), brute(WORD.findall(t or "")[:200_000]) if i != 6 else [(0, 50_000, 1)],
             "" if not (t or "").strip() else {None: "x y", 4: "z", 6: "é\xa0a"}[i]) for i, t in rows]
    assert got == sorted(want, key=str)
    assert periodic_runs.find_runs(make([])).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.find_runs(make(rows), min_exponent=1)
