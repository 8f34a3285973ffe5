"""Operators that SQL cannot express, against plain Python over whole small tables."""

import collections
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

import __spark_entry__ as entry
from wordmill.llm import jaccard_join, queries
from wordmill.llm.shingles import shingle_sets
from wordmill.llm.token_files import Encoder, open_tokens, read_manifest, sequence, write_tokens

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def shingles(t, k):
    w = WORD.findall(low(t))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(sets, pct):
    """Smallest reachable id by links of the given Jaccard similarity."""
    by = collections.defaultdict(list)
    for d in sorted(sets):
        for x in sets[d]:
            by[x].append(d)
    common = collections.Counter((a, b) for ids in by.values() for k, a in enumerate(ids) for b in ids[k + 1:])
    first = {d: d for d in sets}

    def find(x):
        while first[x] != x:
            x = first[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= pct * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((find(a), find(b)))
            first[b] = a
    return {d: find(d) for d in sets}


def test_shingle_hashes_are_sets():
    r = random.Random(2)
    some = ["".join(r.choice("ab É\n\tC") for _ in range(r.randint(0, 30))) for _ in range(500)] + [None, ""]
    assert [len(s) for s in shingle_sets(pa.array(some), 4)] == [len(shingles(t or "", 4)) for t in some]


def test_jaccard(spark, texts):
    want = groups({d: shingles(t, 4) for d, t in texts.items()}, 85)
    rows = queries.op8_jaccard_join(spark, SF).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.n_shingles == len(shingles(texts[r.doc_id], 4)) for r in rows)


@pytest.mark.parametrize("frequent,large,worth", [(2000, 400, 1000), (2, 400, 1), (2, 30, 1000), (3, 8, 1)])
def test_jaccard_of_dense_groups(make, frequent, large, worth):
    """Groups of near copies, with small limits so that combinations, both indexes and many rounds are used."""
    r = random.Random(11)
    rows = []
    for g in range(5):
        base = [f"w{r.randint(0, 300)}" for _ in range(12 * (g + 1))]
        for _ in range(25):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = f"x{r.randint(0, 9)}"
            rows.append((len(rows), " ".join(copy)))
    found = jaccard_join.link_components(make(rows), k=3, min_pct=75, frequent=frequent, large=large, worth=worth)
    got = {x.doc_id: x.component_id for x in found.collect()}
    assert got == groups({d: shingles(t, 3) for d, t in rows}, 75)


def test_lm_base_and_gain(spark, texts):
    tokens = {d: [*WORD.findall(low(t)), ""] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    count = collections.Counter(w for d in tokens if not held[d] for w in tokens[d])
    n, v = sum(count.values()), len(count)
    rows = queries.op7_lm_score(spark, SF).collect()
    for r in rows:
        t = tokens[r.doc_id]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t),
                                                                       sum(count[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_token_files(spark, texts, scratch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    ids = {d: [*tok.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}
    rows = {r.doc_id: r for r in queries.op9_token_files(spark, SF).collect()}
    at = 0
    for d in sorted(ids):
        raw = b"".join(i.to_bytes(4, "little") for i in ids[d])
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (at, len(ids[d]), zlib.crc32(raw))
        at += len(ids[d])
    # Random access to equal-length sequences, without copying.
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    write_tokens(docs, f"{scratch}/t", queries.tokenizer_path(), length=64)
    stream = [i for d in sorted(ids) for i in ids[d]]
    for m in read_manifest(spark, f"{scratch}/t").collect():
        reader = open_tokens(f"{scratch}/t", m.file)
        for k in {0, 1, (m.n_tokens - 1) // 64}:
            view, mask = sequence(reader, k)
            part = stream[m.start:m.start + m.n_tokens][k * 64:(k + 1) * 64]
            assert view[mask].tolist() == part and len(view) == 64 and not view.flags.owndata


def test_encoder_equals_whole_texts():
    from tokenizers import Tokenizer

    tok, encode = Tokenizer.from_file(queries.tokenizer_path()), Encoder(queries.tokenizer_path())
    r = random.Random(3)
    parts = ["a", "B", "é", "1", "²", "_", ",", ".", "!", "'s", " ", " ", "  ", "\n", "\n\n", "\t", "\r", "\xa0", "\x85",
             "日", "́", "<|endoftext|>", "foo", "😀", "\0", "-", "​", "½"]
    some = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(20_000)]
    assert [x.tolist() for x in encode(some)] == [tok.encode(t, add_special_tokens=False).ids for t in some]


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pii_base_spans():
    from wordmill.llm.pii import BASE_KINDS, _automaton, spans_of

    rules = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    valid = [lambda m: True, lambda m: all(int(p) <= 255 for p in m.split(".")),
             lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
             lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15]
    r, anchors = random.Random(4), _automaton()
    pieces = ["a", "B.c", "@", "@x.de", "+", "+4", "1", "25", "300", ".", ".", "-", " ", "(", ")", "é", "4111111111111111",
              "5500 0000 0000 0004", "192.168.0.1", "\n", "%", "token="]
    for _ in range(20_000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 16)))
        want = sorted((m.start(), k, m.end()) for k, (rule, ok) in enumerate(zip(rules, valid, strict=True))
                      for m in re.finditer(rule, text) if ok(m[0]))
        got = [(s, BASE_KINDS.index(k), e) for k, s, e in spans_of(text, anchors) if k in BASE_KINDS]
        assert got == want, text


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op2_quality_classifier(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
               and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    clean = [p for p, y in held if y == 1]
    assert sum(clean) / len(clean) > 0.97


def test_line_dedup_windows(spark, texts):
    """The lines that go are those of the shortest runs of 50 words, from or up to a line, that occur earlier."""
    lines = {d: [(re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" "), len(WORD.findall(x)))
                 for x in t.split("\n") if WORD.search(x)] for d, t in texts.items()}
    seen, gone = {}, collections.defaultdict(set)
    for d in sorted(lines):
        new = {}
        for i in range(len(lines[d])):
            for step in (1, -1):
                j, n = i, 0
                while 0 <= j < len(lines[d]) and n < 50:
                    n, j = n + lines[d][j][1], j + step
                a, b = (i, j) if step == 1 else (j + 1, i + 1)
                if n >= 50:
                    run = tuple(x for x, _ in lines[d][a:b])
                    if run in seen or new.get(run, a) < a:
                        gone[d] |= set(range(a, b))
                    new.setdefault(run, a)
        seen |= new
    for r in queries.op1_line_dedup(spark, SF).collect():
        got = {i for x in r.runs.split(",") if x for i in range(*map(int, x.split(":")))}
        assert got == gone[r.doc_id] and len(got) == r.removed_lines


def test_pipeline(spark, texts):
    """Each stage's verdicts held against plain Python or the SQL of its operator."""
    import duckdb

    import corpus_pipeline
    from wordmill.llm import oracle
    from wordmill.llm.common import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        con.register("input", before)
        docs = materialize(stage(spark, docs, SF), "test-stage")
        after = docs.toPandas()
        ids = set(after.doc_id)
        if name == "quality_rules":
            sql = oracle.quality_rules_sql("input")
            assert ids == {x for x, in con.sql(f"SELECT doc_id FROM ({sql}) WHERE kept").fetchall()}
        elif name == "jaccard_join":
            want = groups({d: shingles(t, 5) for d, t in zip(before.doc_id, before.text, strict=True)}, 80)
            assert ids == {d for d, c in want.items() if d == c}
        elif name == "decontaminate":
            leaks = con.sql(f"SELECT doc_id FROM ({oracle.decontaminate_sql('input')})").fetchall()
            assert ids == set(before.doc_id) - {x for x, in leaks}
        elif name == "mix_sources":
            assert ids == {x for x, in con.sql(f"SELECT doc_id FROM ({oracle.mix_sources_sql('input')}) WHERE kept").fetchall()}
        else:
            assert ids == set(before.doc_id)
        if name != "token_files":
            assert list(after.columns) == list(before.columns) and after.doc_id.is_unique
    again = corpus_pipeline.run(spark, SF)
    assert sorted(again.collect()) == sorted(docs.collect())


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} <= {k.split("_")[0] for k in entry.queries()}
