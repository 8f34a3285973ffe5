"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from wordmill.llm import chat_format, decontaminate, jaccard_join, line_dedup, lm_score, mix_sources, pii
from wordmill.llm import quality_classifier, quality_rules, token_files
from wordmill.llm.queries import tokenizer_path

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = "\n".join(prose(40, k) for k in range(1500))  # 60,000 words
ROWS = [(1, None), (2, ""), (3, " \t\n"), (None, prose(80, 1)), (4, prose(80, 2)), (4, prose(80, 2)), (5, "x"),
        (6, LONG), (7, prose(80, 2)), (8, "é" * 200_000)]


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, prose(30, 9)), (2, None), (3, "two words"), (None, "ä"), (3, "two words")],
                                 "item_id long, text string")


def per_document(make, items, scratch):
    """Each operator that gives one row per document."""
    labels = items.sparkSession.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    yield "lines", line_dedup.line_report
    yield "classifier", lambda d: quality_classifier.score(d, quality_classifier.learn(d, labels))
    yield "pii", pii.find_pii
    yield "mix", mix_sources.probabilities
    yield "lm", lambda d: lm_score.score_documents(d, held_out=d["doc_id"] == 4)
    yield "jaccard", jaccard_join.link_components
    yield "rules", quality_rules.quality_report

    def tokens(d):
        path = f"{scratch}/t{rng.random()}"
        token_files.write_tokens(d, path, tokenizer_path())
        return token_files.read_documents(d.sparkSession, path)
    yield "tokens", tokens


def test_one_row_per_document(make, items, scratch):
    docs, none = make(ROWS), make([])
    for name, op in per_document(make, items, scratch):
        rows = op(docs).collect()
        assert len(rows) == len(ROWS), name
        assert op(none).collect() == [], name


def test_filters_keep_columns_and_order_of_names(make, items):
    docs, none = make(ROWS), make([])
    for op in (quality_rules.apply_quality_rules, line_dedup.drop_repeated_runs, jaccard_join.keep_one,
               mix_sources.mix, pii.redact, lambda d: decontaminate.remove_contaminated(d, items)):
        got = op(docs)
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        assert {(r["_key"], r["n words"], r["a.b"]) for r in got.collect()} == {(7, "x", 1)}
        assert op(none).collect() == []


def test_quality_rules(make):
    line = "all rights reserved by someone"
    rows = [(k, f"{prose(60, k)}\n{line} {k % 2}") for k in range(12)] + [(90, None), (91, ""), (92, prose(49, 1))]
    rows += [(93, "\n".join([f"{line} 7"] * 3 + [prose(50, 50)])), (94, "a b c " * 40)]
    got = {r.doc_id: r for r in quality_rules.quality_report(make(rows)).collect()}
    assert got[0].removed_words == 0 and got[0].kept  # the first document keeps the line (digits are one)
    assert all(got[k].removed_words == 6 and got[k].kept for k in range(1, 12))
    assert not any(got[k].kept for k in (90, 91, 92, 94)) and got[94].n_repeat_words == 120
    assert got[93].removed_words == 18 and got[93].n_dup_lines == 2 and got[93].kept
    deep = [(k, "\n".join([prose(6, 900 + j) for j in range(9)] + [prose(20, k)])) for k in range(8)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_report(make(deep)).collect()}
    assert got[0] and not any(got[k] for k in range(1, 8))  # depleted, but for the first
    out = {r.doc_id: r.text for r in quality_rules.apply_quality_rules(make(rows)).collect()}
    assert out[0] == rows[0][1] and out[5] == prose(60, 5) and 92 not in out
    # Copies of one text count once, so they do not make their own lines boilerplate.
    copies = [(k, prose(70, 3)) for k in range(30)] + [(100 + k, prose(70, 100 + k)) for k in range(9)]
    assert all(r.kept for r in quality_rules.quality_report(make(copies)).collect())


def test_line_dedup(make):
    passage = "\n".join(prose(20, 70 + k) for k in range(4))  # 80 words in lines of 20
    short = "\n".join(prose(20, 80 + k) for k in range(2))    # 40 words: too short
    rows = [(1, f"{prose(30, 1)}\n{passage}\n{prose(30, 2)}"), (2, f"{passage}\n\n{prose(30, 3)}"),
            (3, f"{prose(9, 4)}\n{short}"), (4, short), (5, f"{prose(60, 5)}\n{prose(60, 5)}"), (None, passage)]
    got = {r.doc_id: r.runs for r in line_dedup.line_report(make(rows)).collect()}
    assert got == {1: "", 2: "0:4", 3: "", 4: "", 5: "1:2", None: "0:4"}
    out = {r.doc_id: r.text for r in line_dedup.drop_repeated_runs(make(rows)).collect()}
    assert out[1] == rows[0][1] and out[2] == f"\n{prose(30, 3)}" and out[5] == prose(60, 5) and out[None] == ""


def test_decontamination(make, spark):
    items = spark.createDataFrame([(1, prose(30, 9)), (2, None), (3, "Two words"), (4, prose(30, 9))],
                                  "item_id long, text string")
    near = prose(30, 9).split()
    near[29] = "other"  # one of 26 shingles differs
    far = prose(30, 9).split()
    far[15] = far[5] = "other"  # ten differ
    rows = [(1, f"{LONG} {prose(30, 9).upper()} {LONG}"), (2, " ".join(near)), (3, " ".join(far)), (4, "two  WORDS"),
            (5, "one two words three"), (6, "two wordss"), (7, None), (None, prose(30, 9))]
    found = decontaminate.find_contaminated(make(rows), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (1, 4), (2, 1), (2, 4), (4, 3), (5, 3), (None, 1),
                                                     (None, 4)}
    kept = decontaminate.remove_contaminated(make(rows), items).collect()
    assert sorted(r.doc_id for r in kept) == [3, 6, 7]
    assert decontaminate.find_contaminated(make(rows), items.limit(0)).collect() == []
    blocks = list(decontaminate.item_blocks(items, "item_id", "text", block_chars=100))
    assert sum(t.num_rows for t in blocks) == 4 and len(blocks) > 1


def test_pii_long_numbers(make):
    """Numbers beyond Python's limit for int(), before dots and alone."""
    from wordmill.llm.pii import digest, find_pii
    rows = [(1, "0" * 5000 + ".1.1.1"), (2, "9" * 5000 + ".1.1.1"), (3, "1.2.3." + "0" * 4999 + "255"), (4, "7" * 100_000)]
    got = {r.doc_id: (r.n_ip, r.n_card, r.n_spans) for r in digest(find_pii(make(rows))).collect()}
    assert got == {1: (1, 0, 1), 2: (0, 0, 0), 3: (1, 0, 1), 4: (0, 0, 0)}


@pytest.mark.parametrize("text,want", [
    ("IBAN: DE89 3704 0044 0532 0130 00 is ours", "DE89 3704 0044 0532 0130 00"),
    ("my iban GB82WEST12345698765432.", "GB82WEST12345698765432"),
    ("IBAN number: gb82-west-1234-5698-7654-32 or so", "gb82-west-1234-5698-7654-32"),
    ("IBAN: DE89 3704 0044 0532 0130 01 is wrong", None), ("account number: 12345678", "12345678"),
    ("acct no. 12345678", "12345678"), ("PassWord: abc12345", "abc12345"), ("API_Key='x9x9x9x9'", "x9x9x9x9"),
    ("the account is closed today", None), ("İ token = abc12345", "abc12345"),
    ("see https://example.org/a?b=1.", "https://example.org/a?b=1"), ("HTTP://a.b:80", "HTTP://a.b:80"), ("http://:80/", None),
    ("http://?x", None)])
def test_pii_accounts_and_urls(text, want):
    spans = [text[s:e] for k, s, e in pii.spans_of(text, pii._automaton()) if k in ("account", "url")]
    assert spans == ([want] if want else [])


def test_pii_query_equals_plain_expressions(spark):
    """Counts and digest of the registered query, over whole texts, by the contract's expressions."""
    from wordmill.llm import queries
    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
             "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, x):
        digits = [int(c) for c in x if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in x.split("."))
        if kind == "phone":
            return 9 <= len(digits) <= 15
        doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
        return kind == "email" or 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0

    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        spans = [(m.start(), n, f"{kind}:{m.start()}:{m.end()}", kind) for n, (kind, form) in enumerate(forms.items())
                 for m in re.finditer(form, r.text or "") if valid(kind, m[0])]
        text = ",".join(x for _, _, x, _ in sorted(spans))
        want[r.doc_id] = (*(sum(k == kind for *_, k in spans) for kind in forms), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:6] for r in queries.op4_pii(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and sum(sum(v[:4]) for v in want.values()) > 10


def test_pii_redaction(make):
    text = "mail a.b@c.org, 10.0.0.1 or 300.1.1.1; card 4111 1111 1111 1111 call +49 (30) 1234-567 token = \"ab12cd34\""
    rows = {r.doc_id: r.text for r in pii.redact(make([(1, text), (2, None), (3, "é@é.de @ + 1.2.3")])).collect()}
    assert rows[1] == "mail [EMAIL], [IP] or 300.1.1.1; card [CARD] call [PHONE] token = \"[ACCOUNT]\""
    assert rows[2] is None and rows[3] == "é@é.de @ + 1.2.3"


def test_reply_tree(spark):
    rows = [(1, None, 9, "user", "hi", 0.0), (2, 1, 9, "assistant", "a<|end|>\\l", 1.0), (3, 1, 9, "assistant", "b", 2.0),
            (4, 2, 9, "user", None, 5.0), (5, 3, 9, "user", "x", 4.0), (6, 77, 8, "assistant", "lost", None),
            (7, 8, 7, "user", "loop", 1.0), (8, 7, 7, "user", "loop", 1.0)]
    messages = spark.createDataFrame(rows, "id long, parent long, conv_id long, role string, text string, score double")
    best = chat_format.format_conversations(messages)
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in best.select(
        "conv_id", chat_format.parse(best["formatted"]).alias("turns")).collect()}
    assert got[9] == [("user", "hi"), ("assistant", "a<|end|>\\l"), ("user", "")]  # 6.0 each: the smaller leaf
    assert got[8] == [("assistant", "lost")] and 7 not in got
    both = chat_format.format_conversations(messages, branches=2)
    assert both.where("conv_id = 9").count() == 2
    assert {r.loss for r in best.select(chat_format.loss_text(best["formatted"], best["loss_spans"]).alias("loss"))
            .collect()} == {"a<|end|>\\l", "lost"}


def test_turn_table(spark):
    turns = [(1, 2, "assistant", "b"), (1, 0, "user", "a"), (1, 5, None, None), (None, 0, "user", "n"),
             (2, 0, "user", "same"), (2, 0, "user", "same")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = chat_format.digest(chat_format.format_conversations(chat_format.messages_from_turns(df))).collect()
    got = {r.conv_id: r for r in rows}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 1, 2: 2}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\n\n\n").hexdigest()
    assert chat_format.messages_from_turns(df.limit(0)).count() == 0
    assert chat_format.format_conversations(chat_format.messages_from_turns(df.limit(0))).count() == 0


def test_jaccard_classes(make):
    base = prose(60, 1).split()
    near = base[:59] + ["zz"]
    rows = [(5, " ".join(base)), (3, " ".join(near)), (9, " ".join(base).upper()), (4, "a b"), (2, "A  b"), (7, ""),
            (8, None), (None, " ".join(base)), (6, prose(60, 2)), (6, prose(60, 3))]
    got = [(r.doc_id, r.component_id) for r in jaccard_join.link_components(make(rows)).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (9, 3), (4, 2), (2, 2), (7, 7), (8, 8), (None, None),
                                           (6, 6), (6, 6)], key=str)
    kept = jaccard_join.keep_one(make(rows + [(3, " ".join(near)), (6, prose(60, 2))])).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["2", "3", "6", "6", "7", "8", "None"]


def test_mixing_reaches_targets(make):
    rows = [(k, prose(50, k), "big") for k in range(300)] + [(1000 + k, prose(50, k), "small") for k in range(100)] \
        + [(2000, prose(50, 3), None), (2001, None, "small")]
    p = mix_sources.probabilities(make(rows), fraction=0.4, targets={"source": {"big": 1, "small": 1, None: 0}})
    got = p.groupBy("_source").agg({"probability": "sum"}).collect()
    sums = {r[0]: r[1] for r in got}
    assert abs(sums["big"] * 50 - 401 * 50 * 0.2) < 1 and abs(sums["small"] / 101 * 100 * 50 - 401 * 50 * 0.2) < 1
    assert sums[None] == 0.0  # no share wanted


def test_mixing_margins_of_documents(spark):
    """Every source, language and topic gets its target, and no target is above what its value has."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix_sources.margins(docs).collect()
    total = sum(r.tokens for r in rows if r.margin == "lang")
    assert total == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect())
    for margin in ("source", "lang", "topic"):
        mine = [r for r in rows if r.margin == margin]
        assert all(abs(r.error) <= 0.01 and abs(r.weight - r.target) <= 0.01 * r.target for r in mine)
        assert abs(sum(r.target for r in mine) - 0.8 * total) < 1e-6 * total
        most = [r for r in mine if r.target > 0.9499 * r.tokens]
        rest = [r for r in mine if r not in most]
        assert all(r.target <= 0.95 * r.tokens * (1 + 1e-12) for r in mine) and rest
        levels = [r.target / r.tokens ** 0.7 for r in rest]  # one level for all that are not at their most
        assert max(levels) / min(levels) - 1 < 1e-9
        assert all(r.tokens ** 0.7 * levels[0] >= r.target * (1 - 1e-9) for r in most)


def test_mixing_that_cannot_meet_its_targets(make):
    """A value that is asked for more than it has gives 95 %, the others the rest; what cannot be met together is shown."""
    rows = [(k, prose(50, k), "big") for k in range(300)] + [(1000 + k, prose(50, k), "small") for k in range(100)]
    got = {r.value: (r.target, r.error) for r in mix_sources.margins(
        make(rows), fraction=0.5, targets={"source": {"big": 1, "small": 1}}).collect() if r.margin == "source"}
    assert abs(got["small"][0] - 4750) < 1e-6 and abs(got["big"][0] - 5250) < 1e-6
    assert all(abs(e) <= mix_sources.TOLERANCE for _, e in got.values())
    # All of language "a" is in "big" and the other way round, but their targets differ.
    both = make(rows).withColumn("lang", F.when(F.col("source") == "big", "a").otherwise("b"))
    got = mix_sources.margins(both, fraction=0.5, max_sweeps=5, targets={
        "source": {"big": 3, "small": 1}, "lang": {"a": 1, "b": 1}}).collect()
    assert max(abs(r.error) for r in got) > 0.1 and all(r.weight <= r.tokens + 1e-6 for r in got)


def test_line_dedup_within_lines(make):
    """A passage that begins and ends within lines goes whole, also where the lines break elsewhere."""
    w = [f"w{k}" for k in range(59)]
    inline, broken = " ".join(w), "\n".join([" ".join(w[:9]), " ".join(w[9:30]), " ".join(w[30:])])
    rows = [(1, f"a b {inline} c d"), (2, f"x y {broken.upper()} z\nend"), (3, f"p {' '.join(w[:49])} q"),
            (4, f"{inline} after"), (5, f"r\n{' '.join(w[5:])}\ns"), (None, f"{inline}\n")]
    # 6 and 7 share 52 words that the first document with their gram lacks.
    rows += [(6, " ".join(["g1", "g2", *w[:45], *[f"v{k}" for k in range(7)], "h"])),
             (7, " ".join(["i1", *w[:45], *[f"v{k}" for k in range(7)], "j"]))]
    got = {r.doc_id: (r.spans, r.removed_words, r.removed_lines) for r in line_dedup.line_report(make(rows)).collect()}
    assert got == {1: ("", 0, 0), 2: ("2:61", 59, 0), 3: ("", 0, 0), 4: ("0:59", 59, 0), 5: ("1:55", 54, 0),
                   6: ("", 0, 0), 7: ("1:53", 52, 0), None: ("0:59", 59, 0)}
    out = {r.doc_id: r.text for r in line_dedup.drop_repeated_runs(make(rows)).collect()}
    assert out == {1: rows[0][1], 2: "x y z\nend", 3: rows[2][1], 4: "after", 5: "r\ns", 6: rows[6][1], 7: "i1 j", None: ""}


def repeated_places(texts, least=50):
    """Per document, in order, the words of all runs of ``least`` words that occur at an earlier place."""
    seen, want = set(), {}
    for d, t in texts:
        w, gone = [x for x in re.split(r"[\x20\x09-\x0D]+", t.lower()) if x], set()
        for i in range(len(w) - least + 1):
            run = tuple(w[i:i + least])
            if run in seen:
                gone |= set(range(i, i + least))
            seen.add(run)
        want[d] = gone
    return want


def span_words(rows):
    return {r.doc_id: {i for x in r.spans.split(",") if x for i in range(*map(int, x.split(":")))} for r in rows}


@pytest.mark.parametrize("least", [1, 12, 50])
def test_line_dedup_of_few_words(make, least):
    """Texts of one, two or a few words, whether such words cut or not, and near copies with long equal parts."""
    r = random.Random(least)
    rows = [(k, " ".join(r.choice(WORDS[:k % 4 + 1]) for _ in range(r.randint(0, 150)))) for k in range(40)]
    rows += [(100 + k, f"{w} " * 120) for k, w in enumerate(WORDS[:30])] + [(200, None), (201, ""), (202, LONG)]
    base = prose(200, 77).split()
    for k in range(40):
        copy = list(base)
        for _ in range(r.randint(0, 5)):
            copy[r.randrange(len(copy))] = f"x{r.randint(0, 3)}"
        rows.append((300 + k, " ".join(copy[r.randint(0, 40):])))
    got = line_dedup.line_report(make(rows), min_words=least).collect()
    assert span_words(got) == repeated_places([(d, t or "") for d, t in rows], least)


def test_line_dedup_is_native(make, monkeypatch):
    """No Python on the executors; words said over and over, in stretches and in turns, and whole copies fare as others."""
    from pyspark.sql.classic.dataframe import DataFrame

    def fail(*_, **__):
        raise AssertionError("Python on the executors")
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(DataFrame, name, fail)
    r = random.Random(8)
    rows = [(k, " ".join(w for _ in range(6) for w in [r.choice(WORDS[:9])] * r.choice([1, 7, 49, 50, 51, 120])))
            for k in range(40)]
    rows += [(100 + k, " ".join(WORDS[k:k + 3] * 40)) for k in range(0, 12, 2)]
    rows += [(200 + k, rows[k][1]) for k in range(0, 46, 3)] + [(300, prose(200, 5)), (301, prose(200, 5)), (302, "a " * 49)]
    rows += [(303, "a " * 49), (None, prose(200, 5))]
    got = line_dedup.line_report(make(rows)).collect()
    assert span_words(got) == repeated_places(rows)
    assert all(x.removed_words == len(span_words([x])[x.doc_id]) for x in got)


def test_line_dedup_equals_brute_force(spark):
    """Exactly the words of all runs of 50 words that occur at an earlier place go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = repeated_places(sorted((r.doc_id, r.text or "") for r in docs.collect()))
    rows = line_dedup.line_report(docs).collect()
    assert span_words(rows) == want
    assert all(r.removed_words == len(want[r.doc_id]) for r in rows) and sum(map(len, want.values())) > 0


def test_quality_rules_of_a_hot_host(make):
    """The limit does not grow with the host: 55 of 1,200 texts are under 5 %, yet boilerplate."""
    ending = lambda k: "\nevery page ends so" if k < 55 else "\nsome pages end so" if k < 100 else ""
    rows = [(k, f"{prose(60, k)}{ending(k)}") for k in range(1200)]
    got = {r.doc_id: r.removed_words for r in quality_rules.quality_report(make(rows)).collect()}
    assert got == {k: 4 if 0 < k < 55 else 0 for k in range(1200)}  # 45 of 1,200 are under the limit


def test_block_counts_with_many_buckets():
    """Keys come back whole from buckets named by few and by many bits, and sums are those of the keys."""
    import numpy as np

    from wordmill.llm import block_counts as bc
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    for bits in (1, 9, 16, 18, 30):
        for short in (True, False):
            rows, want = [], {}
            for block in range(6):
                keys, _ = bc.distinct_keys(r.choice(pool, 150), short)
                counts = r.integers(1, 9, len(keys))
                mine = bc.report(block, 1, keys, counts, bits, short)
                rows += [dict(zip(bc.REPORT_ARROW.names, x, strict=True)) for x in mine]
                for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
                    want.setdefault(k, []).append((block, c))
            totals = {}
            for b in {x["bucket"] for x in rows}:
                for block, _, _, n, raw in bc.totals_of([x for x in rows if x["bucket"] == b], bits):
                    totals.setdefault(block, []).append((b, bc.wide(raw, n).tolist()))
            for block, parts in totals.items():
                got = [t for _, x in sorted(parts) for t in x]
                assert got == [sum(c for _, c in want[k]) for k in sorted(want) if block in dict(want[k])]


def test_lm_scores_do_not_depend_on_the_session(make):
    """Equal scores whatever the number of shuffle partitions and blocks."""
    docs = make([(k, prose(30 + k % 50, k % 40)) for k in range(300)] + ROWS)
    spark = docs.sparkSession
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in (8, 16, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = lm_score.score_documents(docs, held_out=docs["doc_id"] % 7 == 0, block_chars=20_000 * n).collect()
            seen.append(sorted((tuple(r) for r in got), key=str))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_jaccard_refuses_half(make):
    with pytest.raises(ValueError):
        jaccard_join.link_components(make(ROWS), min_pct=50)


def test_lm_score_equals_plain(make):
    """Weights by expectation-maximisation over single tokens, and scores, in plain Python on a small table."""
    import collections
    import math

    from pyspark.sql import functions as F
    r = random.Random(3)
    texts = [" ".join(r.choice(WORDS[:6 + k % 40]) for _ in range(20 + k % 30)) for k in range(200)] + ["", "new words only"]
    docs = make(list(enumerate(texts)))
    tenth = F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit("deleted")), F.lit(10)) == 0
    deleted = {x.doc_id for x in docs.where(tenth).collect()}
    held = {k for k in range(len(texts)) if k % 9 == 0 or k >= 200}
    tokens = [[None, *t.split(), "</>"] for t in texts]

    def counts(ids):
        one, two = collections.Counter(), collections.Counter()
        for k in ids:
            one.update(tokens[k])   # the begin mark is counted as a context
            two.update(zip(tokens[k], tokens[k][1:], strict=False))
        return one, two, sum(c for w, c in one.items() if w), len(one) - 1

    def estimates(k, model):
        one, two, total, known = model
        for a, b in zip(tokens[k], tokens[k][1:], strict=False):
            yield one[a], (two[a, b] / max(one[a], 1), one[b] / total, 1 / (known + 1))

    learned = set(range(len(texts))) - held
    kept = counts(learned - deleted)
    bucket = lambda c: 0 if not c else 1 + int(math.log2(c))
    seen = [(bucket(c), p) for k in sorted(learned & deleted) for c, p in estimates(k, kept)]
    weights = {b: [1 / 3] * 3 for b in range(60)}
    for _ in range(lm_score.STEPS):
        got = {b: [lm_score.PRIOR] * 3 for b in weights}
        for b, p in seen:
            share = [w * x for w, x in zip(weights[b], p, strict=True)]
            for j in range(3):
                got[b][j] += share[j] / sum(share)
        weights = {b: [x / sum(v) for x in v] for b, v in got.items()}
    full = counts(learned)
    want = [sum(math.log10(sum(w * x for w, x in zip(weights[bucket(c)], p, strict=True))) for c, p in estimates(k, full))
            for k in range(len(texts))]
    rows = lm_score.score_documents(docs, held_out=docs["doc_id"].isin(sorted(held))).collect()
    assert len(deleted & learned) > 8 and len(rows) == len(want)
    # The operator's histogram tells probabilities apart by half-octaves, so weights agree to a per cent or so.
    for x in rows:
        assert math.isclose(x.score, want[x.doc_id], rel_tol=0.01), (x.doc_id, x.score, want[x.doc_id])
