"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs,
plus signs, digits, URL schemes and identifier cues.  Each anchor is expanded by
a local parser that knows one kind and validates what it found, so the cost
follows the anchors, not the patterns:

* ``email``    at-sign: local part to the left, dotted domain to the right
* ``ip``       digit: four dotted numbers of at most 255
* ``card``     digit: digits with single spaces or hyphens, 12 to 19 of them, Luhn sum
* ``phone``    plus sign: 9 to 15 digits with common separators
* ``url``      scheme: up to white space, without closing punctuation
* ``account``  cue (token, password, account ...) in any case, a word such as "number" if any, a
  separator, then an identifier with a digit; after "iban" an account number, also in groups,
  of the right length whose check sum (mod 97) holds

Spans of one kind never overlap and are found from left to right; positions are
code points, end exclusive.

Defined results: null text has no spans; texts of any length are read whole;
rows that repeat stay as rows; other columns pass through ``redact`` untouched;
empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import map_arrow, positional

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
SPANS = "array<struct<kind:string,start:long,end:long>>"

SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("api_key", "apikey", "api-key", "token", "secret", "password", "passwd", "account", "acct", "ssn",
        "passport", "username", "login")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s\"'<>]+")
_HOST = re.compile(r"(?:[^/?#@]*@)?(?:[\w-]+(?:\.[\w-]+)*|\[[0-9A-Fa-f:.]+\])\.?(?::[0-9]{1,5})?(?:[/?#]|$)")
_NUMBER = r"(?:number|num\.?|no\.?|nr\.?|id|code)"
_ACCOUNT = re.compile(rf"[\"']?(?:\s{{0,3}}{_NUMBER})?\s{{0,3}}(?:[:=#]|is\b)\s{{0,3}}[\"']?([A-Za-z0-9_-]{{6,}})"
                      rf"|\s{{1,3}}{_NUMBER}\s{{1,3}}([A-Za-z0-9_-]{{6,}})", re.I)
_IBAN = re.compile(rf"(?:\s{{0,3}}{_NUMBER})?\s{{0,3}}(?:[:=#]|is\b)?\s{{0,3}}[\"']?([A-Z]{{2}}[0-9]{{2}}(?:[ -]?[A-Z0-9]){{11,30}})", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban_length(candidate: str) -> int:
    """Characters of ``candidate`` up to the end of the longest account number whose check sum holds, or 0."""
    compact = [k for k, c in enumerate(candidate) if c.isalnum()]
    for n in range(len(compact), 14, -1):
        # A number does not end within a run of letters and digits.
        end = compact[n - 1] + 1
        if end < len(candidate) and candidate[end].isalnum():
            continue
        code = "".join(candidate[k] for k in compact[:n]).upper()
        if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return end
    return 0


def _folded(text: str) -> str:
    """Lower case, every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "@+":
        a.add_word(c, (c, 1))
    for c in "0123456789":
        a.add_word(c, ("0", 1))
    for kind, names in (("url", SCHEMES), ("account", CUES), ("iban", ("iban",))):
        for name in names:
            a.add_word(name, (kind, len(name)))
    a.make_automaton()
    return a


def spans_of(text: str, anchors) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then by kind."""
    found: list[tuple[int, int, str, int]] = []
    past = dict.fromkeys(KINDS, 0)  # where the next span of a kind may begin

    def add(kind: str, start: int, end: int) -> None:
        found.append((start, KINDS.index(kind), kind, end))

    for last, (what, size) in anchors.iter(_folded(text)):
        at = last - size + 1
        if what == "0":
            if at >= past["card"]:
                m = _CARD.match(text, at)
                past["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    add("card", at, m.end())
            if at >= past["ip"]:
                m = _IP.match(text, at)
                past["ip"] = (m or _DIGITS.match(text, at)).end()
                if m and all(len(p) <= 3 and int(p or "0") <= 255
                         for p in (x.lstrip("0") for x in m[0].split("."))):
                    add("ip", at, m.end())
        elif what == "@":
            begin = at
            while begin > past["email"] and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at and (m := _DOMAIN.match(text, at + 1)):
                past["email"] = m.end()
                add("email", begin, m.end())
        elif what == "+":
            if at >= past["phone"] and (m := _PHONE.match(text, at)):
                past["phone"] = m.end()
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    add("phone", at, m.end())
        elif what == "url":
            if at >= past["url"] and (m := _URL.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)]}"))
                if end > last + 1 and (text[last] == ":" or _HOST.match(text[last + 1:end])):
                    past["url"] = end
                    add("url", at, end)
        elif what == "iban":
            if at >= past["account"] and (m := _IBAN.match(text, last + 1)) and (n := iban_length(m[1])):
                past["account"] = m.start(1) + n
                add("account", m.start(1), m.start(1) + n)
        elif at >= past["account"] and (m := _ACCOUNT.match(text, last + 1)):
            k = 1 if m[1] else 2
            if any(c in "0123456789" for c in m[k]):
                past["account"] = m.end(k)
                add("account", m.start(k), m.end(k))
    found.sort()
    return [(kind, start, end) for start, _, kind, end in found]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans``: the personal data in every whole text."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t.as_py(), anchors)]
                     for t in b.column("_text")]
            yield pa.record_batch([b.column("_id"), pa.array(spans, kind)], names=["_id", "spans"])

    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, spans {SPANS}"
    return map_arrow(rows, find, schema).withColumnRenamed("_id", id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with personal data replaced in ``text_col``; null texts stay null."""
    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _automaton()
        for b in batches:
            new = [None if t is None else redacted(t, spans_of(t, anchors)) for t in b.column(k).to_pylist()]
            yield b.set_column(k, b.schema.field(k), pa.array(new, b.schema.field(k).type))

    plain, k = positional(docs), docs.columns.index(text_col)
    return map_arrow(plain, replace, plain.schema).toDF(*docs.columns)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, a digest of the base spans, and all spans as text."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(id_col, *map(of, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
