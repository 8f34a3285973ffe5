"""HTML extraction: the maximum-scoring stretch of a page is its main text.

A page is read as a sequence of words and tags.  Words score positive and tags
negative; one linear scan finds the contiguous stretch with the greatest sum, and
what its blocks hold, less parts marked as something else (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments), is the text.

The weights come from labelled pages: those whose author marked one main region
(an ``article`` element, or ``main``).  For every kind of token the counts inside
and outside the regions of all labelled pages give a smoothed log odds; plain words
are kept above zero, tags below.  A part marked as something else counts by its
outer tags alone, so an advert within the text does not end it.  A page's own region,
if it has just one, is a feature of its tokens as well: inside it tags cost least,
outside it words score like tags.  Pages without a region are told by words and tags
alone.

Defined results
* A null or empty page, and one without a positive word, has the text ``""``.
* Blocks are the stretches between block-level tags; white space (any) within one
  becomes a space, ``br`` too; blocks are joined by ``\\n`` in page order, empty ones dropped.
* Character references are decoded once, also without a semicolon.  Tags that the
  page's end cuts off are dropped; elements left open end with the page.  A ``<`` that
  starts no tag is text.
* Of equal stretches the first counts.  Repeated rows and null ids give a row each;
  empty tables give none; other columns play no part.
* Without any labelled page, ``DEFAULTS`` are the weights.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import map_arrow

# Element names with a role of their own here; any other name counts as "other", so the kinds are few.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style title textarea xmp iframe noembed noframes".split())  # their content is no markup
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre "
                  "section select summary table tbody td tfoot th thead tr ul".split())
APART = frozenset("aside button canvas datalist dialog footer form head header map menu nav noscript object select svg "
                  "template".split()) | HIDDEN
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search "
                  "toolbar".split())
NAMES = frozenset("ad ads alert announcement aside banner breadcrumb breadcrumbs comment commentlist comments copyright discussion "
                  "disqus footer gdpr header masthead menu modal nav "
                  "navbar navigation notice notices notification pager pagination popup promo related replies respond share "
                  "sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
STEMS = ("advert", "cookie", "consent", "newsletter", "sidebar", "breadcrumb")
NOT_MARKED = ("with", "has", "no", "without")
NEVER = frozenset(("html", "body", "main"))
DEFAULTS = {"word": 1.0, "word:link": 0.1, "word:outside": -1.0, "word:inside": 1.0}
DEFAULT_TAG = -0.5
LEAST = 0.05      # the smallest size of a weight
MOST = 6.0        # ... and the greatest
SMOOTH = 1.0

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z](?:\"[^\"]*\"|'[^']*'|[^'\">])*>|</?[A-Za-z][^>]*(?:>|\Z)",
                    re.S)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"([^\s=\"'<>/]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _marked(name: str, tag: str) -> bool:
    """Whether an element sets its content apart from the main text, by its name, role, class or id."""
    if name in APART:
        return True
    if name in NEVER or len(tag) == len(name) + 2:
        return False
    for key, value in _ATTR.findall(tag[len(name) + 1:-1]):
        key, value = key.lower(), value.strip("\"'")
        if key == "role":
            if value.lower() in ROLES:
                return True
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        elif key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif key in ("class", "id"):
            for one in value.split():
                parts = [p.lower() for p in _PARTS.findall(one)]
                if any((p in NAMES or p.startswith(STEMS)) and not (k and parts[k - 1] in NOT_MARKED)
                       for k, p in enumerate(parts)):
                    return True
    return False


def tokens_of(html: str) -> list[tuple]:
    """``(kind, words or None, within a part set apart, region depth by article and by main, starts a block)`` in page order."""
    out, stack, at, end = [], [], 0, len(html)
    apart = links = articles = mains = 0

    def leave(k: int) -> None:
        nonlocal apart, links, articles, mains
        for name, marked in stack[k:]:
            apart -= marked
            links -= name == "a"
            articles -= name == "article" and not marked
            mains -= name == "main"
        del stack[k:]

    def text(piece: str) -> None:
        words = unescape(piece)
        if words:
            out.append(("word:link" if links else "word", words, apart > 0, articles, mains, False))

    while at < end:
        found = _TOKEN.search(html, at)
        if found is None:
            text(html[at:])
            break
        if found.start() > at:
            text(html[at:found.start()])
        tag, at = found.group(), found.end()
        if tag[1] in "!?":
            continue
        if tag[-1] != ">":
            break  # cut off by the end of the page
        name = _NAME.match(tag).group(1).lower()
        known = name if name in BLOCK or name in INLINE or name in APART else "other"
        block = name in BLOCK
        if tag[1] == "/":
            k = len(stack) - 1
            while k >= 0 and stack[k][0] != name:
                # An inline end tag does not close the blocks around it.
                k = -1 if name in INLINE and stack[k][0] in BLOCK else k - 1
            if k >= 0:
                leave(k)
            out.append(("/" + known, None, apart > 0, articles, mains, block))
            continue
        if name == "p" or block and stack and stack[-1][0] == "p":
            # A block ends an open paragraph, with the inline elements in it.
            k = len(stack) - 1
            while k >= 0 and stack[k][0] in INLINE:
                k -= 1
            if k >= 0 and stack[k][0] == "p":
                leave(k)
        marked, within = _marked(name, tag), apart > 0
        if name not in VOID and not tag.endswith("/>"):
            stack.append((name, marked))
            apart += marked
            links += name == "a"
            articles += name == "article" and not marked
            mains += name == "main"
        out.append((known, None, within, articles, mains, block))
        if name in HIDDEN and stack and stack[-1][0] == name:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = close.start() if close else end
    return out


def _region(tokens: list[tuple]) -> int | None:
    """The field of a token that tells a page's one main region (its article, else its main), or None."""
    for field in (3, 4):
        starts, before = 0, 0
        for t in tokens:
            starts += t[field] > 0 and before == 0
            before = t[field]
        if starts == 1:
            return field
    return None


def _kinds(tokens: list[tuple], region: int | None) -> Iterator[tuple[str, float]]:
    """Each token's kind and how often it counts (a text: its words; what is in a part set apart: not at all)."""
    for kind, words, apart, *rest in tokens:
        size = 0 if apart else 1 if words is None else len(words.split())
        if region is not None:
            inside = rest[region - 3] > 0
            if words is not None:
                kind = "word:inside" if inside else "word:outside"
            elif inside:
                kind = "in"
        yield kind, size


def weigh(kind: str, inside: int, outside: int, all_inside: int, all_outside: int, kinds: int) -> float:
    """Smoothed log odds of a kind, words above zero, tags and words outside a page's region below."""
    odds = log((inside + SMOOTH) / (all_inside + SMOOTH * kinds)) - log((outside + SMOOTH) / (all_outside + SMOOTH * kinds))
    if kind in ("word", "word:link", "word:inside"):
        return min(max(odds, LEAST), MOST)
    return max(min(odds, -LEAST), -MOST)


def learn_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weight by token kind, from the labelled ones of ``pages`` (all of them).

    Each batch of pages counts its tokens; the counts of the few kinds are added up
    by Spark.  The kinds are fixed above, so what reaches the driver is bounded.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner, outer = Counter(), Counter()
            for html in batch.column(0).to_pylist():
                tokens = tokens_of(html or "")
                region = _region(tokens)
                if region is None:
                    continue
                # Both readings of a page: with its region as a feature, and as if it had none.
                for reading in (region, None):
                    for (kind, size), t in zip(_kinds(tokens, reading), tokens, strict=True):
                        if not size:
                            continue
                        if reading is None or kind in ("in", "word:inside", "word:outside"):
                            (inner if t[region] > 0 and not t[2] else outer)[kind] += size
            kinds = sorted(inner | outer)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([inner[k] for k in kinds], pa.int64()),
                                              pa.array([outer[k] for k in kinds], pa.int64())],
                                             ["kind", "inside", "outside"])

    counted = map_arrow(pages.select(F.col(f"`{html_col}`").cast("string").alias("html")), count,
                        "kind string, inside long, outside long")
    rows = counted.groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    ins, outs = sum(r["inside"] for r in rows), sum(r["outside"] for r in rows)
    return DEFAULTS | {r["kind"]: weigh(r["kind"], r["inside"], r["outside"], ins, outs, len(rows)) for r in rows}


def best_stretch(scores: list[float]) -> tuple[int, int] | None:
    """First and last place of the stretch with the greatest positive sum; of equal ones the first."""
    best, at, total, start = 0.0, None, 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, at = total, (start, k)
    return at


def main_text(html: str | None, weights: dict[str, float]) -> str:
    """The main text of a page."""
    tokens = tokens_of(html or "")
    region = _region(tokens)
    scores = [weights.get(kind, DEFAULT_TAG) * size for kind, size in _kinds(tokens, region)]
    found = best_stretch(scores)
    if found is None:
        return ""
    first, last = found
    # Whole blocks: the stretch goes on to the block tags around it.
    while first > 0 and not tokens[first - 1][5]:
        first -= 1
    while last + 1 < len(tokens) and not tokens[last + 1][5]:
        last += 1
    blocks, own = [], []
    for _, words, apart, *rest in tokens[first:last + 1]:
        if words is None:
            if rest[2]:
                blocks.append("".join(own))
                own = []
            elif _ == "br":
                own.append(" ")
        elif not apart and (region is None or rest[region - 3] > 0):
            own.append(words)
    blocks.append("".join(own))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract(pages: DataFrame, weights: dict[str, float], html_col: str = "html",
            keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of every page, its main ``text`` and ``n_chars`` (code points)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, weights) for h in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*(f"k{k}" for k in range(len(keep))), "text", "n_chars"])

    narrow = pages.select(F.col(f"`{html_col}`").cast("string").alias("html"),
                          *[F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(keep)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[1:])
    out = map_arrow(narrow, scan, f"{schema}, text string, n_chars bigint")
    return out.toDF(*keep, "text", "n_chars")
