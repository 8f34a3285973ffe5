"""Text functions: tokenizer, stop words, in-row term frequencies, buckets.

Everything here returns a Spark ``Column`` built from JVM-side expressions, so
callers keep the work inside the scan stage (no Python workers).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must stay equal to the reference behaviour).
#
# Token rule: a first character that is '#', '@' or a word character, then 2 to
# 24 repeats of an optional apostrophe or hyphen followed by a word character.
# "Word character" is Unicode letters, Unicode numbers and underscore.
TOKEN_PATTERN = r"[#@\p{L}\p{N}_](?:['\-]?[\p{L}\p{N}_]){2,24}"
# The same rule with possessive quantifiers for Java's regex engine: nothing
# follows either quantifier, so giving up backtracking states cannot change
# a match, and the engine does less work per character.
TOKEN_PATTERN_JAVA = r"[#@\p{L}\p{N}_](?:['\-]?+[\p{L}\p{N}_]){2,24}+"

# English stop words (public NLTK English list, 179 words, in its usual order).
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all
any both each few more most other some such no nor not only own same so than too
very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Corpus-specific stop words (21 words).
CORPUS_STOP_WORDS = [
    "category", "references", "also", "external", "links",
    "may", "first", "see", "history", "people", "one", "two",
    "part", "thumb", "including", "second", "following",
    "many", "however", "would", "became",
]

# Whitespace as Python's str.split() sees it (one class, valid in Java and RE2).
PY_WHITESPACE = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                 r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")
# The complement for Java's engine: Unicode white space is one lookup there, while the
# ranges above, negated one by one, take some fifteen times as long in tasks side by side.
PY_WORD_JAVA = r"(?U)[^\s\x1C-\x1F]++"
# ---------------------------------------------------------------------------

STOP_WORDS: tuple[str, ...] = tuple(dict.fromkeys(ENGLISH_STOP_WORDS + CORPUS_STOP_WORDS))


def _text(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col, F.lit(""))  # null text counts as empty


def raw_tokens(text: Column | str) -> Column:
    """All non-overlapping token matches of ``lower(text)``, stop words kept."""
    return F.regexp_extract_all(F.lower(_text(text)), F.lit(TOKEN_PATTERN_JAVA), 0)


def is_stop_word(term: Column) -> Column:
    # More than ten literals: the optimizer turns this into a hash-set lookup.
    return term.isin(*STOP_WORDS)


def tokenize(text: Column | str, stop_words: bool = True) -> Column:
    """Token array of ``text`` in text order, stop words removed."""
    toks = raw_tokens(text)
    if not stop_words:
        return toks
    return F.filter(toks, lambda t: ~is_stop_word(t))


def run_starts(sorted_tokens: str) -> Column:
    """Indexes where a new run of equal tokens begins in a sorted token array.

    ``sorted_tokens`` must name a column (not an expression): lambdas read it
    per element, and an expression there would be re-evaluated each time.
    """
    s = F.col(sorted_tokens)
    return F.filter(
        F.transform(s, lambda x, i: F.when(i == 0, i).when(x != s[i - 1], i).otherwise(F.lit(-1))),
        lambda i: i >= 0,
    )


def run_lengths(sorted_tokens: str, starts: str) -> Column:
    """``array<struct<term, tf>>``: each run's token and its length.

    Both arguments name columns: the sorted tokens and their ``run_starts``.
    Together the two steps count terms inside the row in O(n), so per-document
    term frequencies need no shuffle.
    """
    s, st = F.col(sorted_tokens), F.col(starts)
    return F.transform(
        st,
        lambda p, j: F.struct(
            s[p].alias("term"),
            (F.coalesce(F.try_element_at(st, j + 2), F.size(s)) - p).cast("long").alias("tf"),
        ),
    )


def whitespace_word_count(text: Column | str) -> Column:
    """Number of whitespace-separated words (Python ``len(s.split())``): the
    count of maximal non-whitespace runs, found without building an array."""
    return F.regexp_count(_text(text), F.lit(PY_WORD_JAVA)).cast("long")


def term_bucket(term: Column | str, num_buckets: int = 124) -> Column:
    """Bucket of a term: the first 40 bits of md5(term), modulo ``num_buckets``."""
    term = F.col(term) if isinstance(term, str) else term
    h = F.conv(F.substring(F.md5(term), 1, 10), 16, 10).cast("long")
    return F.pmod(h, F.lit(num_buckets)).cast("int")


def title_of(text: Column | str) -> Column:
    """Title derived from a text body: its first line."""
    return F.substring_index(_text(text), "\n", 1)
