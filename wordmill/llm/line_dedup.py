"""Dedup of repeated runs of words and of lines by winnowing over the hashes of units.

Lines break anywhere, so a text's words in lower case are cut into units at
content-defined places (a word's hash decides), long lines and short ones alike.
Then

1. every run of ``MIN_WORDS`` words selects the smallest hash of the first units
   within it (a run with none a gram of words), so places that share a run share
   a fingerprint; those in one place only drop out,
2. places of one fingerprint are joined and the match extended both ways: to all
   runs that select it, then (where others differ) to parts of ``STEPS[0]`` runs,
   then to single runs, that is word by word into the bounding units,
3. of equal places the first by document id, then position, stays; every later
   one is deleted, wherever its words begin or end within a line.

So the first place of a passage keeps it, and every later one loses it whole: a
repeated run is the union of its runs of ``MIN_WORDS`` words.  Each place is
compared with one place only, so a passage in a third of all documents costs one
comparison for each of them.

All of it is DataFrame functions.  Spark interprets lambdas but compiles what
follows an ``explode``, so only the words' hashes and the cuts are arrays made by
lambdas; units, runs and parts are rows, and their neighbours are looked up in
the arrays of their document.

The report also names the repeated runs of whole equal lines, by the same method
over line hashes: a gram is the shortest run of lines from a line on with
``GRAM_WORDS`` words, a window the shortest with ``MIN_WORDS`` from a line on or
up to a line; each window is joined with the first place that holds its lines,
and the match extended both ways as far as the lines agree.

Defined results: null text is empty and has no lines; blank lines are neither
counted nor deleted, and a line that loses all its words goes with its line feed;
texts with fewer than ``MIN_WORDS`` words lose nothing; null ids sort after all
others; rows that repeat an id and its text are one document and fare alike; a
run that repeats within a document counts as a later place of it; other columns
pass through ``drop_repeated_runs`` untouched; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import NOT_SPACE, SPACE, let, materialize, text_of

GRAM_WORDS = 25
MIN_WORDS = 50
CUT_BELOW = -2 ** 31 + 2 ** 32 // 6  # one word in 6 cuts
UNIT_CUTS = 2  # a unit goes from a cut word to the second one after it
UNITS = 6  # of those within a run, the first so many compete
BARE_WORDS = 13
STEPS = (8, 1)


def _words_by_line(low: Column) -> Column:
    """The words of each line that has any; splits at single characters, which need no regular expression, are faster."""
    plain = F.when(low.rlike("[\\x09\\x0B-\\x0D]"), F.translate(low, "\t\x0b\x0c\r", "    ")).otherwise(low)
    found = F.transform(F.split(plain, "\n"), lambda x: F.split(x, " "))
    return F.filter(F.transform(found, lambda w: F.when(F.array_contains(w, ""), F.array_remove(w, "")).otherwise(w)),
                    lambda x: F.size(x) > 0)


def _hashed(rows: DataFrame) -> DataFrame:
    """``_id, _key, lh, ln, h`` of rows ``_id, _key, _text``: line hashes, their word counts, word hashes."""
    low = rows.select("_id", "_key", F.lower("_text").alias("_low"))
    hashes = let(_words_by_line(F.col("_low")), lambda x: F.struct(
        F.transform(x, lambda w: F.xxhash64(w)).alias("lh"), F.transform(x, lambda w: F.size(w)).alias("ln"),
        F.transform(F.flatten(x), lambda w: F.hash(w)).alias("h")))
    return low.select("_id", "_key", hashes.alias("s")).select("_id", "_key", "s.*")


def _span(n: Column, i: Column, least: int) -> Column:
    """Lines in the shortest run from line ``i`` on with ``least`` words; null if there are too few."""
    zero = F.struct(F.lit(0).alias("w"), F.lit(0).alias("k"))
    # Each line has a word, so ``least`` lines are enough.
    run = F.aggregate(F.slice(n, i + 1, least), zero, lambda a, x: F.when(a["w"] >= least, a).otherwise(
        F.struct((a["w"] + x).alias("w"), (a["k"] + 1).alias("k"))))
    return let(run, lambda r: F.when(r["w"] >= least, r["k"]))


def _places(h: Column) -> Column:
    none = F.array().cast("array<int>")
    return F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(none)


def _grams(h: Column, n: Column, gram_words: int) -> Column:
    return F.transform(_places(h), lambda i: let(_span(n, i, gram_words), lambda k: F.struct(
        k.alias("len"), F.xxhash64(F.slice(h, i + 1, F.coalesce(k, F.lit(0)))).alias("hash"))))


def _windows(h: Column, n: Column, g: Column, min_words: int) -> Column:
    """Each window's place, length, hash of all lines, and its selected gram's place and hash."""
    def window(i: Column, k: Column) -> Column:
        inside = F.filter(F.transform(F.slice(g, i + 1, k), lambda x, o: F.struct(
            x["hash"].alias("hash"), (-(i + o)).alias("at"), (o + x["len"]).alias("end"))), lambda x: x["end"] <= k)
        return let(F.array_min(inside), lambda m: F.struct(
            i.alias("pos"), k.alias("len"), F.xxhash64(F.slice(h, i + 1, k)).alias("window"),
            m["hash"].alias("gram"), (-m["at"]).alias("gram_at")))

    begin = F.transform(_places(h), lambda i: let(_span(n, i, min_words), lambda k: F.when(k.isNotNull(), window(i, k))))
    end = let(F.reverse(n), lambda back: F.transform(_places(h), lambda i: let(
        _span(back, F.size(back) - 1 - i, min_words), lambda k: F.when(k.isNotNull(), window(i - k + 1, k)))))
    return F.array_distinct(F.filter(F.concat(begin, end), lambda w: w.isNotNull()))


def sequences(lined: DataFrame, gram_words: int, min_words: int) -> DataFrame:
    """``_id, _key, h, n, w``: line hashes, their word counts, and windows of documents ``_id, _key, lh, ln``."""
    windows = let(F.struct("lh", "ln"), lambda s: let(_grams(s["lh"], s["ln"], gram_words),
                                                      lambda g: _windows(s["lh"], s["ln"], g, min_words)))
    return lined.select("_id", "_key", F.col("lh").alias("h"), F.col("ln").alias("n"), windows.alias("w"))


def _same(a: str, b: str) -> Column:
    return (F.col(f"{a}._key") == F.col(f"{b}._key")) & F.col(f"{a}._id").eqNullSafe(F.col(f"{b}._id"))


def repeated_runs(seqs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``_id, _key, runs``: the [start, end) line runs of each document that occur at an earlier place."""
    each = seqs.select("_id", "_key", F.inline("w"))
    prints = each.groupBy("gram", "_id", "_key", "gram_at").agg(F.lit(1).alias("one"))
    shared = prints.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram")
    placed = materialize(each.join(shared, "gram").select("_id", "_key", "pos", "window"), "windows")
    firsts = placed.groupBy("window").agg(F.min(_place("pos")).alias("f"))
    later = placed.join(firsts, "window").where(~_is_at("f", "pos"))
    diagonals = later.select("_id", "_key", F.col("f._id").alias("_aid"), F.col("f._key").alias("_akey"),
                             (F.col("pos") - F.col("f.at")).alias("shift")).distinct()
    own = seqs.groupBy("_id", "_key").agg(F.first(F.struct("h", "n")).alias("s"))
    held = materialize(own, "lines")
    first = held.select(F.col("_id").alias("_i"), F.col("_key").alias("_k"), F.col("s.h").alias("ah"))
    pairs = diagonals.join(first, F.col("_aid").eqNullSafe(F.col("_i")) & (F.col("_akey") == F.col("_k"))) \
        .select("_id", "_key", "shift", "ah").alias("p").join(held.alias("d"), _same("p", "d")) \
        .select("p._id", "p._key", "shift", "ah", F.col("s.h").alias("h"), F.col("s.n").alias("n"))

    def runs(h: Column, n: Column, ah: Column, shift: Column) -> Column:
        # Where the diagonal's lines differ (or end) the runs are parted.
        differ = F.filter(_places(h), lambda i: ~F.coalesce(F.get(h, i) == F.get(ah, i - shift), F.lit(False)))
        edges = F.concat(F.array(F.lit(-1)), differ, F.array(F.size(h)))
        return let(edges, lambda e: F.filter(
            F.transform(F.slice(e, 1, F.size(e) - 1), lambda x, k: F.struct((x + 1).alias("start"),
                                                                            F.get(e, k + 1).alias("end"))),
            lambda r: F.aggregate(F.slice(n, r["start"] + 1, r["end"] - r["start"]), F.lit(0), lambda a, b: a + b)
            >= min_words))

    found = pairs.select("_id", "_key", F.inline(runs(F.col("h"), F.col("n"), F.col("ah"), F.col("shift"))))
    return found.groupBy("_id", "_key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("runs"))


def _words(h: str, begin: Column, end: Column, salt: Column) -> Column:
    return F.xxhash64(F.slice(h, begin + 1, end - begin), salt.cast("int"))


def _smallest(ranks: Column, reach: int) -> Column:
    """The smallest of each ``reach`` ranks from one on, above its place: the leftmost of equals, by minima over 1, 2, 4, ..."""
    def wider(least: Column, step: int) -> Column:
        return let(least, lambda a: F.transform(a, lambda x, i: F.least(x, F.get(a, i + step))))

    least, span = F.transform(ranks, lambda x, i: F.shiftleft(x.cast("long"), 32) + i), 1
    while span < reach:
        step = min(span, reach - span)
        least, span = wider(least, step), span + step
    return least


def _bare(w: Column, start: Column, min_words: int) -> Column:
    """The fingerprints of the runs in ``w``, the words from ``start`` on, that hold no whole unit.

    A run selects the gram of ``BARE_WORDS`` that begins with its smallest word hash,
    the leftmost of equals; a word that its next one repeats only if all are such.
    Where one word fills many runs in a row, the first, the second, the last and
    every ``min_words``-th stand for all: they touch, and repeat the first.
    """
    size = min(BARE_WORDS, min_words)
    reach, top = min_words - size + 1, 2 ** 31 - 1
    ranks = F.transform(w, lambda x, i: F.when(x == F.get(w, i + 1), top).otherwise(x)) if size > 1 else w

    def rows(least: Column) -> Column:
        at = lambda i: F.get(least, i).bitwiseAND(2 ** 32 - 1).cast("int")
        runs = F.sequence(F.lit(0), F.size(w) - min_words)
        lo = F.filter(runs, lambda i: F.coalesce(at(i) != at(i - 1), F.lit(True)))
        each = let(lo, lambda lo: F.transform(lo, lambda i, k: F.struct(
            i.alias("lo"), (F.coalesce(F.get(lo, k + 1), F.size(w) - min_words + 1) - 1).alias("hi"))))
        if 0 <= size - 2 <= reach:  # two stretches of equal words that touch fill a run
            equal = lambda i: F.coalesce(F.get(least, i) >= top << 32, F.lit(False))
            inner = lambda i: equal(i - 2) & equal(i + size - 1)
            each = F.filter(each, lambda r: ~inner(r["lo"]) | ((start + r["lo"]) % min_words == 0))
        return F.transform(each, lambda r: let(at(r["lo"]), lambda a: F.struct(
            (start + a).alias("at"), (start + r["lo"]).alias("lo"), (start + r["hi"]).alias("hi"),
            _words(w, a, a + size, F.lit(-1)).alias("gram"),
            _words(w, r["lo"], r["hi"] + min_words, a - r["lo"]).alias("around"))))

    return let(_smallest(ranks, reach), rows)


def picks(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """The fingerprints ``_id, _key, at, lo, hi, gram, around``: runs that start in [lo, hi] select the gram at ``at``.

    A unit goes from one cut word up to and with the word after the ``UNIT_CUTS``-th
    next, as that word makes it a cut, too: the two differ.  A run selects the smallest hash among the first ``UNITS`` units within it, the
    leftmost of equals.  So every run has a row, and which gram it selects follows
    from its own words.  ``around`` hashes the words of all runs of a row.

    One more row of each document, where ``gram`` is null, has its ``lines``
    (``lh, ln, h``), so that the texts are read and cut into words here only.
    """
    hashed = _hashed(_keyed(docs, id_col, text_col))
    # Of a word said over and over the last cuts only, or all its places would be fingerprints.
    cuts = F.filter(_places(F.col("h")), lambda i: (F.get(F.col("h"), i) < CUT_BELOW)
                    & (F.get(F.col("h"), i) != F.get(F.col("h"), i + 1)))
    cut = hashed.select("*", cuts.alias("cuts"))
    # Which unit is smaller is a matter of its cut words; what it is, of all its words.
    ranks = F.transform(F.sequence(F.lit(0), F.size("cuts") - UNIT_CUTS - 1), lambda k: F.xxhash64(
        *[F.get(F.col("h"), F.get(F.col("cuts"), k + j)) for j in range(UNIT_CUTS + 1)]))
    ranked = cut.select("*", F.when(F.size("cuts") > UNIT_CUTS, ranks).alias("ranks"))
    each = ranked.select("*", F.explode(F.sequence(F.lit(-1), F.size("cuts"))).alias("k"))
    k, n, rank = F.col("k"), F.size("h"), lambda i: F.get(F.col("ranks"), i)
    begin, end = lambda i: F.get(F.col("cuts"), i), lambda i: F.get(F.col("cuts"), i + UNIT_CUTS) + 1
    # The nearest units that a run must not have before, or after, the unit to select it.
    before = reduce(lambda w, j: w.when(rank(k - j) <= rank(k), k - j), range(1, UNITS), F).otherwise(k - UNITS)
    after = reduce(lambda w, j: w.when(rank(k + j) < rank(k), k + j), range(1, UNITS), F)
    near = each.select("*", before.alias("before"), after.alias("after"))
    lo = F.greatest(F.lit(0), end(k) - min_words + 1, begin(F.col("before")) + 1)
    hi = F.least(n - min_words, begin(k), F.greatest(begin(F.col("after") - UNITS), end(F.col("after")) - min_words))
    # Runs from the cut word before on that end before this unit does hold none.
    start, stop = F.when(k == 0, 0).otherwise(begin(k - 1) + 1), F.least(begin(k), end(k) - min_words, n - min_words)
    # An array of one row, as the optimizer would copy its expressions into the filter, and what it compiles be too long.
    found = near.select("_id", "_key", "lh", "ln", "h", "k", F.inline(F.array(F.struct(
        begin(k).alias("at"), end(k).alias("to"), lo.alias("lo"), F.when(rank(k).isNotNull(), hi).alias("hi"),
        start.alias("start"), stop.alias("stop")))))
    found = found.where("k = -1 OR lo <= hi OR start <= stop")
    gram = _words("h", F.col("at"), F.col("to") + 1, F.lit(-1))
    around = _words("h", F.col("lo"), F.col("hi") + min_words, F.col("at") - F.col("lo"))
    whole = F.when(F.col("lo") <= F.col("hi"), F.struct("at", "lo", "hi", gram.alias("gram"), around.alias("around")))
    bare = F.when(F.col("start") <= F.col("stop"),
                  F.slice("h", F.col("start") + 1, F.col("stop") - F.col("start") + min_words))
    out = found.select("_id", "_key", F.when(F.col("k") == -1, F.struct("lh", "ln", "h")).alias("lines"), whole.alias("p"),
                       "start", bare.alias("w"))
    every = F.when(F.col("w").isNull(), F.array("p")).otherwise(
        F.concat(F.array("p"), _bare(F.col("w"), F.col("start"), min_words)))
    return out.select("_id", "_key", "lines", F.explode(every).alias("p")).select("_id", "_key", "lines", "p.*") \
        .where("lines IS NOT NULL OR gram IS NOT NULL")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")) \
        .withColumn("_key", F.xxhash64("_text"))


def _place(at: str) -> Column:
    # Null ids sort last: a leading flag decides.
    return F.struct(F.col("_id").isNull().alias("late"), F.col("_id").alias("_id"), F.col("_key").alias("_key"),
                    F.col(at).alias("at"))


def _is_at(place: str, at: str) -> Column:
    return F.col("_id").eqNullSafe(F.col(f"{place}._id")) & (F.col("_key") == F.col(f"{place}._key")) \
        & (F.col(at) == F.col(f"{place}.at"))


def _placed(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``rows`` with the ``first`` place of their keys, and whether there is another: ``_twice``.

    A sum and a join, not a window, and the sum stored: rows of a hot key meet in no task.
    """
    ends = rows.groupBy(*keys).agg(F.min(_place(at)).alias("first"), F.max(_place(at)).alias("last"))
    known = ends.select(*keys, "first", (F.col("first") != F.col("last")).alias("_twice"))
    return rows.join(materialize(known, "ends"), keys)


def _matched(each: DataFrame, single: bool = False) -> DataFrame:
    """The rows that share their gram with another text or place of a text, with what is known of them.

    ``_twice``: the same surroundings are in two places or more; ``_first``: this
    place is their first; ``_open``: the gram has other surroundings, too, as it
    never has where rows are ``single`` runs.
    """
    shared = each.withColumn("_open", F.lit(False))
    if not single:
        # Sums of fixed width, and stored before the join, so that a hot gram's rows can be split there.
        ends = [f(c).alias(f"{c}{k}") for c in ("_key", "at", "around") for k, f in enumerate((F.min, F.max))]
        grams = each.groupBy("gram").agg(*ends).where("_key0 != _key1 OR at0 != at1")
        grams = materialize(grams.select("gram", (F.col("around0") != F.col("around1")).alias("_open")), "grams")
        shared = materialize(each.join(grams, "gram"), "shared")
    placed = _placed(shared, ["gram", "around"], "lo")
    # Rows that repeat an id and its text are one place.
    found = placed.select("_id", "_key", "at", "lo", "hi", "_twice", "_open",
                          _is_at("first", "lo").alias("_first"))
    return materialize(found.where("_twice OR _open"), "matched")


def _extended(held: DataFrame, open_: DataFrame, step: int, min_words: int) -> DataFrame:
    """The rows ``open_`` in parts of at most ``step`` runs, aligned to their gram; ``held`` has the words.

    A part's own gram is made of the words that all its runs have in common, be
    the part cut short or not.
    """
    places = open_.groupBy("_id", "_key").agg(F.collect_set(F.struct("at", "lo", "hi")).alias("_w"))
    each = held.alias("d").join(places.alias("w"), _same("d", "w")).select("d._id", "d._key", "h", "_w") \
        .select("_id", "_key", "h", F.explode("_w").alias("p")).select("_id", "_key", "h", "p.*")
    number = lambda c: F.floor((F.col(c) - F.col("at")) / step).cast("int")
    parts = each.select("*", F.explode(F.sequence(number("lo"), number("hi"))).alias("q"))
    begin = F.col("at") + F.col("q") * step
    some = parts.select("_id", "_key", "h", "q", "at", begin.alias("begin"), F.greatest("lo", begin).alias("lo"),
                        F.least(F.col("hi"), begin + step - 1).alias("hi"))
    gram = _words("h", F.col("begin") + step - 1, F.col("begin") + min_words, F.col("q"))
    around = _words("h", F.col("lo"), F.col("hi") + min_words, F.col("lo") - F.col("begin"))
    return materialize(some.select("_id", "_key", "at", "lo", "hi", gram.alias("gram"), around.alias("around")), "parts")


def _copies(lined: DataFrame, min_words: int) -> DataFrame:
    """Texts that are in two documents or more, whole: the first, and every later one."""
    size = F.aggregate("ln", F.lit(0), lambda a, x: a + x)
    sized = lined.select("_id", "_key", F.lit(0).alias("lo"), (size - min_words).alias("hi")).where("hi >= 0")
    often = sized.groupBy("_key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("_key")
    some = materialize(sized.join(often, "_key"), "copies")
    return _placed(some, ["_key"], "lo").where("_twice").select("_id", "_key", "lo", "hi", _is_at("first", "lo").alias("_first"))


def matches(each: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``_id, _key, lo, hi, _first``: places whose runs (starts in [lo, hi]) are also elsewhere, at an earlier place or not.

    ``each`` are the stored ``picks`` of the documents.  Copies of a whole text
    need no fingerprints; those shared by copies only stay out of the rest.
    """
    lined = each.where("lines IS NOT NULL").select("_id", "_key", "lines.*")
    found = _matched(each.where("gram IS NOT NULL").drop("lines"))
    every = [found]
    some = found.where("_first AND _open").select("_id", "_key").distinct()
    held = materialize(lined.select("_id", "_key", "h").alias("d").join(some.alias("w"), _same("d", "w"), "left_semi"), "words")
    for step in STEPS:
        parts = _extended(held, found.where("_first AND _open"), min(step, min_words), min_words)
        found = _matched(parts, step == 1)
        every.append(found)
    every = [f.where("_twice").select("_id", "_key", "lo", "hi", "_first") for f in every]
    return reduce(DataFrame.unionByName, every, _copies(lined, min_words))


def repeated_words(found: DataFrame, min_words: int) -> DataFrame:
    """``_id, _key, spans``: the [start, end) word runs of each document that occur at an earlier place."""
    # Starts near enough to each other for their runs to touch.
    near = F.concat(F.sequence(F.col("lo"), F.col("hi"), F.lit(min_words)), F.array("hi"))
    starts = found.where("NOT _first").select("_id", "_key", F.explode(near).alias("start"))

    def spans(s: Column) -> Column:
        begin = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1) + min_words < x, F.lit(True)))
        end = F.filter(s, lambda x, i: F.coalesce(x + min_words < F.get(s, i + 1), F.lit(True)))
        return F.zip_with(begin, end, lambda b, e: F.struct(b.alias("start"), (e + min_words).alias("end")))

    return starts.groupBy("_id", "_key").agg(F.collect_set("start").alias("s")).select(
        "_id", "_key", let(F.sort_array("s"), spans).alias("spans"))


def _lines_of(runs: Column) -> Column:
    """The line numbers in any of the runs, in order."""
    return F.sort_array(F.array_distinct(F.flatten(
        F.transform(runs, lambda r: F.sequence(r["start"], r["end"] - 1)))))


def _pairs(runs: Column) -> Column:
    """``start:end`` of each run, joined by commas."""
    return F.coalesce(F.array_join(F.transform(runs, lambda r: F.concat_ws(
        ":", r["start"].cast("string"), r["end"].cast("string"))), ","), F.lit(""))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_words: int = GRAM_WORDS,
                min_words: int = MIN_WORDS) -> DataFrame:
    """``id, n_lines, n_words, removed_lines, removed_words, runs, spans`` of every document.

    ``spans`` are the word runs that go and ``removed_words`` their words; ``runs``
    and ``removed_lines`` are what of them are repeated runs of whole equal lines.
    """
    each = materialize(picks(docs, id_col, text_col, min_words), "picks")
    found = materialize(matches(each, min_words), "matches")
    spans = repeated_words(found, min_words)
    lined = each.where("lines IS NOT NULL").select("_id", "_key", "lines.*")
    # A repeated run of lines is one of words, so only documents with a match can have any.
    held = found.select("_id", "_key").distinct()
    some = lined.alias("d").join(held.alias("r"), _same("d", "r"), "left_semi")
    seqs = materialize(sequences(some, gram_words, min_words), "sequences")
    runs = repeated_runs(seqs, min_words).select("_id", "_key", "runs", F.lit(None).alias("spans"))
    gone = runs.unionByName(spans.select("_id", "_key", F.lit(None).alias("runs"), "spans")) \
        .groupBy("_id", "_key").agg(F.first("runs", True).alias("runs"), F.first("spans", True).alias("spans"))
    counts = lined.select(
        "_id", "_key", F.size("ln").cast("long").alias("n_lines"),
        F.aggregate("ln", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_words"))
    out = counts.alias("s").join(gone.alias("r"), _same("s", "r"), "left")
    lines = F.coalesce(_lines_of(F.col("runs")), F.array().cast("array<int>"))
    cut = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select(
        F.col("s._id").alias(id_col), "n_lines", "n_words", F.size(lines).cast("long").alias("removed_lines"),
        F.coalesce(cut, F.lit(0).cast("long")).alias("removed_words"), _pairs(F.col("runs")).alias("runs"),
        _pairs(F.col("spans")).alias("spans"))


def _without_words(text: Column, spans: Column) -> Column:
    """``text`` less the word runs ``spans``; a line that loses all its words goes with its line feed."""
    blank = lambda t: F.regexp_extract(t, f"^({SPACE})?", 0)

    def rest(t: Column, k: Column) -> Column:
        # Each word has the white space before it; the word after a run takes the run's, unless it begins a line.
        begin, end = F.coalesce(F.get(spans, k - 1)["end"], F.lit(0)), F.coalesce(F.get(spans, k)["start"], F.size(t))
        run = F.get(spans, k - 1)["start"]
        head, before = F.get(t, begin), blank(F.get(t, run))
        after = F.when(run == 0, F.concat(before, F.regexp_replace(blank(head), "^[\\x20\\x09\\x0B-\\x0D]*(\n|$)", ""))) \
            .when(blank(head).contains("\n"), blank(head)).otherwise(before)
        first = F.when(k == 0, head).otherwise(F.concat(after, F.regexp_replace(head, f"^({SPACE})?", "")))
        return F.when(begin < end, F.concat(F.array(first), F.slice(t, begin + 2, end - begin - 1))) \
            .otherwise(F.array().cast("array<string>"))

    tail = F.substring(text, F.length(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))) + 1, F.length(text))
    ends = F.element_at(spans, -1)["end"]
    found = F.regexp_extract_all(text, F.lit(f"({SPACE})?{NOT_SPACE}+"), F.lit(0))
    return let(found, lambda t: F.concat(
        F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), lambda k: rest(t, k))), ""),
        F.when((ends == F.size(t)) & (F.get(spans, F.lit(0))["start"] == 0) & (F.size(spans) == 1), F.lit(""))
        .otherwise(tail)))


def drop_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       gram_words: int = GRAM_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, in their own columns, without the words of repeated runs."""
    each = materialize(picks(docs, id_col, text_col, min_words), "picks")
    spans = repeated_words(matches(each, min_words), min_words)
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), text_of(text_col).alias("_text")) \
        .withColumn("_key", F.xxhash64("_text"))
    out = rows.alias("d").join(spans.alias("r"), _same("d", "r"), "left")
    text = F.when(F.col("spans").isNull(), F.col(f"_row.`{text_col}`")).otherwise(
        _without_words(F.col("_text"), F.col("spans")))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
