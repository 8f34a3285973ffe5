"""N-gram Jaccard join with token-combination prefixes.

Documents are sets of word shingles; two of them link when their Jaccard
similarity reaches the threshold.  Equal sets are one class from the start.

1. The document frequency of every shingle is counted over all classes
   (``block_counts``) and orders the shingles, rare ones first.
2. A class of size n links only to classes with which it shares at least
   ceil(t n) shingles, so the first shared shingle lies in its first
   n - ceil(t n) + 1, the second one place further.  In this extended prefix,
   shingles of the rare class (document frequency up to ``FREQUENT``) are
   indexed one by one; of the frequent class, all combinations of two are.  Very
   large sets (over ``LARGE`` shingles), whose combinations would be many, index
   their frequent shingles one by one; sets between ``LARGE`` and ``LARGE`` / t
   do both, so two linked sets always share an entry.  Shingles that no other
   class has are not indexed, which leaves out all classes without near copies.
3. Classes under one entry are compared with one of them, the leader, and
   verified exactly; links join classes into components.  Only pairs that still
   lie in different components are of interest then: rounds with other leaders
   follow while they link many, and last all those pairs are verified.  So a
   group of thousands of near copies costs a few comparisons a member, and no
   link between components is missed.
4. Before any verification, two exact bounds drop pairs that cannot link: the
   shingles that come before the entry in either set, and parity bits.

Nothing is capped or sampled; equal texts are never expanded into pairs.

Defined results: words are lower-cased (A-Z); a text with fewer words than a
shingle is one shingle, a text without words has none and links with nothing;
null ids take no part and have a null component; rows that repeat an id are
documents of their own under that id; a component's id is its smallest document
id; empty tables give empty results; other columns are ignored, or pass through
``keep_one`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wordmill.llm import block_counts as bc
from wordmill.llm.common import map_arrow, materialize
from wordmill.llm.components import connected_components
from wordmill.llm.shingles import mix, shingle_sets

FREQUENT = 2_000       # classes that share a shingle of the rare class, at most
LARGE = 400            # shingles of a set whose frequent ones are combined
STARS = 6              # rounds with one leader per entry, at most
WORTH = 1_000          # links of such a round for another to follow; with fewer, no dense group of more is left
DROPPED_BYTES = 64 << 20
_U = np.uint64
SHINGLES = 1
ANSWER = "block int, kind int, bucket int, n int, totals binary"
ANSWER_ARROW = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()),
                          ("totals", pa.binary())])


def needed(n, pct: int):
    """Shingles that a set of size ``n`` shares with any linked set, at least."""
    return -(-n * pct // 100)


def _signature(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def signatures(rows: DataFrame, text_col: str, k: int) -> DataFrame:
    """``rows`` with ``_n``, the size of each text's shingle set, and ``_s``, its 64-bit signature."""
    place = rows.columns.index(text_col)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(len(s), _signature(s)) for s in shingle_sets(b.column(place), k)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.int64())],
                names=[*b.schema.names, "_n", "_s"])

    return map_arrow(rows, sign, StructType(list(rows.schema.fields)).add("_n", "long").add("_s", "long"))


def _index_entries(s: np.ndarray, df: np.ndarray, pct: int, frequent: int, large: int) -> tuple[np.ndarray, np.ndarray]:
    """The index entries of one set, and the shingles that come before each in the set's order.

    ``s`` are the set's shingle hashes, ``df`` their document frequencies.  Two
    sets that meet under the first entry they share have no earlier shingle in
    common, which bounds what they can share at all.
    """
    n = len(s)
    extended = min(n, n - needed(n, pct) + 2)
    order = np.lexsort((s, df))[:extended]
    s, df, place = s[order], df[order], np.arange(extended)
    rare, often = np.flatnonzero((df > 1) & (df <= frequent)), np.flatnonzero(df > frequent)
    entries, places = [s[rare]], [place[rare]]
    if n > large:
        entries.append(s[often])
        places.append(place[often])
    if n * pct <= large * 100 and len(often) > 1:
        i, j = np.triu_indices(len(often), 1)
        entries.append(mix(s[often][i] * _U(0x9E3779B97F4A7C15) ^ s[often][j]))
        places.append(place[often][j] - 1)  # the two shingles, and nothing else up to the second
    return np.concatenate(entries), np.concatenate(places)


def _parity(s: np.ndarray) -> tuple[int, int]:
    """128 bits, each the parity of the shingles that fall on it.

    A shingle that only one of two sets has changes one bit, so two sets differ
    in at least as many shingles as their parities differ in bits.
    """
    bits = (np.bincount((s & _U(127)).astype(np.int64), minlength=128) & 1).astype(np.uint8)
    low, high = np.packbits(bits).view(np.int64).tolist()
    return low, high


def _index(docs: DataFrame, classes: DataFrame, text_col: str, k: int, pct: int, frequent: int,
           large: int) -> DataFrame:
    """``node, n, doc, b0, b1, posts, shingles`` of every class that may have links."""
    n_blocks, bits = bc.plan_blocks(docs, text_col)
    dealt = docs.select("_id", "_text", F.pmod(F.xxhash64("_id"), F.lit(n_blocks)).cast("int").alias("_block"))
    # One row per class, dealt like the document that stands for it.
    chosen = classes.select(F.pmod(F.xxhash64("doc"), F.lit(n_blocks)).cast("int").alias("block"),
                            F.lit(0).alias("kind"), F.lit(0).alias("bucket"), F.lit(0).alias("n"),
                            F.lit(None).cast("binary").alias("totals"), "doc", "node")

    def stand_ins(t: pa.Table, listed: pa.Table) -> tuple[list, list[np.ndarray]]:
        """Nodes and shingle sets of the block's classes, in a fixed order."""
        own = listed.filter(pa.compute.equal(listed.column("kind"), 0))
        want = set(zip(own.column("doc").to_pylist(), own.column("node").to_pylist(), strict=True))
        rows = t.filter(pa.compute.is_in(t.column("_id"), value_set=own.column("doc").combine_chunks()))
        got = {}
        for doc, s in zip(rows.column("_id").to_pylist(), shingle_sets(rows.column("_text"), k), strict=True):
            node = _signature(s)
            if (doc, node) in want:
                got[node] = (node, doc, s)
        ordered = [got[x] for x in sorted(got)]
        return [x[:2] for x in ordered], [x[2] for x in ordered]

    def count(key: tuple, t: pa.Table, listed: pa.Table) -> pa.Table:
        sets = stand_ins(t, listed)[1]
        if not sets:
            return bc.table_of([], bc.REPORT_ARROW)
        keys, at = bc.distinct_keys(np.concatenate(sets), True)
        counts = np.bincount(at, minlength=len(keys))
        return bc.table_of(bc.report(key[0].as_py(), SHINGLES, keys, counts, bits, True), bc.REPORT_ARROW)

    def add_up(key: tuple, t: pa.Table) -> pa.Table:
        return bc.table_of(bc.totals_of(t.to_pylist(), bits), ANSWER_ARROW)

    def entries(key: tuple, t: pa.Table, listed: pa.Table) -> pa.Table:
        names, sets = stand_ins(t, listed)
        out = []
        if sets:
            keys, at = bc.distinct_keys(np.concatenate(sets), True)
            replies = listed.filter(pa.compute.equal(listed.column("kind"), SHINGLES))
            df, edge = bc.answers(replies, SHINGLES, "totals")[at], 0
            for (node, doc), s in zip(names, sets, strict=True):
                own, places = _index_entries(s, df[edge:edge + len(s)], pct, frequent, large)
                edge += len(s)
                if len(own):
                    posts = [{"entry": e, "place": p} for e, p in zip(own.view(np.int64).tolist(), places.tolist(),
                                                                      strict=True)]
                    out.append((node, len(s), doc, *_parity(s), posts, s.view(np.int64)))
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        post = pa.list_(pa.struct([("entry", pa.int64()), ("place", pa.int32())]))
        kinds = [pa.int64()] * 5 + [post, pa.list_(pa.int64())]
        return pa.table([pa.array(c, x) for c, x in zip(cols, kinds, strict=True)],
                        names=["node", "n", "doc", "b0", "b1", "posts", "shingles"])

    texts = dealt.groupBy("_block")
    reports = texts.cogroup(chosen.groupBy("block")).applyInArrow(count, bc.REPORT)
    answers = materialize(reports.groupBy("bucket").applyInArrow(add_up, ANSWER), "df")
    none = F.lit(None).cast("long")
    listed = chosen.unionByName(answers.withColumns({"doc": none, "node": none}))
    return materialize(dealt.groupBy("_block").cogroup(listed.groupBy("block")).applyInArrow(
        entries, "node long, n long, doc long, b0 long, b1 long, posts array<struct<entry:long,place:int>>, "
                 "shingles array<long>"), "index")


def _verified(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """``a, b, linked`` of the pairs, by exact intersection."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").select(
        "a", "b", (both * 100 >= (F.size("sa") + F.size("sb") - both) * pct).alias("linked"))


def _components(index: DataFrame, pct: int, more: int) -> DataFrame | None:
    """``node, comp`` of every class that has a link, or None."""
    side = ["node", "n", "place", "b0", "b1"]
    posts = index.select("node", "n", "doc", "b0", "b1", F.inline("posts"))
    shared = posts.groupBy("entry").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("entry")
    posts = materialize(posts.join(shared, "entry"), "posts")
    if not posts.limit(1).count():
        return None
    differ = F.bit_count(F.col("b0").bitwiseXOR(F.col("b02"))) + F.bit_count(F.col("b1").bitwiseXOR(F.col("b12")))
    both = F.col("n") + F.col("n2")
    most = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"), F.floor((both - differ) / 2))
    able = (F.col("comp") != F.col("comp2")) & (most * 100 >= (both - most) * pct)
    open_ = posts.withColumn("comp", F.col("node"))
    comps, tested, links, stars, worth = None, None, None, 0, True
    while True:
        if worth and stars < STARS:  # every member of an entry with one of them
            first = (F.lit(0) if not stars else F.xxhash64("node", F.lit(stars))).alias("r")
            leader = open_.groupBy("entry").agg(F.min(F.struct(first, "doc", *side, "comp")).alias("l")).select(
                "entry", *[F.col(f"l.{c}").alias(f"{c}2") for c in (*side, "comp")])
            found = open_.join(leader, "entry").where(able)
        else:  # all that could still join two components
            other = open_.select("entry", *[F.col(c).alias(f"{c}2") for c in (*side, "comp")])
            found = open_.join(other, "entry").where(able & (F.col("node") < F.col("node2")))
        pairs = found.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        results = materialize(_verified(pairs, index, pct), "verified")
        n_linked = results.where("linked").count()
        new, seen = results.where("linked").select("a", "b"), results.select("a", "b")
        tested = seen if tested is None else tested.unionByName(seen)
        links = new if links is None else links.unionByName(new)
        if n_linked or comps is None:
            comps = connected_components(links)
        if not worth or stars >= STARS:
            return comps
        worth, stars = n_linked >= more, stars + 1
        at = comps.select(F.col("node").alias("x"), "comp")
        now = posts.join(at, F.col("node") == F.col("x"), "left").select(
            "entry", "doc", *side, F.coalesce("comp", "node").alias("comp"))
        mixed = now.groupBy("entry").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")) \
            .where("lo < hi").select("entry")
        open_ = materialize(now.join(mixed, "entry"), "open")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, min_pct: int = 80,
                    frequent: int = FREQUENT, large: int = LARGE, worth: int = WORTH) -> DataFrame:
    """``id, n_shingles, component_id`` of every document; ids are whole numbers.

    ``min_pct`` is over 50: a pair that one shared shingle links may have no combination in common.
    """
    if not 50 < min_pct <= 100:
        raise ValueError("token combinations find all links for a similarity over 50 %")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    signed = materialize(signatures(rows, "_text", k).select("_id", "_n", "_s"), "signed")
    # Classes of equal sets, each with its first document.
    classes = materialize(signed.where("_n > 0 AND _id IS NOT NULL").groupBy(F.col("_s").alias("node")).agg(
        F.min("_id").alias("doc")), "classes")
    index = _index(rows.where("_id IS NOT NULL"), classes, "_text", k, min_pct, frequent, large)
    comps = _components(index, min_pct, worth)
    if comps is not None:
        known = classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        firsts = known.groupBy("comp").agg(F.min("doc").alias("first"))
        classes = materialize(known.join(firsts, "comp").select("node", F.col("first").alias("doc")), "classes")
    joined = signed.join(classes, (F.col("_s") == F.col("node")) & (F.col("_n") > 0) & F.col("_id").isNotNull(), "left")
    return joined.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col),
                         F.col("_n").alias("n_shingles"), F.coalesce("doc", "_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
             min_pct: int = 80) -> DataFrame:
    """The documents, in their own columns, with one of every component: that of the smallest id."""
    found = materialize(link_components(docs, id_col, text_col, k, min_pct), "components")
    ids = found.where(F.col(id_col).isNotNull())
    dropped = ids.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    n = dropped.count()
    gone = F.broadcast(dropped) if n * 16 <= DROPPED_BYTES else dropped  # 16 bytes a row: a checked bound
    again = ids.groupBy(id_col).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col(id_col).alias("_again"))
    if not again.limit(1).count():
        return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
    # Some ids repeat: decide their rows one by one, by id and set.
    some = docs.join(again, F.col(id_col) == F.col("_again"), "left_semi")
    rest = docs.join(again, F.col(id_col) == F.col("_again"), "left_anti")
    wrapped = some.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"),
                          F.struct("*").alias("_row"))
    signed = signatures(wrapped, "_text", k)
    stay = ids.where(F.col(id_col) == F.col("component_id")).select(
        F.col(id_col).alias("_keep"), F.col("n_shingles").alias("_size")).distinct()
    one = signed.join(stay, (F.col("_id") == F.col("_keep")) & (F.col("_n") == F.col("_size"))).withColumn(
        "_r", F.row_number().over(Window.partitionBy("_id", "_s").orderBy("_text")))
    first = one.where((F.col("_r") == 1) | (F.col("_n") == 0)).select("_row.*")
    return rest.join(gone, F.col(id_col) == F.col("_gone"), "left_anti").unionByName(first)
