"""Merkle dataset manifest: a hash tree over the rows of a table, by group (DataFrame functions only).

Leaves of a group, in id order, are cut into aligned blocks of 8^4.  A block
keeps each of its levels as one string of concatenated hex digests, so a run of
eight nodes is a substring of fixed width: hashing these substrings gives the
next level, and what flanks a node within its run are its siblings, one segment
per level.  The roots of a group's blocks are the leaves of the next round, until
one node, the group's subroot, remains; the subroots, in group order, make the
tree of the whole table in the same way.

Rows are numbered by range partitions, a block gathers at most 8^4 of them, and
only digests travel: texts are hashed where they are read.  A row's proof is cut
out of its block's strings when it is asked for; proofs are never shuffled.

Defined results
* A null field counts as ``-``, any other as its UTF-8 byte count, ``:``, value.
* Groups are ordered bytewise, a null group first; null ids come first in theirs.
* Rows that repeat an id are leaves of their own, ordered by their digest (equal
  ones are interchangeable but for their place).
* A lone leaf is its group's subroot, a lone subroot the root, each with no siblings.
* Empty tables give no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import let, materialize, number_rows

ARITY = 8
LEVELS = 4                    # levels within a block
BLOCK = ARITY ** LEVELS       # leaves of a block
HEX = 64                      # characters of a digest
RUN = ARITY * HEX
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"


def leaf_hash(fields: list[Column]) -> Column:
    """Digest of a row's fields, each with its length, so no two rows read alike."""
    def part(c: Column) -> Column:
        return let(c.cast("string"), lambda v: F.coalesce(
            F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*[part(c) for c in fields]).cast("binary"), 256)


def fold(proof: Column, leaf: Column) -> Column:
    """The root that a leaf leads to, by the siblings on its way."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof as one hex string, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def _parents(level: Column) -> Column:
    """The next level of a level string: a digest of every run."""
    last = F.floor((F.octet_length(level) - 1) / RUN).cast("int")
    hashed = F.transform(F.sequence(F.lit(0), last),
                         lambda i: F.sha2(F.substring(level, i * RUN + 1, F.lit(RUN)), 256))
    return F.array_join(hashed, "").cast("binary")


def _blocks(nodes: DataFrame) -> DataFrame:
    """``_g, _block, _size, _rows, l0..l4``: the level strings of every block, null above its last level."""
    at = F.floor(F.col("_pos") / BLOCK).cast("long")
    got = nodes.groupBy("_g", at.alias("_block")).agg(
        F.max("_size").alias("_size"), F.sort_array(F.collect_list(F.struct("_pos", "_node", "_load"))).alias("_in"))
    # Strings of digests are kept as bytes, whose substrings need no search for characters.
    got = got.select("_g", "_block", "_size", F.col("_in._load").alias("_rows"),
                     F.array_join(F.col("_in._node"), "").cast("binary").alias("l0"))
    for j in range(LEVELS):
        got = got.withColumn(f"l{j + 1}", F.when(F.col("_size") > ARITY ** j, _parents(F.col(f"l{j}"))))
    return got


def _segments(i: Column) -> Column:
    """The flanks of leaf ``i`` of a block, one pair per level that the block has."""
    pairs = []
    for j in range(LEVELS):
        level, own = F.col(f"l{j}"), F.shiftright(i, 3 * j) * HEX
        run = F.shiftright(i, 3 * (j + 1)) * RUN
        pair = F.struct(F.substring(level, run + 1, own - run).cast("string").alias("left"),
                        F.substring(level, own + HEX + 1, run + RUN - own - HEX).cast("string").alias("right"))
        pairs.append(F.when(F.col(f"l{j + 1}").isNotNull(), pair))
    return F.filter(F.array(*pairs), lambda s: s.isNotNull())


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every node's way up its group's tree, and the trees' tops (``_g, _top``), read without the ways.

    Nodes are ``_g, _pos, _size, _node, _load``, ways ``_g, _pos, _load, _proof, _top``.
    ``_pos`` counts a group's nodes from 0, ``_size`` is their number.  Each call
    divides the nodes by 8^4, so the recursion is a few calls deep.
    """
    blocks = materialize(_blocks(nodes), "blocks")
    tops = blocks.select("_g", F.col("_block").alias("_pos"), F.ceil(F.col("_size") / BLOCK).cast("long").alias("_size"),
                         F.coalesce(*[f"l{j}" for j in range(LEVELS, -1, -1)]).cast("string").alias("_node"),
                         F.lit(0).alias("_load"))
    if (tops.agg(F.max("_size")).first()[0] or 0) > 1:
        above = climb(tops)[0].select("_g", F.col("_pos").alias("_block"), F.col("_proof").alias("_up"), "_top")
        above = materialize(above, "above")
    else:
        above = tops.select("_g", F.col("_pos").alias("_block"), F.array().cast(PROOF).alias("_up"),
                            F.col("_node").alias("_top"))
    each = F.transform(F.col("_rows"), lambda load, i: F.struct(
        (F.col("_block") * BLOCK + i).alias("_pos"), load.alias("_load"), _segments(i).alias("_own")))
    rows = blocks.select("_g", "_block", F.inline(each))
    ways = rows.join(above, ["_g", "_block"]) \
        .select("_g", "_pos", "_load", F.concat("_own", "_up").alias("_proof"), "_top")
    return ways, above.where(F.col("_block") == 0).select("_g", "_top")


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``_pos`` and ``_size`` within ``_g``, in order of ``_g, _id, _node``."""
    placed = number_rows(rows, ["_g", "_id", "_node"], "_at")
    groups = materialize(placed.groupBy("_g").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_size")), "groups")
    return placed.join(groups, "_g").withColumn("_pos", F.col("_at") - F.col("_from"))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS,
             carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, group, ``leaf``, ``proof`` (flanks by level), ``subroot``, ``root``.

    ``carry`` are further columns, computed from the row where it is read, that
    come back with it under their names.
    """
    extra = carry or {}
    group = F.col(f"`{group_col}`").cast("string")
    key = F.coalesce(F.concat(F.lit("1"), group), F.lit("0"))  # bytewise order, null first
    leaves = docs.select(key.alias("_g"), F.col(f"`{id_col}`").alias("_id"),
                         leaf_hash([F.col(f"`{f}`") for f in fields]).alias("_node"),
                         F.struct(F.col(f"`{group_col}`").alias("group"),
                                  *[c.alias(f"x{k}") for k, c in enumerate(extra.values())]).alias("_more"))
    placed = _numbered(materialize(leaves, "leaves"))
    rows, subroots = climb(placed.select("_g", "_pos", "_size", "_node",
                               F.struct("_id", F.col("_node").alias("leaf"), "_more").alias("_load")))
    upper = _numbered(subroots.select(F.lit("").alias("_g"), F.col("_g").alias("_id"), F.col("_top").alias("_node")))
    upper, _ = climb(upper.select("_g", "_pos", "_size", "_node", F.struct("_id").alias("_load")))
    upper = materialize(upper.select(F.col("_load._id").alias("_g"), F.col("_proof").alias("_last"),
                                     F.col("_top").alias("root")), "roots")
    return rows.join(upper, "_g").select(
        F.col("_load._id").alias(id_col), F.col("_load._more.group").alias(group_col),
        F.col("_load.leaf").alias("leaf"), F.concat("_proof", "_last").alias("proof"),
        F.col("_top").alias("subroot"), "root",
        *[F.col(f"_load._more.x{k}").alias(name) for k, name in enumerate(extra)])


def verified(rows: DataFrame, seen: str) -> DataFrame:
    """Adds ``folded_root`` and ``verified``: whether the digest in column ``seen`` leads to the root."""
    folded = fold(F.col("proof"), F.col(seen))
    return rows.withColumn("folded_root", folded).withColumn("verified", F.col("folded_root") == F.col("root"))
