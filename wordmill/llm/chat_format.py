"""Chat formatting from reply trees (DataFrame functions only).

Messages point to the message they answer.  Iterative self-joins double the
distance each message can look back (parent, grandparent, 4th, 8th ancestor),
which gives every message its root, depth and summed score in log2(depth)
rounds.  The leaves are then ranked per root by their path's score, and the same
doubled links, taken from long to short, enumerate the chosen root-to-leaf paths.
Each path becomes one formatted conversation with the spans under the loss mask.

Template: for every turn ``<|turn|>role<|body|>text<|end|>``.  Inside roles and
texts ``\\`` becomes ``\\b`` and ``<`` becomes ``\\l``, so no control string can
occur there, and the escape is undone exactly.

Defined results
* null text and null role are empty strings; null scores are 0.
* A parent that does not exist makes its message a root; messages on a cycle
  have no root and are in no path.
* Equal path scores: the smaller leaf id ranks first.
* Rows of a plain turn table are ordered by (turn, role, text); rows that repeat
  all of them stay as turns of their own.  Null conversation ids form one
  conversation, null turns come first.
* Empty tables give empty results; other columns are ignored.
* A conversation is one output row, so one path must fit into a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmill.llm.common import let, materialize, number_rows

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def messages_from_turns(turns: DataFrame) -> DataFrame:
    """``id, parent, conv_id, role, text, score``: each row of ``conv_id, turn, role, text``
    answers the row before it in its conversation."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    rows = number_rows(rows, ["conv_id", "turn", "role", "text"], "id")
    first = rows.groupBy("conv_id").agg(F.min("id").alias("first"))
    # Consecutive numbers within a conversation: all rows but its first answer the number before.
    roots = first.select(F.col("first").alias("root"))
    joined = rows.join(roots, F.col("id") == F.col("root"), "left")
    return joined.select("id", F.when(F.col("root").isNull(), F.col("id") - 1).alias("parent"), "conv_id", "role",
                         "text", F.lit(0.0).alias("score"))


def _links(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Every message that has a root with its root, depth and path score, and the doubled links (id, up) by round.

    Only messages whose look-back has not reached a root yet take part in a
    round's join, so a deep tree does not make the shallow ones work.
    """
    m = messages.select("id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = m.select(F.col("id").alias("up"))
    # ``total`` and ``depth`` cover the message and all up to, not including, ``up``.
    one = F.lit(1).cast("long").alias("depth")
    linked = materialize(m.where("parent IS NOT NULL").join(known, F.col("parent") == F.col("up")).select(
        "id", "up", F.col("score").alias("total"), one, F.lit(None).cast("long").alias("root")), "chat-links")
    roots = m.join(linked.select(F.col("id").alias("_l")), F.col("id") == F.col("_l"), "left_anti").select(
        "id", F.lit(None).cast("long").alias("up"), F.col("score").alias("total"), one, F.col("id").alias("root"))
    ended, open_, levels = materialize(roots, "chat-links"), linked, []
    n = open_.count()
    limit = n.bit_length() + 1  # more rounds are needed by cycles only
    while n and len(levels) < limit:
        levels.append(open_.select("id", "up"))
        far = ended.unionByName(open_).select(*[F.col(c).alias(f"_{c}") for c in open_.columns])
        state = materialize(open_.join(far, F.col("up") == F.col("_id")).select(
            "id", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"),
            (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_root").alias("root")), "chat-links")
        ended, open_ = ended.unionByName(state.where("up IS NULL")), state.where("up IS NOT NULL")
        n = open_.count()
    return ended, levels


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``path, rank, score, n_turns, id, place``: the ``branches`` best root-to-leaf paths of every root.

    ``path`` is the leaf's id, ``place`` the distance from the leaf.
    """
    nodes, levels = _links(messages)
    answered = messages.select(F.col("parent").alias("_p")).where("_p IS NOT NULL").distinct()
    leaves = nodes.join(answered, nodes["id"] == answered["_p"], "left_anti")
    best = Window.partitionBy("root").orderBy(F.col("total").desc(), "id")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches).select(
        F.col("id").alias("path"), "rank", F.col("total").alias("path_score"), F.col("depth").alias("n_turns"),
        F.col("id").alias("node"), F.lit(0).cast("long").alias("place"))
    paths = materialize(chosen, "chat-paths")
    for k in range(len(levels) - 1, -1, -1):
        step = levels[k]
        further = paths.join(step, paths["node"] == step["id"]).select(
            "path", "rank", "path_score", "n_turns", F.col("up").alias("node"),
            (F.col("place") + F.lit(1 << k)).alias("place"))
        paths = materialize(paths.unionByName(further), "chat-paths")
    return paths


def _format(turns: Column) -> Column:
    """Struct of the formatted text and the [start, end) spans under the loss mask, in code points."""
    pieces = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY)).alias("head"), escape(t["text"]).alias("body"),
        (t["role"] == LOSS_ROLE).alias("loss")))
    span = "array<struct<start:bigint,end:bigint>>"

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        spans = F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))) \
            .otherwise(acc["spans"])
        return F.struct((end + len(END)).alias("at"), spans.alias("spans"))

    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("spans"))
    return let(pieces, lambda p: F.struct(
        F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate(p, empty, add)["spans"].alias("loss_spans")))


def format_conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``conv_id, path, rank, score, formatted, loss_spans``: one row per chosen path."""
    paths = reply_paths(messages, branches)
    told = messages.select("id", "conv_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    rows = paths.join(told, paths["node"] == F.col("id"))
    turns = rows.groupBy("path").agg(
        F.first("rank").alias("rank"), F.first("path_score").alias("score"),
        F.max(F.when(F.col("place") == F.col("n_turns") - 1, F.col("conv_id"))).alias("conv_id"),
        F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("o"), F.col("role"), F.col("text")))).alias("t"))
    return turns.select("conv_id", "path", "rank", "score", _format(F.col("t")).alias("f")) \
        .select("conv_id", "path", "rank", "score", "f.formatted", "f.loss_spans")


def parse(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    marked = F.split(formatted, r"<\|end\|>")
    turns = F.slice(marked, 1, F.size(marked) - 1)
    return F.transform(turns, lambda t: let(
        F.split(F.substring(t, len(TURN) + 1, 2**31 - 1), r"<\|body\|>"), lambda p: F.struct(
            unescape(F.get(p, F.lit(0))).alias("role"), unescape(F.get(p, F.lit(1))).alias("text"))))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digest(conversations: DataFrame) -> DataFrame:
    """Per conversation, figures and digests read back from the formatted text."""
    back = conversations.select("conv_id", "path", "formatted", parse(F.col("formatted")).alias("turns"),
                                loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def with_rows(turns: DataFrame, rows: list[tuple]) -> DataFrame:
    """``turns`` and literal ``(conv_id, turn, role, text)`` rows."""
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        "role", "text")
    one = turns.sparkSession.range(1)
    extra = [one.select(F.lit(c).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"),
                        F.lit(r).alias("role"), F.lit(x).alias("text")) for c, t, r, x in rows]
    return reduce(DataFrame.unionByName, extra, base)
