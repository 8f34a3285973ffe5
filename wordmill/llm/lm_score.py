"""Language-model scores by deleted interpolation.

The model mixes three maximum-likelihood estimates, of the word after its
predecessor, of the word alone, and the uniform one.  The mixture weights depend
on how often the predecessor was seen (buckets of doubling frequency) and are
learned by expectation-maximisation on held-out counts: a tenth of the training
documents, chosen by a hash of id and text, is deleted from the counts, and the
weights are those that make this tenth likeliest.  Scores then use the counts of all
training documents.  All sums over documents are of whole numbers, so scores do not
depend on how the documents are dealt.

Counting uses ``block_counts``: word and word-pair counts of the whole corpus,
grown with it, nothing pruned.  For the weights, what reaches the driver is one
histogram over (frequency bucket, two half-octaves), of fixed size.

Tokens are lower-cased (A-Z) words and one end per text; a text's first word
follows a begin mark.  Probabilities are over the known tokens and one unknown.

Defined results: null text is empty (the end alone); null ids and repeated rows
are scored like others; an empty table gives an empty result; with no training
documents every probability is uniform; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.llm import block_counts as bc
from wordmill.llm.common import materialize
from wordmill.llm.shingles import mix, pieces, splitmix, word_hashes

_U = np.uint64
END, BEGIN = splitmix(np.array([1 << 40, 2 << 40], dtype=_U))
WORD, PAIR = 1, 2
SHORT = {WORD: False, PAIR: True}
DELETED = 10           # one document in so many is held out for the weights
UNIT = 2.0 ** 30       # probabilities are added up in whole multiples of its inverse
ADD = 0.1              # the base score's additive constant
MAX_BUCKET = 48
LEVELS = 96            # half-octaves of probability that the histogram tells apart
STEPS = 60             # of expectation-maximisation
PRIOR = 0.5            # pseudo-count of each weight: none is ever zero
ANSWER = "block int, kind int, bucket int, n int, totals binary, kept binary"
ANSWER_ARROW = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()),
                          ("totals", pa.binary()), ("kept", pa.binary())])


class _Tokens:
    """The token stream of a block: words and pairs as places in sorted distinct keys."""

    def __init__(self, texts: pa.ChunkedArray):
        streams, sizes = [], []
        for _, some in pieces(texts):
            words, off = word_hashes(some)
            ends = np.full(len(off) - 1, END)
            streams.append(np.insert(words, off[1:], ends))
            sizes.append(np.diff(off) + 1)
        self.sizes = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
        stream = np.concatenate(streams) if streams else np.empty(0, _U)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        before = np.empty(len(stream), _U)
        before[1:] = stream[:-1]
        self.first = np.zeros(len(stream), bool)
        self.first[np.cumsum(self.sizes) - self.sizes] = True
        before[self.first] = BEGIN
        self.words, self.word_at = bc.distinct_keys(stream, SHORT[WORD])
        self.pairs, self.pair_at = bc.distinct_keys(mix(before * _U(0x9E3779B97F4A7C15) ^ stream), SHORT[PAIR])

    def estimates(self, word_counts: np.ndarray, pair_counts: np.ndarray, total: int, texts: int):
        """Context frequency, pair and word estimate of every token."""
        seen = word_counts[self.word_at]
        context = np.empty(len(seen), np.int64)
        context[1:] = seen[:-1]
        context[self.first] = texts
        pair = pair_counts[self.pair_at] / np.maximum(context, 1)
        return context, pair, seen / max(total, 1)


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64).clip(0, MAX_BUCKET)


def _level(p: np.ndarray) -> np.ndarray:
    halves = 1 + np.floor(-2 * np.log2(np.maximum(p, 1e-300)))
    return np.where(p > 0, halves.clip(1, LEVELS - 1), 0).astype(np.int64)


def learn_weights(cells: np.ndarray, uniform: float) -> np.ndarray:
    """Weights (pair, word, uniform) per context bucket from rows (bucket, n, pair sum, word sum)."""
    bucket, n = cells[:, 0].astype(np.int64), cells[:, 1]
    p = np.stack([cells[:, 2] / n, cells[:, 3] / n, np.full(len(n), uniform)], 1)
    weights = np.full((MAX_BUCKET + 1, 3), 1 / 3)
    for _ in range(STEPS):
        share = weights[bucket] * p
        share *= (n / share.sum(1))[:, None]
        got = np.full((MAX_BUCKET + 1, 3), PRIOR)
        for k in range(3):
            got[:, k] += np.bincount(bucket, share[:, k], MAX_BUCKET + 1)
        weights = got / got.sum(1, keepdims=True)
    return weights


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
                    block_chars: int = bc.BLOCK_CHARS) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every text.

    ``held_out`` marks the documents that are scored without being learned from.
    """
    n_blocks, bits = bc.plan_blocks(docs, text_col, block_chars, least=DELETED)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"),
                       F.coalesce(held_out, F.lit(False)).alias("_held"))
    # Deleted documents have the first blocks to themselves.  Rows that repeat an id and a text share a block.
    n_deleted = -(-n_blocks // DELETED)
    n_blocks += n_deleted
    deleted = F.pmod(F.xxhash64("_id", F.xxhash64("_text"), F.lit("deleted")), F.lit(DELETED)) == 0
    place = F.xxhash64("_id", F.xxhash64("_text"))
    dealt = rows.withColumn("_block", F.when(deleted, F.pmod(place, F.lit(n_deleted))).otherwise(
        n_deleted + F.pmod(place, F.lit(n_blocks - n_deleted))).cast("int"))

    def count(key: tuple, t: pa.Table) -> pa.Table:
        number = key[0].as_py()
        tokens = _Tokens(t.column("_text"))
        learned = ~t.column("_held").to_numpy()[tokens.doc]
        out = []
        for kind, keys, at in ((WORD, tokens.words, tokens.word_at), (PAIR, tokens.pairs, tokens.pair_at)):
            out += bc.report(number, kind, keys, np.bincount(at, learned, len(keys)).astype(np.int64), bits, SHORT[kind])
        return bc.table_of(out, bc.REPORT_ARROW)

    def add_up(key: tuple, t: pa.Table) -> pa.Table:
        out = []
        for kind in (WORD, PAIR):
            own = [r for r in t.to_pylist() if r["kind"] == kind]
            if not own:
                continue
            counts = np.concatenate([bc.wide(r["counts"], r["n"]) for r in own])
            keys, at = np.unique(np.concatenate([bc.reported_keys(r, bits) for r in own]), return_inverse=True)
            gone = np.repeat([r["block"] < n_deleted for r in own], [r["n"] for r in own])
            totals = np.bincount(at, counts, len(keys)).astype(np.int64)
            kept = np.bincount(at, np.where(gone, 0, counts), len(keys)).astype(np.int64)
            edge = 0
            for r in own:
                mine = at[edge:edge + r["n"]]
                edge += r["n"]
                out.append((r["block"], kind, r["bucket"], r["n"], bc.narrow(totals[mine]),
                            bc.narrow(kept[mine]) if r["block"] < n_deleted else b""))
            if kind == WORD:  # block -1: number and sum of the known tokens, and of ends, all and kept
                end = keys == END
                sums = [(totals > 0).sum(), totals.sum(), (kept > 0).sum(), kept.sum(), totals[end].sum(), kept[end].sum()]
                out.append((-1, WORD, r["bucket"], len(sums), ",".join(map(str, sums)).encode(), b""))
        return bc.table_of(out, ANSWER_ARROW)

    reports = dealt.groupBy("_block").applyInArrow(count, bc.REPORT)
    found = materialize(reports.groupBy("bucket").applyInArrow(add_up, ANSWER), "lm-counts")
    parts = F.split(F.col("totals").cast("string"), ",")
    sums = found.where("block < 0").agg(*[F.coalesce(F.sum(parts[k].cast("long")), F.lit(0)) for k in range(6)]).first()
    known, total, known_kept, total_kept, texts, texts_kept = map(int, sums)
    replies = found.where("block >= 0")

    def tell(key: tuple, t: pa.Table, reply: pa.Table) -> pa.Table:
        tokens = _Tokens(t.column("_text"))
        context, pair, word = tokens.estimates(bc.answers(reply, WORD, "kept"), bc.answers(reply, PAIR, "kept"),
                                               total_kept, texts_kept)
        learned = ~t.column("_held").to_numpy()[tokens.doc]
        code = ((_bucket(context) * LEVELS + _level(pair)) * LEVELS + _level(word))[learned]
        cells, at = np.unique(code, return_inverse=True)
        whole = lambda p: pa.array(np.bincount(at, np.rint(p[learned] * UNIT), len(cells)).astype(np.int64))
        return pa.table([pa.array(cells), pa.array(np.bincount(at, minlength=len(cells)).astype(np.int64)), whole(pair),
                         whole(word)], names=["cell", "n", "pair", "word"])

    held = dealt.where(F.col("_block") < n_deleted).groupBy("_block").cogroup(
        replies.where(F.col("block") < n_deleted).groupBy("block"))
    cells = held.applyInArrow(tell, "cell long, n long, pair long, word long") \
        .groupBy("cell").agg(*[F.sum(F.col(c).cast("decimal(38,0)")) for c in ("n", "pair", "word")]).orderBy("cell").collect()
    table = np.array([(r[0] // LEVELS ** 2, r[1], float(r[2]) / UNIT, float(r[3]) / UNIT) for r in cells],
                     np.float64).reshape(-1, 4)
    weights = learn_weights(table, 1 / (known_kept + 1))

    def score(key: tuple, t: pa.Table, reply: pa.Table) -> pa.Table:
        tokens = _Tokens(t.column("_text"))
        counts = bc.answers(reply, WORD, "totals")
        context, pair, word = tokens.estimates(counts, bc.answers(reply, PAIR, "totals"), total, texts)
        w = weights[_bucket(context)]
        p = w[:, 0] * pair + w[:, 1] * word + w[:, 2] / (known + 1)
        seen = counts[tokens.word_at]
        base = np.log10((seen + ADD) / (total + ADD * (known + 1)))
        add = lambda x: np.bincount(tokens.doc, x, len(tokens.sizes))
        return pa.table([t.column("_id"), t.column("_held"), pa.array(tokens.sizes),
                         pa.array(add(seen > 0).astype(np.int64)), pa.array(np.full(len(tokens.sizes), total)),
                         pa.array(add(base)), pa.array(add(np.log10(p)))], names=names)

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = f"`{id_col}` {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, " \
             "base_score double, score double"
    return dealt.groupBy("_block").cogroup(replies.groupBy("block")).applyInArrow(score, schema)
