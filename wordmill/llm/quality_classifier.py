"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors, one for each of its words and each
of its character (UTF-8 byte) 3- and 4-grams, looked up by hash; a word that
repeats the one before it adds the vector of that pattern.  A softmax layer on
the average gives the label's probability.  Vectors and layer are trained
together by stochastic gradient descent in numpy.

Training takes at most about ``SAMPLE`` labelled documents, chosen by a hash of
their ids (documented bound), whole texts; their features are counted on the
executors and one task trains on them.  For scoring, vectors and layer fold into
one number per hash bucket, so all documents are scored in one pass over their
bytes, wherever they lie.

Defined results: null text is empty; an empty text scores by the layer's bias
alone; null labels are not learned from; with no labels every score is 0.5; null
ids and repeated rows are scored like others; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import map_arrow
from wordmill.llm.shingles import mix, pieces, string_buffers, word_hashes

SAMPLE = 6_000         # labelled documents to learn from, at most about
BITS = 18              # hash buckets
DIM = 16               # of the vectors
EPOCHS = 8
RATE = 4.0             # of learning, falling to zero
GRAMS = (3, 4)
_U = np.uint64
_REPEAT = np.array([(1 << BITS) - 1])


def _gram_buckets(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the ``n`` bytes from each place on (digits count as 0)."""
    if len(data) < n:
        return np.empty(0, np.int64)
    data = np.where((data >= 48) & (data <= 57), np.uint8(48), data).astype(_U)
    h = np.full(len(data) - n + 1, n, _U)
    for j in range(n):
        h = (h << _U(8)) | data[j:len(data) - n + 1 + j]
    return (mix(h) >> _U(64 - BITS)).astype(np.int64)


def _word_buckets(words: np.ndarray) -> np.ndarray:
    return (words >> _U(64 - BITS)).astype(np.int64)


def _features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and their counts, text by text."""
    for _, some in pieces(texts):
        data, off = string_buffers(some)
        words, at = word_hashes(some)
        for k in range(len(some)):
            own, text = words[at[k]:at[k + 1]], data[off[k]:off[k + 1]]
            repeats = np.repeat(_REPEAT, int((own[1:] == own[:-1]).sum()))
            yield np.unique(np.concatenate([_word_buckets(own), repeats, *(_gram_buckets(text, n) for n in GRAMS)]),
                            return_counts=True)


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """The logit of label 1 that each bucket adds, and last the bias."""
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, EPOCHS * len(labels)), 0
    shares = [(c / max(c.sum(), 1)).astype(np.float32) for _, c in features]
    for _ in range(EPOCHS):
        for i in rng.permutation(len(labels)):
            buckets, share = features[i][0], shares[i]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ vectors[buckets] if len(buckets) else np.zeros(DIM, np.float32)
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            if len(buckets):
                vectors[buckets] -= (rate * share)[:, None] * (p @ layer)
            layer -= 0.1 * rate * np.outer(p, mean)
            bias -= 0.01 * rate * p
    return np.append(vectors @ (layer[1] - layer[0]), bias[1] - bias[0]).astype(np.float32)


def logits(texts: pa.Array, model: np.ndarray) -> np.ndarray:
    """The logit of label 1 of every text."""
    value, out = model[:-1].astype(np.float64), []

    def sums(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(x)])
        return total[edges[1:]] - total[edges[:-1]]

    for _, some in pieces(texts):
        data, off = string_buffers(some)
        words, at = word_hashes(some)
        got, n = sums(value[_word_buckets(words)], at), np.diff(at)
        if len(words):
            same = np.append(False, words[1:] == words[:-1])
            same[at[:-1][at[:-1] < len(words)]] = False
            again = sums(same.astype(np.float64), at)
            got, n = got + again * value[_REPEAT[0]], n + again
        for k in GRAMS:
            x = np.zeros(len(data))
            x[:max(0, len(data) - k + 1)] = value[_gram_buckets(data, k)]
            # The last k-1 places of a text have no gram of their own.
            last = np.minimum(np.maximum(off[1:] - k + 1, off[:-1]), off[1:])
            total = np.concatenate([[0.0], np.cumsum(x)])
            got, n = got + total[last] - total[off[:-1]], n + (last - off[:-1])
        out.append(got / np.maximum(n, 1) + model[-1])
    return np.concatenate(out) if out else np.empty(0)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Trains on a sample of the labelled documents; the model is one number per bucket."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"),
                                                             F.col(label_col).cast("int").alias("_label"))
    n = known.count()
    if not n:
        return np.zeros((1 << BITS) + 1, np.float32)
    scale = 1 << 30
    some = known.where(F.pmod(F.xxhash64("_id"), F.lit(scale)) < int(min(1.0, sample / n) * scale))
    texts = docs.select(F.col(id_col).alias("_key"), F.coalesce(text_col, F.lit("")).alias("_text")) \
        .join(F.broadcast(some), F.col("_key") == F.col("_id"))  # ``sample`` rows of two numbers

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(_features(b.column("_text")))
            yield pa.record_batch([b.column("_order"), b.column("_label"),
                                   pa.array([x.astype("<u4").tobytes() for x, _ in found], pa.binary()),
                                   pa.array([c.astype("<u4").tobytes() for _, c in found], pa.binary())],
                                  names=["_order", "_label", "buckets", "counts"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, marks = [], []
        for b in batches:
            marks += b.column("_label").to_pylist()
            features += [(np.frombuffer(x, "<u4"), np.frombuffer(c, "<u4"))
                         for x, c in zip(b.column("buckets").to_pylist(), b.column("counts").to_pylist(), strict=True)]
        model = train(features, np.array(marks, np.int64))
        yield pa.record_batch([pa.array([model.tobytes()], pa.binary())], names=["model"])

    ordered = texts.select(F.xxhash64("_id", "_text").alias("_order"), "_label", "_text")
    counted = map_arrow(ordered, count, "_order long, _label int, buckets binary, counts binary")
    fitted = map_arrow(counted.repartition(1).sortWithinPartitions("_order", "_label"), fit, "model binary").first()
    return np.frombuffer(bytes(fitted["model"]), np.float32) if fitted else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          carry: dict[str, Column] | None = None) -> DataFrame:
    """``id, score, predicted`` (and the columns of ``carry``) of every document."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = 1 / (1 + np.exp(-logits(b.column("_text"), model)))
            yield pa.record_batch([b.column("_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                  names=[id_col, "score", "predicted"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, predicted int"
    scored = map_arrow(rows, rate, schema)
    return scored.select("*", *[c.alias(n) for n, c in (carry or {}).items()])
