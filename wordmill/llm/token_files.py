"""Token ids in Arrow files of equal-length sequences.

Documents are range-partitioned by id; every partition tokenises its documents
in order, ends each with an end id and cuts the stream of ids into sequences of
one length.  A partition becomes one Arrow IPC file whose columns are
fixed-size lists, so sequence ``i`` of a file lies at a computed place and a
memory-mapped reader gets ids and masks without copying:

* ``input_ids``  fixed_size_list<uint16 or uint32>[length]
* ``mask``       fixed_size_list<bool>[length]: true for ids, false for padding
* ``doc_end``    fixed_size_list<bool>[length]: true at each document's end id

The last sequence of a file is padded.  A second Arrow file of the partition
lists its documents (id, first place, number of ids).  A task writes under a
name of its own attempt and renames when done, so a repeated task replaces its
file by an equal one.  ``manifest`` (Parquet) has one row per file.

Defined results: null text is empty (the end id alone); null ids come first,
equal ids stay as rows of their own in input order; other columns are ignored;
an empty table gives an empty manifest.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordmill.llm.common import map_arrow, shuffle_partitions

SEQUENCE = 2048        # ids in a sequence
BATCH = 64             # sequences in a record batch
CACHE = 400_000      # pieces whose ids a worker remembers
GROUP = 256            # documents tokenised together


def filesystem(path: str):
    """The Arrow file system and path for a URI (a plain path is local)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# Marks cut off from the word before them, and words from the line break before them.
_MARK = re.compile(r"[,.\n](?<=[^\W_][,.\n])")
_LINE = re.compile(r"\n(?<=\S\n)(?=[^\W_])")


class Encoder:
    """Ids of whole texts, remembering those of small pieces.

    Byte-level pre-tokenisation always starts a new piece at a single space
    before a character, at a comma, full stop or line break after a letter or
    digit, and at a letter or digit after a single line break.  A text's ids
    are those of its pieces in turn; pieces that begin without a space carry
    a zero character.  New pieces are encoded many at a time as one text and
    told apart by the bytes each id stands for.  Texts with other white space
    after a space, or with a zero character, are encoded as a whole.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path)
        size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # In a byte-level vocabulary every character of an entry stands for one byte.
        self.n_bytes = np.array([len(self.tok.id_to_token(i) or "") for i in range(size)], np.int64)
        self.known: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _spaced(self, some: list[str]) -> list[bytes]:
        """The ids of each piece with a space before it."""
        ids = self._whole(" " + " ".join(some))
        ends = np.cumsum(self.n_bytes[ids])
        sizes = np.cumsum([len(p.encode()) + 1 for p in some])
        cuts = np.searchsorted(ends, sizes) + 1
        if (ends[cuts - 1] != sizes).any():  # a special token's own string
            return [self._whole(" " + p).tobytes() for p in some]
        raw, width = ids.tobytes(), self.dtype.itemsize
        edges = [0, *(cuts * width).tolist()]
        return [raw[i:j] for i, j in zip(edges, edges[1:], strict=False)]

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) > CACHE // 2:  # what was not used since the last time goes
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        new = pieces - known.keys()
        seen = new & old.keys()
        known.update(zip(seen, map(old.__getitem__, seen), strict=True))
        plain = []
        for p in new - seen:
            if p[:1] == "\0":
                known[p] = self._whole(p[1:]).tobytes()
            elif not p or p[0].isspace() or p[-1].isspace():
                known[p] = None if not p or p[0].isspace() else self._whole(" " + p).tobytes()
            else:
                plain.append(p)
        for k in range(0, len(plain), 2048):
            some = plain[k:k + 2048]
            known.update(zip(some, self._spaced(some), strict=True))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        parts = [None if "\0" in t else ("\0" + _LINE.sub("\n \0", _MARK.sub(r" \0\g<0>", t))).split(" ")
                 for t in texts]
        self._learn(set().union(*filter(None, parts)))
        out, get = [], self.known.__getitem__
        for t, p in zip(texts, parts, strict=True):
            try:
                out.append(np.frombuffer(b"".join(map(get, p)), self.dtype))
            except TypeError:  # no pieces, or one that is not for itself
                out.append(self._whole(t))
        return out


@lru_cache(maxsize=1)
def encoder(tokenizer_path: str) -> Encoder:
    """One per worker process: what it remembers serves all its tasks."""
    return Encoder(tokenizer_path)


class _Writer:
    """Cuts a stream of ids into sequences and writes them in batches."""

    def __init__(self, sink, dtype: np.dtype, length: int):
        self.length, self.dtype = length, dtype
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)),
                                 ("doc_end", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.ids: list[np.ndarray] = []
        self.ends: list[int] = []  # places of end ids in what is not yet written
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.held += len(ids)
        self.ends.append(self.held - 1)
        if self.held >= BATCH * self.length:
            self._write(self.held // self.length // BATCH * BATCH)  # full batches only

    def _write(self, n: int) -> None:
        stream, size = np.concatenate(self.ids), n * self.length
        ends = np.zeros(size, bool)
        at = np.array(self.ends, np.int64)
        ends[at[at < size]] = True
        mask = np.ones(size, bool)
        body = stream[:size]
        if len(body) < size:
            mask[len(body):] = False
            body = np.concatenate([body, np.zeros(size - len(body), self.dtype)])
        for k in range(0, n, BATCH):
            cut = slice(k * self.length, min(n, k + BATCH) * self.length)
            cols = [pa.FixedSizeListArray.from_arrays(pa.array(x[cut]), self.length) for x in (body, mask, ends)]
            self.out.write_batch(pa.record_batch(cols, schema=self.schema))
        self.ids = [stream[size:].copy()]
        self.held = max(0, len(stream) - size)
        self.ends = [int(e) - size for e in at if e >= size]

    def close(self) -> None:
        if self.held:
            self._write(-(-self.held // self.length))
        self.out.close()


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, length: int = SEQUENCE,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files below ``path``; returns the manifest ``file, n_docs, n_tokens, start``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"),
                       F.monotonically_increasing_id().alias("tie"))
    placed = rows.repartitionByRange(shuffle_partitions(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        context = TaskContext.get()
        file = context.partitionId()
        fs, root = filesystem(path)
        fs.create_dir(root, recursive=True)
        encode = encoder(tokenizer_path)
        end = np.array([end_id], encode.dtype)
        own = f".{context.taskAttemptId()}.part"
        names = [f"{root}/tokens-{file:06d}.arrow", f"{root}/docs-{file:06d}.arrow"]
        index = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
        n_docs = at = 0
        with fs.open_output_stream(names[0] + own) as a, fs.open_output_stream(names[1] + own) as b:
            out, listed = _Writer(a, encode.dtype, length), pa.ipc.new_file(b, index)
            for batch in _chain(first, batches):
                for k in range(0, batch.num_rows, GROUP):
                    some = batch.slice(k, GROUP)
                    encoded = encode(some.column("text").to_pylist())
                    sizes = np.array([len(x) + 1 for x in encoded], np.int64)
                    for ids in encoded:
                        out.add(np.concatenate([ids, end]))
                    firsts = at + np.cumsum(sizes) - sizes
                    listed.write_batch(pa.record_batch([some.column("doc_id"), pa.array(firsts), pa.array(sizes)],
                                                       schema=index))
                    at += int(sizes.sum())
                    n_docs += len(sizes)
            out.close()
            listed.close()
        for name in names:
            if fs.type_name != "local" and fs.get_file_info(name).type.name != "NotFound":
                fs.delete_file(name)
            fs.move(name + own, name)
        yield pa.record_batch([pa.array([file], pa.int32()), pa.array([n_docs], pa.int64()),
                               pa.array([at], pa.int64())], names=["file", "n_docs", "n_tokens"])

    map_arrow(placed, write, "file int, n_docs long, n_tokens long").write.parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def _chain(first, rest):
    yield first
    yield from rest


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file, n_docs, n_tokens, start``: one row per file, ``start`` counts the ids of earlier files."""
    files = spark.read.schema("file int, n_docs long, n_tokens long").parquet(f"{path}/manifest")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def open_tokens(path: str, file: int):
    """A reader of one file's sequences: memory-mapped (without copying) where the file is local."""
    fs, root = filesystem(path)
    name = f"{root}/tokens-{file:06d}.arrow"
    return pa.ipc.open_file(pa.memory_map(name) if fs.type_name == "local" else fs.open_input_file(name))


def sequence(reader, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence ``i`` of a file; the ids are a view of the mapped file."""
    batch, row = reader.get_batch(i // _batch_rows(reader)), i % _batch_rows(reader)
    ids = batch.column("input_ids")
    length = ids.type.list_size
    view = ids.values.slice((ids.offset + row) * length, length).to_numpy(zero_copy_only=True)
    mask = batch.column("mask")
    return view, mask.values.slice((mask.offset + row) * length, length).to_numpy(zero_copy_only=False)


def _batch_rows(reader) -> int:
    """Sequences in each batch of a file but the last."""
    return reader.get_batch(0).num_rows


def _stream(reader) -> Iterator[np.ndarray]:
    """The ids of a file, batch by batch, without padding."""
    for k in range(reader.num_record_batches):
        batch = reader.get_batch(k)
        ids = batch.column("input_ids").flatten().to_numpy(zero_copy_only=True)
        mask = batch.column("mask").flatten().to_numpy(zero_copy_only=False)
        yield ids if mask.all() else ids[mask]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files."""
    manifest = read_manifest(spark, path)
    tasks = manifest.repartition(shuffle_partitions(manifest), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                fs, root = filesystem(path)
                parts, held, at = _stream(open_tokens(path, row["file"])), np.empty(0, np.uint32), 0
                with fs.open_input_file(f"{root}/docs-{row['file']:06d}.arrow") as f:
                    listed = pa.ipc.open_file(f)
                    for k in range(listed.num_record_batches):
                        docs, sums = listed.get_batch(k), []
                        for n in docs.column("n_tokens").to_pylist():
                            have, size = [held[at:]], len(held) - at
                            while size < n:
                                have.append(next(parts).astype("<u4"))
                                size += len(have[-1])
                            if len(have) > 1:
                                held, at = np.concatenate(have), 0
                            sums.append(zlib.crc32(held[at:at + n].tobytes()))
                            at += n
                        starts = np.asarray(docs.column("first")) + row["start"]
                        yield pa.record_batch([docs.column("doc_id"), pa.array(starts), docs.column("n_tokens"),
                                               pa.array(sums, pa.int64())],
                                              names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(tasks, read, "doc_id long, start long, n_tokens long, ids_crc32 long")
