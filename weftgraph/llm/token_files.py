"""Token-ID output: Arrow stream files of equal-length sequences and masks, read without copying.

A shard is a pair of Arrow IPC *stream* files in one folder:

* ``shard-NNNNNN.arrows``: record batches of ``ids`` (fixed-size list of uint16 or uint32) and ``mask``
  (fixed-size list of bool, true where an id is real).  Every batch but the last holds ``rows_per_batch``
  rows, so all messages have one length and sequence ``i`` is found by arithmetic in the mapped file: its
  ids and its mask are views of the file's pages.
* ``shard-NNNNNN.docs.arrows``: ``doc_id``, ``start`` (ids before the document in its shard), ``n_tokens``.

Documents follow each other in ascending doc_id (null first; equal ids by text), each closed by ``end_id``;
a document may cross sequences, never shards.  Only the shard's last sequence is padded (id 0, mask false).
Null text counts as empty and gives the end id alone; an empty table gives no shard; repeated rows are
written once for each row; columns other than doc_id and text are ignored.

Shards are written under a task's own name and renamed when complete, so a task that is run again, or twice
at once, leaves the same files.  ``pyarrow.fs`` opens the target folder by its URI.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import shared
from .wordcache import cached_tokenizer

_MANIFEST = "shard long, path string, n_docs long, n_tokens long"


def _schema(dtype: str, length: int) -> pa.Schema:
    kind = pa.uint16() if dtype == "<u2" else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Packs documents into sequences and appends full batches to the stream; holds one batch at most."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: str, length: int, rows_per_batch: int):
        self._schema, self._dtype, self._length = _schema(dtype, length), np.dtype(dtype), length
        self._fill = np.zeros(length * rows_per_batch, dtype=self._dtype)
        self._used = self.n_tokens = self.n_docs = 0
        self._out = fs.open_output_stream(f"{path}.arrows")
        self._ipc = pa.ipc.new_stream(self._out, self._schema)
        self._docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self._docs_out = fs.open_output_stream(f"{path}.docs.arrows")
        self._docs_ipc = pa.ipc.new_stream(self._docs_out, self._docs_schema)
        self._docs: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append((doc_id, self.n_tokens, len(ids)))
        self.n_docs += 1
        self.n_tokens += len(ids)
        if len(self._docs) >= 1 << 14:
            self._flush_docs()
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, len(self._fill) - self._used)
            self._fill[self._used : self._used + n] = ids[at : at + n]
            self._used, at = self._used + n, at + n
            if self._used == len(self._fill):
                self._flush()

    def _flush(self) -> None:
        rows = -(-self._used // self._length)
        if not rows:
            return
        size = rows * self._length
        self._fill[self._used : size] = 0
        ids = pa.FixedSizeListArray.from_arrays(pa.array(self._fill[:size].copy()), self._length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(size) < self._used), self._length)
        self._ipc.write_batch(pa.record_batch([ids, mask], schema=self._schema))
        self._used = 0

    def _flush_docs(self) -> None:
        columns = [list(x) for x in zip(*self._docs)] or [[], [], []]
        self._docs_ipc.write_batch(pa.record_batch([pa.array(x, pa.int64()) for x in columns], schema=self._docs_schema))
        self._docs = []

    def close(self) -> None:
        self._flush()
        self._flush_docs()
        for x in (self._ipc, self._docs_ipc, self._out, self._docs_out):
            x.close()


class ShardReader:
    """Random access to a shard's sequences; a local file is mapped, others are read into memory once."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        opened = lambda p: pa.memory_map(p) if isinstance(fs, pafs.LocalFileSystem) else pa.BufferReader(fs.open_input_stream(p).readall())
        self._file, self._docs_path, self._open = opened(f"{path}.arrows"), f"{path}.docs.arrows", opened
        self.schema = pa.ipc.open_stream(self._file).schema
        self._length = self.schema.field("ids").type.list_size
        self._file.seek(0)
        pa.ipc.read_message(self._file)
        self._first = self._file.tell()
        try:
            batch = pa.ipc.read_record_batch(pa.ipc.read_message(self._file), self.schema)
            self._rows, self._stride = batch.num_rows, self._file.tell() - self._first
        except EOFError:
            self._rows, self._stride = 1, 0

    def batch(self, i: int) -> pa.RecordBatch:
        """Batch ``i`` by its place in the file; its buffers are the file's."""
        self._file.seek(self._first + i * self._stride)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self._file), self.schema)

    def flat(self, i: int) -> np.ndarray:
        return self.batch(i).column("ids").flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of one sequence, as views."""
        batch = self.batch(i // self._rows)
        ids, mask = batch.column("ids"), batch.column("mask")
        return ids[i % self._rows].values.to_numpy(zero_copy_only=True), mask[i % self._rows].values

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        with pa.ipc.open_stream(self._open(self._docs_path)) as docs:
            for batch in docs:
                yield from zip(*(batch.column(k).to_pylist() for k in range(3)))

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids [start, start + n) as one view for each batch that holds some of them."""
        size = self._rows * self._length
        while n > 0:
            i, at = divmod(start, size)
            if getattr(self, "_at", None) != i:
                self._at, self._now = i, self.flat(i)
            part = self._now[at : at + n]
            yield part
            start, n = start + len(part), n - len(part)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int = 1 << 16, length: int = 2048, rows_per_batch: int = 64
) -> DataFrame:
    """Encodes ``docs`` and writes shards to ``folder`` (a URI all executors reach); returns the manifest:
    shard (in document order), path, n_docs, n_tokens.

    One range shuffle of the texts orders documents; encoding and writing share the task that holds a range.
    """
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, tok = context.partitionId(), cached_tokenizer(tokenizer, True, dtype)
        end = np.array([end_id], dtype=dtype).tobytes()
        fs, root = pafs.FileSystem.from_uri(folder)
        writer, tmp, path = None, f"{root}/.shard-{shard:06d}-{context.taskAttemptId()}", f"{root}/shard-{shard:06d}"
        for batch in shared.slices(batches, most=8 << 20, owner="words"):
            if writer is None:
                fs.create_dir(root, recursive=True)
                writer = ShardWriter(fs, tmp, dtype, length, rows_per_batch)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tok.encode_many(batch.column("text"))):
                writer.add(doc_id, np.frombuffer(ids + end, dtype=dtype))
        if writer is None:
            return
        writer.close()
        for suffix in (".docs.arrows", ".arrows"):
            fs.move(tmp + suffix, path + suffix)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/shard-{shard:06d}"], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens]})

    ranged = shared.texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return shared.table(ranged.mapInArrow(write, _MANIFEST), "token-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A row for each document in the shards: doc_id, start over all shards, n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers).  The driver holds one row for each shard file, as Spark itself does."""
    base, rows = 0, []
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):
        rows.append((r["path"], base))
        base += r["n_tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                fs, root = pafs.FileSystem.from_uri(path)
                reader, out = ShardReader(fs, root), []
                for doc_id, start, n in reader.documents():
                    crc = 0
                    for part in reader.tokens(start, n):
                        crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                    out.append((doc_id, before + start, n, crc))
                    if len(out) == 1 << 15:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    shards = spark.createDataFrame(rows, "path string, base long")
    return shards.repartition(max(1, len(rows))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
