"""Token-id sequences in Arrow stream files of fixed-size-list batches.

Documents are encoded in ascending id order and each gets the end id; the ids
of one part form one file whose rows are equal-length sequences plus a mask
(false on the padding after the part's last id).  All batches but the last
hold the same number of rows, so they have the same length in bytes and a
reader goes straight to row i of a memory-mapped file: ``first batch + (i div
rows) * batch length``, without copying and without reading what lies before.

The index (one row per document: file, place in the file, number of ids) is
committed by Spark's writer.  A file name belongs to one task attempt and only
files in the committed index count, so a lost executor or a repeated attempt
leaves at most an unused file.

Defined results: a NULL text is empty (only the end id); NULL ids come first;
equal ids keep one row each, ordered by the text's hash; an empty table gives
an empty index and no file; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.ranks import with_offsets
from lexiframe.llm.storage import attempt_name, open_filesystem, plus, written
from lexiframe.llm.tokens import cached_tokenizer
from lexiframe.session import scratch_path

LENGTH = 2048       # ids of a sequence
BATCH_ROWS = 64     # sequences of a batch

INDEX = "id long, part long, local long, n_tokens long, file string, head long, stride long"


class SequenceWriter:
    """Collects ids and writes full batches; memory is one batch and one document."""

    def __init__(self, sink, dtype: np.dtype, length: int, rows: int):
        self.dtype, self.length, self.rows = dtype, length, rows
        self.type = pa.list_(pa.from_numpy_dtype(dtype), length)
        self.schema = pa.schema([("ids", self.type), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = sink
        self.out = pa.ipc.new_stream(sink, self.schema)
        # the schema message is written with the first batch
        self.head, self.stride, self.batches = sink.tell() + self.schema.serialize().size, 0, 0
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        full = self.length * self.rows
        if self.n >= full:
            flat = np.concatenate(self.held)
            for i in range(0, len(flat) - full + 1, full):
                self._write(flat[i: i + full], full)
            self.held = [flat[len(flat) // full * full:]]
            self.n = len(self.held[0])

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        batch = pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length),
             pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema)
        before = max(self.head, self.sink.tell())
        self.out.write_batch(batch)
        self.batches += 1
        if self.batches == 1:
            self.stride = self.sink.tell() - before
        elif self.sink.tell() - before != self.stride and len(flat) == self.length * self.rows:
            raise OSError("batches of equal rows differ in length")

    def close(self) -> None:
        if self.n:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, dtype=self.dtype)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.out.close()


class SequenceReader:
    """Random access to the sequences of one file."""

    def __init__(self, uri: str, head: int, stride: int, length: int, rows: int):
        filesystem, path = open_filesystem(uri)
        local = filesystem.type_name == "local"
        self.file = pa.memory_map(path) if local else filesystem.open_input_file(path)
        self.head, self.stride, self.length, self.rows = head, stride, length, rows
        self.schema = pa.ipc.open_stream(self.file).schema
        self.at, self.batch = -1, None

    def _batch(self, i: int) -> pa.RecordBatch:
        if i != self.at:
            self.file.seek(self.head + i * self.stride)
            self.batch = pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)
            self.at = i
        return self.batch

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``; the ids are a view of the file."""
        batch, row = self._batch(i // self.rows), i % self.rows
        cut = slice(row * self.length, (row + 1) * self.length)
        return (batch.column(0).flatten().to_numpy()[cut],
                batch.column(1).flatten()[cut].to_numpy(zero_copy_only=False))

    def ids(self, start: int, n: int):
        """Pieces of the ids ``start .. start + n`` of the file, batch by batch."""
        full = self.rows * self.length
        while n > 0:
            batch = self._batch(start // full)
            flat = batch.column(0).flatten().to_numpy()
            piece = flat[start % full: start % full + n]
            yield piece
            start, n = start + len(piece), n - len(piece)


def write_sequences(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int, path: str,
                    keeps_space: bool = True, length: int = LENGTH, rows: int = BATCH_ROWS) -> DataFrame:
    """Write the files below ``path``; returns the committed index with the
    columns of ``INDEX`` plus ``start`` (ids of all documents before)."""

    def encode(batches):
        part = TaskContext.get().partitionId()
        tok = cached_tokenizer(tokenizer_path, keeps_space)
        filesystem, folder = open_filesystem(path)
        filesystem.create_dir(folder, recursive=True)
        name, sink, out, local = attempt_name("part", part, ".arrows"), None, None, 0
        for batch in batches:
            if out is None:
                sink = filesystem.open_output_stream(f"{folder}/{name}")
                out = SequenceWriter(sink, tok.dtype, length, rows)
            counts = []
            for raw in tok.encode_column(batch.column("text")):
                ids = np.append(np.frombuffer(raw, dtype=tok.dtype), tok.dtype.type(end_id))
                out.add(ids)
                counts.append(len(ids))
            n = len(counts)
            starts = local + np.concatenate([[0], np.cumsum(counts)[:-1]]) if n else np.zeros(0)
            local += sum(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([part] * n, pa.int64()), pa.array(starts.astype(np.int64)),
                 pa.array(counts, pa.int64()), pa.array([f"{path}/{name}"] * n), pa.array([out.head] * n, pa.int64())],
                names=["id", "part", "local", "n_tokens", "file", "head"])
        if out is not None:
            out.close()
            sink.close()

    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keys = ["id", "_tie"]
    parts = keyed.withColumn("_tie", F.xxhash64("text")).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    stride = batch_bytes(tokenizer_path, length, rows)
    index = parts.mapInArrow(encode, INDEX.replace(", stride long", "")).withColumn("stride", F.lit(stride).cast("long"))
    return with_offsets(written(index, "sequence-index"), [], "part", "local", "n_tokens", "start")


def batch_bytes(tokenizer_path: str, length: int, rows: int) -> int:
    """Length in bytes of a full batch, the same in every file."""
    dtype = cached_tokenizer(tokenizer_path, True).dtype
    out = SequenceWriter(pa.BufferOutputStream(), dtype, length, rows)
    out.add(np.zeros(length * rows, dtype=dtype))
    return out.stride


def read_digests(index: DataFrame, length: int = LENGTH, rows: int = BATCH_ROWS) -> DataFrame:
    """Read every document's ids back from the files: ``ids_crc32`` is the
    unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def read(batches):
        name, reader = None, None
        for batch in batches:
            crcs = []
            cols = [batch.column(c).to_pylist() for c in ("file", "head", "stride", "local", "n_tokens")]
            for file, head, stride, local, n in zip(*cols, strict=True):
                if file != name:
                    name, reader = file, SequenceReader(file, head, stride, length, rows)
                crc = 0
                for piece in reader.ids(local, n):
                    crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(crcs, pa.int64())],
                                             names=[*batch.schema.names, "ids_crc32"])

    return index.mapInArrow(read, plus(index.schema, ids_crc32="long"))


def op3_sequence_files(spark, sf_dir):
    """Every document's ids, written to the files and read back."""
    import public_tokenizers

    from lexiframe.llm.storage import table

    index = write_sequences(table(spark, sf_dir, "documents"), "doc_id", "text",
                            public_tokenizers.path("byte_bpe_50k.json"), 0, scratch_path(spark, "sequences"))
    return read_digests(index).select(F.col("id").alias("doc_id"), F.col("start").cast("long").alias("start"), "n_tokens", "ids_crc32")
