"""WARC archives and a Merkle audit of their replicas.

Pages are written as WARC records, each a gzip member of its own, one file per
task; an index holds every record's file, place and ordered offset range.  The
stored bytes of each range are hashed (leaf), runs of ``FANOUT`` neighbours are
hashed into the node of the joint offset range, up to one root per file and
one root over the files.  Two replicas are compared from the root down: only
children of nodes that differ are looked at, so finding d damaged records
costs about d * FANOUT * depth comparisons, whatever the size of the archive.

Files are read once per replica, in the order of the index, each by the task
that holds its index rows; memory is one record.  A file or range that is
missing or short gets another hash (or none) and so differs.

Defined results: NULL html is an empty record body; NULL urls become
``urn:none``; repeated pages are records of their own; an empty table gives an
archive without records and an empty audit; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.llm.storage import attempt_name, open_filesystem, table, written
from lexiframe.session import scratch_path

FANOUT = 16
#: Bytes copied at once.
CHUNK = 1 << 20
INDEX = "page_id long, url string, file string, idx long, offset long, length long, n_bytes long, sha256 string"


def record_bytes(url: str, body: bytes, page_id) -> bytes:
    """One WARC 1.1 resource record.  The id is made from the content, so a
    repeated attempt writes the same bytes."""
    digest = hashlib.sha256(body).hexdigest()
    rid = hashlib.sha256(f"{page_id}\n{url}\n{digest}".encode()).hexdigest()
    uuid = f"{rid[:8]}-{rid[8:12]}-5{rid[13:16]}-8{rid[17:20]}-{rid[20:32]}"
    head = ("WARC/1.1\r\nWARC-Type: resource\r\n"
            f"WARC-Target-URI: {' '.join(url.split())}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n"
            f"WARC-Record-ID: <urn:uuid:{uuid}>\r\nWARC-Block-Digest: sha256:{digest}\r\n"
            f"Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n")
    return head.encode() + body + b"\r\n\r\n"


def parse_record(stored: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one stored record."""
    raw = zlib.decompress(stored, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def write_archive(pages: DataFrame, id_col: str, url_col: str, body_col: str, path: str) -> DataFrame:
    """Write the archive below ``path``; returns the committed index."""

    def write(batches):
        filesystem, folder = open_filesystem(path)
        filesystem.create_dir(folder, recursive=True)
        name = attempt_name("part", TaskContext.get().partitionId(), ".warc.gz")
        sink, at, idx = None, 0, 0
        for batch in batches:
            sink = sink or filesystem.open_output_stream(f"{folder}/{name}", compression=None)
            rows = []
            for key, url, body in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "body")), strict=True):
                raw = body.encode()
                deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
                stored = deflate.compress(record_bytes(url, raw, key)) + deflate.flush()
                sink.write(stored)
                rows.append((key, url, name, idx, at, len(stored), len(raw), hashlib.sha256(raw).hexdigest()))
                at += len(stored)
                idx += 1
            if rows:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 names=[f.split()[0] for f in INDEX.split(", ")])
        if sink:
            sink.close()

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("urn:none")).alias("url"),
                        F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body"))
    return written(rows.mapInArrow(write, INDEX), "warc-index")


def _ranges(batches):
    """Runs of index rows of one file: ``(file, batch, from, to)``."""
    for batch in batches:
        files = batch.column("file").to_pylist()
        lo = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or files[i] != files[lo]:
                yield files[lo], batch, lo, i
                lo = i


def copy_replica(index: DataFrame, source: str, target: str, damaged: str | None = None) -> DataFrame:
    """Copy an archive record by record; returns the index of the copy (place
    of each record in it).  ``damaged``: SQL condition on the index; one bit in
    the middle of such a record's stored bytes is flipped (an audit drill)."""

    def copy(batches):
        src, from_folder = open_filesystem(source)
        dst, to_folder = open_filesystem(target)
        dst.create_dir(to_folder, recursive=True)
        name = part = reader = sink = None
        at = 0
        for file, batch, lo, hi in _ranges(batches):
            if file != name:
                for f in (reader, sink):
                    if f is not None:
                        f.close()
                name, part, at = file, attempt_name("copy", TaskContext.get().partitionId(), ".warc.gz"), 0
                reader = src.open_input_file(f"{from_folder}/{file}")
                sink = dst.open_output_stream(f"{to_folder}/{part}", compression=None)
            rows = batch.slice(lo, hi - lo)
            offsets, lengths = rows.column("offset").to_pylist(), rows.column("length").to_pylist()
            places = []
            for offset, length, bad in zip(offsets, lengths, rows.column("bad").to_pylist(), strict=True):
                raw = reader.read_at(length, offset)
                if bad:
                    raw = bytearray(raw)
                    raw[len(raw) // 2] ^= 1
                sink.write(bytes(raw))
                places.append(at)
                at += length
            yield pa.RecordBatch.from_arrays(
                [rows.column("file"), rows.column("idx"), pa.array([part] * (hi - lo)), pa.array(places, pa.int64()), rows.column("length")],
                names=["file", "idx", "stored", "offset", "length"])
        for f in (reader, sink):
            if f is not None:
                f.close()

    rows = index.select("file", "idx", "offset", "length", F.coalesce(F.expr(damaged or "false"), F.lit(False)).alias("bad"))
    return written(rows.mapInArrow(copy, "file string, idx long, stored string, offset long, length long"), "replica-index")


def leaves(ranges: DataFrame, path: str) -> DataFrame:
    """``(file, idx, offset, length, hash)``: the sha-256 of every stored range;
    NULL where the file is missing.  ``ranges``: (file, idx, stored, offset, length)."""

    def digest(batches):
        filesystem, folder = open_filesystem(path)
        name, reader = None, None
        for rows in batches:
            stored, out = rows.column("stored").to_pylist(), []
            for file, offset, length in zip(stored, rows.column("offset").to_pylist(), rows.column("length").to_pylist(), strict=True):
                if file != name:
                    if reader is not None:
                        reader.close()
                    name = file
                    try:
                        reader = filesystem.open_input_file(f"{folder}/{file}")
                    except FileNotFoundError:
                        reader = None
                raw = None
                if reader is not None and offset <= reader.size():
                    raw = reader.read_at(length, offset)
                out.append(None if raw is None else hashlib.sha256(b"\0" + raw).hexdigest())
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("file", "idx", "offset", "length")], pa.array(out, pa.string())],
                                             names=["file", "idx", "offset", "length", "hash"])
        if reader is not None:
            reader.close()

    return ranges.select("file", "idx", "stored", "offset", "length").mapInArrow(
        digest, "file string, idx long, offset long, length long, hash string")


def _up(nodes: DataFrame) -> DataFrame:
    """The next level of every file's tree: at most ``FANOUT`` children to a node."""
    child = F.struct("idx", F.coalesce("hash", F.lit("-")).alias("hash"))
    return nodes.groupBy("file", F.floor(F.col("idx") / FANOUT).cast("long").alias("idx")).agg(
        F.min("offset").alias("offset"), F.sum("length").alias("length"),
        F.sha2(F.concat(F.lit("1"), F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat_ws(":", c["idx"].cast("string"), c["hash"])), ",")), 256).alias("hash"))


class MerkleTree:
    """Levels of a replica's forest, leaves first; the last level has one node per file."""

    def __init__(self, leaf_nodes: DataFrame, name: str):
        self.levels = [written(leaf_nodes, f"merkle-{name}")]
        while True:
            top = self.levels[-1]
            if top.filter("idx > 0").isEmpty():
                break
            self.levels.append(written(_up(top), f"merkle-{name}"))

    def root(self) -> str | None:
        """Hash over all files in order of their names (files meet in runs of
        ``FANOUT``, level by level); the window numbers one row per file."""
        nodes = self.levels[-1].select(F.lit("").alias("file"), F.dense_rank().over(Window.orderBy("file")).cast("long").alias("idx"), "offset", "length",
                                       F.concat_ws("=", "file", F.coalesce("hash", F.lit("-"))).alias("hash"))
        nodes = written(nodes.withColumn("idx", F.col("idx") - 1), "merkle-files")
        while not nodes.filter("idx > 0").isEmpty():
            nodes = written(_up(nodes), "merkle-files")
        row = nodes.first()
        return row["hash"] if row else None


def differing_leaves(a: MerkleTree, b: MerkleTree) -> DataFrame:
    """``(file, idx)`` of the leaves that differ or exist in one replica only,
    found from the top down."""
    depth = max(len(a.levels), len(b.levels))
    level = lambda t, i: t.levels[min(i, len(t.levels) - 1)].select("file", "idx", "hash")
    wanted = None
    for i in range(depth - 1, -1, -1):
        x, y = level(a, i), level(b, i).withColumnRenamed("hash", "other")
        if wanted is not None:
            up = wanted.select("file", F.col("idx").alias("up"))
            x, y = (t.withColumn("up", F.floor(F.col("idx") / FANOUT).cast("long")).join(up, ["file", "up"], "left_semi").drop("up") for t in (x, y))
        both = x.join(y, ["file", "idx"], "full_outer")
        wanted = written(both.filter(~F.col("hash").eqNullSafe(F.col("other")) | F.col("hash").isNull()).select("file", "idx"), "differing")
    return wanted


def op9_merkle_audit(spark, sf_dir):
    """Write the pages as an archive, copy it with a drill (a bit flipped in
    every record whose page_id is divisible by 50), audit the copy against the
    original and report every record: its content's digest, and whether its
    copy is intact.  If the roots agree nothing is descended."""
    primary, replica = scratch_path(spark, "warc-a"), scratch_path(spark, "warc-b")
    index = write_archive(table(spark, sf_dir, "pages"), "page_id", "url", "html", primary)
    copy = copy_replica(index, primary, replica, damaged="page_id % 50 = 0")
    first = MerkleTree(leaves(index.withColumn("stored", F.col("file")), primary), "a")
    second = MerkleTree(leaves(copy, replica), "b")
    rows = index.withColumn("_bad", F.lit(None).cast("boolean"))
    if first.root() != second.root():
        bad = differing_leaves(first, second).withColumn("_bad", F.lit(True))
        rows = index.join(bad, ["file", "idx"], "left")
    return rows.select("page_id", "url", "n_bytes", "sha256", F.col("_bad").isNull().alias("intact"))


ORACLE = """
SELECT page_id, COALESCE(url, 'urn:none') AS url, CAST(octet_length(encode(COALESCE(html, ''))) AS BIGINT) AS n_bytes,
       sha256(COALESCE(html, '')) AS sha256, COALESCE(page_id % 50 <> 0, TRUE) AS intact
FROM pages
"""
