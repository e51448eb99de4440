"""Media columns: content-addressed payloads in tar shards.

A payload is stored as a PNG image of 64 RGB pixels a row, whose 8-bit samples are the payload's bytes; the
member's name is the payload's digest. Rows carry the digest, the shard, the offset and the length. The
header of a member is read by a range of 33 bytes and fills the metadata columns.

A task writes a tar shard with each of its distinct payloads once. Copies that other tasks wrote stay in
their shards without a row pointing at them: the index keeps one place for each digest.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROW = 192
HEADER = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WRITTEN = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
READ = "digest string, width int, height int, bit_depth int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % ROW if text else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """Rows without prediction (filter 0), so the samples are the payload's bytes as they are."""
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(start: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first 33 bytes."""
    if start[:8] != SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", start[16:25])


def from_png(data: bytes) -> bytes:
    width, height, _ = png_header(data[:HEADER])
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        packed += [body] if kind == b"IDAT" else []
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 3 * width + 1)
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and deviation of each colour channel, and the mean step between neighbouring pixels, in thousandths."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, 3)
    total, squares = pixels.sum(0, dtype=np.int64), np.array([int(np.dot(c := pixels[:, k].astype(np.int64), c)) for k in range(3)])
    n = len(pixels)
    mean = [int(x) * 1000 // n for x in total]
    var = [(int(q) * n - int(x) ** 2) * 1000 // (n * n) for q, x in zip(squares, total, strict=True)]
    step = int(np.abs(np.diff(pixels.astype(np.int16), axis=0)).sum(dtype=np.int64)) * 1000 // n
    return ":".join(map(str, [*mean, *var, step]))


def write_shards(docs: DataFrame, folder: str, *, level: int = 6) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length of every document; running the plan writes the shards."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        path, places, rows = f"{folder}/media-{TaskContext.get().partitionId():06d}.tar", {}, []
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def write(out):
            at = 0
            for batch in (b for part in ([first], batches) for b in part):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast("binary").to_pylist(), strict=True):
                    payload = padded(text)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in places:
                        data = to_png(payload, level)
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(data)
                        head = info.tobuf(tarfile.PAX_FORMAT)
                        out.write(head)
                        out.write(data)
                        out.write(b"\0" * (-len(data) % 512))
                        places[digest] = (at + len(head), len(data))
                        at += len(head) + len(data) + -len(data) % 512
                    rows.append((doc_id, len(text), digest, path, *places[digest]))
            out.write(b"\0" * 1024)

        common.publish(path, write)
        for a in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 10_000], strict=True), kind, strict=True)], schema=kind)

    return common.texts(docs).mapInArrow(common.lean(run), WRITTEN)


def read_members(index: DataFrame) -> DataFrame:
    """index: digest, shard, offset, length, ordered by shard within partitions. Metadata come from the header's range alone."""

    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("digest", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("bit_depth", pa.int32()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
        opened, f = None, None
        for batch in batches:
            rows = []
            for digest, shard, offset, length in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if shard != opened:
                    if f:
                        f.close()
                    fs, path = common.open_fs(shard)
                    opened, f = shard, fs.open_input_file(path)
                f.seek(offset)
                width, height, depth = png_header(f.read(HEADER))
                f.seek(offset)
                data = f.read(length)
                payload = from_png(data)
                rows.append((digest, width, height, depth, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kind), kind, strict=True)], schema=kind)
        if f:
            f.close()

    return index.select("digest", "shard", "offset", "length").mapInArrow(common.lean(run), READ)


def media_columns(docs: DataFrame, *, level: int = 6) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length and, read back: width, height, bit_depth, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Null and empty texts become one row of spaces. Equal texts share one place. Repeated rows keep their
    rows. An empty table gives no rows.
    """
    work = common.Workspace(docs.sparkSession, "media")
    written = work.keep(write_shards(docs, f"{work.path}/shards", level=level), "rows")
    places = written.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place")).select("digest", "place.*")
    places = work.keep(places, "index")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = places.repartition(tasks, "shard", F.floor(F.col("offset") / (8 << 20))).sortWithinPartitions("shard", "offset")
    read = work.keep(read_members(ordered), "read")
    return written.select("doc_id", "n_bytes", "digest").join(places, "digest").join(read, "digest")
