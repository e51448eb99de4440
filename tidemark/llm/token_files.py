"""Token-id files with bit-plane shuffling.

A file holds fixed-size blocks of ids. Each block is transposed into byte planes (or bit planes), each
plane is compressed by zstandard on its own, and a chunk index at the end gives every plane's place,
so a reader can fetch any block by a range read. Documents lie in ascending order of id over all files.

Layout: magic, blocks' planes one after the other, then a zstandard frame of int64 words
[doc ids, lengths, null flags], then the index as JSON, then its length as 8 bytes and the magic again.
"""

from __future__ import annotations

import io
import json
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"TMPLANE1"
MANIFEST = "shard int, path string, n_docs long, n_ids long"
DOCS = "shard int, doc_id long, at long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, planes: str) -> np.ndarray:
    """Rows are planes: byte k of every id, or bit k of every id packed eight to a byte."""
    by_byte = ids.view(np.uint8).reshape(len(ids), ids.dtype.itemsize).T
    if planes == "byte":
        return np.ascontiguousarray(by_byte)
    bits = np.stack([(plane[None, :] >> np.arange(8, dtype=np.uint8)[:, None]) & 1 for plane in by_byte]).reshape(-1, len(ids))
    return np.packbits(bits, axis=1, bitorder="little")


def from_planes(rows: np.ndarray, planes: str, n: int, dtype: np.dtype) -> np.ndarray:
    if planes == "bit":
        bits = np.unpackbits(rows, axis=1, count=n, bitorder="little").reshape(dtype.itemsize, 8, n)
        rows = (bits << np.arange(8, dtype=np.uint8)[None, :, None]).sum(axis=1, dtype=np.uint8)
    return np.ascontiguousarray(rows.T).reshape(-1).view(dtype)[:n]


class Writer:
    def __init__(self, out, dtype: np.dtype, block: int = 1 << 16, planes: str = "byte", level: int = 3):
        import zstandard

        self.out, self.dtype, self.block, self.planes = out, dtype, block, planes
        self.pack, self.index, self.place = zstandard.ZstdCompressor(level=level), [], 0
        self.wait, self.held, self.docs, self.total = [], 0, [], 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.place += len(data)
        return len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, len(ids), doc_id is None))
        self.wait.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.block:
            rest = np.concatenate(self.wait)
            while len(rest) >= self.block:
                self._block(rest[: self.block])
                rest = rest[self.block :]
            self.wait, self.held = [rest], len(rest)

    def _block(self, ids: np.ndarray) -> None:
        at = self.place
        sizes = [self._put(self.pack.compress(row.tobytes())) for row in to_planes(np.ascontiguousarray(ids, self.dtype), self.planes)]
        self.index.append([at, len(ids), sizes])

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.wait))
        at = self.place
        n = self._put(self.pack.compress(np.array(self.docs, np.int64).reshape(-1, 3).T.tobytes()))
        head = json.dumps({"dtype": self.dtype.str, "planes": self.planes, "docs": [at, n, len(self.docs)], "blocks": self.index}).encode()
        self._put(head)
        self._put(len(head).to_bytes(8, "little") + MAGIC)


class Reader:
    """Reads the index first and then one block at a time."""

    def __init__(self, source):
        import zstandard

        self.f, self.unpack = source, zstandard.ZstdDecompressor()
        end = source.seek(0, io.SEEK_END)
        tail = self._read(end - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a complete token file")
        n = int.from_bytes(tail[:8], "little")
        self.head = json.loads(self._read(end - 16 - n, n))
        self.dtype = np.dtype(self.head["dtype"])
        at, size, count = self.head["docs"]
        self.doc_ids, self.lengths, self.nulls = np.frombuffer(self.unpack.decompress(self._read(at, size)), np.int64).reshape(3, count)

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def blocks(self):
        for at, n, sizes in self.head["blocks"]:
            raw, planes = self._read(at, sum(sizes)), []
            for size in sizes:
                planes.append(np.frombuffer(self.unpack.decompress(raw[:size]), np.uint8))
                raw = raw[size:]
            yield from_planes(np.stack(planes), self.head["planes"], n, self.dtype)

    def documents(self):
        """(id or None, start in this file, ids) of each document, holding one document and one block at a time."""
        source, have, at = self.blocks(), np.zeros(0, self.dtype), 0
        for doc_id, n, null in zip(self.doc_ids.tolist(), self.lengths.tolist(), self.nulls.tolist(), strict=True):
            parts, got = [], len(have)
            if got < n:
                parts.append(have)
                while got < n:
                    have = next(source)
                    parts.append(have)
                    got += len(have)
                all_ids = np.concatenate(parts)
                ids, have = all_ids[:n], all_ids[n:]
            else:
                ids, have = have[:n], have[n:]
            yield (None if null else doc_id), at, ids
            at += n


def write_token_files(docs: DataFrame, folder: str, *, tokenizer: str, end_id: int, block: int = 1 << 16, planes: str = "byte", level: int = 3) -> DataFrame:
    """Encode every whole text, append `end_id`, and write one file for each range of document ids.

    Returns the manifest (shard, path, n_docs, n_ids), one row a file; running its plan writes the files.
    Null and empty texts give the end id alone; null ids come first; rows of equal id are ordered by
    text; a file is renamed into place when complete, so lost executors and second attempts do no harm.
    """

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import SLICE, encoder

        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        path, n = f"{folder}/ids-{shard:06d}.bin", [0, 0]
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def write(out):
            w = Writer(out, enc.dtype, block, planes, level)
            end = np.array([end_id], enc.dtype).tobytes()
            for batch in (b for part in ([first], batches) for b in part):
                for a, b in common.slices(batch.column(1), SLICE):
                    part = batch.slice(a, b - a)
                    for doc_id, coded in zip(part.column(0).to_pylist(), enc.encode_all(part.column(1).to_pylist()), strict=True):
                        w.add(doc_id, np.frombuffer(coded + end, enc.dtype))
                    n[0] += len(part)
            w.close()
            n[1] = w.total

        common.publish(path, write)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "n_docs": n[0], "n_ids": n[1]}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ordered = common.texts(docs).repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return ordered.mapInArrow(common.lean(encode), MANIFEST)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document: shard, doc_id, at (ids before it in the file), n_tokens and ids_crc32, read back from the files."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = common.open_fs(path)
                rows = {"shard": [], "doc_id": [], "at": [], "n_tokens": [], "ids_crc32": []}
                with fs.open_input_file(place) as f:
                    for doc_id, at, ids in Reader(f).documents():
                        for k, v in zip(rows, (shard, doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            rows[k].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))

    return manifest.select("shard", "path").mapInArrow(read, DOCS)


def token_files(docs: DataFrame, *, tokenizer: str, end_id: int = 2, **options) -> DataFrame:
    """Write token files and read them back: doc_id, start, n_tokens, ids_crc32, shard.

    start counts the ids of all documents before this one over all files. An empty table gives no rows.
    """
    work = common.Workspace(docs.sparkSession, "token-files")
    manifest = work.keep(write_token_files(docs, f"{work.path}/files", tokenizer=tokenizer, end_id=end_id, **options), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    files = work.keep(base, "base")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = read_token_files(files.repartition(tasks, "shard"))
    return found.join(files.select("shard", "base"), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")
