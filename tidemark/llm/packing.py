"""Packing token sequences by large-item matching and best fit.

Texts are encoded and cut into pieces of at most `capacity` ids. Pieces are dealt by hash into units of
bounded size, one to a task, and packed there: a unit wastes at most part of one sequence more than packing
all at once.
In a unit, pieces above a third of the capacity stand at most twice in a sequence and are paired
greedily, each with the largest that still fits; smaller pieces then go, largest first, into the
tightest gap that holds them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import SLICE

PIECES = "doc_id long, piece int, start long, length long, ids binary"
PACKED = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: the first may be shorter, all others are full."""
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def match_and_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece; bins are numbered from 0."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    sizes = lengths[order]
    large = int(np.searchsorted(sizes, capacity // 3, side="right"))
    fill: list[int] = []
    waiting, ids = sizes[large:].tolist(), order[large:].tolist()
    while waiting:
        size, item = waiting.pop(), ids.pop()
        bins[item] = len(fill)
        fill.append(size)
        if (k := bisect_right(waiting, capacity - size)) > 0:
            other, mate = waiting.pop(k - 1), ids.pop(k - 1)
            bins[mate], offsets[mate] = len(fill) - 1, size
            fill[-1] += other
    gaps = sorted((capacity - f, b) for b, f in enumerate(fill) if f < capacity)
    for size, item in zip(sizes[:large][::-1].tolist(), order[:large][::-1].tolist(), strict=True):
        k = bisect_left(gaps, (size, -1))
        if k == len(gaps):
            b, room = len(fill), capacity
            fill.append(0)
        else:
            room, b = gaps.pop(k)
        bins[item], offsets[item] = b, fill[b]
        fill[b] += size
        if room > size:
            insort(gaps, (room - size, b))
    return bins, offsets


def encode_pieces(docs: DataFrame, *, tokenizer: str, end_id: int, capacity: int, slice_bytes: int = SLICE) -> DataFrame:
    """Every whole text's ids with `end_id` after them, cut; ids are little-endian and as wide as the vocabulary needs, 16 or 32 bits.

    slice_bytes: of text that are encoded together, within a batch; a longer text goes by itself.
    """

    def encode(batches):
        import pyarrow as pa

        from .tokens import encoder

        enc = encoder(tokenizer)
        end, size = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        kind = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            held = 0
            for doc_id, coded in ((i, x) for a, b in common.slices(batch.column(1), slice_bytes) for i, x in zip(batch.column(0).slice(a, b - a).to_pylist(), enc.encode_all(batch.column(1).slice(a, b - a).to_pylist()), strict=True)):
                ids, at = coded + end, 0
                for k, n in enumerate(cut(len(ids) // size, capacity)):
                    for column, v in zip(rows, (doc_id, k, at, n, ids[size * at : size * (at + n)]), strict=True):
                        column.append(v)
                    at += n
                held += at
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, kind, strict=True)], schema=kind)
                    rows, held = [[], [], [], [], []], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, kind, strict=True)], schema=kind)

    return common.texts(docs).mapInArrow(common.lean(encode), PIECES)


def _units(batches):
    """Tables of whole units from batches in which each unit's rows stand together."""
    import pyarrow as pa

    held, now = [], None
    for batch in batches:
        unit = batch.column("unit").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(unit)) + 1).tolist(), len(unit)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if now is not None and unit[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = unit[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def widened(ids, lengths: np.ndarray):
    """Binary ids of `lengths` numbers each as little-endian unsigned 32-bit ones."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    starts = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
    raw = np.frombuffer(ids.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    wide = raw.view("<u2" if len(raw) < 4 * offsets[-1] else "<u4").astype("<u4")
    return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(4 * offsets), pa.py_buffer(wide)])


def pack(docs: DataFrame, *, tokenizer: str, end_id: int = 0, capacity: int = 2048, unit_docs: int = 8192, unit_bytes: int = 24 << 20, most_tasks: int = 65_536, slice_bytes: int = SLICE) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids, sequence_id, offset; sequences hold at most `capacity` ids.

    Null and empty texts are packed as the end id alone; repeated rows are packed as often as they
    occur, in the order of their ids; an empty table gives no rows. A text is encoded by one task, which
    holds it and its ids. unit_docs and unit_bytes bound on average what is packed and held at a time (in
    documents, and in bytes of text); the result is whole at any value. There is a task for every unit, up
    to `most_tasks`; beyond that a task sorts its rows by unit and packs one unit after another.
    slice_bytes bounds the text that is encoded together: less of it takes less memory and more time.
    """
    texts = common.texts(docs)
    size = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    units = max(1, -(-size["n"] // unit_docs), -(-(size["bytes"] or 0) // unit_bytes))
    tasks = min(units, most_tasks)

    def packed(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        from .tokens import release

        release()
        keys = ["doc_id", "piece", "length", "ids"]
        for unit, rows in _units(batches):
            rows = rows.drop_columns(["unit"]).combine_chunks()
            order = pc.sort_indices(rows.select(keys), [(k, "ascending") for k in keys]).to_numpy()
            bins, offsets = match_and_fit(rows.column("length").to_numpy()[order], capacity)
            for k in range(0, len(order), 1024):
                part = rows.take(pa.array(order[k : k + 1024]))
                part = part.combine_chunks()
                ids = part.column("ids").chunk(0)
                part = part.set_column(part.column_names.index("ids"), "ids", widened(ids, part.column("length").to_numpy()))
                part = part.append_column("sequence_id", pa.array((int(unit) << 40) + bins[k : k + 1024])).append_column("offset", pa.array(offsets[k : k + 1024]))
                yield from part.to_batches()

    pieces = encode_pieces(docs, tokenizer=tokenizer, end_id=end_id, capacity=capacity, slice_bytes=slice_bytes)
    dealt = pieces.select(*pieces.columns, F.pmod(F.xxhash64("doc_id", "piece", "ids"), F.lit(units)).alias("unit"))
    dealt = dealt.repartitionById(tasks, F.pmod("unit", F.lit(tasks)).cast("int"))
    if tasks < units:
        dealt = dealt.sortWithinPartitions("unit")
    return dealt.mapInArrow(common.lean(packed), PACKED)
