"""Removal of long repeated strings by prefix-free parsing.

Rolling-hash triggers cut texts into phrases: the trigger of a window of `length` bytes is the leftmost of
its `GRAM`-byte strings with the least rolling hash, and a phrase spans all consecutive windows of one
trigger. So a window lies in one phrase, and equal windows have equal triggers at equal places.

The parse is the sequence of phrases. Phrases whose core (the 116 bytes to the right, or 84 to the left and
the trigger, that all their windows share) occurs once in the corpus hold no repeated window and are left
at once. The others make the dictionary: each distinct phrase once, with its number of occurrences.

A shard of the dictionary holds all phrases of its cores. It is put in order twice: by what lies left of the
triggers, read backwards, and by what follows from the triggers on, each to a depth of `length` bytes. With
the lengths of common prefixes in both orders, a window (left part, right part) gets the pair of its
classes; windows of one pair are equal, byte for byte. The textbook's suffix arrays over all suffixes of
the dictionary and over the whole parse are not built: they would give the corpus order of every byte, at
16 bytes and more of shuffle for each, and a window of fixed length needs only the order of its two
parts, which these sorted contexts are.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GRAM = 32
#: Parts in which the occurrences of a frequent core are looked up, and how many cores may count as frequent.
SALT = 32
FREQUENT = 100_000
#: A phrase's place in one number: its first window, the number of its windows, and its trigger's distance from the first.
FIELD = 16
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
KEYED = "id long, row long, key long, place long"
PHRASES = "id long, row long, key long, lo int, n int, at int, phrase binary, bytes binary"
REPEATED = "key long, phrase binary, runs array<struct<a:int,b:int>>"


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class Powers:
    """Powers of the base and of its inverse, as far as asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 1 << 22)
            ones = np.ones(1, np.uint64)
            cls.up = np.cumprod(np.concatenate([ones, np.full(n, BASE, np.uint64)]), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate([ones, np.full(n, np.uint64(_inverse(int(BASE))), np.uint64)]), dtype=np.uint64)
        return cls.up, cls.down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def triggers(texts: list[bytes], length: int):
    """(text, lo, hi, at, key) arrays: the windows that start from lo to hi have the trigger at `at`; key is their core's hash.

    A trigger's windows are given in two parts: those that start at most `length - 116` bytes before it, and the others.
    """
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    offset = np.concatenate([[0], np.cumsum(sizes)])
    n, span, core = len(raw), length - GRAM + 1, (length + GRAM) // 2
    empty = tuple(np.zeros(0, np.int64) for _ in range(5))
    if n < length:
        return empty
    up, down = Powers.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    grams = n - GRAM + 1
    bits = max(1, int(n).bit_length())
    low = np.uint64((1 << bits) - 1)
    h = _mix((total[GRAM:] - total[:grams]) * down[:grams])
    h = (h & ~low) | np.arange(grams, dtype=np.uint64)
    pad = -grams % span
    blocks = np.concatenate([h, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - length + 1
    least = np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts])
    text = np.repeat(np.arange(len(texts)), sizes)[:starts]
    whole = np.flatnonzero(np.arange(starts) + length <= offset[text + 1])
    if not len(whole):
        return empty
    at = (least[whole] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(whole) != 1)]))
    last = np.concatenate([first[1:], [len(whole)]]) - 1
    lo, hi, at = whole[first], whole[last], at[first]
    half = length - core
    out = []
    for side in (0, 1):
        a, b = (np.maximum(lo, at - half), hi) if side == 0 else (lo, np.minimum(hi, at - half - 1))
        keep = a <= b
        a, b, x = a[keep], b[keep], at[keep]
        s = x if side == 0 else x - half
        key = _mix((total[s + core] - total[s]) * down[s] + np.uint64(side))
        t = text[a]
        out.append((t, a - offset[t], b - offset[t], x - offset[t], key.view(np.int64)))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(5))


def _batches(column, most: int = 2 << 20):
    from .words import text_batches

    return text_batches(column, most)


def parse(docs: DataFrame, length: int) -> DataFrame:
    """docs: id, row, text. The parse: a row for every phrase, without its bytes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, texts in _batches(batch.column(2)):
                text, lo, hi, at, key = triggers(texts, length)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][text]), pa.array(rows[a:b][text]), pa.array(key.astype(np.int64)), pa.array(lo << 2 * FIELD | hi - lo + 1 << FIELD | at - lo)], names=["id", "row", "key", "place"])

    return docs.mapInArrow(common.lean(run), KEYED)


def phrases(found: DataFrame, length: int) -> DataFrame:
    """found: id, row, text, marks (key, place). Each marked phrase with its bytes and their digest."""

    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("key", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("at", pa.int32()), ("phrase", pa.binary()), ("bytes", pa.binary())])
        for batch in batches:
            out, held = [], 0
            for id_, row, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast("binary").to_pylist(), batch.column(3).to_pylist(), strict=True):
                for m in marks:
                    lo, n, at = m["place"] >> 2 * FIELD, m["place"] >> FIELD & (1 << FIELD) - 1, m["place"] & (1 << FIELD) - 1
                    part = text[lo : lo + n - 1 + length]
                    out.append((id_, row, m["key"], lo, n, at, hashlib.blake2b(part, digest_size=16).digest(), part))
                    held += len(part)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    return found.mapInArrow(common.lean(run), PHRASES)


def _order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of equally long byte rows, and the length of each one's common prefix with the one before it in that order."""
    words = np.ascontiguousarray(rows).view(">u8")
    order = np.lexsort(words.T[::-1])
    same = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 65536):
        here = rows[order[a : a + 65536]]
        differs = here != rows[order[a - 1 : a - 1 + len(here)]]
        same[a : a + len(here)] = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    return order, same


def _classes(order: np.ndarray, same: np.ndarray, depth: int) -> np.ndarray:
    """A number for each row, equal for rows that agree in their first `depth` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(same < depth)
    return out


def repeated_windows(parts: list[bytes], at: np.ndarray, n: np.ndarray, times: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each distinct phrase the runs (first, last) of its windows that occur twice or more in all."""
    wide = -(-length // 8) * 8
    left, right = np.zeros((len(parts), wide), np.uint8), np.zeros((len(parts), wide), np.uint8)
    for i, (p, x) in enumerate(zip(parts, at.tolist(), strict=True)):
        b = np.frombuffer(p, np.uint8)
        back = b[max(0, x - wide) : x][::-1]
        left[i, : len(back)] = back
        ahead = b[x : x + wide]
        right[i, : len(ahead)] = ahead
    (lo, ll), (ro, rl) = _order(left), _order(right)
    hits: list[list[int]] = [[] for _ in parts]
    for t in range(int(at.max(initial=0)) + 1):
        live = np.flatnonzero((at >= t) & (at - t < n))
        if not len(live):
            continue
        pair = _classes(lo, ll, t)[live] * np.int64(len(parts) + 1) + _classes(ro, rl, length - t)[live]
        _, which, count = np.unique(pair, return_inverse=True, return_counts=True)
        for i in live[(count[which] > 1) & (times[live] < 2)].tolist():
            hits[i].append(int(at[i]) - t)
    out = []
    for i in range(len(parts)):
        if times[i] > 1:
            out.append([(0, int(n[i]) - 1)])
        elif hits[i]:
            w = np.array(sorted(hits[i]))
            cut = np.flatnonzero(np.diff(w) > 1)
            out.append(list(zip(w[np.concatenate([[0], cut + 1])].tolist(), w[np.concatenate([cut, [len(w) - 1]])].tolist(), strict=True)))
        else:
            out.append([])
    return out


def order_shards(dictionary: DataFrame, length: int, most: int = 20_000) -> DataFrame:
    """dictionary: key, phrase, times, n, at, bytes, with all phrases of a key in one partition and in the order of keys."""

    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("key", pa.int64()), ("phrase", pa.binary()), ("runs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])

        def done(rows):
            columns = rows.to_pydict()
            runs = repeated_windows(columns["bytes"], np.array(columns["at"], np.int64), np.array(columns["n"], np.int64), np.array(columns["times"], np.int64), length)
            keep = [i for i, r in enumerate(runs) if r]
            return pa.RecordBatch.from_arrays([pa.array([columns["key"][i] for i in keep], pa.int64()), pa.array([columns["phrase"][i] for i in keep], pa.binary()), pa.array([[{"a": a, "b": b} for a, b in runs[i]] for i in keep], kind.field("runs").type)], schema=kind)

        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, rows]) if rest is not None else rows
            keys = rest.column("key").to_numpy()
            if len(keys) >= most and keys[0] != keys[-1]:
                cut = int(np.searchsorted(keys, keys[-1]))
                yield done(rest.slice(0, cut))
                rest = rest.slice(cut).combine_chunks()
        if rest is not None and rest.num_rows:
            yield done(rest)

    return dictionary.select("key", "phrase", "times", "n", "at", "bytes").mapInArrow(common.lean(run), REPEATED)


def _cover(rows: DataFrame, length: int, with_text: bool) -> DataFrame:
    """rows: id, row, text, windows (array of first and last window start). n_removed, n_spans and kept_sha256, or the kept bytes too."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for id_, row, text, windows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast("binary").to_pylist(), batch.column(3).to_pylist(), strict=True):
                kept, at, removed, spans, end = [], 0, 0, 0, -1
                for a, b in sorted((w["a"], w["b"] + length) for w in windows):
                    if a > end:
                        kept.append(text[at:a])
                        spans += 1
                        start = a
                    else:
                        start = end
                    if b > end:
                        removed += b - max(start, a)
                        end = at = b
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append((id_, row, removed, spans, hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["id", "row", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(common.lean(run), "id long, row long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, *, length: int = 200, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, with `with_text`).

    Every byte goes that a `length`-byte string covers which also starts anywhere else in the corpus, in
    the same text or another. Null and empty texts lose nothing; of repeated rows with `length` bytes or
    more every row loses all; an empty table gives no rows. length: 64 bytes at least.

    Rows are told apart by their id and a 64-bit hash of their text; only rows of one id could share both
    by accident. A null id counts as the smallest long here. A text's arrays take about 80 bytes of memory
    for each of its bytes, in one task.

    The places of a frequent core are looked up in `SALT` parts. Frequent are those with more than 4,096
    places and more than the FREQUENT-th part of all places, so there are at most FREQUENT of them and they
    are broadcast. Everything beyond that join works on distinct phrases.
    """
    if not 2 * GRAM <= length < 1 << FIELD:
        raise ValueError("length must be 64 at least and below 65536")
    work = common.Workspace(docs.sparkSession, "suffix-dedup")
    named = common.texts(docs).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("row"), "doc_id", "text")
    long_ = named.select("id", "row", "text").filter(F.octet_length("text") >= length)
    marks = parse(long_, length)
    often = work.keep(marks.select("key").groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "often")
    places = often.agg(F.sum("c")).first()[0] or 0
    frequent = F.broadcast(often.filter(F.col("c") > max(4096, places // FREQUENT)).select("key", F.lit(True).alias("frequent")))
    parts = F.when(F.col("frequent"), F.pmod(F.xxhash64("id", "row"), F.lit(SALT)).cast("int")).otherwise(0)
    salted = often.join(frequent, "key", "left").select("key", F.explode(F.when(F.col("frequent"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    met = marks.join(frequent, "key", "left").withColumn("salt", parts).drop("frequent").join(salted, ["key", "salt"])
    found = work.keep(met.groupBy("id", "row").agg(F.collect_set(F.struct("key", "place")).alias("marks")), "marks")
    held = work.keep(long_.join(found, ["id", "row"]).select("id", "row", "text", "marks"), "texts")

    occurrence = phrases(held, length)
    dictionary = occurrence.groupBy("key", "phrase").agg(F.count("*").alias("times"), F.first("n").alias("n"), F.first("at").alias("at"), F.first("bytes").alias("bytes"))
    dictionary = work.keep(dictionary, "dictionary")
    crowd = dictionary.groupBy("key").agg(F.sum("times").alias("c")).filter("c > 1").select("key")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = dictionary.join(crowd, "key").repartition(tasks, "key").sortWithinPartitions("key", "phrase")
    repeated = work.keep(order_shards(shards, length), "repeated")

    hit = phrases(held, length).select("id", "row", "key", "lo", "phrase").join(repeated, ["key", "phrase"])
    windows = hit.select("id", "row", F.explode(F.transform("runs", lambda r: F.struct((r["a"] + F.col("lo")).alias("a"), (r["b"] + F.col("lo")).alias("b")))).alias("w"))
    windows = work.keep(windows.groupBy("id", "row").agg(F.collect_set("w").alias("windows")), "windows")
    lost = _cover(held.select("id", "row", "text").join(windows, ["id", "row"]).select("id", "row", "text", "windows"), length, with_text).dropDuplicates(["id", "row"])

    whole = named.select("id", "row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("all_sha256"), *([F.col("text").cast("binary").alias("all_bytes")] if with_text else []))
    out = whole.join(lost, ["id", "row"], "left")
    shown = [F.coalesce("kept", "all_bytes").alias("kept")] if with_text else []
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"), *shown)
