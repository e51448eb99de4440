"""Near-duplicates by min-max hashing, confirmed on full shingle sets.

Every permutation of the shingles yields two signature values, the minimum and the maximum, so half the
hash evaluations give a signature of the same length. Bands of it name candidate buckets. Texts with one
shingle set form a class, and only classes are compared: first every member of a bucket with the bucket's
busiest member, then, where a bucket still holds several components, each member outside the hub's
component with the members of other components. Bitmaps of the sets bound every intersection from above
and rule most loose pairs out without a loss; each pair left is confirmed on the two full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph
from .words import WHITE, Words, mix, text_batches

SIGNED = "doc_id long, row_hash long, n_shingles long, cls binary, bands array<long>, marks array<long>"
MARKS = 16
SETS = "cls binary, items array<long>"


def _sets(texts: list[bytes], shingle: int):
    """(position, sorted distinct shingle hashes) of each text that has words."""
    doc, h = Words(texts, WHITE).shingles(shingle)
    order = np.argsort(doc, kind="stable") if len(doc) and np.any(np.diff(doc) < 0) else None
    if order is not None:
        doc, h = doc[order], h[order]
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i in np.flatnonzero(np.diff(at)).tolist():
        yield i, np.unique(h[at[i] : at[i + 1]])


def class_key(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.astype("<u8").tobytes(), digest_size=16).digest()


def band_hashes(sets: list[np.ndarray], permutations: int, rows: int) -> np.ndarray:
    """One row a set: the hashes of the bands of its min-max signature (2 * permutations values).

    All minima stand before all maxima, so the values of a band come from different permutations.
    """
    rng = np.random.default_rng(20240229)
    flip, odd = rng.integers(0, 1 << 63, permutations, np.uint64), rng.integers(0, 1 << 63, permutations, np.uint64) | np.uint64(1)
    bands = 2 * permutations // rows
    out = np.empty((len(sets), bands), np.uint64)
    for first, last in _groups([len(s) for s in sets]):
        items, at = np.concatenate(sets[first:last]), np.cumsum([0, *map(len, sets[first:last])])[:-1]
        values, v = np.empty((2 * permutations, last - first), np.uint64), np.empty_like(items)
        for k in range(permutations):
            np.multiply(np.bitwise_xor(items, flip[k], out=v), odd[k], out=v)
            np.minimum.reduceat(v, at, out=values[k])
            np.maximum.reduceat(v, at, out=values[permutations + k])
        rest = values[: bands * rows].reshape(bands, rows, -1)
        h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64)[:, None], (bands, last - first))
        for r in range(rows):
            h = mix(h * np.uint64(3) + rest[:, r])
        out[first:last] = h.T
    return out.view(np.int64)


def _groups(sizes: list[int], most_items: int = 1 << 15, most_sets: int = 1 << 11):
    """Runs (from, to) of sets with few items together, or a single set."""
    first, items = 0, 0
    for i, n in enumerate(sizes):
        if i > first and (items + n > most_items or i - first == most_sets):
            yield first, i
            first, items = i, 0
        items += n
    if first < len(sizes):
        yield first, len(sizes)


def marks(items: np.ndarray) -> np.ndarray:
    """A bitmap of 64 * MARKS bits with the bit of every item set."""
    bits = np.zeros(64 * MARKS, bool)
    bits[(items >> np.uint64(20)) % np.uint64(64 * MARKS)] = True
    return np.packbits(bits).view(np.int64)


def row_hash(text):
    """What tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def sign(docs: DataFrame, *, shingle: int, percent: int, permutations: int, rows: int) -> DataFrame:
    """doc_id, row_hash, n_shingles, cls (a digest of the shingle set, null without words), bands and marks of every document.

    Sets too small to be similar to any other set have no bands.
    """

    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("bands", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64()))])
        for batch in batches:
            for a, b, texts in text_batches(batch.column(1), 1 << 20):
                sizes, keys, bands, bits, sets, places = np.zeros(b - a, np.int64), [None] * (b - a), [None] * (b - a), [None] * (b - a), [], []
                for i, items in _sets(texts, shingle):
                    sizes[i], keys[i] = len(items), class_key(items)
                    if len(items) * (100 - percent) >= percent:
                        bits[i] = marks(items)
                        sets.append(items)
                        places.append(i)
                if sets:
                    for i, row in zip(places, band_hashes(sets, permutations, rows), strict=True):
                        bands[i] = row
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], schema=kind)

    texts = common.texts(docs)
    return texts.select("doc_id", "text", row_hash("text").alias("row_hash")).mapInArrow(common.lean(run), SIGNED)


def full_sets(docs: DataFrame, *, shingle: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("cls", pa.binary()), ("items", pa.list_(pa.int64()))])
        for batch in batches:
            for _, _, texts in text_batches(batch.column(1), 1 << 20):
                found = [(class_key(items), items.view(np.int64)) for _, items in _sets(texts, shingle)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([v for _, v in found], pa.list_(pa.int64()))], schema=kind)

    return common.texts(docs).mapInArrow(common.lean(run), SETS)


BITS = [f"m{i}" for i in range(MARKS)]


def _can_link(other: str, percent: int):
    """Whether two sets can reach the similarity; never false for those that do.

    Of each set come the size n, the marks m0, m1, ... and `spare`, the size less the marks that are set;
    the second set's names begin with `other`. A mark that only one of the two has stands for at least
    one shingle that the other lacks, so the marks of both and the smaller `spare` bound the intersection.
    Short expressions over flat columns: the join's condition stays a method that the JVM compiles.
    """
    both = sum((F.bit_count(F.col(b).bitwiseAND(F.col(other + b))) for b in BITS), F.lit(0))
    n, n2 = F.col("n"), F.col(other + "n")
    fit = F.lit(100) * F.least(n, n2) >= F.lit(percent) * F.greatest(n, n2)
    return fit & (F.lit(100 + percent) * (both + F.least(F.col("spare"), F.col(other + "spare"))) >= F.lit(percent) * (n + n2))


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, permutations: int = 256, rows: int = 8, small: int = 2_000_000, by_row: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept (doc_id = component_id).

    by_row: also row_hash and first, which is true for the rows of one id and text alone in each component
    (the smallest id, no null if it can be, and of its texts the one of the smallest hash), and for every
    row without shingles.

    Documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets; links are
    confirmed on full sets, and candidates come from 2 * permutations / rows bands: of 64 bands of 8 values
    a pair shares none with a probability of 8e-6 at the similarity 0.8, and one with 0.04 at 0.4. At
    most `small` ids whose texts are read again are broadcast, and an eighth as many classes in links and
    groups of more than one row, which are wider; more meet the rows in a shuffle.

    Null and empty texts, and texts without words, have no shingles, stand alone and are kept. Rows of
    equal id are documents of their own, each linked by its text; a null id stays null and is never the
    smallest id of others. An empty table gives no rows.
    """
    work = common.Workspace(docs.sparkSession, "near-duplicates")
    signed = work.keep(sign(docs, shingle=shingle, percent=percent, permutations=permutations, rows=rows), "signed")
    classes = signed.filter("bands is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    classes = work.keep(classes, "classes")
    banded = classes.select("cls", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    found = banded.join(shared, "key")
    member = work.keep(found.join(classes.select("cls", "doc_id", "n", F.expr("n - aggregate(marks, 0L, (s, m) -> s + bit_count(m))").alias("spare"), *(F.col("marks")[i].alias(b) for i, b in enumerate(BITS))), "cls"), "members")

    def bounded(table: DataFrame, rows: int) -> DataFrame:
        """A written table, broadcast if it has at most so many rows, so that no group's rows need to meet for it."""
        return F.broadcast(table) if table.count() <= rows else table

    wanted = bounded(work.keep(member.select("doc_id").distinct().select(F.col("doc_id").alias("w")), "wanted"), small)
    sources = common.texts(docs)
    sets = full_sets(sources.join(wanted, sources["doc_id"].eqNullSafe(wanted["w"]), "left_semi"), shingle=shingle)
    sets = work.keep(sets, "sets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """pairs: a, b; those whose full sets are similar enough."""
        left, right = sets.select(F.col("cls").alias("a"), F.col("items").alias("x")), sets.select(F.col("cls").alias("b"), F.col("items").alias("y"))
        both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
        union = F.size("x") + F.size("y") - F.col("common")
        return work.keep(both.filter(100 * F.col("common") >= percent * union).select("a", "b"), name)

    shape = ["n", "spare", *BITS]
    busy = member.groupBy("cls").agg(F.sum("size").alias("score"))
    hubs = member.join(busy, "cls").groupBy("key").agg(F.max(F.struct("score", "cls", *shape)).alias("hub")).select("key", F.col("hub.cls").alias("hub"), *(F.col(f"hub.{c}").alias(f"hub_{c}") for c in shape))
    hubs = work.keep(hubs, "hubs")
    stars = member.join(hubs, "key").filter((F.col("cls") != F.col("hub")) & _can_link("hub_", percent))
    first = confirmed(stars.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct(), "links")

    labels = work.keep(graph.components(first, work), "labels")
    placed = member.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", *shape, F.coalesce("label", "cls").alias("label"))
    placed = work.keep(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("key")
    open_ = work.keep(placed.join(mixed, "key").join(hubs.select("key", "hub"), "key"), "open")
    main = open_.filter("cls = hub").select("key", F.col("label").alias("main"))
    minor = open_.join(main, "key").filter("label != main").select("key", F.col("cls").alias("c2"), F.col("label").alias("l2"), *(F.col(c).alias(f"o_{c}") for c in shape))
    apart = (F.col("label") != F.col("l2")) & ((F.col("label") == F.col("main")) | (F.col("cls") < F.col("c2")))
    cross = open_.join(main, "key").join(minor, "key").filter(apart & (F.col("cls") != F.col("hub")) & _can_link("o_", percent))
    second = confirmed(cross.select(F.least("cls", "c2").alias("a"), F.greatest("cls", "c2").alias("b")).distinct(), "more-links")

    ends = labels.filter("node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    final = work.keep(graph.components(ends.unionByName(second), work), "final")
    reach = signed.select("doc_id", "row_hash", "n_shingles", "cls").join(bounded(final.withColumnRenamed("node", "cls"), small // 8), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")
    groups = reach.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"), F.min(row).alias("row"), F.count("*").alias("rows"))
    groups = work.keep(groups.filter("rows > 1").drop("rows"), "groups")
    found = reach.join(bounded(groups, small // 8), "label", "left").withColumn("component_id", F.when(F.col("row").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull()).alias("kept")
    more = ["row_hash", (F.col("row").isNull() | (row == F.col("row"))).alias("first")] if by_row else []
    return found.select("doc_id", "n_shingles", "component_id", kept, *more)
