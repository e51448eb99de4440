"""Exact top-k search by inner product with a KD-tree per shard.

Candidates are dealt by hash into shards of bounded size. A shard turns its vectors to their principal
axes, builds a KD-tree there by median splits of the widest dimension, and keeps a tight bounding box at
every node. A query goes through a tree's leaves best first, by the largest inner product that the boxes
above a leaf allow, and stops where that bound can no longer reach the k-th score known so far. Queries
are searched many at a time: all take their next leaves together, and a leaf meets those that want it in
one product of matrices. The k-th score is propagated: every query first searches one shard, its home, and
takes the k-th score found there into all other shards.

Vectors are quantised to integers, so scores are exact; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

FOUND = "query_id long, vec_id long, score long"
#: Leaves that a query takes at once; each burst is twice as long as the one before, up to the last.
BURSTS = (1, 2, 4, 8)


class Tree:
    """Leaves hold runs of `rows`; node i has the children 2i+1 and 2i+2."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, leaf: int = 128):
        self.rows, self.ids, self.axes = rows, ids, self._axes(rows)
        turned = rows @ self.axes
        depth = max(0, int(np.ceil(np.log2(max(1, len(rows)) / leaf)))) if rows.shape[1] else 0
        runs = [np.arange(len(rows))]
        for _ in range(depth):
            split = []
            for run in runs:
                part = turned[run]
                axis = int(np.argmax(part.max(0) - part.min(0))) if len(run) else 0
                half = len(run) // 2
                cut = np.argpartition(part[:, axis], half) if half else np.arange(len(run))
                split += [run[cut[:half]], run[cut[half:]]]
            runs = split
        self.first_leaf, self.runs = len(runs) - 1, runs
        nodes, dim = 2 * len(runs) - 1, rows.shape[1]
        self.lo, self.hi = np.full((nodes, dim), np.inf), np.full((nodes, dim), -np.inf)
        for k, run in enumerate(runs):
            if len(run):
                self.lo[self.first_leaf + k], self.hi[self.first_leaf + k] = turned[run].min(0), turned[run].max(0)
        for i in range(self.first_leaf - 1, -1, -1):
            self.lo[i] = np.minimum(self.lo[2 * i + 1], self.lo[2 * i + 2])
            self.hi[i] = np.maximum(self.hi[2 * i + 1], self.hi[2 * i + 2])
        self.empty = np.isinf(self.lo).any(1)
        self.lo[self.empty] = self.hi[self.empty] = 0
        #: The longest row: what turning and summing can be out by grows with it.
        self.reach = float(np.sqrt((rows.astype(np.float64) ** 2).sum(1).max(initial=0)))

    @staticmethod
    def _axes(rows: np.ndarray) -> np.ndarray:
        if len(rows) < 2 or not rows.shape[1]:
            return np.eye(rows.shape[1])
        middle = rows - rows.mean(0)
        return np.linalg.eigh(middle.T @ middle)[1]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Queries by nodes: no row under the node scores higher. A node's bound is never above its parent's."""
        turned = queries @ self.axes
        out = np.maximum(turned, 0) @ self.hi.T + np.minimum(turned, 0) @ self.lo.T
        out += 1e-9 * (1 + self.reach * np.sqrt((queries**2).sum(1)))[:, None]
        out[:, self.empty] = -np.inf
        for i in range(1, out.shape[1]):
            np.minimum(out[:, i], out[:, (i - 1) // 2], out=out[:, i])
        return out

    def search(self, queries: np.ndarray, names: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's position, id, score) of the k best rows of each query that reach its floor; its own id takes no part."""
        leaf_bounds = self.bounds(queries)[:, self.first_leaf :]
        order = np.argsort(-leaf_bounds, axis=1, kind="stable")
        ranked = np.take_along_axis(leaf_bounds, order, 1)
        floors = floors.astype(np.float64).copy()
        who, ids, scores = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        at, step = 0, 0
        while at < order.shape[1]:
            to = min(at + BURSTS[min(step, len(BURSTS) - 1)], order.shape[1])
            asks, places = np.nonzero((ranked[:, at:to] >= floors[:, None]) & (ranked[:, at:to] > -np.inf))
            if not len(asks):
                break
            leaves = order[asks, at + places]
            by_leaf = np.argsort(leaves, kind="stable")
            asks, leaves = asks[by_leaf], leaves[by_leaf]
            edges = np.flatnonzero(np.diff(leaves, prepend=-1, append=-1))
            new = [(who, ids, scores)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                run, some = self.runs[leaves[a]], asks[a:b]
                got = queries[some] @ self.rows[run].T
                q, r = np.nonzero((got >= floors[some][:, None]) & (self.ids[run][None, :] != names[some][:, None]))
                new.append((some[q], self.ids[run][r], got[q, r]))
            who, ids, scores = (np.concatenate([x[i] for x in new]) for i in range(3))
            best = np.lexsort((ids, -scores, who))
            who, ids, scores = who[best], ids[best], scores[best]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            who, ids, scores, rank = who[rank < k], ids[rank < k], scores[rank < k], rank[rank < k]
            full = rank == k - 1
            floors[who[full]] = np.maximum(floors[who[full]], scores[full])
            at, step = to, step + 1
        return who, ids, scores


def quantised(vectors: DataFrame, *, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; rows that are null or hold nulls, NaN or infinities go."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(~F.coalesce(bad, F.lit(True)))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(column) -> np.ndarray:
    """Rows of equally long lists."""
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def _walk(k: int, most: int = 512):
    """Rows come as (dim, shard, block, is_query, vec_id, v, floor), sorted by the first four: a shard's rows, then the block's queries."""

    def walk(batches):
        import pyarrow as pa

        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        now, parts, tree = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
            edges = [0, *(np.flatnonzero(np.diff(keys, axis=0).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                group = tuple(keys[a, :3].tolist())
                if group != now:
                    now, parts, tree = group, [], None
                ids, vectors = batch.column(4).slice(a, b - a).to_numpy(), _matrix(batch.column(5).slice(a, b - a))
                if not keys[a, 3]:
                    parts.append((ids, vectors))
                    continue
                if tree is None:
                    if not parts:
                        continue
                    tree, parts = Tree(np.concatenate([v for _, v in parts]), np.concatenate([i for i, _ in parts])), []
                floors = batch.column(6).slice(a, b - a).to_numpy()
                for at in range(0, b - a, most):
                    who, found, scores = tree.search(vectors[at : at + most], ids[at : at + most], floors[at : at + most], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + most][who]), pa.array(found), pa.array(scores.astype(np.int64))], schema=kind)

    return walk


def top_k(vectors: DataFrame, *, query_filter, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shard_rows: int = 16384, block_rows: int = 65536, most_tasks: int = 65_536) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k highest integer inner products.

    query_filter: a condition over vec_id that picks the queries from the rows. Vectors must have one
    length; others than the commonest have no inner product with it and are searched among their own.
    An id that occurs on several rows is a query for each distinct vector of it (merged by id) and a
    candidate as often as it occurs, never for its own id. Scores stay exact up to 2^53. Empty vectors
    score 0 with one another; empty tables give no rows.

    Every block of `block_rows` queries meets every shard once: a stated query set against all rows, in
    blocks. A task holds one shard's rows and 512 queries at a time.
    """
    spark = vectors.sparkSession
    work = common.Workspace(spark, "top-k")
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    rows = work.keep(quantised(named, id_col="vec_id", vector_col="embedding", scale=scale).select("vec_id", "v", F.size("v").alias("dim")), "rows")
    queries = rows.filter(query_filter)
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("home", F.pmod(F.xxhash64("vec_id", F.lit("home")), F.lit(shards)).cast("int"))
    keys = ["dim", "shard", "block", "is_query"]
    tasks = min(shards * blocks, most_tasks)

    def search(asks: DataFrame) -> DataFrame:
        """asks: vec_id, v, dim, shard, block, floor."""
        both = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("dim", "shard", "block", F.lit(False).alias("is_query"), "vec_id", "v", F.lit(float("-inf")).alias("floor"))
        both = both.unionByName(asks.select("dim", "shard", "block", F.lit(True).alias("is_query"), "vec_id", "v", "floor"))
        task = F.pmod(F.col("shard").cast("long") * blocks + F.col("block"), F.lit(tasks)).cast("int")
        return both.repartitionById(tasks, task).sortWithinPartitions(*keys).select(*keys, "vec_id", "v", "floor").mapInArrow(_walk(k), FOUND)

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    near = work.keep(search(asked.select("vec_id", "v", "dim", F.col("home").alias("shard"), "block", F.lit(float("-inf")).alias("floor"))), "home")
    if shards == 1:
        found = near
    else:
        kth = near.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("kth"))
        others = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard != home")
        others = others.join(kth, "vec_id", "left").withColumn("floor", F.coalesce("kth", F.lit(float("-inf"))))
        found = near.unionByName(search(others.select("vec_id", "v", "dim", "shard", "block", "floor")))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k_sql(k: int = 20, scale: int = 64, every: int = 20) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, [floor(CAST(x AS DOUBLE) * {scale}) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
