"""Tables as resources: parquet folders, and the registry of the standard tables."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..model import EngineError, Resource

IDENTITY = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id"}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def discover(spark: SparkSession, folder: str, names: list[str], *, scopes: dict[str, str] | None = None, cascades: dict[str, tuple[tuple[str, str], ...]] | None = None, keys: dict[str, str | tuple[str, ...] | None] | None = None) -> dict[str, Resource]:
    """Resources of tables from their schemas; keys: identities by table, else those known; a table without one is keyless."""
    out = {}
    for n in names:
        columns = tuple(read_table(spark, folder, n).columns)
        key = keys[n] if keys and n in keys else IDENTITY.get(n)
        out[n] = Resource(n, columns, n, ((key,) if isinstance(key, str) else tuple(key)) if key else None, (scopes or {}).get(n), (cascades or {}).get(n, ()))
    return out


def discover_catalog(spark: SparkSession, database: str | None = None) -> dict[str, Resource]:
    """Resources of the session catalog's tables and views: unscoped and keyless, since it knows no keys."""
    return {t.name: Resource(t.name, tuple(c.name for c in spark.catalog.listColumns(t.name if t.isTemporary else f"{t.namespace[0]}.{t.name}")), t.name) for t in spark.catalog.listTables(database)}


def logical(tables: dict[str, DataFrame], resource: Resource) -> DataFrame:
    """One table of a resource's physical parts; a part may lack columns, which are null there."""
    if not resource.parts:
        return tables[resource.table or resource.id]
    parts = [tables[p].select(*[c for c in resource.columns if c in tables[p].columns]) for p in resource.parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*resource.columns)


def schema_fingerprint(tables: dict[str, DataFrame]) -> str:
    """A digest of the tables' columns and types."""
    return hashlib.sha256("\n".join(f"{n}:{tables[n].schema.json()}" for n in sorted(tables)).encode()).hexdigest()


def check_table(df: DataFrame, resource: Resource) -> list[str]:
    """Codes against a table: its columns must be those registered, and its identity unique."""
    if set(df.columns) != set(resource.columns):
        return ["RESOURCE_DRIFT"]
    if resource.identity and df.groupBy(*resource.identity).count().filter("count > 1").limit(1).count():
        return ["VALIDATION_FAILED"]
    return []


def write_table(df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet") -> None:
    if mode not in ("append", "overwrite", "error", "ignore"):
        raise EngineError("INVALID_WRITE_MODE")
    df.write.mode(mode).format(fmt).save(path)


def batches(df: DataFrame, size: int = 1000):
    """Rows in lists of `size` (1 to 10000), as a cursor gives them."""
    if not 1 <= size <= 10000:
        raise EngineError("INVALID_BATCH_SIZE")
    held = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
