"""Streams of changes: every micro-batch is a command."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..model import EngineError
from ..storage import kept

OPERATION = "operation"


def apply_changes(command, resource: str, rows: DataFrame) -> None:
    """Rows of a change feed: `operation` is insert, update or delete, by the resource's identity; without that column all are inserts."""
    r = command.engine.resources[resource]
    if OPERATION not in rows.columns or OPERATION in r.columns:
        command.insert(resource, rows)
        return
    if rows.filter(~F.coalesce(F.col(OPERATION).isin("insert", "update", "delete"), F.lit(False))).limit(1).count():
        raise EngineError("INVALID_OBSERVER_ROW")
    kinds = {x[0] for x in rows.select(OPERATION).distinct().collect()}
    if "delete" in kinds:
        command.delete_keys(resource, rows.filter(F.col(OPERATION) == "delete"))
    if kinds & {"update", "insert"}:
        command.merge(resource, rows.filter(F.col(OPERATION) != "delete")) if r.identity else command.insert(resource, rows.filter(F.col(OPERATION) == "insert"))


def impact_stream(changes: DataFrame, engine: Engine, resource: str, path: str, checkpoint: str):
    """A change feed of `resource` as a stream of commands; the impact of batch n is written to path/batch=n, anew if it is repeated.

    Old states come from the engine's tables, so updates and deletes reach the inputs that a row leaves. A
    repeated batch merges the same rows again. An identity may occur once a batch. A batch's rows are
    written, since the engine's tables hold on to them.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = kept(rows, f"batch-{resource}")
        engine.command(lambda c: apply_changes(c, resource, rows)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(changes: DataFrame, time_column: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """A change feed without repeated rows, as long as repeats come within `late`."""
    stamped = changes.withColumn(time_column, changes[time_column].cast("timestamp"))
    return stamped.withWatermark(time_column, late).dropDuplicatesWithinWatermark(keys)
