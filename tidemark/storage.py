"""Tables written in the folder that driver and executors share: they cut lineage and outlive a lost executor."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where tables go if the driver runs everything itself and spark.checkpoint.dir is unset, as in tests.
LOCAL = "file:///tmp/checkpoints/tidemark"
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where none is set and the driver runs everything itself."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = LOCAL
    return root


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table of its own and read back. Results read from it later, so it stays until the driver ends."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/engine/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def sweep() -> None:
    """Remove what was written, as long as the session still runs."""
    for spark, path in _written:
        context = spark.sparkContext
        if context._jsc is not None and not context._jsc.sc().isStopped():
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)
    _written.clear()
