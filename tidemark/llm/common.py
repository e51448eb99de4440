"""What the training-data operators share: inputs, shared folders and written intermediate tables."""

from __future__ import annotations

import atexit
import os
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where tables go if the driver runs everything itself and spark.checkpoint.dir is unset, as in tests.
LOCAL_SHARED = "file:///tmp/checkpoints/tidemark"
_owner: ContextVar[str | None] = ContextVar("owner", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text alone, null texts as empty ones; other columns of any name are left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor and the driver reach, with the scheme that Hadoop gives it.

    Where none is set, a local master gets a local folder and any other one an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = LOCAL_SHARED
        spark.sparkContext.setCheckpointDir(root)
    p, fs = _hadoop(spark, root)
    return fs.makeQualified(p).toString().replace("file:/", "file:///").replace("file://///", "file:///")


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def owned(owner: str):
    """Workspaces made inside belong to `owner`, who alone can release them."""
    token = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(token)


class Workspace:
    """Written tables of one operator call, in a folder of its own under the shared one.

    A written table cuts lineage: if an executor is lost later, its tasks read the table again. The
    folder stays until its owner releases it or the driver ends, since the operator's result is lazy
    and reads from it.
    """

    made: list[tuple[str | None, SparkSession, str]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.n = spark, 0
        self.path = f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex[:12]}"
        Workspace.made.append((_owner.get(), spark, self.path))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Remove tables of this workspace that nothing will read again."""
        for df in frames:
            for f in {os.path.dirname(x) for x in df.inputFiles() if self.path.split("://")[1] in x}:
                _delete(self.spark, f)

    @classmethod
    def release(cls, owner: str) -> None:
        """Remove the folders of `owner`; results that need them must have been written."""
        for mine, spark, path in list(cls.made):
            if mine == owner:
                _delete(spark, path)
                cls.made.remove((mine, spark, path))

    @classmethod
    def sweep(cls) -> None:
        """At the end of the driver: remove what is left, as long as the session still runs."""
        for _, spark, path in cls.made:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                _delete(spark, path)
        cls.made.clear()


atexit.register(Workspace.sweep)


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def lean(run):
    """A function over Arrow batches whose Python worker hands its free memory back at the end of every task.

    Workers stay for later tasks of any operator, so what one has touched would count against the next.
    """

    def tidy(batches):
        yield from run(batches)
        trim()

    return tidy


def trim() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def slices(column, most: int = 2 << 20):
    """Runs (from, to) of a string column's rows, each of at most `most` bytes or a single row."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, to
        at = to


def open_fs(uri: str):
    """The file system and path of a URI for use in executors' Python (local, HDFS, S3 and so on)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def publish(uri: str, write) -> None:
    """Write a file under another name and rename it, so that a retried or second attempt never leaves half a file.

    Attempts at one name write the same bytes. Where a rename refuses an existing file, as on HDFS, the
    file that is there stays.
    """
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex[:8]}.draft"
    with fs.open_output_stream(draft) as out:
        write(out)
    try:
        fs.move(draft, path)
    except OSError:
        if not _exists(fs, path):
            raise
        fs.delete_file(draft)


def _exists(fs, path: str) -> bool:
    from pyarrow.fs import FileType

    return fs.get_file_info(path).type == FileType.File


def schema_of(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)
