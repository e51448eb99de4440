"""The corpus pipeline: toxicity, near-duplicates, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame,
which is written as Parquet and read again before the next stage begins. All but the last return the
columns of `documents`; other columns of `docs` go. Every stage releases the folders of the stages before
it, so two runs over one sf_dir in one driver must go through `run`, which keeps theirs apart.
"""

from __future__ import annotations

import uuid
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, minhash, mixing, packing, pii, tokens, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None
_run: ContextVar[str | None] = ContextVar("run", default=None)


#: What goes to a Python worker at once. Executors run all stages, and both sides hold a batch of each task.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
#: Bytes of text that packing encodes together; the executors' JVMs are at their full size by then.
SLICE = 2 << 20


def stage(f):
    """The stage's written tables replace those of the stage before it; batches are BATCH from then on in this session."""

    @wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(*BATCH)
        owner = f"pipeline:{_run.get() or sf_dir}"
        common.Workspace.release(owner)
        with common.owned(owner):
            return f(spark, docs, sf_dir)

    return call


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string kernel's plane does not call toxic; it is trained on the labelled documents of the input tables.

    Null and empty texts are kept, repeated rows share their decision, rows of a null id are scored as all
    others; empty tables give no rows, and without usable labels nothing is toxic.
    """
    model = toxicity.train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS[1:]).filter("predicted = 0").select(*COLUMNS)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicates (five-word shingles, similarity 0.8): that of the smallest id.

    Of repeated rows, and of rows that share an id, one is kept as of any other copies; a row of a null id
    is kept only if its group has no other. Rows without words are no copies of anything and all kept.
    An empty table gives no rows.
    """
    near = minhash.near_duplicates(docs, shingle=5, percent=80, by_row=True).filter("first")
    kept = near.groupBy("doc_id", "row_hash").agg(((F.count("*") > 1) & (F.max("n_shingles") > 0)).alias("many")).select(F.col("doc_id").alias("kept_id"), F.col("row_hash").alias("kept_hash"), "many")
    named = docs.select(*COLUMNS).withColumn("row_hash", minhash.row_hash("text"))
    found = named.join(kept, named["doc_id"].eqNullSafe(kept["kept_id"]) & (named["row_hash"] == kept["kept_hash"]))
    repeated = found.filter("many").dropDuplicates(["doc_id", "row_hash"])
    return found.filter("not many").unionByName(repeated).select(*COLUMNS)


@stage
def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text with its personal data replaced by their kinds; n_chars is that of the new text.

    A null text becomes an empty one; repeated rows stay repeated; an empty table gives no rows.
    """
    found = pii.find(docs, keep=COLUMNS[2:4], redacted=True)
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as drawn for their source's target weight, shuffled.

    A null source is a source of its own; rows of one id and text draw alike, null ones as empty; an empty
    table gives no rows.
    """
    return mixing.mix(docs, temperature=0.5, seed=7).select(*COLUMNS)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens.

    Null and empty texts are an end id alone; repeated rows are packed as often as they occur; an empty
    table gives no rows.
    """
    return packing.pack(docs, tokenizer=tokens.default_path("byte_bpe_50k.json"), end_id=0, capacity=2048, slice_bytes=SLICE)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is a table in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    name = uuid.uuid4().hex[:12]
    place, token = f"{common.shared_dir(spark)}/corpus-pipeline-{name}", _run.set(name)
    try:
        for label, function in STAGES:
            out = function(spark, docs, sf_dir)
            out.write.parquet(f"{place}/{label}")
            docs = spark.read.schema(out.schema).parquet(f"{place}/{label}")
        common.Workspace.release(f"pipeline:{name}")
    finally:
        _run.reset(token)
    return docs
