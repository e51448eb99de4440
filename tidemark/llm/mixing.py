"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Every source gets a mean repetition rate: its target share of all characters divided by the share it
has. A document's count is drawn by inverting the Poisson distribution of that mean at a uniform number
hashed from the seed, the document's id and its text, so a rerun or a retried task draws the same
counts. Documents are then exploded by their counts and dealt over the cluster in the order of another
hash, which is a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Two to the 52nd: hashes of 13 hexadecimal digits become exact doubles below one.
UNIT = float(1 << 52)


def unit_hash(*parts: Column) -> Column:
    """A uniform double in [0, 1) from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(UNIT)


#: The largest mean whose probabilities are summed from exp(-rate) on, which is still an exact double there.
MOST = 700.0


def poisson_steps(rate: Column) -> tuple[Column, Column]:
    """The first k and the cumulative probabilities P(X <= k) from there on, as far as doubles can tell them from zero and one.

    Up to `MOST` the first k is 0. Beyond it the terms begin twelve deviations and more below the mean, as
    multiples of their first one, and are divided by their sum in the end, so no rate underflows.
    """
    large = rate > MOST
    reach = 12 * F.sqrt(rate) + 30
    first, last = F.when(large, F.floor(rate - reach)).otherwise(0).cast("long"), F.ceil(rate + reach).cast("long")
    begin = F.when(large, F.lit(1.0)).otherwise(F.exp(-rate))
    steps = F.aggregate(
        F.sequence(first + 1, last),
        F.struct(begin.alias("p"), F.array(begin).alias("steps")),
        lambda a, k: F.struct(
            (a["p"] * rate / k).alias("p"),
            F.concat(a["steps"], F.array(F.element_at(a["steps"], -1) + a["p"] * rate / k)).alias("steps"),
        ),
        lambda a: F.when(large, F.transform(a["steps"], lambda s: s / F.element_at(a["steps"], -1))).otherwise(a["steps"]),
    )
    return first, steps


def source_rates(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """Per source: its characters and the mean number of times that a document of it should occur.

    weights: target shares by source (others get none); without them, shares follow the sources' sizes to
    the power `temperature`. The target total is the input's own number of characters. A source without
    characters keeps the rate 1. A null source is a source of its own.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("long")).alias("chars"))
    if weights is None:
        sized = sizes.withColumn("share", F.when(F.col("chars") > 0, F.pow(F.col("chars").cast("double"), F.lit(temperature))).otherwise(0.0))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
        sized = sizes.withColumn("share", F.coalesce(given[F.coalesce("source", F.lit(""))].cast("double"), F.lit(0.0)))
    total = sized.agg(F.sum("chars").alias("all_chars"), F.sum("share").alias("all_shares"))
    rate = F.col("share") / F.col("all_shares") * F.col("all_chars") / F.col("chars")
    return sized.join(F.broadcast(total)).select("source", "chars", F.when((F.col("chars") > 0) & (F.col("all_shares") > 0), F.round(rate, 9)).otherwise(1.0).alias("rate"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, temperature: float = 0.5, seed: int = 7) -> DataFrame:
    """All columns of `docs`, each row as often as drawn, with `copy` (from 1), `repetitions` and `mix_order`.

    Rows of equal id and text draw alike, since the draw is hashed from them; null ids and texts hash as
    empty strings; an empty table gives no rows. Columns of `docs` with the names of the added ones are
    replaced by those. `mix_order` is uniform in [0, 1), so partition i of n takes the orders from i / n
    on, and the partitions together are in the order of `mix_order`.

    The sources' rates are written first, so that Spark knows their size: it broadcasts them below its
    own threshold and else joins by shuffling.
    """
    docs = docs.drop("copy", "repetitions", "mix_order")
    rates = common.Workspace(docs.sparkSession, "mixing").keep(source_rates(docs, source_col=source_col, text_col=text_col, weights=weights, temperature=temperature), "rates")
    first, ladder = poisson_steps(F.col("rate"))
    steps = rates.select(F.col("source").alias("__source"), first.alias("__first"), ladder.alias("__steps"))
    ident = [F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(text_col, F.lit("")))]
    drawn = docs.join(steps, docs[source_col].eqNullSafe(steps["__source"])).withColumn("__u", unit_hash(*ident))
    count = (F.col("__first") + F.size(F.filter("__steps", lambda s: s <= F.col("__u")))).cast("int")
    counted = drawn.withColumn("repetitions", count).drop("__source", "__first", "__steps", "__u").filter("repetitions > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repetitions"))))
    shuffled = copies.withColumn("mix_order", unit_hash(F.lit(f"{seed}:order"), *ident[1:], F.col("copy").cast("string")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shuffled.repartitionById(parts, F.floor(F.col("mix_order") * parts).cast("int")).sortWithinPartitions("mix_order")


def mix_sql(*, temperature: float = 0.5, seed: int = 7, columns: str = "doc_id, source, repetitions, copy, mix_order, n_chars", docs: str = "documents") -> str:
    """The same rows in DuckDB's SQL, for the default weights."""
    unit = "CAST(CAST(('0x' || substr(md5({}), 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
    ident = "coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))"
    return f"""
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars FROM {docs} GROUP BY source
), shares AS (
  SELECT source, chars, CASE WHEN chars > 0 THEN pow(CAST(chars AS DOUBLE), {temperature}) ELSE 0.0 END AS share FROM sizes
), rates AS (
  SELECT source, CASE WHEN chars > 0 THEN round(share / (SELECT sum(share) FROM shares) * (SELECT CAST(sum(chars) AS DOUBLE) FROM shares) / chars, 9) ELSE 1.0 END AS rate FROM shares
), begins AS (
  SELECT source, rate, rate > {MOST} AS large, CASE WHEN rate > {MOST} THEN CAST(floor(rate - 12 * sqrt(rate) - 30) AS BIGINT) ELSE 0 END AS k, CASE WHEN rate > {MOST} THEN 1.0 ELSE exp(-rate) END AS p FROM rates
), steps AS (
  SELECT source, rate, large, k, k AS first, CAST(p AS DOUBLE) AS p, CAST(p AS DOUBLE) AS cum FROM begins
  UNION ALL
  SELECT source, rate, large, k + 1, first, p * rate / (k + 1), cum + p * rate / (k + 1) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
), ladder AS (
  SELECT source, min(first) AS first, CASE WHEN bool_or(large) THEN [c / list_aggregate(list(cum), 'max') FOR c IN list(cum)] ELSE list(cum) END AS steps FROM steps GROUP BY source
), drawn AS (
  SELECT d.*, {ident} AS ident, l.first, l.steps, {unit.format(f"'{seed}:' || {ident}")} AS u FROM {docs} d JOIN ladder l ON d.source IS NOT DISTINCT FROM l.source
), counted AS (
  SELECT *, CAST(first + len([s FOR s IN steps IF s <= u]) AS INTEGER) AS repetitions FROM drawn
), copies AS (
  SELECT *, unnest(range(1, repetitions + 1)) AS c FROM counted WHERE repetitions > 0
), mixed AS (
  SELECT * EXCLUDE (c), CAST(c AS INTEGER) AS copy, {unit.format(f"'{seed}:order:' || ident || ':' || CAST(c AS VARCHAR)")} AS mix_order FROM copies
)
SELECT {columns} FROM mixed"""
