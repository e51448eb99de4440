"""Change capture: row states of inserted, deleted and updated rows as one DataFrame of facts.

A fact is a pair of states (before, after) of one row and stands in one row: fact, resource, op, changed,
before, after; a state is null where the row is absent. Values are canonical texts. `states` lays facts out
long, a row for each state. A statement scans its table once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import CERTIFIED, NESTED, canonical_column
from ..model import EngineError, Limits, Manifest, Resource

STATE = "struct<kind:string,scope:string,fields:map<string,string>,equality:map<string,string>>"
FACTS = f"fact string, resource string, op string, changed array<string>, before {STATE}, after {STATE}"
STATES = "fact string, resource string, op string, side string, kind string, scope string, fields map<string,string>, equality map<string,string>, changed array<string>"
OPS = ("insert", "update", "delete", "unknown")


def _none() -> Column:
    return F.lit(None)


def observed(resource: Resource, manifest: Manifest) -> list[str]:
    """Columns of which facts need the values: scope, identity, bound and filtered ones."""
    out = {resource.scope} if resource.scope else set()
    out |= set(resource.identity or ())
    for reads in manifest.reads.values():
        for r in reads:
            if r.resource == resource.id:
                out |= {c for c, _ in r.bindings} | {c for c, _ in r.filters}
    return sorted(out)


class Encoder:
    """States and facts of one resource's rows; `kinds` are its columns' types, by name."""

    def __init__(self, resource: Resource, columns: list[str], kinds: dict):
        self.resource, self.columns, self.kinds = resource, columns, kinds
        self.opaque = any(isinstance(kinds[c], NESTED) for c in columns)

    def text(self, column: str, prefix: str = "") -> Column:
        return canonical_column(F.col(prefix + column), self.kinds[column])

    def _map(self, columns: list[str], prefix: str) -> Column:
        if not columns:
            return F.create_map().cast("map<string,string>")
        return F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[self.text(c, prefix) for c in columns]))

    def state(self, prefix: str = "") -> Column:
        """Rows of which an observed value is no scalar are unknown."""
        if self.opaque:
            return F.struct(F.lit("unknown").alias("kind"), *(_none().cast(t).alias(n) for n, t in (("scope", "string"), ("fields", "map<string,string>"), ("equality", "map<string,string>")))).cast(STATE)
        certified = [c for c in self.columns if isinstance(self.kinds[c], CERTIFIED)]
        scope = self.text(self.resource.scope, prefix) if self.resource.scope else _none().cast("string")
        return F.struct(F.lit("known").alias("kind"), scope.alias("scope"), self._map(self.columns, prefix).alias("fields"), self._map(certified, prefix).alias("equality")).cast(STATE)

    def facts(self, df: DataFrame, op: str, *, before: str | None = None, after: str | None = None, changed: Column | None = None) -> DataFrame:
        """before, after: the prefix of that side's columns, or None where it is absent."""
        named = before if before is not None else after
        key = [F.when(F.col(named + c).isNull(), "null").otherwise(F.col(named + c).cast("string") if not isinstance(self.kinds[c], NESTED) else F.to_json(F.array(named + c))) for c in self.resource.identity or ()]
        absent = _none().cast(STATE)
        return df.select(
            F.concat_ws(":", F.lit(self.resource.id), F.lit(op), *key).alias("fact"), F.lit(self.resource.id).alias("resource"), F.lit(op).alias("op"),
            (changed if changed is not None else _none()).cast("array<string>").alias("changed"),
            (self.state(before) if before is not None else absent).alias("before"), (self.state(after) if after is not None else absent).alias("after"),
        )


def encoder(df: DataFrame, resource: Resource, columns: list[str]) -> Encoder:
    return Encoder(resource, columns, {f.name: f.dataType for f in df.schema})


def inserted(new: DataFrame, resource: Resource, columns: list[str]) -> DataFrame:
    return encoder(new, resource, columns).facts(new, "insert", after="")


def deleted(old: DataFrame, resource: Resource, columns: list[str]) -> DataFrame:
    return encoder(old, resource, columns).facts(old, "delete", before="")


def all_unknown(spark, resource: Resource, op: str = "unknown") -> DataFrame:
    """One fact that says only that something changed: a truncated or keyless table, a refreshed view."""
    lost = ("unknown", None, None, None)
    return spark.createDataFrame([(f"{resource.id}:{op}", resource.id, op, None, lost, lost)], FACTS)


def changes(resource: Resource, old: str = "old_", new: str = "new_") -> Column:
    return F.array_compact(F.array(*[F.when(~F.col(old + c).eqNullSafe(F.col(new + c)), F.lit(c)) for c in resource.columns]))


def updated_in_place(old: DataFrame, values: dict[str, Column], resource: Resource, columns: list[str]) -> DataFrame:
    """Rows that an update of other columns than the identity changes; one pass over them."""
    e = encoder(old, resource, columns)
    both = old.select(*[F.col(c).alias(f"old_{c}") for c in resource.columns], *[values.get(c, F.col(c)).alias(f"new_{c}") for c in resource.columns])
    moved = both.withColumn("__changed", changes(resource)).filter(F.size("__changed") > 0)
    return e.facts(moved, "update", before="old_", after="new_", changed=F.col("__changed"))


def paired(old: DataFrame, new: DataFrame, resource: Resource, how: str = "full_outer") -> DataFrame:
    """Null-safe join on the identity; columns with the prefixes old_ and new_."""
    a = old.select(*[F.col(c).alias(f"old_{c}") for c in resource.columns], F.lit(True).alias("was"))
    b = new.select(*[F.col(c).alias(f"new_{c}") for c in resource.columns], F.lit(True).alias("is"))
    return a.join(b, reduce(lambda x, y: x & y, [F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in resource.identity]), how)


def updated(old: DataFrame, new: DataFrame, resource: Resource, columns: list[str]) -> DataFrame:
    """Rows that differ, by their identity; a changed identity gives two half facts, a table without one a single unknown fact."""
    if not resource.identity:
        return all_unknown(old.sparkSession, resource)
    e, both = encoder(old, resource, columns), paired(old, new, resource)
    moved = both.filter("was and is").withColumn("__changed", changes(resource)).filter(F.size("__changed") > 0)
    facts = e.facts(moved, "update", before="old_", after="new_", changed=F.col("__changed"))
    return facts.unionByName(e.facts(both.filter("was and is is null"), "update", before="old_")).unionByName(e.facts(both.filter("is and was is null"), "update", after="new_"))


def merged(table: DataFrame, rows: DataFrame, resource: Resource, columns: list[str]) -> DataFrame:
    """Facts of rows that replace those of the same identity or are put in; one join."""
    e, both = encoder(table, resource, columns), paired(table, rows, resource, "right")
    moved = both.filter("was").withColumn("__changed", changes(resource)).filter(F.size("__changed") > 0)
    return e.facts(moved, "update", before="old_", after="new_", changed=F.col("__changed")).unionByName(e.facts(both.filter("was is null"), "insert", after="new_"))


def states(facts: DataFrame) -> DataFrame:
    """A row for each state that is not absent."""
    sides = F.explode(F.filter(F.array(F.struct(F.lit("before").alias("side"), F.col("before").alias("s")), F.struct(F.lit("after").alias("side"), F.col("after").alias("s"))), lambda x: x["s"].isNotNull()))
    long_ = facts.select("fact", "resource", "op", "changed", sides.alias("x"))
    return long_.select("fact", "resource", "op", "x.side", "x.s.kind", "x.s.scope", "x.s.fields", "x.s.equality", "changed")


def uncertified(facts: DataFrame, certified: list[str]) -> DataFrame:
    """Facts without proof of equality for resources that are not in `certified`."""
    bare = lambda s: F.when(F.col(s).isNotNull(), F.struct(F.col(f"{s}.kind"), F.col(f"{s}.scope"), F.col(f"{s}.fields"), _none().cast("map<string,string>").alias("equality")).cast(STATE))
    known = F.col("resource").isin(certified)
    return facts.withColumns({s: F.when(known, F.col(s)).otherwise(bare(s)) for s in ("before", "after")})


def checked(facts: DataFrame, resources: dict[str, Resource]) -> DataFrame:
    """Facts from elsewhere, or an error about the first that is not well formed."""
    if [(f.name, f.dataType.simpleString()) for f in facts.schema] != [(f.name, f.dataType.simpleString()) for f in _schema()]:
        raise EngineError("INVALID_WRITE_FACT")
    scalar = lambda v: v.isNotNull() & v.rlike(r'^(null|true|false|-?[0-9].*|".*")$')
    every = lambda m: F.coalesce(F.forall(F.map_values(m), scalar), F.lit(True))
    sides = [F.col("before"), F.col("after")]
    code = F.when(~F.col("resource").isin(list(resources)), "UNREGISTERED_RESOURCE").when(F.col("resource").isNull() | ~F.coalesce(F.col("op").isin(*OPS), F.lit(False)), "INVALID_WRITE_FACT")
    code = code.when(reduce(lambda a, b: a | b, [s.isNotNull() & ~F.coalesce(s["kind"].isin("known", "unknown"), F.lit(False)) for s in sides]), "INVALID_ROW_STATE")
    code = code.when(reduce(lambda a, b: a | b, [F.coalesce((s["kind"] == "known") & (s["fields"].isNull() | ~every(s["fields"]) | ~every(s["equality"])), F.lit(False)) for s in sides]), "NON_SCALAR_FIELD")
    bad = facts.select(code.alias("code")).filter("code is not null").first()
    if bad:
        raise EngineError(bad["code"])
    return facts


def _schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(FACTS)


def sizes(facts: DataFrame) -> DataFrame:
    """Number and bytes of the facts of every resource."""
    size = F.octet_length(F.to_json(F.struct("resource", "op", "changed", "before", "after")))
    return facts.groupBy("resource").agg(F.count("*").alias("facts"), F.sum(size.cast("long")).alias("bytes"))


def largest(pressure: DataFrame) -> DataFrame:
    """The resource with the most bytes, ties by name."""
    return pressure.agg(F.max_by("resource", F.struct("bytes", F.lit(0))).alias("resource"), F.max("bytes").alias("bytes"))


def over(pressure: dict[str, tuple[int, int]], limits: Limits) -> list[str]:
    """Resources to summarise, the largest first, until numbers and bytes of facts are within the limits.

    pressure: number and bytes of facts by resource, at most limits.resources of them.
    """
    left, out = dict(pressure), []
    while True:
        count, size = sum(n for n, _ in left.values()), sum(b for _, b in left.values())
        if count <= limits.facts and size + count + 1 <= limits.fact_bytes:
            return out
        rest = [r for r in left if r not in out]
        if not rest:
            return out
        most = max(rest, key=lambda r: (left[r][1], r))
        out.append(most)
        left[most] = (1, min(left[most][1], limits.summary_bytes))


def summarised(facts: DataFrame, resources: list[str] | int, limits: Limits = Limits()) -> DataFrame:
    """The facts, those of `resources` reduced to one each (a number: of all with more facts than that).

    The one fact keeps what all known states of a side share: scope, fields and proofs of equality. Absent
    states do not count; an unknown state, or two scopes, make the side unknown; two operations make the
    operation unknown; changed columns are put together, null if one is. Beyond limits.summary_bytes the
    shared values go first, then the states.
    """
    if isinstance(resources, int):
        n = facts.groupBy("resource").agg(F.count("*").alias("facts"))
        chosen = F.broadcast(n.filter(F.col("facts") > resources).select("resource"))
        few, many = facts.join(chosen, "resource", "left_anti").select(*facts.columns), facts.join(chosen, "resource")
    else:
        few, many = facts.filter(~F.col("resource").isin(resources)), facts.filter(F.col("resource").isin(resources))
    flat = many.select("resource", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("s")) for s in ("before", "after")])).alias("x")).select("resource", "x.side", "x.s").filter("s is not null")
    side = flat.groupBy("resource", "side").agg(F.count("*").alias("all"), F.max((F.col("s.kind") == "unknown").cast("int")).alias("lost"), F.min(F.coalesce("s.scope", F.lit(""))).alias("low"), F.max(F.coalesce("s.scope", F.lit(""))).alias("high"), F.max("s.scope").alias("scope"))

    def shared(name: str) -> DataFrame:
        each = flat.select("resource", "side", F.explode(f"s.{name}").alias("c", "v")).groupBy("resource", "side", "c").agg(F.count("*").alias("n"), F.min("v").alias("v"), F.max("v").alias("w")).filter("v <=> w")
        kept = each.join(side.select("resource", "side", "all"), ["resource", "side"]).filter("n = all")
        return kept.groupBy("resource", "side").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "v")))).alias(name))

    proven = flat.groupBy("resource", "side").agg(F.max(F.col("s.equality").isNull()).alias("unproven"))
    empty = F.create_map().cast("map<string,string>")
    j = side.join(shared("fields"), ["resource", "side"], "left").join(shared("equality"), ["resource", "side"], "left").join(proven, ["resource", "side"])
    unknown = (F.col("lost") == 1) | (F.col("low") != F.col("high"))
    known = F.struct(F.lit("known").alias("kind"), "scope", F.coalesce("fields", empty).alias("fields"), F.when(~F.col("unproven"), F.coalesce("equality", empty)).alias("equality")).cast(STATE)
    blank = F.struct(F.lit("unknown").alias("kind"), _none().cast("string").alias("scope"), _none().cast("map<string,string>").alias("fields"), _none().cast("map<string,string>").alias("equality")).cast(STATE)
    one = j.select("resource", "side", F.when(unknown, blank).otherwise(known).alias("s"))
    wide = one.groupBy("resource").agg(F.first(F.when(F.col("side") == "before", F.col("s")), True).alias("before"), F.first(F.when(F.col("side") == "after", F.col("s")), True).alias("after"))
    ops = many.groupBy("resource").agg(F.count_distinct("op").alias("ops"), F.min("op").alias("one"), F.max(F.col("changed").isNull()).alias("any"))
    columns = many.select("resource", F.explode("changed").alias("c")).groupBy("resource").agg(F.array_sort(F.collect_set("c")).alias("c"))
    j = wide.join(ops, "resource").join(columns, "resource", "left")
    short = j.select(F.concat("resource", F.lit(":summary")).alias("fact"), "resource", F.when(F.col("ops") > 1, "unknown").otherwise(F.col("one")).alias("op"), F.when(~F.col("any"), F.coalesce("c", F.array().cast("array<string>"))).alias("changed"), "before", "after")
    return few.select(*facts.columns).unionByName(_bounded(short, limits).select(*facts.columns))


def _bounded(short: DataFrame, limits: Limits) -> DataFrame:
    size = F.octet_length(F.to_json(F.struct("resource", "op", "changed", "before", "after")))
    empty = F.create_map().cast("map<string,string>")

    def stripped(s: str) -> Column:
        return F.when(F.col(f"{s}.kind") == "known", F.struct(F.col(f"{s}.kind"), F.col(f"{s}.scope"), empty.alias("fields"), _none().cast("map<string,string>").alias("equality")).cast(STATE)).otherwise(F.col(s))

    def lost(s: str) -> Column:
        return F.when(F.col(s).isNotNull(), F.struct(F.lit("unknown").alias("kind"), _none().cast("string").alias("scope"), _none().cast("map<string,string>").alias("fields"), _none().cast("map<string,string>").alias("equality")).cast(STATE))

    large = short.withColumn("__large", size > limits.summary_bytes)
    large = large.withColumns({s: F.when(F.col("__large"), stripped(s)).otherwise(F.col(s)) for s in ("before", "after")}).withColumn("changed", F.when(~F.col("__large"), F.col("changed")))
    again = large.withColumn("__large", size > limits.summary_bytes)
    return again.withColumns({s: F.when(F.col("__large"), lost(s)).otherwise(F.col(s)) for s in ("before", "after")})
