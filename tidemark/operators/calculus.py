"""The impact calculus: facts and reads to the fewest sufficient input selectors of every endpoint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import filter_may_equal, match_keys, may_equal
from ..model import EngineError, Limits, Manifest, Resource
from ..storage import kept

READS = "endpoint string, resource string, scope_column string, columns array<string>, bindings array<struct<column:string,input:string>>, filters array<struct<column:string,value:string>>"
EXCLUDED = ("scope-excluded", "columns-unchanged", "filter-excluded")
IMPACT = "endpoint string, status string, codes string, target string, selector string, alternative string, input string, value string"
KEY = ["endpoint", "target"]


def reads_table(spark: SparkSession, manifest: Manifest, resources: dict[str, Resource]) -> DataFrame:
    """One row a read; its size is that of the registered queries, at most 512 endpoints."""
    return spark.createDataFrame([(n, r.resource, resources[r.resource].scope, list(r.columns) if r.columns is not None else None, [tuple(b) for b in r.bindings], [tuple(f) for f in r.filters]) for n, reads in manifest.reads.items() for r in reads], READS)


def decisions(states: DataFrame, reads: DataFrame, *, scope: str | None = None, conservative: list[str] | None = None) -> DataFrame:
    """Each state with each read of its resource: reason, target, alternative (input -> value) and whether precision was lost.

    scope: the caller's, as a canonical text. Reads of `conservative` endpoints count as unbound, unfiltered and of any scope.
    """
    loose = F.col("endpoint").isin(conservative or [])
    j = states.join(F.broadcast(reads), "resource")
    known, columns = F.col("kind") == "known", F.when(loose, None).otherwise(F.col("columns"))
    bindings = F.when(loose, F.array().cast("array<struct<column:string,input:string>>")).otherwise(F.col("bindings"))
    filters = F.when(loose, F.array().cast("array<struct<column:string,value:string>>")).otherwise(F.col("filters"))
    j = j.withColumns({"__c": columns, "__b": bindings, "__f": filters})
    foreign = F.lit(scope is not None) & F.col("scope_column").isNotNull() & known & ~F.col("scope").eqNullSafe(F.lit(scope)) & ~loose
    watched = F.concat("__c", F.transform("__f", lambda f: f["column"]))
    rescoped = F.coalesce(F.array_contains("changed", F.col("scope_column")), F.lit(False))
    touched = F.when(F.col("__c").isNull(), F.size("changed") > 0).otherwise(F.coalesce(F.arrays_overlap("changed", watched), F.lit(False)))
    unchanged = (F.col("op") == "update") & F.col("changed").isNotNull() & ~rescoped & ~touched
    value = lambda f: F.element_at("equality", f["column"])
    ruled = known & F.coalesce(F.exists("__f", lambda f: F.coalesce(~filter_may_equal(value(f), f["value"]), F.lit(False))), F.lit(False))
    pairs = F.transform(F.filter("__b", lambda b: F.map_contains_key("fields", b["column"])), lambda b: F.struct(b["input"].alias("k"), F.element_at("fields", b["column"]).alias("v")))
    pairs = F.when(known, F.array_distinct(pairs))
    torn = F.size(F.array_distinct(F.transform(pairs, lambda p: p["k"]))) < F.size(pairs)
    missing = known & (torn | F.exists("__b", lambda b: ~F.map_contains_key("fields", b["column"])))
    reason = F.when(foreign, "scope-excluded").when(unchanged, "columns-unchanged").when(ruled, "filter-excluded").when(~known, "unknown-row").when(missing, "missing-binding").otherwise("matched")
    unproved = known & F.exists("__f", lambda f: ~F.coalesce(value(f) == f["value"], F.lit(False)))
    reduced = ~known | (F.col("op") == "unknown") | ((F.col("op") == "update") & F.col("changed").isNull() & F.col("__c").isNotNull()) | F.coalesce(unproved, F.lit(False)) | missing | loose
    alternative = F.when(known & ~F.coalesce(torn, F.lit(False)), F.map_from_entries(F.array_sort(pairs))).otherwise(F.create_map().cast("map<string,string>"))
    return j.select("fact", "resource", "endpoint", "side", reason.alias("reason"), F.when(F.col("scope_column").isNull(), "global").otherwise("caller").alias("target"), F.coalesce(alternative, F.create_map().cast("map<string,string>")).alias("alternative"), F.coalesce(reduced, F.lit(True)).alias("reduced"))


def alternatives(found: DataFrame) -> DataFrame:
    """The distinct alternatives of the decisions that count: endpoint, target, a (entries by input), names, reduced."""
    hit = found.filter(~F.col("reason").isin(*EXCLUDED)).groupBy(*KEY, F.array_sort(F.map_entries("alternative")).alias("a")).agg(F.max("reduced").alias("reduced"))
    return hit.select(*KEY, "a", F.transform("a", lambda e: e["key"]).alias("names"), "reduced")


def minimal(each: DataFrame) -> DataFrame:
    """Alternatives without those that another one of fewer inputs subsumes.

    An alternative is cut down to every smaller set of inputs that occurs in its target, and looked up by
    equality; these sets come from the reads and are few. Alternatives are never compared pair by pair.
    """
    shapes = each.select(*KEY, F.col("names").alias("shape")).distinct()
    cut = each.join(F.broadcast(shapes), KEY).filter((F.size("shape") < F.size("names")) & (F.size(F.array_except("shape", "names")) == 0))
    cut = cut.select(*KEY, F.col("a").alias("narrow"), F.filter("a", lambda e: F.array_contains("shape", e["key"])).alias("a"))
    gone = cut.join(each.select(*KEY, "a"), [*KEY, "a"], "left_semi").select(*KEY, F.col("narrow").alias("a")).distinct()
    return each.join(gone, [*KEY, "a"], "left_anti")


def json_of(entries: Column) -> Column:
    """The canonical text of an alternative, its inputs in order."""
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))


def budget(targets: DataFrame, endpoints: DataFrame, limit: int) -> DataFrame:
    """Targets (endpoint, target, bytes) that must be widened to all inputs so that the whole answer has at most `limit` bytes.

    endpoints: endpoint, status, bytes without targets. The largest go first, ties by name; an endpoint's
    first widening costs the bytes of its new status and code. There are at most two targets an endpoint,
    512 endpoints, so these tables are small by the limits of registration.
    """
    broad = F.length(F.concat(F.lit('{"scope":"'), F.col("target"), F.lit('","selector":{"kind":"all"}}')))
    j = targets.join(endpoints.select("endpoint", "status"), "endpoint")
    order = [F.col("bytes").desc(), F.col("endpoint"), F.col("target")]
    first = F.row_number().over(Window.partitionBy("endpoint").orderBy(*order)) == 1
    growth = F.when(first & (F.col("status") == "verified"), len('"codes":["PRECISION_REDUCED"],') + len("conservative") - len("verified")).otherwise(0)
    saved = j.withColumn("saving", F.col("bytes") - broad - growth)
    total = endpoints.agg(F.sum("bytes").alias("e"), F.count("*").alias("n")).crossJoin(targets.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("t")))
    whole = total.select((F.col("e") + F.col("t") + F.lit(len('{"endpoints":{}}')) + F.greatest(F.col("n") - 1, F.lit(0))).alias("whole"))
    before = F.coalesce(F.sum("saving").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return saved.withColumn("before", before).crossJoin(F.broadcast(whole)).filter(F.col("whole") - F.col("before") > limit).select(*KEY)


def impact(found: DataFrame, endpoints: list[str], *, limits: Limits = Limits(), unavailable: list[str] | None = None, codes: dict[str, list[str]] | None = None, keep=kept) -> DataFrame:
    """Long rows: endpoint, status, codes, target, selector (all, inputs, none), alternative, input, value.

    Alternatives that another one subsumes go. More than limits.selectors of a target become their common
    part, or all inputs; targets beyond limits.impact_bytes become all inputs, the largest first. Every
    endpoint appears; input and value are null unless the selector is inputs. codes: reasons of endpoints
    that are conservative or unavailable from the outset.

    The distinct alternatives are written once and everything is worked out from that table, so the facts
    are read once. Rows meet their endpoint's status where they are: an endpoint may have any number of rows,
    so they are never dealt out by endpoint.
    """
    spark, unavailable, codes = found.sparkSession, unavailable or [], codes or {}
    each = keep(alternatives(found).filter(~F.col("endpoint").isin(unavailable)), "alternatives")
    state = each.groupBy(*KEY).agg(F.max("reduced").alias("reduced"), F.max(F.size("a") == 0).alias("everything"), F.min(F.size("a")).alias("least"), F.max(F.size("a")).alias("most"))
    narrow = each.join(F.broadcast(state.filter("not everything").select(*KEY, (F.col("least") < F.col("most")).alias("mixed"))), KEY)
    fewest = narrow.select(*each.columns)
    if not state.filter("not everything and least < most").isEmpty():  # else no alternative needs to be looked up
        fewest = narrow.filter("not mixed").select(*each.columns).unionByName(minimal(narrow.filter("mixed").select(*each.columns)))
    n = fewest.groupBy(*KEY).agg(F.count("*").alias("n"))
    over = F.broadcast(n.filter(F.col("n") > limits.selectors))
    entries = fewest.join(over, KEY).select(*KEY, "n", F.explode("a").alias("e"))
    common = entries.groupBy(*KEY, "e").agg(F.count("*").alias("c"), F.max("n").alias("n")).filter("c = n").groupBy(*KEY).agg(F.array_sort(F.collect_list("e")).alias("a"))
    inputs = keep(fewest.select(*KEY, "a").join(over, KEY, "left_anti").unionByName(common), "inputs")
    cut = over.select(*KEY, F.lit(True).alias("cut"))
    status = state.join(cut, KEY, "left").groupBy("endpoint").agg(F.max(F.col("reduced") | F.coalesce("cut", F.lit(False))).alias("reduced"))
    names = spark.createDataFrame([(e, e in unavailable, sorted(codes.get(e, []))) for e in endpoints], "endpoint string, gone boolean, given array<string>")
    judged = names.join(F.broadcast(status), "endpoint", "left").withColumn("reached", F.col("reduced").isNotNull()).withColumn("reduced", F.coalesce("reduced", F.lit(False)) | (F.size("given") > 0))
    judged = judged.select("endpoint", F.when(F.col("gone"), "unavailable").when(F.col("reduced"), "conservative").otherwise("verified").alias("status"), "given", "reached")
    chosen = inputs.select(*KEY).distinct()
    wide = state.select(*KEY).join(chosen, KEY, "left_anti")
    if limits.impact_bytes < 1 << 60:
        size = lambda kind, extra: F.length(F.lit(f'{{"scope":"","selector":{{"kind":"{kind}"}}}}')) + F.length("target") + extra
        alone = inputs.groupBy(*KEY).agg((F.sum(F.octet_length(json_of(F.col("a")))) + F.count("*") - 1 + len(',"values":[]')).alias("extra"))
        sized = alone.select(*KEY, size("inputs", F.col("extra")).cast("long").alias("bytes"))
        flat = wide.select(*KEY, size("all", F.lit(0)).cast("long").alias("bytes")).unionByName(sized).groupBy("endpoint").agg((F.count("*") - 1).alias("commas"))
        plain = F.octet_length(F.to_json(F.array("endpoint"))) - 2 + len(':{"status":"","targets":[]}') + F.length("status")
        coded = F.when(F.col("status") != "verified", len('"codes":["PRECISION_REDUCED"],')).otherwise(0)
        fixed = wide.groupBy("endpoint").agg(F.sum(size("all", F.lit(0))).alias("fixed"))
        envelope = judged.join(flat, "endpoint", "left").join(fixed, "endpoint", "left").select("endpoint", "status", (plain + coded + F.coalesce("commas", F.lit(0)) + F.coalesce("fixed", F.lit(0))).cast("long").alias("bytes"))
        late = keep(budget(sized, envelope, limits.impact_bytes), "widened")
        inputs = inputs.join(F.broadcast(late), KEY, "left_anti")
        wide = wide.unionByName(late)
        judged = judged.join(F.broadcast(late.select("endpoint").distinct().withColumn("late", F.lit(True))), "endpoint", "left").select("endpoint", F.when((F.col("status") == "verified") & F.col("late"), "conservative").otherwise(F.col("status")).alias("status"), "given", "reached")
    text = F.concat_ws("&", F.transform("a", lambda e: F.concat_ws("=", e["key"], e["value"])))
    long_ = inputs.select(*KEY, F.lit("inputs").alias("selector"), text.alias("alternative"), F.explode("a").alias("e")).select(*KEY, "selector", "alternative", F.col("e.key").alias("input"), F.col("e.value").alias("value"))
    blank = [F.lit(None).cast("string").alias(c) for c in ("alternative", "input", "value")]
    rows = long_.unionByName(wide.select(*KEY, F.lit("all").alias("selector"), *blank))
    rows = rows.unionByName(names.select("endpoint", F.lit(None).cast("string").alias("target"), F.lit("none").alias("selector"), *blank))
    lost = F.when((F.col("status") == "conservative"), F.array(F.lit("PRECISION_REDUCED"))).otherwise(F.array().cast("array<string>"))
    out = rows.join(F.broadcast(judged), "endpoint").filter("selector <> 'none' or not reached")
    said = F.array_join(F.array_sort(F.array_union("given", lost)), ",")
    return out.select("endpoint", "status", said.alias("codes"), "target", "selector", "alternative", "input", "value")


def ordered(impacts: DataFrame) -> DataFrame:
    """An impact in its fixed order."""
    return impacts.orderBy("endpoint", "target", "alternative", "input")


def _composite(values: Column, names: Column, given: bool) -> Column:
    """Every way to put together a key of each of the first three named values."""
    keys = F.transform(F.slice(names, 1, 3), lambda n: match_keys(F.element_at(values, n), given))
    return F.aggregate(keys, F.array(F.lit("")), lambda left, right: F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.concat_ws("\u0001", x, y)))))


def matching(impacts: DataFrame, inputs: DataFrame) -> DataFrame:
    """Registered inputs (endpoint, name, values map of canonical texts) that an impact reaches.

    An alternative matches if each of its inputs is missing from the registered ones or may equal it. Both
    sides are joined by keys that scalars share exactly if they may be equal, on up to three inputs at
    once; what more an alternative demands is checked then. No input meets alternatives without a key in
    common.
    """
    wide = impacts.filter("selector = 'all'").select("endpoint").distinct()
    a = F.map_from_entries(F.array_sort(F.collect_list(F.struct("input", "value"))))
    sets = impacts.filter("selector = 'inputs'").groupBy("endpoint", "target", "alternative").agg(a.alias("a")).select("endpoint", "a", F.array_sort(F.map_keys("a")).alias("shape"))
    shapes = sets.select("endpoint", "shape").distinct()
    rows = inputs.withColumn("values", F.coalesce("values", F.create_map().cast("map<string,string>"))).join(F.broadcast(shapes), "endpoint").withColumn("present", F.array_intersect("shape", F.map_keys("values")))
    bare = rows.filter("size(present) = 0").select("endpoint", "name")
    asked = rows.filter("size(present) > 0").withColumn("key", F.explode(_composite(F.col("values"), F.col("present"), True)))
    patterns = asked.select("endpoint", "shape", "present").distinct()
    offered = sets.join(F.broadcast(patterns), ["endpoint", "shape"])
    rest = F.filter(F.array_sort(F.map_entries("a")), lambda e: F.array_position("present", e["key"]) > 3)
    offered = offered.select("endpoint", "shape", "present", F.explode(_composite(F.col("a"), F.col("present"), False)).alias("key"), rest.alias("rest")).distinct()
    o = offered.select(*[F.col(c).alias(f"o_{c}") for c in offered.columns])
    same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"o_{c}") for c in ("endpoint", "shape", "present", "key")])
    fits = F.forall("o_rest", lambda e: may_equal(F.element_at("values", e["key"]), e["value"]))
    hit = asked.join(o, same & fits, "left_semi").select("endpoint", "name")
    return inputs.join(F.broadcast(wide), "endpoint", "left_semi").select("endpoint", "name").unionByName(bare).unionByName(hit).distinct()


# --- assessments --------------------------------------------------------------------------------------

REPORT = "endpoint string, status string, codes array<string>"


def validation_report(spark: SparkSession, manifest: Manifest, status: str = "verified", codes: tuple[str, ...] = ()) -> DataFrame:
    """One assessment an endpoint, at most 512."""
    return spark.createDataFrame([(e, status, sorted(codes)) for e in sorted(manifest.reads)], REPORT)


def merge_assessments(*tables: DataFrame) -> DataFrame:
    """The worst status of each endpoint (endpoint, status, codes) and all codes of those that are not verified."""
    rank = F.when(F.col("status") == "unavailable", 2).when(F.col("status") == "conservative", 1).otherwise(0)
    grouped = reduce(DataFrame.unionByName, tables).groupBy("endpoint").agg(F.max(rank).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"))
    return grouped.select("endpoint", F.element_at(F.array(*map(F.lit, ("verified", "conservative", "unavailable"))), F.col("r") + 1).alias("status"), "codes")


def assess_resource(report: DataFrame, manifest: Manifest, resource: str, status: str, codes: tuple[str, ...]) -> DataFrame:
    """The report with an assessment of every endpoint that reads the resource."""
    spark = report.sparkSession
    hit = [(e, status, sorted(codes)) for e, reads in manifest.reads.items() if any(r.resource == resource for r in reads)]
    return merge_assessments(report, spark.createDataFrame(hit, REPORT))


def apply_assessment(impacts: DataFrame, report: DataFrame) -> DataFrame:
    """An impact under a report: the worse status, all codes, no targets where unavailable; endpoints that the report lacks are unavailable."""
    own = impacts.select("endpoint", "status", F.filter(F.split("codes", ","), lambda c: c != "").alias("codes")).distinct()
    told = report.select("endpoint", "status", "codes")
    missing = own.select("endpoint").join(told, "endpoint", "left_anti").select("endpoint", F.lit("unavailable").alias("status"), F.array(F.lit("VALIDATION_FAILED")).alias("codes"))
    worst = merge_assessments(own, told.join(own, "endpoint", "left_semi"), missing)
    j = impacts.drop("status", "codes").join(F.broadcast(worst), "endpoint")
    gone = F.col("status") == "unavailable"
    hidden = {c: F.when(~gone, F.col(c)) for c in ("target", "alternative", "input", "value")} | {"selector": F.when(gone, "none").otherwise(F.col("selector"))}
    return j.withColumns(hidden | {"codes": F.array_join("codes", ",")}).select(*impacts.columns).distinct()


def unavailable_impact(spark: SparkSession, endpoints: list[str], code: str) -> DataFrame:
    return spark.createDataFrame([(e, "unavailable", code, None, "none", None, None, None) for e in sorted(endpoints)], IMPACT)


def all_impact(spark: SparkSession, manifest: Manifest, resources: dict[str, Resource], code: str) -> DataFrame:
    """All inputs of every endpoint that reads anything."""
    targets = {(e, "caller" if resources[r.resource].scope else "global") for e, reads in manifest.reads.items() for r in reads}
    rows = [(e, "conservative", code, t, "all", None, None, None) for e, t in sorted(targets)]
    return spark.createDataFrame(rows + [(e, "verified", "", None, "none", None, None, None) for e, reads in sorted(manifest.reads.items()) if not reads], IMPACT)


def check_budget(endpoints: list[str], limits: Limits) -> None:
    """Even with every target widened an answer must fit."""
    from ..model import CODES, byte_length

    broad = {e: {"status": "conservative", "codes": sorted(CODES), "targets": [{"scope": s, "selector": {"kind": "all"}} for s in ("caller", "global")]} for e in endpoints}
    if byte_length({"endpoints": broad}) > limits.impact_bytes:
        raise EngineError("MANIFEST_TARGET_BUDGET")
