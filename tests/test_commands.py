"""Commands: capture, cascades, bounds, guards, and their impact on every result."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.engine import Command, Engine
from tidemark.model import EngineError, Fragment, Limits, Resource, canonical, number_text, quoted
from tidemark.functions.scalars import match_keys, may_equal
from tidemark.operators import calculus, capture
from tidemark.plans.algebra import Bind, Call, Combine, Input, Join, Literal, Map, Order, Select, Sql, eq
from tidemark.plans.manifest import compile_manifest, validate_manifest
from tidemark.model import Manifest, Read, validate_resources

ORDERS = Resource("orders", ("id", "customer", "status", "priority"), identity=("id",))
ITEMS = Resource("items", ("id", "order_id", "amount"), identity=("id",))
NOTES = Resource("notes", ("item_id", "text"))
FAMILY = [Resource("orders", ORDERS.columns, identity=("id",), cascades=(("items", "order_id"),)), Resource("items", ITEMS.columns, identity=("id",), cascades=(("notes", "item_id"),)), NOTES]
QUERIES = {
    "list": Select("orders", ("id", "status"), (eq("customer", Input("customer")),), (Order("priority"), Order("id"))),
    "detail": Select("orders", None, (eq("id", Input("id")),), joins=(Join("items", Select("items", order=(Order("id"),)), "id", "order_id", many=True),)),
    "ready": Select("orders", ("id",), (eq("status", Literal("ready")),), (Order("priority"), Order("id"))),
    "notes": Select("notes", ("text",)),
}
UNBOUNDED = Limits.unbounded()


@pytest.fixture
def tables(spark):
    orders = spark.createDataFrame([(f"seed{i}", "odd" if i % 2 else "even", "ready", i) for i in range(8)], "id string, customer string, status string, priority long")
    items = spark.createDataFrame([(f"i{i}", f"seed{i % 8}", i) for i in range(12)], "id string, order_id string, amount long")
    return {"orders": orders, "items": items, "notes": spark.createDataFrame([("i1", "x"), ("i2", "y"), (None, "z")], "item_id string, text string")}


def engine(spark, tables, **options):
    return Engine(spark, tables, FAMILY, QUERIES, **{"limits": UNBOUNDED} | options)


def found(impact):
    return {(r.endpoint, r.status, r.selector, r.input, r.value) for r in impact.collect() if r.selector != "none"}


def test_cascades_reach_all_levels(spark, tables):
    e = engine(spark, tables)
    out = found(e.command(lambda c: c.delete("orders", "id = 'seed1'")))
    assert ("notes", "verified", "all", None, None) in out
    assert {r.text for r in e.tables["notes"].collect()} == {"y", "z"} and e.tables["items"].count() == 10
    truncated = engine(spark, tables)
    out = found(truncated.command(lambda c: c.truncate("orders")))
    assert ("notes", "conservative", "all", None, None) in out
    assert truncated.tables["items"].count() == 0 and [r.text for r in truncated.tables["notes"].collect()] == ["z"]
    with pytest.raises(EngineError, match="INVALID_CASCADE"):
        validate_resources([Resource("a", ("x",), cascades=(("b", "y"),)), Resource("b", ("y",))])


def test_facts_of_keyless_rows_are_counted(spark, tables):
    e = engine(spark, tables)
    c = Command(e)
    c.insert("notes", spark.createDataFrame([("i1", "same")] * 500, "item_id string, text string"))
    assert [(r.facts, r.resource) for r in capture.sizes(c.facts()).collect()] == [(500, "notes")]
    assert capture.over({"notes": (500, 1000), "orders": (3, 9000)}, Limits()) == ["orders", "notes"]
    c.insert("orders", spark.createDataFrame([(None, "a", "s", 1), ("", "a", "s", 1)], tables["orders"].schema))
    assert c.facts().filter("resource = 'orders'").select("fact").distinct().count() == 2


def test_large_writes_keep_what_is_common(spark, tables):
    many = spark.range(300).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("one").alias("customer"), F.lit("ready").alias("status"), F.col("id").alias("priority"))
    e = engine(spark, tables, limits=Limits())
    out = found(e.command(lambda c: (c.insert("orders", many), c.insert("notes", spark.createDataFrame([("i1", "x")], "item_id string, text string")))))
    assert ("list", "verified", "inputs", "customer", '"one"') in out and ("detail", "conservative", "all", None, None) in out
    assert ("ready", "verified", "all", None, None) in out and ("notes", "verified", "all", None, None) in out


def test_summaries_lose_what_differs(spark):
    known = lambda scope, fields, equality: ("known", scope, fields, equality)
    rows = [("a", "r", "update", ["x"], known("1", {"x": "1", "y": "null"}, {"x": "1"}), known("1", {"x": "2", "y": "3"}, {"x": "2"})), ("b", "r", "update", ["y"], known("1", {"x": "1", "y": "null"}, {"x": "1"}), None), ("c", "s", "insert", None, None, ("unknown", None, None, None)), ("d", "s", "delete", None, known("1", {"k": "1"}, None), None)]
    facts = spark.createDataFrame(rows, capture.FACTS)
    got = {r.resource: r for r in capture.summarised(facts, ["r", "s"]).collect()}
    assert got["r"].op == "update" and got["r"].changed == ["x", "y"]
    assert got["r"].before.fields == {"x": "1", "y": "null"} and got["r"].before.equality == {"x": "1"} and got["r"].after.fields == {"x": "2", "y": "3"}
    assert got["s"].op == "unknown" and got["s"].after.kind == "unknown" and got["s"].before.fields == {"k": "1"} and got["s"].before.equality is None and got["s"].changed is None
    small = {r.resource: r for r in capture.summarised(facts, ["r"], Limits(summary_bytes=120)).collect()}
    assert small["r"].before.fields != {"x": "1", "y": "null"} and small["r"].changed is None
    mixed = capture.summarised(spark.createDataFrame([rows[0], ("b", "r", "update", [], known("2", {}, None), None)], capture.FACTS), ["r"]).collect()
    assert mixed[0].before.kind == "unknown"


def test_facts_from_elsewhere_are_checked(spark, tables):
    good = ("f", "orders", "insert", None, None, ("known", None, {"id": '"x"'}, None))
    for bad, code in ((("f", "nothing", *good[2:]), "UNREGISTERED_RESOURCE"), (("f", "orders", "replace", *good[3:]), "INVALID_WRITE_FACT"), ((*good[:5], ("odd", None, {}, None)), "INVALID_ROW_STATE"), ((*good[:5], ("known", None, {"id": "[1]"}, None)), "NON_SCALAR_FIELD")):
        with pytest.raises(EngineError, match=code):
            engine(spark, tables).command(lambda c, b=bad: c.add(spark.createDataFrame([b], capture.FACTS)))
    assert ("detail", "verified", "inputs", "id", '"x"') in found(engine(spark, tables).command(lambda c: c.add(spark.createDataFrame([good], capture.FACTS)), scope=None))


def test_merge_meets_null_identities_once(spark):
    r = Resource("t", ("k", "v"), identity=("k",))
    rows = spark.createDataFrame([(None, 1), (1, 1)], "k long, v long")
    e = Engine(spark, {"t": rows}, [r], {"q": Select("t", ("v",), (eq("k", Input("k")),))}, limits=UNBOUNDED)
    out = found(e.command(lambda c: c.merge("t", spark.createDataFrame([(None, 9), (2, 2)], rows.schema))))
    assert out == {("q", "verified", "inputs", "k", "null"), ("q", "verified", "inputs", "k", "2")}
    assert sorted(map(tuple, e.tables["t"].collect()), key=str) == [(1, 1), (2, 2), (None, 9)]
    with pytest.raises(EngineError, match="DUPLICATE_IDENTITY"):
        e.command(lambda c: c.merge("t", spark.createDataFrame([(5, 1), (5, 2)], rows.schema)))
    swapped = e.command(lambda c: c.update("t", {"k": "3 - k"}, "k is not null"))
    assert {x[4] for x in found(swapped)} == {"1", "2"}


def test_guards(spark, tables):
    e = engine(spark, tables)

    def swallowed(c):
        try:
            c.delete("nothing", "true")
        except EngineError:
            pass

    with pytest.raises(EngineError, match="COMMAND_OPERATION_FAILED"):
        e.command(swallowed)

    def undone(c):
        try:
            with c.savepoint():
                c.delete("orders", "true")
                c.delete("nothing", "true")
        except EngineError:
            pass
        c.update("orders", {"status": "'done'"}, "id = 'seed3'")

    assert ("list", "verified", "inputs", "customer", '"odd"') in found(e.command(undone)) and e.tables["orders"].count() == 8
    with pytest.raises(EngineError, match="OVERLAPPING"):
        e.command(lambda c: e.command(lambda d: None))
    with pytest.raises(EngineError, match="INVALID_SCOPE"):
        e.command(lambda c: None, scope=["a"])
    before = e.snapshot()
    e.command(lambda c: c.truncate("orders"))
    assert before["orders"].count() == 8 and e.query("ready").count() == 0


def test_materialised_results_are_only_refreshed(spark, tables):
    top = Resource("top", ("customer", "n"), refreshed=True)
    counts = tables["orders"].groupBy("customer").count().withColumnRenamed("count", "n")
    e = Engine(spark, tables | {"top": counts}, [*FAMILY, top], {"top": Select("top")}, limits=UNBOUNDED)
    with pytest.raises(EngineError, match="MATERIALIZED_RESOURCE"):
        e.command(lambda c: c.delete("top", "true"))
    assert found(e.command(lambda c: c.refresh("top"))) == {("top", "conservative", "all", None, None)} and e.query("top").count() == 0


def test_a_failed_calculation_leaves_no_endpoint_unaffected(spark, tables, monkeypatch):
    e = engine(spark, tables)
    monkeypatch.setattr(calculus, "impact", lambda *a, **k: 1 / 0)
    out = e.command(lambda c: c.delete("orders", "id = 'seed1'")).collect()
    assert {(r.endpoint, r.status, r.codes) for r in out} == {(q, "unavailable", "CALCULATION_FAILED") for q in QUERIES} and e.tables["orders"].count() == 7


def test_versions_are_written_from_time_to_time(spark, tables):
    e = engine(spark, tables, write_every=2)
    for _ in range(4):
        e.command(lambda c: c.update("orders", {"priority": "priority + 1"}, "true"))
    assert "LocalTableScan" not in e.tables["orders"]._jdf.queryExecution().toString() and e.tables["orders"].agg(F.sum("priority")).first()[0] == 28 + 32


def test_no_store_reaches_all_that_is_made_of_it(spark, tables):
    queries = {"raw": Sql("SELECT count(*) AS n FROM orders", no_store=True), "call": Call("raw"), "both": Combine((("a", Call("call")), ("b", Select("notes")))), "map": Map(Call("raw"), lambda d: d), "bind": Bind(Select("notes"), Call("raw"), lambda d, i: {}), "plain": Select("notes")}
    e = Engine(spark, tables, FAMILY, queries, limits=UNBOUNDED)
    for q in ("raw", "call", "both", "map", "bind"):
        with pytest.raises(EngineError, match="QUERY_REQUIRES_NO_STORE_EXECUTION"):
            e.query(q)
    assert e.query_uncached("map")["cachePolicy"] == "no-store" and e.query_uncached("call")["data"].first().n == 8
    with pytest.raises(EngineError, match="NON_PLAIN_PLAN_VALUE"):
        Engine(spark, tables, FAMILY, {"odd": Select("orders", where=(eq("id", Literal(object())),))}, limits=UNBOUNDED)


def test_inputs_are_checked(spark, tables):
    def refuse(i):
        raise ValueError("no customer")

    class Schema:
        @staticmethod
        def parse(i):
            return i | {"extra": 1}

    e = engine(spark, tables, parse={"list": refuse, "detail": Schema})
    with pytest.raises(EngineError, match="INVALID_QUERY_INPUT:no customer"):
        e.query("list", {"customer": "odd"})
    assert e.query("detail", {"id": "seed1"}).count() == 1
    with pytest.raises(EngineError, match="UNKNOWN_QUERY"):
        e.query("nothing")
    with pytest.raises(EngineError, match="INVALID_QUERY_DEFINITION"):
        engine(spark, tables, parse={"list": 3})


def test_schemas_with_versions(spark, tables):
    class Schema:
        version = 1

        def __init__(self, issues=(), value=None):
            self.issues, self.value = issues, value

        def validate(self, given):
            return Schema(self.issues, given if self.value is None else self.value)

    assert engine(spark, tables, parse={"list": Schema()}).query("list", {"customer": "odd"}).count() == 4
    with pytest.raises(EngineError, match="INVALID_QUERY_INPUT:bad; worse"):
        engine(spark, tables, parse={"list": Schema(("bad", "worse"))}).query("list", {"customer": "odd"})
    Schema.version = 2
    with pytest.raises(EngineError, match="UNSUPPORTED_INPUT_SCHEMA_VERSION"):
        engine(spark, tables, parse={"list": Schema()})


def test_what_a_caller_bound_is_carried_to_calls(spark, tables):
    rewrite = lambda i: i | {"customer": "even"}
    queries = QUERIES | {"again": Call("list"), "mapped": Call("list", lambda i: {"customer": i["c"]}), "deeper": Call("again"), "loose": Call("list")}
    e = Engine(spark, tables, FAMILY, queries, limits=UNBOUNDED, parse={"list": rewrite}, opaque=frozenset({"loose"}))
    for q in ("list", "again", "deeper"):
        with pytest.raises(EngineError, match="PRESERVATION_VIOLATION:customer"):
            e.query(q, {"customer": "odd"})
    assert e.query("mapped", {"c": "odd"}).count() == 4 and e.query("loose", {"customer": "odd"}).count() == 4


def test_manifests_are_validated():
    r = validate_resources([ORDERS])
    for read, code in ((Read("items", ()), "UNREGISTERED_RESOURCE"), (Read("orders", ("nothing",)), "UNREGISTERED_COLUMN"), (Read("orders", (), (("id", ""),)), "INVALID_BINDING"), (Read("orders", (), (), (("id", 1),)), "INVALID_READ_FILTER")):
        with pytest.raises(EngineError, match=code):
            validate_manifest(Manifest({"q": (read,)}), r)
    with pytest.raises(EngineError, match="INVALID_ENDPOINT"):
        validate_manifest(Manifest({"": ()}), r)
    with pytest.raises(EngineError, match="MANIFEST_LIMIT"):
        validate_manifest(Manifest({"q": (Read("orders", None),)}), r, Limits(manifest_bytes=10))
    with pytest.raises(EngineError, match="MANIFEST_TARGET_BUDGET"):
        calculus.check_budget([f"endpoint{i}" for i in range(500)], Limits())


def test_reports_migration_and_fingerprints(spark, tables, tmp_path):
    e = engine(spark, tables)
    path, mark = str(tmp_path / "report"), e.fingerprint()
    assert {r.status for r in e.stored_validation(path).collect()} == {"verified"}
    assert e.stored_validation(path).count() == 4 and engine(spark, tables).fingerprint() == mark
    e.tables["items"] = e.tables["items"].unionByName(e.tables["items"])
    bad = {r.endpoint: (r.status, r.codes) for r in e.validate().collect()}
    assert bad["detail"] == ("conservative", ["VALIDATION_FAILED"]) and bad["list"][0] == "verified"
    with pytest.raises(EngineError, match="RESOURCE_DRIFT"):
        e.migrate(lambda t: t | {"notes": t["notes"].drop("text")}, FAMILY, QUERIES)
    assert e.fingerprint() == mark
    out = e.migrate(lambda t: t | {"notes": t["notes"].drop("text")}, [*FAMILY[:2], Resource("notes", ("item_id",))], {"notes": Select("notes")}).collect()
    assert [(r.endpoint, r.selector, r.codes) for r in out] == [("notes", "all", "CATALOG_DRIFT")] and e.fingerprint() != mark


def test_widening_stops_when_the_answer_fits(spark, tables):
    e = engine(spark, tables, limits=Limits(**(UNBOUNDED.__dict__ | {"impact_bytes": 1 << 62})))
    states = spark.range(40).select(F.concat(F.lit("k"), "id").alias("id"), F.lit("c").alias("customer"), F.lit("done").alias("status"), F.col("id").alias("priority"))
    c = Command(e)
    c.insert("orders", states)
    facts = capture.states(c.facts())
    import json

    def size(limit):
        rows = calculus.impact(calculus.decisions(facts, e.reads), list(QUERIES), limits=Limits(**(UNBOUNDED.__dict__ | {"impact_bytes": limit}))).collect()
        out = {}
        for r in rows:
            ep = out.setdefault(r.endpoint, {"status": r.status} | ({"codes": r.codes.split(",")} if r.codes else {}) | {"t": {}})
            if r.target:
                ep["t"].setdefault(r.target, {"kind": r.selector, "values": {}})["values"].setdefault(r.alternative, {})[r.input] = json.loads(r.value) if r.value else None
        plain = {"endpoints": {k: {x: y for x, y in v.items() if x != "t"} | {"targets": [{"scope": s, "selector": {"kind": t["kind"]} | ({"values": list(t["values"].values())} if t["kind"] == "inputs" else {})} for s, t in v["t"].items()]} for k, v in out.items()}}
        return len(canonical(plain).encode()), sum(t["kind"] == "all" for v in out.values() for t in v["t"].values())

    whole, wide = size(1 << 62)
    assert size(whole) == (whole, wide) and size(whole - 1)[0] <= whole - 1 and size(whole - 1)[1] == wide + 1


def test_subsumption_compares_by_inputs(spark):
    alternatives = [("e", "global", {"a": "1"}), ("e", "global", {"a": "1", "b": "2"}), ("e", "global", {"a": "2", "b": "2"}), ("e", "global", {"a": "2", "b": "2", "c": "3"}), ("e", "caller", {"a": "1", "b": "2"}), ("e", "global", {"c": "1", "d": "1"})]
    f = spark.createDataFrame([("f", "r", e, "after", "matched", t, a, False) for e, t, a in alternatives], "fact string, resource string, endpoint string, side string, reason string, target string, alternative map<string,string>, reduced boolean")
    rows = calculus.impact(f, ["e"], limits=UNBOUNDED).collect()
    assert {(r.target, r.alternative) for r in rows} == {("global", "a=1"), ("global", "a=2&b=2"), ("caller", "a=1&b=2"), ("global", "c=1&d=1")}


def test_rows_of_one_endpoint_stay_in_many_tasks(spark):
    empty = F.create_map().cast("map<string,string>")
    f = spark.range(0, 40000, 1, 4).select(F.lit("f").alias("fact"), F.lit("r").alias("resource"), F.lit("e").alias("endpoint"), F.lit("after").alias("side"), F.lit("matched").alias("reason"), F.lit("global").alias("target"), F.create_map(F.lit("a"), F.col("id").cast("string")).alias("alternative"), F.lit(False).alias("reduced"))
    f = f.unionByName(f.limit(1).withColumns({"endpoint": F.lit("w"), "alternative": empty}))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = calculus.impact(f, ["e", "w", "gone", "calm"], limits=UNBOUNDED, unavailable=["gone"])
        assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) < 20000
        assert sorted(map(tuple, out.filter("endpoint <> 'e'").collect())) == [("calm", "verified", "", None, "none", None, None, None), ("gone", "unavailable", "", None, "none", None, None, None), ("w", "verified", "", "global", "all", None, None, None)]
        assert out.filter("endpoint = 'e' and status = 'verified' and selector = 'inputs'").select("value").distinct().count() == 40000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_join_deals_rows_out_by_endpoint(spark):
    import re

    f = spark.createDataFrame([("f", "r", e, "after", "matched", "global", a, False) for e, a in (("e", {"a": "1"}), ("e", {"a": "1", "b": "2"}), ("e", {"a": "2", "b": "2"}), ("plain", {"a": "1"}))], "fact string, resource string, endpoint string, side string, reason string, target string, alternative map<string,string>, reduced boolean")
    given_ = spark.createDataFrame([("e", "n", {"a": "1"}), ("plain", "n", {"a": "2"})], "endpoint string, name string, values map<string,string>")
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(was, ("-1", "false")):
        spark.conf.set(k, v)
    try:
        out = calculus.impact(f, ["e", "plain", "calm"], limits=UNBOUNDED)
        stored = spark.createDataFrame(out.collect(), calculus.IMPACT)
        plain = calculus.impact(f.filter("endpoint = 'plain'"), ["plain"], limits=UNBOUNDED)
        each = calculus.minimal(calculus.alternatives(f))
        for df in (each, calculus.matching(stored, given_)):
            keys = [set(re.findall(r"(\w+)#", k)) for k in re.findall(r"SortMergeJoin \[(.*?)\], \[", df._jdf.queryExecution().executedPlan().toString())]
            assert not [k for k in keys if k <= {"endpoint", "target", "shape", "present"}], keys
        assert not re.search(r"Join \[endpoint#\d+, target#\d+, a#", plain._jdf.queryExecution().executedPlan().toString())
        assert {(r.endpoint, r.alternative) for r in out.collect()} == {("e", "a=1"), ("e", "a=2&b=2"), ("plain", "a=1"), ("calm", None)}
        assert {(r.endpoint, r.name) for r in calculus.matching(stored, given_).collect()} == {("e", "n")}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_an_impact_scans_a_written_table_once(spark, tables, tmp_path):
    tables["orders"].write.parquet(str(tmp_path / "orders"))
    stored = tables | {"orders": spark.read.parquet(str(tmp_path / "orders"))}
    c = Command(engine(spark, stored))
    c.update("orders", {"customer": "'x'"}, "priority > 2")
    assert c.facts()._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    out = engine(spark, stored).command(lambda c: c.update("orders", {"customer": "'x'"}, "priority > 2"))
    assert str(tmp_path) not in out._jdf.queryExecution().executedPlan().toString()


SCALARS = st.one_of(st.none(), st.booleans(), st.integers(-20, 20), st.sampled_from([0.5, 1e-7, 2.0, 1e21]), st.sampled_from(["", " ", "1", "01", "1 ", "0x10", "0b1", "0o7", "1e1", "+2", "TRUE", "true ", "a", "A", "a ", "Infinity", "16", "-0", ".5", "5.", "é", "É", '"']))


def test_keys_are_shared_exactly_if_scalars_may_be_equal(spark):
    seen = []

    @settings(max_examples=150, database=None)
    @given(st.tuples(SCALARS, SCALARS))
    def draw(pair):
        seen.append(tuple(map(canonical, pair)))

    draw()
    rows = spark.createDataFrame(seen + [(a, a) for a, _ in seen], "a string, b string").distinct()
    bad = rows.select("a", "b", may_equal(F.col("a"), F.col("b")).alias("may"), F.arrays_overlap(match_keys(F.col("a"), True), match_keys(F.col("b"), False)).alias("keys")).filter("may <> keys or may is null")
    assert bad.collect() == []


def test_matching_on_many_inputs(spark):
    impacts = spark.createDataFrame([("e", "v", "", "global", "inputs", "x", k, v) for k, v in (("a", "1"), ("b", '"x"'), ("c", "2"), ("d", "3"))] + [("w", "v", "", "global", "all", None, None, None), ("n", "v", "", None, "none", None, None, None)], calculus.IMPACT)
    full = {"a": '"1"', "b": '"X"', "c": "2", "d": "3"}
    given_ = [("e", "whole", full), ("e", "part", {"a": "1", "d": "3"}), ("e", "bare", {}), ("e", "null", None), ("e", "wrong4", full | {"d": "4"}), ("e", "wrong1", full | {"a": "2"}), ("e", "other", {"z": "1"}), ("w", "any", {"q": "1"}), ("n", "none", {"a": "1"})]
    got = calculus.matching(impacts, spark.createDataFrame(given_, "endpoint string, name string, values map<string,string>"))
    assert {r.name for r in got.collect()} == {"whole", "part", "bare", "null", "other", "any"}


def test_text_of_numbers_and_identifiers():
    assert [number_text(x) for x in (1e21, 1e-7, 1.5e-7, 0.000001, 123.25, -0.5, 1e20, 0.0)] == ["1e+21", "1e-7", "1.5e-7", "0.000001", "123.25", "-0.5", "100000000000000000000", "0"]
    assert canonical(1.0) == "1" and quoted("a`b") == "`a``b`"
    text, args = Fragment.joined([Fragment("SELECT"), Fragment.identifier("x"), Fragment("="), Fragment.value(3)]).named()
    assert (text, args) == ("SELECT `x` = :p0", {"p0": 3})
    with pytest.raises(EngineError, match="INVALID_IDENTIFIER"):
        quoted("")


def test_every_changed_result_is_matched(spark, tables):
    """Twenty rounds of pseudo-random writes: a result that differs must be reached by the impact."""
    seed = 713

    def draw():
        nonlocal seed
        seed = (seed * 1664525 + 1013904223) % 2**32
        return seed >> 8

    inputs = [("list", "odd", {"customer": '"odd"'}), ("list", "even", {"customer": '"even"'}), ("ready", "", {})] + [("detail", f"seed{i}", {"id": f'"seed{i}"'}) for i in range(8)]
    asked = spark.createDataFrame(inputs, "endpoint string, name string, values map<string,string>")
    e = engine(spark, {k: v.coalesce(1) for k, v in tables.items()}, write_every=1)

    def results():
        rows = [tuple(r) for r in e.tables["orders"].select("id", "customer", "status", "priority").collect()]
        of = {("list", c): tuple(sorted((p, i, s) for i, k, s, p in rows if k == c)) for c in ("odd", "even")}
        return of | {("ready", ""): tuple(sorted((p, i) for i, _, s, p in rows if s == "ready"))} | {("detail", f"seed{n}"): tuple(sorted(r for r in rows if r[0] == f"seed{n}")) for n in range(8)}

    for _ in range(8):
        before = results()
        status, priority, customer, key = "ready" if draw() % 2 else "draft", draw() % 20, "odd" if draw() % 2 else "even", draw() % 8
        reach = {(r.endpoint, r.name) for r in calculus.matching(e.command(lambda c: c.update("orders", {"status": f"'{status}'", "priority": f"{priority}L", "customer": f"'{customer}'"}, f"id = 'seed{key}'")), asked).collect()}
        after = results()
        assert {k for k in before if before[k] != after[k]} <= reach


def test_a_feed_reaches_the_inputs_that_rows_leave(spark, tables, tmp_path):
    from tidemark.streaming.commands import impact_stream

    feed = spark.createDataFrame([("seed1", "new", "ready", 1, "update"), ("seed2", None, None, None, "delete"), ("fresh", "third", "ready", 5, "insert")], "id string, customer string, status string, priority long, operation string")
    feed.write.parquet(str(tmp_path / "in"))
    e = engine(spark, tables)
    stream = spark.readStream.schema(feed.schema).parquet(str(tmp_path / "in"))
    impact_stream(stream, e, "orders", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = found(spark.read.parquet(str(tmp_path / "out")))
    assert {x[4] for x in got if x[0] == "list"} == {'"odd"', '"even"', '"new"', '"third"'} and e.tables["orders"].count() == 8


def test_repeats_leave_a_feed(spark, tmp_path):
    from tidemark.streaming.commands import first_seen

    events = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")], "id string, at string")
    events.write.parquet(str(tmp_path / "in"))
    stream = first_seen(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "at", ["id"])
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_composed_manifest_is_sound():
    r = validate_resources([ORDERS, ITEMS])
    m = compile_manifest({"a": Select("orders", ("id",), (eq("id", Input("i")),)), "b": Call("a", lambda i: i), "c": Combine((("x", Call("a")),))}, r)
    assert m.reads["b"][0].bindings == () and m.reads["c"][0].bindings == (("id", "i"),)
