import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.model import EngineError, Limits, Resource, canonical, validate_resources
from tidemark.operators import calculus, capture
from tidemark.plans.algebra import Call, Input, Literal, Order, Select, any_of, eq
from tidemark.plans.manifest import compile_manifest
from tidemark.plans.sqltext import sql_reads

T = Resource("records", ("id", "tenant", "filter", "value"), identity=("id",), scope="tenant")
G = Resource("records", ("id", "status", "customer"), identity=("id",))
BY_FILTER = {"list": Select("records", ("value",), (eq("filter", Input("filter")),))}
READY = {"ready": Select("records", ("id", "status", "customer"), (eq("customer", Input("customer")), eq("status", Literal("ready"))))}


def outcome(spark, resource, queries, states, scope=None):
    resources = validate_resources([resource])
    reads = calculus.reads_table(spark, compile_manifest(queries, resources), resources)
    found = calculus.decisions(spark.createDataFrame(states, capture.STATES), reads, scope=scope)
    rows = calculus.impact(found, list(queries)).collect()
    return sorted({r.reason for r in found.collect()}), {r.status for r in rows}, sorted((r.selector, r.input, r.value) for r in rows if r.selector != "none")


def state(side, op, fields=None, *, kind="known", scope=None, equality=None, changed=None):
    return ("f", "records", op, side, kind, scope, fields, equality, changed)


def test_goldens(spark):
    assert outcome(spark, T, BY_FILTER, [state("after", "insert", {"filter": "false"}, scope='"a"')], '"a"') == (["matched"], {"verified"}, [("inputs", "filter", "false")])
    old_new = [state("before", "update", {"filter": "null"}, scope='"a"', changed=["filter"]), state("after", "update", {"filter": '"new"'}, scope='"a"', changed=["filter"])]
    assert outcome(spark, T, BY_FILTER, old_new, '"a"') == (["matched"], {"verified"}, [("inputs", "filter", '"new"'), ("inputs", "filter", "null")])
    assert outcome(spark, T, BY_FILTER, [state("after", "insert", {"filter": '"p"'}, scope='"b"')], '"a"') == (["scope-excluded"], {"verified"}, [])
    unknown = [state("before", "unknown", kind="unknown"), state("after", "unknown", {"filter": '"new"'}, scope='"a"')]
    assert outcome(spark, T, BY_FILTER, unknown, '"a"')[1:] == ({"conservative"}, [("all", None, None)])
    same = [state(s, "update", {"filter": "1"}, scope='"a"', changed=["id"]) for s in ("before", "after")]
    assert outcome(spark, T, BY_FILTER, same, '"a"') == (["columns-unchanged"], {"verified"}, [])
    assert outcome(spark, G, READY, [state("after", "insert", {"customer": '"a"'}, equality={"status": '"draft"'})]) == (["filter-excluded"], {"verified"}, [])
    moved = [state("before", "update", {"customer": '"a"'}, equality={"status": '"ready"'}, changed=["status", "customer"]), state("after", "update", {"customer": '"b"'}, equality={"status": '"draft"'}, changed=["status", "customer"])]
    assert outcome(spark, G, READY, moved) == (["filter-excluded", "matched"], {"verified"}, [("inputs", "customer", '"a"')])


def test_canonical_and_resources():
    assert canonical({"b": 1.0, "a": [True, None, "x"]}) == '{"a":[true,null,"x"],"b":1}'
    for bad, code in (([Resource("a", ("x",), identity=())], "EMPTY_IDENTITY"), ([Resource("a", ("x",), cascades=(("a", "x"),))], "CASCADE_CYCLE"), ([Resource("a", ("x",), identity=("y",))], "UNREGISTERED_COLUMN")):
        with pytest.raises(EngineError, match=code):
            validate_resources(bad)


def test_manifest_rules():
    r = validate_resources([G])
    m = compile_manifest({"a": Select("records", ("id",), (any_of(eq("id", Input("x")), eq("customer", Input("y"))),)), "b": Call("a", lambda i: i)}, r)
    assert m.reads["a"][0].bindings == () and m.reads["a"][0].columns == ("customer", "id")
    with pytest.raises(EngineError, match="Query cycle"):
        compile_manifest({"a": Call("b"), "b": Call("a")}, r)
    assert compile_manifest(READY, r, opaque=frozenset({"ready"})).reads["ready"][0].bindings == ()


def test_commands(spark):
    rows = spark.createDataFrame([(1, "ready", "a"), (2, "draft", "b"), (3, None, None)], "id long, status string, customer string")
    e = Engine(spark, {"records": rows}, [G], READY, limits=Limits())
    out = e.command(lambda c: c.update("records", {"customer": "'z'"}, "id = 1")).collect()
    assert sorted(r.value for r in out) == ['"a"', '"z"']
    assert e.query("ready", {"customer": "z"}).count() == 1
    with pytest.raises(RuntimeError):
        e.command(lambda c: (c.truncate("records"), (_ for _ in ()).throw(RuntimeError()))[0])
    assert e.tables["records"].count() == 3
    kept = []
    e.command(kept.append)
    with pytest.raises(EngineError, match="WRITE_CONTEXT_CLOSED"):
        kept[0].truncate("records")
    merged = e.command(lambda c: c.merge("records", spark.createDataFrame([(2, "ready", "b"), (9, "ready", "q")], rows.schema))).collect()
    assert sorted(r.value for r in merged) == ['"b"', '"q"']
    assert e.tables["records"].count() == 4
    with pytest.raises(EngineError, match="Missing query input"):
        e.query("ready")
    with pytest.raises(EngineError, match="PRESERVATION"):
        Engine(spark, {"records": rows}, [G], READY, parse={"ready": lambda i: {"customer": "other"}}).query("ready", {"customer": "z"})


def test_paging_and_nulls(spark):
    rows = spark.createDataFrame([(1, "b", None), (2, None, None), (3, "a", None)], "id long, status string, customer string")
    e = Engine(spark, {"records": rows}, [G], {"q": Select("records", ("id",), order=(Order("status"),)), "bad": Select("records", limit=0)})
    assert [r.id for r in e.query("q").collect()] == [3, 1, 2]
    with pytest.raises(EngineError, match="Invalid query limit"):
        e.query("bad")


def test_sql_text(spark):
    r = validate_resources([Resource("users", ("id", "status", "role_id")), Resource("roles", ("id", "name"))])
    spark.createDataFrame([], "id long, status string, role_id long").createOrReplaceTempView("users")
    spark.createDataFrame([], "id long, name string").createOrReplaceTempView("roles")
    [read] = sql_reads(spark, "select count(*) from users where status = :s", r, {"s": "x"})
    assert read.columns == ("status",) and read.bindings == (("status", "s"),)
    twice = sql_reads(spark, "select a.id from users a cross join users b", r, {})
    assert [r.columns for r in twice] == [("id",), ()]
    for text, code in (("delete from users", "REQUIRES_SELECT"), ("select now() from users", "FRESHNESS"), ("select 1; select 2", "ONE_STATEMENT")):
        with pytest.raises(EngineError, match=code):
            sql_reads(spark, text, r, {})


def test_stream(spark, tmp_path):
    from tidemark.streaming.commands import impact_stream

    rows = spark.createDataFrame([(1, "ready", "a"), (2, "draft", "b")], "id long, status string, customer string")
    rows.write.parquet(str(tmp_path / "in"))
    e = Engine(spark, {"records": rows.limit(0)}, [G], READY)
    feed = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    impact_stream(feed, e, "records", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).filter(F.col("selector") == "inputs").collect()
    assert [r.value for r in got] == ['"a"']
