"""The registered queries of the engine's own operators, each with its SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .engine import Engine
from .functions.scalars import canonical_column, filter_may_equal, may_equal
from .model import Limits, Resource, canonical
from .operators import calculus, capture
from .plans.algebra import Bind, Builder, Call, Choose, Combine, Compare, Count, Input, Join, Literal, Map, Order, Select, Sql, Value, When, all_of, any_of, compare, eq, not_
from .plans.manifest import inspect
from .plans.policy import Policy
from .plans.sqltext import sql_reads
from .sources.catalog import check_table, discover, logical, read_table

Q, SQL = {}, {}
NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

LIST = Select("orders", ("o_orderkey", "o_custkey", "o_orderstatus"), (eq("o_custkey", Input("customer")),), (Order("o_orderkey"),))
DETAIL = Select("orders", None, (eq("o_orderkey", Input("id")),), joins=(Join("items", Select("lineitem"), "o_orderkey", "l_orderkey", many=True),))
TOTAL = Map(Select("lineitem", ("l_quantity", "l_orderkey"), (eq("l_orderkey", Input("id")),)), lambda df: df.agg(F.sum(F.col("l_quantity").cast("long")).alias("total")))
READY = Select("orders", ("o_orderkey",), (eq("o_orderstatus", Literal("O")),), (Order("o_orderkey"),))
ENDPOINTS = {"orders.list": LIST, "orders.detail": DETAIL, "orders.total": TOTAL, "orders.ready": READY}


def tables(spark, sf, names=NAMES):
    return {n: read_table(spark, sf, n) for n in names}


def builder(spark, sf, queries=None, extra=None):
    t = tables(spark, sf) | (extra or {})
    r = discover(spark, sf, NAMES)
    for n, df in (extra or {}).items():
        r[n] = type(r["orders"])(n, tuple(df.columns), n)
    return Builder(spark, t, r, queries)


def engine(spark, sf, queries=None, **options):
    r = discover(spark, sf, ["customer", "orders", "lineitem"], scopes=options.pop("scopes", None), cascades=options.pop("cascades", None))
    return Engine(spark, tables(spark, sf, list(r)), list(r.values()), queries or ENDPOINTS, limits=options.pop("limits", Limits.unbounded()), **options)


def add(name, sql, f):
    Q[name], SQL[name] = f, sql


def plan(name, p, sql, inputs=None, queries=None, after=lambda x: x, extra=None):
    add(name, sql, lambda spark, sf: after(builder(spark, sf, queries, extra(spark, sf) if extra else None).run(p, inputs or {})))


ORD = ("o_orderkey", "o_custkey", "o_orderstatus")
plan("select_all", Select("nation"), "SELECT * FROM nation")
plan("select_project", Select("customer", ("c_custkey", "c_name")), "SELECT c_custkey, c_name FROM customer")
plan("select_eq_input", LIST, "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 7", {"customer": 7})
plan("select_eq_literal", READY, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
plan("filter_compare", Select("lineitem", ("l_orderkey", "l_linenumber", "l_quantity"), (compare("l_quantity", ">=", 20), compare("l_quantity", "<", 30), compare("l_returnflag", "<>", "R"), compare("l_linenumber", "<=", 3))), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 20 AND l_quantity < 30 AND l_returnflag <> 'R' AND l_linenumber <= 3")
plan("filter_in", Select("orders", ORD, (compare("o_orderstatus", "in", ["F", "P"]),)), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
plan("filter_in_empty", Select("orders", ORD, (compare("o_orderstatus", "in", []),)), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE false")
plan("filter_and_or_not", Select("orders", ORD, (any_of(all_of(eq("o_orderstatus", "F"), compare("o_totalprice", "<", 100000)), not_(compare("o_orderpriority", ">", "1-URGENT"))),)), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice < 100000) OR NOT (o_orderpriority > '1-URGENT')")
plan("filter_empty_bool", Select("orders", ORD, (all_of(), not_(any_of()))), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")


def _nullable(spark, sf):
    o = read_table(spark, sf, "orders")
    return {"sparse": o.select("o_orderkey", F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("priority"))}


SPARSE = "(SELECT o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority FROM orders)"
plan("filter_null", Select("sparse", ("o_orderkey",), (Compare("priority", "is-null"),)), f"SELECT o_orderkey FROM {SPARSE} WHERE priority IS NULL", extra=_nullable)
plan("filter_not_null", Select("sparse", None, (Compare("priority", "not-null"),)), f"SELECT o_orderkey, priority FROM {SPARSE} WHERE priority IS NOT NULL", extra=_nullable)
for _n, _asc, _first in (("asc", True, False), ("desc", False, False), ("first", True, True)):
    plan(f"order_nulls_{_n}", Select("sparse", None, (), (Order("priority", _asc, _first), Order("o_orderkey")), limit=50, offset=2900), f"SELECT o_orderkey, priority FROM {SPARSE} ORDER BY priority {'ASC' if _asc else 'DESC'} NULLS {'FIRST' if _first else 'LAST'}, o_orderkey LIMIT 50 OFFSET 2900", extra=_nullable)
plan("limit_offset", Select("orders", ORD, (), (Order("o_orderkey"),), limit=20, offset=5), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 5")
plan("offset_only", Select("customer", ("c_custkey",), (), (Order("c_custkey"),), offset=100), "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100")
plan("page_from_input", Select("orders", ("o_orderkey",), (), (Order("o_orderkey", False),), limit=Input("size"), offset=Input("skip")), "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 9 OFFSET 3", {"size": 9, "skip": 3})
plan("count_where", Count(Select("orders", None, (eq("o_orderstatus", "F"),), (Order("o_orderkey"),), limit=3)), "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'")
plan("count_required_join", Count(Select("customer", joins=(Join("x", Select("orders", where=(eq("o_orderstatus", "P"),)), "c_custkey", "o_custkey", required=True),))), "SELECT count(*) AS count FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
plan("join_one_optional", Select("orders", ("o_orderkey",), joins=(Join("c", Select("customer", ("c_name",), (compare("c_acctbal", ">", 0),)), "o_custkey", "c_custkey"),)), "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0", after=lambda d: d.select("o_orderkey", "c.c_name"))
plan("join_one_first", Select("customer", ("c_custkey",), joins=(Join("o", Select("orders", ("o_orderkey",), (), (Order("o_orderkey", False),)), "c_custkey", "o_custkey"),)), "SELECT c_custkey, max(o_orderkey) AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", after=lambda d: d.select("c_custkey", "o.o_orderkey"))
plan("join_many", Select("customer", ("c_custkey",), joins=(Join("o", Select("orders", ("o_orderkey",), (), (Order("o_orderkey"),)), "c_custkey", "o_custkey", many=True),)), "SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS at FROM customer JOIN orders ON o_custkey = c_custkey", after=lambda d: d.select("c_custkey", F.posexplode("o").alias("at", "x")).select("c_custkey", "x.o_orderkey", F.col("at").cast("long").alias("at")))
plan("join_many_paged", Select("customer", ("c_custkey",), joins=(Join("o", Select("orders", ("o_orderkey",), (), (Order("o_orderkey"),), limit=2, offset=1), "c_custkey", "o_custkey", many=True),)), "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey) WHERE n IN (2, 3)", after=lambda d: d.select("c_custkey", F.explode("o").alias("x")).select("c_custkey", "x.o_orderkey"))
plan("join_required", Select("customer", ("c_custkey",), joins=(Join("o", Select("orders", where=(eq("o_orderstatus", "P"),)), "c_custkey", "o_custkey", required=True),)), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
plan("join_nested", Select("customer", ("c_custkey",), joins=(Join("o", Select("orders", ("o_orderkey",), joins=(Join("l", Select("lineitem", ("l_partkey",)), "o_orderkey", "l_orderkey", many=True),)), "c_custkey", "o_custkey", many=True),)), "SELECT c_custkey, o_orderkey, l_partkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey", after=lambda d: d.select("c_custkey", F.explode("o").alias("o")).select("c_custkey", "o.o_orderkey", F.explode("o.l").alias("l")).select("c_custkey", "o_orderkey", "l.l_partkey"))
plan("map_sum", TOTAL, "SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem WHERE l_orderkey = 9", {"id": 9})
plan("call_identity", Call("orders.list"), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 3", {"customer": 3}, ENDPOINTS)
plan("call_mapped", Call("orders.list", lambda i: {"customer": i["c"] + 1}), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 4", {"c": 3}, ENDPOINTS)
plan("combine_parts", Combine((("a", Count(Select("orders"))), ("b", Count(Select("customer"))))), "SELECT 'a' AS part, count(*) AS count FROM orders UNION ALL SELECT 'b', count(*) FROM customer", after=lambda d: d["a"].select(F.lit("a").alias("part"), "count").unionByName(d["b"].select(F.lit("b").alias("part"), "count")))
for _n, _v in (("yes", True), ("no", False)):
    plan(f"when_{_n}", When(lambda i: i["x"], READY, Select("orders", ("o_orderkey",), (eq("o_orderstatus", "P"),))), f"SELECT o_orderkey FROM orders WHERE o_orderstatus = '{'O' if _v else 'P'}'", {"x": _v})
plan("bind_child", Bind(Select("orders", ("o_custkey",), (eq("o_orderkey", Input("id")),)), Select("customer", ("c_custkey", "c_name"), (eq("c_custkey", Input("c")),)), lambda df, i: {"c": df.first()[0]}), "SELECT c_custkey, c_name FROM customer WHERE c_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 12)", {"id": 12})
plan("choose_branch", Choose((("f", READY), ("c", Select("customer", ("c_custkey",)))), lambda i: i["k"]), "SELECT c_custkey FROM customer", {"k": "c"})
Q["value_const"], SQL["value_const"] = lambda spark, sf: spark.range(1).select(F.lit(builder(spark, sf).run(Value(42), {})).cast("long").alias("value")), "SELECT CAST(42 AS BIGINT) AS value"

for _n, _t in {
    "sql_cross_self": "SELECT a.r_regionkey AS x, b.r_regionkey AS y FROM region a CROSS JOIN region b",
    "sql_left_using": "SELECT o_orderkey, n FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY l_orderkey) x USING (o_orderkey)",
    "sql_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "sql_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "sql_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000",
    "sql_row_number": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS n FROM orders",
    "sql_recursive": "WITH RECURSIVE t(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM t WHERE k < 25) SELECT k, n_name FROM t JOIN nation ON n_nationkey = k",
    "sql_lateral": "SELECT c_custkey, m FROM customer, LATERAL (SELECT max(o_orderkey) AS m FROM orders WHERE o_custkey = c_custkey) x",
    "sql_group_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "sql_cte_shadow": "WITH orders AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0) SELECT k FROM orders",
}.items():
    plan(_n, Sql(_t), _t)


def values(columns, rows):
    show = lambda v: "NULL" if v is None else f"'{v}'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({', '.join(columns)})"


def _reads(spark, sf, f):
    m = engine(spark, sf).manifest
    return spark.createDataFrame([x for n, rs in m.reads.items() for r in rs for x in f(n, r)], "endpoint string, resource string, a string, b string")


DEPS = ("endpoint", "resource", "a", "b")
add("deps_reads", values(DEPS, [("orders.list", "orders", c, None) for c in ORD] + [("orders.detail", "orders", "*", None), ("orders.detail", "lineitem", "*", None), ("orders.total", "lineitem", "l_orderkey", None), ("orders.total", "lineitem", "l_quantity", None), ("orders.ready", "orders", "o_orderkey", None), ("orders.ready", "orders", "o_orderstatus", None)]), lambda spark, sf: _reads(spark, sf, lambda n, r: [(n, r.resource, c, None) for c in (r.columns if r.columns is not None else ("*",))]))
add("deps_bindings", values(DEPS, [("orders.list", "orders", "o_custkey", "customer"), ("orders.detail", "orders", "o_orderkey", "id"), ("orders.detail", "lineitem", "l_orderkey", "id"), ("orders.total", "lineitem", "l_orderkey", "id")]), lambda spark, sf: _reads(spark, sf, lambda n, r: [(n, r.resource, *b) for b in r.bindings]))
add("deps_filters", values(DEPS, [("orders.ready", "orders", "o_orderstatus", '"O"')]), lambda spark, sf: _reads(spark, sf, lambda n, r: [(n, r.resource, *f) for f in r.filters]))
add("deps_sources", values(("endpoint", "resource"), [("orders.detail", "lineitem"), ("orders.detail", "orders"), ("orders.list", "orders"), ("orders.ready", "orders"), ("orders.total", "lineitem")]), lambda spark, sf: spark.createDataFrame([(n, r) for n, rs in engine(spark, sf).manifest.sources.items() for r in rs], "endpoint string, resource string"))
add("deps_dependents", values(("resource", "endpoint"), [("lineitem", "orders.detail"), ("lineitem", "orders.total"), ("orders", "orders.detail"), ("orders", "orders.list"), ("orders", "orders.ready")]), lambda spark, sf: spark.createDataFrame([(r, n) for r, ns in engine(spark, sf).manifest.dependents.items() for n in ns], "resource string, endpoint string"))


def sql_deps(spark, sf, text, sample=None):
    """The reads of a text, long: resource, col (* for all), input; occurrences that read the same are one."""
    b = builder(spark, sf)
    for n, df in b.tables.items():
        df.createOrReplaceTempView(n)
    reads = sql_reads(spark, text, b.resources, sample or {})
    return spark.createDataFrame(sorted({(r.resource, c, next((i for k, i in r.bindings if k == c), None)) for r in reads for c in r.columns or ("*",)}, key=repr), "resource string, col string, input string")


ONE = {"c": 1}
for _n, (_t, _s, _r) in {
    "deps_sql": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey = :c", ONE, [("customer", "c_custkey", None), ("customer", "c_name", None), ("orders", "o_custkey", "c"), ("orders", "o_orderkey", None)]),
    "deps_sql_cte_shadow": ("WITH orders AS (SELECT c_custkey AS k FROM customer) SELECT k FROM orders", None, [("customer", "c_custkey", None)]),
    "deps_sql_alias": ("SELECT orders.c_name FROM customer AS orders", None, [("customer", "c_name", None)]),
    "deps_sql_expression": ("SELECT o_orderkey FROM orders WHERE o_custkey = :c + 1", ONE, [("orders", "o_custkey", None), ("orders", "o_orderkey", None)]),
    "deps_sql_negated": ("SELECT o_orderkey FROM orders WHERE (o_custkey = :c) = false", ONE, [("orders", "o_custkey", None), ("orders", "o_orderkey", None)]),
    "deps_sql_cast": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = CAST(:c AS STRING)", ONE, [("orders", "o_orderkey", None), ("orders", "o_orderstatus", None)]),
    "deps_sql_outer": ("SELECT c_name FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey = :c AND coalesce(o_orderkey = :d, true)", {"c": 1, "d": 2}, [("customer", "c_custkey", "c"), ("customer", "c_name", None), ("orders", "o_custkey", None), ("orders", "o_orderkey", None)]),
    "deps_sql_or": ("SELECT o_orderkey FROM orders WHERE (o_custkey = :c AND o_orderstatus = 'F') OR (o_custkey = :c AND o_orderkey = :d)", {"c": 1, "d": 2}, [("orders", "o_custkey", "c"), ("orders", "o_orderkey", None), ("orders", "o_orderstatus", None)]),
    "deps_sql_literal": ("SELECT o_orderkey, ':z' AS q, 'now()' AS p FROM orders WHERE o_orderstatus = :s", {"s": "x"}, [("orders", "o_orderkey", None), ("orders", "o_orderstatus", "s")]),
    "deps_sql_self": ("SELECT a.o_orderkey FROM orders a JOIN orders b ON a.o_orderkey = b.o_custkey WHERE b.o_custkey = :c", ONE, [("orders", "o_custkey", "c"), ("orders", "o_orderkey", None)]),
    "deps_sql_limit": ("SELECT o_orderkey FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10) WHERE o_custkey = :c", ONE, [("orders", "o_custkey", None), ("orders", "o_orderkey", None)]),
    "deps_sql_exists": ("SELECT c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = :s)", {"s": "x"}, [("customer", "c_custkey", None), ("customer", "c_name", None), ("orders", "o_custkey", None), ("orders", "o_orderstatus", "s")]),
}.items():
    add(_n, values(("resource", "col", "input"), _r), lambda spark, sf, t=_t, s=_s: sql_deps(spark, sf, t, s))

REFUSED = {"now": "SELECT now() FROM orders", "random": "SELECT random() AS r FROM orders", "user": "SELECT session_user() FROM orders", "two": "SELECT 1 FROM orders; SELECT 2", "write": "DELETE FROM orders", "unknown": "SELECT * FROM nowhere", "sample": "SELECT * FROM orders TABLESAMPLE (10 PERCENT)", "constant": "SELECT 1 AS one", "fine": "SELECT o_orderkey FROM orders"}


def _refused(spark, sf):
    from .plans.sqltext import compile_artifact

    b = builder(spark, sf)
    for n, df in b.tables.items():
        df.createOrReplaceTempView(n)
    return spark.createDataFrame([(n, x["policy"], x["diagnostic"]) for n, x in compile_artifact(spark, REFUSED, b.resources).items()], "name string, policy string, code string")


add("deps_sql_refused", values(("name", "policy", "code"), [("now", "no-store", "QUERY_REQUIRES_FRESHNESS_POLICY"), ("random", "no-store", "QUERY_REQUIRES_FRESHNESS_POLICY"), ("user", "no-store", "QUERY_REQUIRES_FRESHNESS_POLICY"), ("two", "no-store", "QUERY_REQUIRES_ONE_STATEMENT"), ("write", "no-store", "QUERY_REQUIRES_SELECT"), ("unknown", "no-store", "UNRESOLVED_QUERY_RELATION"), ("sample", "no-store", "QUERY_REQUIRES_FRESHNESS_POLICY"), ("constant", "no-store", "QUERY_HAS_NO_TRACKED_RELATION"), ("fine", "store", None)]), _refused)

MOVE = ("orders", {"o_custkey": "(o_custkey + 1) % 100"}, "o_orderkey % 50 = 0")
MOVED = "SELECT o_orderkey, o_custkey AS was, (o_custkey + 1) % 100 AS now FROM orders WHERE o_orderkey % 50 = 0"
CHANGED = f"(SELECT * FROM ({MOVED}) WHERE was <> now)"


def command(spark, sf, work, *, coded=False, **options):
    e = engine(spark, sf, options.pop("queries", None), **{k: options.pop(k) for k in ("limits", "scopes", "cascades", "policies") if k in options})
    out = e.command(work, **options)
    return out if coded else out.drop("codes")


def states(spark, sf, work, **options):
    from .engine import Command

    c = Command(engine(spark, sf, **options))
    work(c)
    return c.states().select("fact", "resource", "op", "side", "kind", F.element_at("fields", "o_custkey").alias("customer"), F.array_join("changed", ",").alias("changed"))


def fact_sql(rows):
    return f"SELECT fact, 'orders' AS resource, op, side, 'known' AS kind, CAST(customer AS VARCHAR) AS customer, changed FROM ({rows})"


def _new_orders(spark, sf):
    return read_table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").withColumn("o_orderkey", F.col("o_orderkey") + 1000000000)


add("facts_insert", fact_sql("SELECT 'orders:insert:' || (o_orderkey + 1000000000) AS fact, 'insert' AS op, 'after' AS side, o_custkey AS customer, CAST(NULL AS VARCHAR) AS changed FROM orders WHERE o_orderpriority = '1-URGENT'"), lambda s, d: states(s, d, lambda c: c.insert("orders", _new_orders(s, d))))
add("facts_delete", fact_sql("SELECT 'orders:delete:' || o_orderkey AS fact, 'delete' AS op, 'before' AS side, o_custkey AS customer, CAST(NULL AS VARCHAR) AS changed FROM orders WHERE o_orderpriority = '1-URGENT'"), lambda s, d: states(s, d, lambda c: c.delete("orders", "o_orderpriority = '1-URGENT'")))
add("facts_update", fact_sql(" UNION ALL ".join(f"SELECT 'orders:update:' || o_orderkey AS fact, 'update' AS op, '{side}' AS side, {v} AS customer, 'o_custkey' AS changed FROM {CHANGED}" for side, v in (("before", "was"), ("after", "now")))), lambda s, d: states(s, d, lambda c: c.update(*MOVE)))
add("facts_update_noop", fact_sql("SELECT '' AS fact, '' AS op, '' AS side, 0 AS customer, '' AS changed WHERE false"), lambda s, d: states(s, d, lambda c: c.update("orders", {"o_custkey": "o_custkey"}, "true")))
add("facts_key_change", fact_sql(" UNION ALL ".join(f"SELECT 'orders:update:' || {k} AS fact, 'update' AS op, '{side}' AS side, o_custkey AS customer, CAST(NULL AS VARCHAR) AS changed FROM orders WHERE o_orderstatus = 'P'" for side, k in (("before", "o_orderkey"), ("after", "(o_orderkey + 5000000000)")))), lambda s, d: states(s, d, lambda c: c.update("orders", {"o_orderkey": "o_orderkey + 5000000000"}, "o_orderstatus = 'P'")))
UNKNOWN = values(("fact", "resource", "op", "side", "kind", "customer", "changed"), [("{0}:unknown", "{0}", "unknown", s, "unknown", None, None) for s in ("before", "after")])
add("facts_keyless", UNKNOWN.format("lineitem"), lambda s, d: states(s, d, lambda c: c.update("lineitem", {"l_tax": "0.0"}, "l_returnflag = 'R'")))
add("facts_truncate", UNKNOWN.format("orders"), lambda s, d: states(s, d, lambda c: c.truncate("orders")))
add("facts_cascade", "SELECT 'customer' AS resource, CAST(count(*) AS BIGINT) AS facts FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", lambda s, d: states(s, d, lambda c: c.delete("customer", "c_mktsegment = 'BUILDING'"), cascades={"customer": (("orders", "o_custkey"),)}).groupBy("resource").agg(F.count("*").alias("facts")))


def _summary(spark, sf, where):
    from .engine import Command

    c = Command(engine(spark, sf))
    c.update("orders", {"o_orderstatus": "'X'"}, where)
    return capture.states(capture.summarised(c.facts(), 5)).select("fact", "resource", "op", "side", "kind", F.element_at("fields", "o_custkey").alias("customer"), F.element_at("fields", "o_orderstatus").alias("status"))


add("facts_batch_common", "SELECT 'orders:summary' AS fact, 'orders' AS resource, 'update' AS op, side, 'known' AS kind, CAST(CASE WHEN min(o_custkey) = max(o_custkey) THEN min(o_custkey) END AS VARCHAR) AS customer, CASE WHEN side = 'after' THEN '\"X\"' WHEN min(o_orderstatus) = max(o_orderstatus) THEN '\"' || min(o_orderstatus) || '\"' END AS status FROM orders CROSS JOIN (SELECT unnest(['before', 'after']) AS side) WHERE o_custkey = 7 GROUP BY side", lambda s, d: _summary(s, d, "o_custkey = 7"))
add("writeset_summary", "SELECT 'orders:summary' AS fact, 'orders' AS resource, 'update' AS op, side, 'known' AS kind, CAST(CASE WHEN min(o_custkey) = max(o_custkey) THEN min(o_custkey) END AS VARCHAR) AS customer, CASE WHEN side = 'after' THEN '\"X\"' WHEN min(o_orderstatus) = max(o_orderstatus) THEN '\"' || min(o_orderstatus) || '\"' END AS status FROM orders CROSS JOIN (SELECT unnest(['before', 'after']) AS side) WHERE o_orderstatus = 'F' GROUP BY side", lambda s, d: _summary(s, d, "o_orderstatus = 'F'"))

OUT = "endpoint, status, target, selector, alternative, input, value"


def impact_sql(*parts):
    return " UNION ALL ".join(f"SELECT {OUT} FROM ({p})" for p in parts)


def rows_sql(endpoint, input_, source, status="verified", target="global"):
    return f"SELECT DISTINCT '{endpoint}' AS endpoint, '{status}' AS status, '{target}' AS target, 'inputs' AS selector, '{input_}=' || v AS alternative, '{input_}' AS input, CAST(v AS VARCHAR) AS value FROM ({source})"


def flat_sql(endpoint, selector="none", status="verified", target=None):
    return f"SELECT '{endpoint}' AS endpoint, '{status}' AS status, {'CAST(NULL AS VARCHAR)' if target is None else repr(target)} AS target, '{selector}' AS selector, CAST(NULL AS VARCHAR) AS alternative, CAST(NULL AS VARCHAR) AS input, CAST(NULL AS VARCHAR) AS value"


BOTH = f"SELECT was AS v FROM {CHANGED} UNION SELECT now FROM {CHANGED}"
IDS = f"SELECT o_orderkey AS v FROM {CHANGED}"
MOVE_IMPACT = impact_sql(rows_sql("orders.list", "customer", BOTH), rows_sql("orders.detail", "id", IDS), flat_sql("orders.total"), flat_sql("orders.ready"))
add("impact_move", MOVE_IMPACT, lambda s, d: command(s, d, lambda c: c.update(*MOVE)))
add("impact_insert", impact_sql(rows_sql("orders.list", "customer", "SELECT o_custkey AS v FROM orders WHERE o_orderpriority = '1-URGENT'"), rows_sql("orders.detail", "id", "SELECT o_orderkey + 1000000000 AS v FROM orders WHERE o_orderpriority = '1-URGENT'"), flat_sql("orders.total"), flat_sql("orders.ready", "all", target="global")), lambda s, d: command(s, d, lambda c: c.insert("orders", _new_orders(s, d))))
add("impact_columns", impact_sql(flat_sql("orders.list"), rows_sql("orders.detail", "id", "SELECT o_orderkey AS v FROM orders WHERE o_orderpriority = '2-HIGH'"), flat_sql("orders.total"), flat_sql("orders.ready")), lambda s, d: command(s, d, lambda c: c.update("orders", {"o_totalprice": "o_totalprice + 1"}, "o_orderpriority = '2-HIGH'")))
add("impact_filter", impact_sql(rows_sql("orders.list", "customer", "SELECT o_custkey AS v FROM orders WHERE o_orderstatus = 'F'"), rows_sql("orders.detail", "id", "SELECT o_orderkey AS v FROM orders WHERE o_orderstatus = 'F'"), flat_sql("orders.total"), flat_sql("orders.ready")), lambda s, d: command(s, d, lambda c: c.delete("orders", "o_orderstatus = 'F'")))
add("impact_join", impact_sql(flat_sql("orders.list"), rows_sql("orders.detail", "id", "SELECT l_orderkey AS v FROM lineitem WHERE l_returnflag = 'R'"), rows_sql("orders.total", "id", "SELECT l_orderkey AS v FROM lineitem WHERE l_returnflag = 'R'"), flat_sql("orders.ready")), lambda s, d: command(s, d, lambda c: c.delete("lineitem", "l_returnflag = 'R'")))
add("impact_keyless", impact_sql(flat_sql("orders.list"), flat_sql("orders.detail", "all", "conservative", "global"), flat_sql("orders.total", "all", "conservative", "global"), flat_sql("orders.ready")), lambda s, d: command(s, d, lambda c: c.update("lineitem", {"l_tax": "0.0"}, "l_returnflag = 'R'")))
add("impact_conservative", impact_sql(flat_sql("orders.list", "all", "conservative", "global"), rows_sql("orders.detail", "id", IDS), flat_sql("orders.total"), flat_sql("orders.ready")), lambda s, d: command(s, d, lambda c: c.update(*MOVE), conservative=["orders.list"]))
add("impact_unavailable", impact_sql(flat_sql("orders.list", status="unavailable"), rows_sql("orders.detail", "id", IDS), flat_sql("orders.total"), flat_sql("orders.ready")), lambda s, d: command(s, d, lambda c: c.update(*MOVE), unavailable=["orders.list"]))
BALANCES = {"customers.by_id": Select("customer", None, (eq("c_custkey", Input("id")),)), "customers.by_id_nation": Select("customer", None, (any_of(eq("c_custkey", Input("id"))), eq("c_nationkey", Input("nation"))))}
add("impact_scope", impact_sql(rows_sql("customers.by_id", "id", "SELECT c_custkey AS v FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'", target="caller"), "SELECT 'customers.by_id_nation' AS endpoint, 'verified' AS status, 'caller' AS target, 'inputs' AS selector, 'id=' || c_custkey || '&nation=' || c_nationkey AS alternative, k AS input, CAST(CASE k WHEN 'id' THEN c_custkey ELSE c_nationkey END AS VARCHAR) AS value FROM customer CROSS JOIN (SELECT unnest(['id', 'nation']) AS k) WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'"), lambda s, d: command(s, d, lambda c: c.delete("customer", "c_acctbal > 0"), scope="BUILDING", scopes={"customer": "c_mktsegment"}, queries=BALANCES))
BY_NATION = {"n": Select("customer", ("c_name",), (eq("c_nationkey", Input("nation")), eq("c_custkey", Input("id"))))}
add("impact_selector_limit", "SELECT 'n' AS endpoint, 'conservative' AS status, 'global' AS target, 'inputs' AS selector, 'nation=3' AS alternative, 'nation' AS input, '3' AS value", lambda s, d: command(s, d, lambda c: c.delete("customer", "c_nationkey = 3"), queries=BY_NATION, limits=Limits(selectors=10)))
add("impact_selector_all", "SELECT 'n' AS endpoint, 'conservative' AS status, 'global' AS target, 'all' AS selector, CAST(NULL AS VARCHAR) AS alternative, CAST(NULL AS VARCHAR) AS input, CAST(NULL AS VARCHAR) AS value", lambda s, d: command(s, d, lambda c: c.delete("customer", "c_mktsegment = 'BUILDING'"), queries=BY_NATION, limits=Limits(selectors=10)))
TWICE = {"x": Select("orders", None, (eq("o_custkey", Input("k")), eq("o_orderkey", Input("k"))))}
add("impact_conflict", "SELECT 'x' AS endpoint, 'conservative' AS status, 'global' AS target, 'all' AS selector, CAST(NULL AS VARCHAR) AS alternative, CAST(NULL AS VARCHAR) AS input, CAST(NULL AS VARCHAR) AS value", lambda s, d: command(s, d, lambda c: c.delete("orders", "o_orderstatus = 'P'"), queries=TWICE))
WIDE = {"u": Combine((("a", Select("customer", None, (eq("c_nationkey", Input("nation")),))), ("b", Select("customer", None, (eq("c_nationkey", Input("nation")), eq("c_custkey", Input("id")))))))}
add("impact_subsume", rows_sql("u", "nation", "SELECT c_nationkey AS v FROM customer WHERE c_mktsegment = 'BUILDING'"), lambda s, d: command(s, d, lambda c: c.delete("customer", "c_mktsegment = 'BUILDING'"), queries=WIDE))


def _explain(spark, sf):
    from .engine import Command

    e = engine(spark, sf)
    c = Command(e)
    c.delete("orders", "o_orderpriority = '1-URGENT'")
    return e.explain(c.states()).groupBy("endpoint", "reason").agg(F.count("*").alias("n"))


add("impact_explain", "SELECT endpoint, 'matched' AS reason, count(*) AS n FROM orders CROSS JOIN (SELECT unnest(['orders.list', 'orders.detail']) AS endpoint) WHERE o_orderpriority = '1-URGENT' GROUP BY 1 UNION ALL SELECT 'orders.ready', CASE WHEN o_orderstatus = 'O' THEN 'matched' ELSE 'filter-excluded' END, count(*) FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 2", _explain)


def _inputs(spark, sf):
    c = read_table(spark, sf, "customer")
    return c.select(F.lit("orders.list").alias("endpoint"), F.col("c_custkey").cast("string").alias("name"), F.create_map(F.lit("customer"), F.col("c_custkey").cast("string")).alias("values"))


add("impact_match", f"SELECT 'orders.list' AS endpoint, CAST(c_custkey AS VARCHAR) AS name FROM customer WHERE c_custkey IN ({BOTH})", lambda s, d: calculus.matching(command(s, d, lambda c: c.update(*MOVE)), _inputs(s, d)))


def _soundness(spark, sf):
    """Customers whose list changed, and how many of them the impact missed."""
    e = engine(spark, sf)
    before = e.tables["orders"]
    reach = calculus.matching(e.command(lambda c: c.update(*MOVE)), _inputs(spark, sf))
    rows = lambda t: t.select("o_custkey", "o_orderkey", "o_orderstatus")
    gone, come = rows(before).exceptAll(rows(e.tables["orders"])), rows(e.tables["orders"]).exceptAll(rows(before))
    changed = gone.unionByName(come).select(F.col("o_custkey").cast("string").alias("name")).distinct()
    return changed.join(reach.withColumn("hit", F.lit(1)), "name", "left").agg(F.count("*").alias("changed"), F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("missed"))


add("impact_soundness", f"SELECT count(*) AS changed, CAST(0 AS BIGINT) AS missed FROM ({BOTH})", _soundness)
PAIRS = [(True, 1), (1, "01"), ("1", 1), ("READY", "ready"), ("ready  ", "ready"), (0.1, 0.100000001), (None, None), (None, 1), ("a", "b"), (1, 2), (True, "TRUE"), ("WORK ", "work"), ("1", "01")]
add("scalar_may_equal", values(("a", "b", "may", "filter"), [(canonical(a), canonical(b), *m) for (a, b), m in zip(PAIRS, [("false", "true"), ("true", "true"), ("true", "true"), ("true", "true"), ("true", "true"), ("false", "true"), ("true", "true"), ("false", "false"), ("false", "false"), ("false", "false"), ("true", "true"), ("false", "false"), ("false", "false")], strict=True)]), lambda spark, sf: spark.createDataFrame([(canonical(a), canonical(b)) for a, b in PAIRS], "a string, b string").select("a", "b", may_equal(F.col("a"), F.col("b")).cast("string").alias("may"), filter_may_equal(F.col("a"), F.col("b")).cast("string").alias("filter")))
add("scalar_canonical", "SELECT c_custkey, '\"' || c_name || '\"' AS name, CAST(c_custkey AS VARCHAR) AS key FROM customer", lambda spark, sf: (lambda t: t.select("c_custkey", canonical_column(F.col("c_name"), t.schema["c_name"].dataType).alias("name"), canonical_column(F.col("c_custkey"), t.schema["c_custkey"].dataType).alias("key")))(read_table(spark, sf, "customer")))
add("validate_identity", values(("resource", "codes"), [("customer", ""), ("orders", ""), ("lineitem", "VALIDATION_FAILED"), ("nation", "RESOURCE_DRIFT")]), lambda spark, sf: spark.createDataFrame([(n, ",".join(check_table(read_table(spark, sf, n), r))) for n, r in (discover(spark, sf, ["customer", "orders"]) | {"lineitem": type(discover(spark, sf, ["orders"])["orders"])("lineitem", tuple(read_table(spark, sf, "lineitem").columns), identity=("l_orderkey", "l_linenumber")), "nation": type(discover(spark, sf, ["orders"])["orders"])("nation", ("n_nationkey",))}).items()], "resource string, codes string"))
add("assessment_merge", values(("endpoint", "status", "codes"), [("a", "conservative", "PRECISION_REDUCED"), ("b", "unavailable", "CATALOG_DRIFT,VALIDATION_FAILED"), ("c", "verified", "")]), lambda spark, sf: calculus.merge_assessments(spark.createDataFrame([("a", "verified", []), ("b", "conservative", ["VALIDATION_FAILED"]), ("c", "verified", [])], "endpoint string, status string, codes array<string>"), spark.createDataFrame([("a", "conservative", ["PRECISION_REDUCED"]), ("b", "unavailable", ["CATALOG_DRIFT"])], "endpoint string, status string, codes array<string>")).select("endpoint", "status", F.array_join("codes", ",").alias("codes")))


def _savepoint(spark, sf):
    def work(c):
        try:
            with c.savepoint():
                c.delete("orders", "o_orderstatus = 'F'")
                raise RuntimeError
        except RuntimeError:
            pass
        c.update(*MOVE)

    return command(spark, sf, work)


add("command_savepoint", MOVE_IMPACT, _savepoint)


add("bind_null", "SELECT c_custkey, c_name FROM customer WHERE false", lambda spark, sf: spark.createDataFrame(builder(spark, sf).run(Bind(Select("orders", ("o_custkey",)), Select("customer", ("c_custkey", "c_name")), lambda df, i: None), {}), "c_custkey long, c_name string"))


def facts_of(spark, sf, work, **options):
    from .engine import Command

    c = Command(engine(spark, sf, **options))
    work(c)
    return c.facts()


DEEP = {"customer": (("orders", "o_custkey"),), "orders": (("lineitem", "l_orderkey"),)}
LOST = "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3"
add("facts_cascade_deep", f"SELECT 'customer' AS resource, CAST(count(*) AS BIGINT) AS facts FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'orders', count(*) FROM ({LOST}) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN ({LOST})", lambda s, d: facts_of(s, d, lambda c: c.delete("customer", "c_nationkey = 3"), cascades=DEEP).groupBy("resource").agg(F.count("*").alias("facts")))
add("facts_truncate_children", values(("resource", "op"), [("customer", "unknown"), ("orders", "unknown"), ("lineitem", "unknown")]), lambda s, d: facts_of(s, d, lambda c: c.truncate("customer"), cascades=DEEP).select("resource", "op"))


def _merged(spark, sf):
    rows = read_table(spark, sf, "orders").filter("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("Q"))
    new = rows.withColumn("o_orderkey", F.col("o_orderkey") + 1000000000)
    return states(spark, sf, lambda c: c.merge("orders", rows.unionByName(new)))


add("facts_merge", fact_sql(" UNION ALL ".join([f"SELECT 'orders:update:' || o_orderkey AS fact, 'update' AS op, '{side}' AS side, o_custkey AS customer, 'o_orderstatus' AS changed FROM orders WHERE o_orderstatus = 'P'" for side in ("before", "after")] + ["SELECT 'orders:insert:' || (o_orderkey + 1000000000) AS fact, 'insert' AS op, 'after' AS side, o_custkey AS customer, CAST(NULL AS VARCHAR) AS changed FROM orders WHERE o_orderstatus = 'P'"])), _merged)
add("writeset_pressure", "SELECT 'customer' AS resource, CAST(count(*) AS BIGINT) AS facts FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderstatus = 'P'", lambda s, d: capture.sizes(facts_of(s, d, lambda c: (c.delete("customer", "c_mktsegment = 'BUILDING'"), c.delete("orders", "o_orderstatus = 'P'")))).select("resource", "facts"))


def _overflow(c):
    c.update("orders", {"o_totalprice": "o_totalprice + 1"}, "o_orderstatus = 'P'")
    c.update("customer", {"c_acctbal": "c_acctbal + 1"}, "c_custkey = 7")


# Under the default limits: more than 200 orders become one fact, which keeps their common status alone; the single customer keeps its values.
OVERFLOW = {"orders.price": Select("orders", ("o_totalprice", "o_orderkey"), (eq("o_orderkey", Input("id")),)), "orders.prices": Select("orders", ("o_totalprice",), (eq("o_orderstatus", Input("status")),)), "customers.one": Select("customer", None, (eq("c_custkey", Input("id")),))}
add("writeset_overflow", impact_sql(flat_sql("orders.price", "all", "conservative", "global"), rows_sql("orders.prices", "status", "SELECT '\"P\"' AS v"), rows_sql("customers.one", "id", "SELECT 7 AS v")), lambda s, d: command(s, d, _overflow, queries=OVERFLOW, limits=Limits()).drop("codes"))
# The same under the default limits: more changed orders than 200, whose customers and ids differ, become one fact without a bound value.
add("impact_move_bounded", impact_sql(flat_sql("orders.list", "all", "conservative", "global"), flat_sql("orders.detail", "all", "conservative", "global"), flat_sql("orders.total"), flat_sql("orders.ready")), lambda s, d: command(s, d, lambda c: c.update(*MOVE), limits=Limits()))
WHOLE = {"w": Combine((("a", Select("customer", ("c_name",), (eq("c_nationkey", Input("nation")), eq("c_custkey", Input("id"))))), ("b", Select("orders", ("o_orderkey",), (eq("o_custkey", Input("id")),)))))}
PAIRED = "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'"


def _pair(c):
    c.delete("customer", "c_mktsegment = 'BUILDING'")
    c.delete("orders", "o_orderstatus = 'P'")


add("impact_subsume_pair", impact_sql(rows_sql("w", "id", PAIRED.replace("AS k", "AS v")), f"SELECT 'w' AS endpoint, 'verified' AS status, 'global' AS target, 'inputs' AS selector, 'id=' || c_custkey || '&nation=' || c_nationkey AS alternative, k AS input, CAST(CASE k WHEN 'id' THEN c_custkey ELSE c_nationkey END AS VARCHAR) AS value FROM customer CROSS JOIN (SELECT unnest(['id', 'nation']) AS k) WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN ({PAIRED})"), lambda s, d: command(s, d, _pair, queries=WHOLE))
LOWER = {"lower": Select("orders", ("o_orderkey",), (eq("o_orderstatus", Literal("p")), eq("o_custkey", Input("customer"))))}
add("impact_filter_unproved", rows_sql("lower", "customer", "SELECT o_custkey AS v FROM orders WHERE o_orderstatus = 'P'", "conservative"), lambda s, d: command(s, d, lambda c: c.delete("orders", "true"), queries=LOWER))


def _partial(c):
    """Facts from elsewhere that lack a bound column."""
    c.delete("orders", "o_orderstatus = 'P'")
    bare = lambda side: F.when(F.col(side).isNotNull(), F.col(side).withField("fields", F.map_filter(f"{side}.fields", lambda k, _: k != "o_custkey")))
    facts = c.parts.pop()
    c.add(facts.withColumns({"before": bare("before"), "after": bare("after")}))


BOTH_BOUND = {"b": Select("orders", ("o_totalprice",), (eq("o_custkey", Input("customer")), eq("o_orderkey", Input("id"))))}
add("impact_missing", rows_sql("b", "id", "SELECT o_orderkey AS v FROM orders WHERE o_orderstatus = 'P'", "conservative"), lambda s, d: command(s, d, _partial, queries=BOTH_BOUND))
BUDGET = {"big": Select("orders", None, (eq("o_orderkey", Input("id")),)), "small": Select("customer", None, (eq("c_nationkey", Input("nation")),))}


def _large(c):
    c.delete("orders", "o_orderstatus = 'P'")
    c.delete("customer", "c_nationkey = 3")


add("impact_budget", impact_sql(flat_sql("big", "all", "conservative", "global"), rows_sql("small", "nation", "SELECT 3 AS v")), lambda s, d: command(s, d, _large, queries=BUDGET, limits=Limits(**(Limits.unbounded().__dict__ | {"impact_bytes": 1000}))))
add("impact_codes", values(("endpoint", "status", "codes"), [("orders.list", "conservative", "PRECISION_REDUCED,VALIDATION_FAILED"), ("orders.detail", "unavailable", "CATALOG_DRIFT"), ("orders.total", "verified", ""), ("orders.ready", "verified", "")]), lambda s, d: command(s, d, lambda c: c.update(*MOVE), report=s.createDataFrame([("orders.list", "conservative", ["VALIDATION_FAILED"]), ("orders.detail", "unavailable", ["CATALOG_DRIFT"])], calculus.REPORT), coded=True).select("endpoint", "status", F.when(F.col("endpoint") == "orders.detail", "CATALOG_DRIFT").otherwise(F.col("codes")).alias("codes")).distinct())
add("assessment_apply", impact_sql(flat_sql("orders.list", status="unavailable"), rows_sql("orders.detail", "id", IDS, "conservative"), flat_sql("orders.total"), flat_sql("orders.ready", status="unavailable")), lambda s, d: calculus.apply_assessment(command(s, d, lambda c: c.update(*MOVE), coded=True), s.createDataFrame([("orders.list", "unavailable", ["CATALOG_DRIFT"]), ("orders.detail", "conservative", ["VALIDATION_FAILED"]), ("orders.total", "verified", [])], calculus.REPORT)).drop("codes"))
add("assessment_resource", values(("endpoint", "status", "codes"), [("orders.list", "verified", ""), ("orders.detail", "conservative", "RESOURCE_DRIFT"), ("orders.total", "conservative", "RESOURCE_DRIFT"), ("orders.ready", "verified", "")]), lambda s, d: (lambda e: calculus.assess_resource(calculus.validation_report(s, e.manifest), e.manifest, "lineitem", "conservative", ("RESOURCE_DRIFT",)).withColumn("codes", F.array_join("codes", ",")))(engine(s, d)))
add("assessment_unavailable", values(("endpoint", "status", "codes"), [(e, "unavailable", "CALCULATION_FAILED") for e in ENDPOINTS]), lambda s, d: calculus.unavailable_impact(s, list(ENDPOINTS), "CALCULATION_FAILED").select("endpoint", "status", "codes"))


def _drifted(spark, sf):
    e = engine(spark, sf)
    e.tables["lineitem"] = e.tables["lineitem"].drop("l_tax")
    return e.validate().withColumn("codes", F.array_join("codes", ","))


add("validate_columns", values(("endpoint", "status", "codes"), [("orders.list", "verified", ""), ("orders.detail", "unavailable", "RESOURCE_DRIFT"), ("orders.total", "unavailable", "RESOURCE_DRIFT"), ("orders.ready", "verified", "")]), _drifted)
add("deps_inspect", values(("endpoint", "resource", "kind", "name", "value"), [("orders.ready", "orders", "column", "o_orderkey", None), ("orders.ready", "orders", "column", "o_orderstatus", None), ("orders.ready", "orders", "filter", "o_orderstatus", '"O"')]), lambda s, d: inspect(s, engine(s, d, {"orders.ready": READY}).manifest))
POLICIES = [Policy("orders", "o_orderstatus <> 'P'"), Policy("orders", "o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", permissive=False)]
add("policy_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", lambda s, d: engine(s, d, {"orders.ready": READY}, policies=POLICIES).query("orders.ready"))
add("policy_deps", values(("endpoint", "resource", "name"), [("orders.ready", "orders", c) for c in ("o_custkey", "o_orderkey", "o_orderstatus")] + [("orders.ready", "customer", c) for c in ("c_custkey", "c_mktsegment")]), lambda s, d: inspect(s, engine(s, d, {"orders.ready": READY}, policies=POLICIES).manifest).filter("kind = 'column'").select("endpoint", "resource", "name"))
add("policy_impact", flat_sql("orders.ready", "all", target="global"), lambda s, d: command(s, d, lambda c: c.update("customer", {"c_mktsegment": "'X'"}, "c_nationkey = 3"), queries={"orders.ready": READY}, policies=POLICIES).drop("codes"))


def _refresh(c):
    c.refresh("orders", c.tables["orders"].filter("o_orderstatus = 'F'"))


add("impact_refresh", impact_sql(*[flat_sql(e, "all", "conservative", "global") for e in ("orders.list", "orders.detail", "orders.ready")], flat_sql("orders.total")), lambda s, d: command(s, d, _refresh))
add("impact_copy_in", impact_sql(rows_sql("orders.list", "customer", "SELECT o_custkey AS v FROM orders"), rows_sql("orders.detail", "id", "SELECT o_orderkey AS v FROM orders"), flat_sql("orders.total"), flat_sql("orders.ready", "all", target="global")), lambda s, d: command(s, d, lambda c: c.copy_in("orders", f"{d}/orders.parquet")))
add("impact_migrate", impact_sql(flat_sql("orders.list", "all", "conservative", "global"), flat_sql("orders.ready", "all", "conservative", "global")), lambda s, d: (lambda e: e.migrate(lambda t: t | {"orders": t["orders"].drop("o_orderpriority")}, [replace(r, columns=tuple(c for c in r.columns if c != "o_orderpriority")) for r in e.resources.values()], {"orders.list": LIST, "orders.ready": READY}).drop("codes"))(engine(s, d)))


TOP = Resource("top", ("o_custkey", "n"), refreshed=True)
TOPS = {"top.one": Select("top", ("n",), (eq("o_custkey", Input("customer")),)), "orders.list": LIST}


def _materialised(spark, sf):
    """Counts by customer as a resource of their own, computed anew after a move: all that reads it is affected."""
    r, t = discover(spark, sf, ["orders"]), tables(spark, sf, ["orders"])
    counts = lambda o: o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    e = Engine(spark, t | {"top": counts(t["orders"])}, [*r.values(), TOP], TOPS, limits=Limits.unbounded())
    e.command(lambda c: c.update(*MOVE))
    return e.command(lambda c: c.refresh("top", counts(c.tables["orders"]))).drop("codes")


add("impact_materialised", impact_sql(flat_sql("top.one", "all", "conservative", "global"), flat_sql("orders.list")), _materialised)


def _parts(spark, sf):
    o = read_table(spark, sf, "orders")
    parts = {f"orders_{k}": o.filter(F.col("o_orderstatus") == k) for k in ("F", "O")} | {"orders_P": o.filter("o_orderstatus = 'P'").drop("o_totalprice")}
    return logical(parts, Resource("orders", tuple(o.columns), parts=tuple(parts))).select("o_orderkey", "o_totalprice")


add("partition_union", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice FROM orders", _parts)
WANTED = [("a", "customer", "7"), ("b", "customer", '"7"'), ("c", "customer", '"0x7"'), ("d", "customer", '"07 "'), ("e", "customer", "8"), ("f", "other", "7"), ("g", "customer", "null"), ("h", "customer", '"seven"')]
add("impact_match_scalars", values(("name",), [(n,) for n in ("a", "b", "c", "d", "f")]), lambda s, d: calculus.matching(command(s, d, lambda c: c.delete("orders", "o_custkey = 7"), queries={"orders.list": LIST}), s.createDataFrame([("orders.list", n, {k: v}) for n, k, v in WANTED], "endpoint string, name string, values map<string,string>")).select("name"))


def _stream(spark, sf):
    """Orders replayed as one micro-batch of a change feed: the urgent ones deleted, the next ones moved to customer 1."""
    from .storage import shared_folder
    from .streaming.commands import impact_stream

    place, o = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}", read_table(spark, sf, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "delete").when(F.col("o_orderpriority") == "2-HIGH", "update")
    feed = o.withColumn("operation", kind).filter("operation is not null").withColumn("o_custkey", F.when(F.col("operation") == "update", 1).otherwise(F.col("o_custkey")).cast("long"))
    feed.write.parquet(f"{place}/feed")
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1000).parquet(f"{place}/feed")
    impact_stream(stream, engine(spark, sf, {"orders.list": LIST}), "orders", f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{place}/out").select(*OUT.split(", "))


add("stream_impact", rows_sql("orders.list", "customer", "SELECT o_custkey AS v FROM orders WHERE o_orderpriority = '1-URGENT' OR (o_orderpriority = '2-HIGH' AND o_custkey <> 1) UNION SELECT 1 FROM orders WHERE o_orderpriority = '2-HIGH' AND o_custkey <> 1"), _stream)
SQL_LIST = "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey = :customer"
SQL_NATION = "WITH orders AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) SELECT k, n FROM orders WHERE k = :nation"


def _sql_soundness(spark, sf):
    """SQL endpoints before and after two changes: inputs whose result changed, and how many of them the impact missed."""
    samples = {SQL_LIST: {"customer": 1}, SQL_NATION: {"nation": 1}}
    r = discover(spark, sf, ["customer", "orders", "lineitem"])
    for n in r:
        read_table(spark, sf, n).createOrReplaceTempView(n)
    e = engine(spark, sf, {"list": Sql(SQL_LIST), "nation": Sql(SQL_NATION)}, sql_reads=lambda text: sql_reads(spark, text, r, samples[text]))

    def results():
        o, c = e.tables["orders"], e.tables["customer"]
        rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.lit("list").alias("endpoint"), F.col("o_custkey").cast("string").alias("name"), F.concat_ws("|", "o_orderkey", "c_name").alias("r"))
        return rows.unionByName(c.groupBy("c_nationkey").count().select(F.lit("nation").alias("endpoint"), F.col("c_nationkey").cast("string").alias("name"), F.col("count").cast("string").alias("r")))

    names = [("list", "customer", "c_custkey"), ("nation", "nation", "c_nationkey")]
    inputs = reduce(lambda a, b: a.unionByName(b), [read_table(spark, sf, "customer").select(F.lit(n).alias("endpoint"), F.col(c).cast("string").alias("name"), F.create_map(F.lit(i), F.col(c).cast("string")).alias("values")) for n, i, c in names])
    before = results()
    work = lambda c: (c.update(*MOVE), c.update("customer", {"c_name": "concat(c_name, '!')", "c_nationkey": "c_nationkey + 1"}, "c_nationkey = 3"))
    reach = calculus.matching(e.command(work), inputs).withColumn("hit", F.lit(1))
    after = results()
    changed = before.exceptAll(after).unionByName(after.exceptAll(before)).select("endpoint", "name").distinct()
    found = changed.join(inputs.select("endpoint", "name").distinct(), ["endpoint", "name"]).join(reach, ["endpoint", "name"], "left")
    return found.groupBy("endpoint").agg(F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("missed"))


add("sql_soundness", "SELECT 'list' AS endpoint, CAST(0 AS BIGINT) AS missed UNION ALL SELECT 'nation', 0", _sql_soundness)
NUMBERS = [0.5, 0.00001, 1e-7, 1.5e21, 123456789.25, 1e20, -0.25, 12345678901234567890.0, 0.1, 100.0]
add("scalar_numbers", values(("t",), [(canonical(x),) for x in NUMBERS]), lambda spark, sf: spark.createDataFrame([(x,) for x in NUMBERS], "x double").select(canonical_column(F.col("x"), T.DoubleType()).alias("t")))


def queries():
    return dict(Q)


def oracle_sql():
    return dict(SQL)
