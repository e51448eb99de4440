"""What SQL text reads, and what is refused."""

import pytest
from pyspark.sql import types as T

from tidemark.model import EngineError, Resource, validate_resources
from tidemark.plans.policy import Policy, unproven, with_policies
from tidemark.plans.manifest import compile_manifest
from tidemark.plans.algebra import Select
from tidemark.plans.sqltext import compile_artifact, sql_reads


@pytest.fixture
def r(spark):
    out = validate_resources([Resource("users", ("id", "status", "role_id")), Resource("roles", ("id", "name"))])
    spark.createDataFrame([], "id long, status string, role_id long").createOrReplaceTempView("users")
    spark.createDataFrame([], "id long, name string").createOrReplaceTempView("roles")
    return out


def reads(spark, r, text, **sample):
    return [(x.resource, x.columns, x.bindings) for x in sql_reads(spark, text, r, sample)]


def test_relations_are_those_that_spark_resolves(spark, r):
    assert reads(spark, r, "WITH users AS (SELECT id AS k FROM roles) SELECT k FROM users") == [("roles", ("id",), ())]
    assert reads(spark, r, "SELECT users.name FROM roles AS users") == [("roles", ("name",), ())]
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW active AS SELECT id FROM users WHERE status = 'on'")
    assert {x[0] for x in reads(spark, r, "SELECT id FROM active")} == {"users"}
    assert [x[0] for x in reads(spark, r, "SELECT 1 AS one FROM users WHERE id IN (SELECT id FROM roles)")] == ["roles", "users"]
    assert reads(spark, r, "SELECT id FROM users UNION SELECT id FROM roles WHERE id = :i", i=1) == [("roles", ("id",), (("id", "i"),)), ("users", ("id",), ())]


@pytest.mark.parametrize(
    "where, bound",
    [
        ("id = :i", True), (":i = id", True), ("id = :i AND status = 'x'", True), ("(id = :i AND status = 'x') OR (id = :i AND status = 'y')", True),
        ("id = :i + 1", False), ("1 + id = :i", False), ("(id = :i) = false", False), ("NOT id = :i", False), ("id = :i OR status = 'x'", False),
        ("coalesce(id = :i, true)", False), ("id <=> :i", False), ("id >= :i", False), ("id = CAST(:i AS DOUBLE)", False), ("status = CAST(:i AS STRING)", False), ("status = :i", False),
    ],
)
def test_bindings_hold_wherever_the_condition_does(spark, r, where, bound):
    [(_, _, got)] = reads(spark, r, f"SELECT id FROM users WHERE {where}", i=1)
    assert got == ((("id", "i"),) if bound else ())


@pytest.mark.parametrize(
    "text, bound",
    [
        ("SELECT k FROM (SELECT id AS k, status FROM users) WHERE k = :i", True),
        ("SELECT id FROM (SELECT id FROM users ORDER BY id LIMIT 3) WHERE id = :i", False),
        ("SELECT n FROM (SELECT id, count(*) OVER () AS n FROM users) WHERE id = :i", False),
        ("SELECT id FROM (SELECT id FROM users UNION ALL SELECT id FROM users) WHERE id = :i", False),
        ("SELECT r.name FROM roles r LEFT JOIN users u ON r.id = u.role_id WHERE u.id = :i", False),
        ("SELECT u.id FROM users u LEFT JOIN roles r ON r.id = u.role_id WHERE u.id = :i", True),
        ("SELECT u.id FROM users u FULL JOIN roles r ON r.id = u.role_id WHERE u.id = :i", False),
    ],
)
def test_conditions_count_only_where_failing_rows_are_without_effect(spark, r, text, bound):
    got = [b for n, _, b in reads(spark, r, text, i=1) if n == "users"]
    assert got[0] == ((("id", "i"),) if bound else ())


def test_a_self_join_keeps_its_occurrences_apart(spark, r):
    assert reads(spark, r, "SELECT a.status FROM users a JOIN users b ON a.id = b.role_id WHERE b.id = :i", i=1) == [("users", ("id", "role_id"), (("id", "i"),)), ("users", ("id", "status"), ())]


def test_parameters_are_those_of_the_statement(spark, r):
    assert reads(spark, r, "SELECT id, ':z' AS q FROM users WHERE status = :s", s="x") == [("users", ("id", "status"), (("status", "s"),))]
    with pytest.raises(EngineError, match="PARAMETER_MISMATCH"):
        sql_reads(spark, "SELECT id FROM users WHERE id = :i", r, {})


@pytest.mark.parametrize(
    "text, code",
    [
        ("SELECT now() FROM users", "FRESHNESS"), ("SELECT random() AS r FROM users", "FRESHNESS"), ("SELECT session_user() FROM users", "FRESHNESS"), ("SELECT id FROM users WHERE id > rand()", "FRESHNESS"),
        ("SELECT * FROM users TABLESAMPLE (5 PERCENT)", "FRESHNESS"), ("SELECT 1; SELECT 2", "ONE_STATEMENT"), ("DELETE FROM users", "REQUIRES_SELECT"), ("SELECT 1 AS one", "NO_TRACKED_RELATION"),
        ("SELECT * FROM nowhere", "UNRESOLVED_QUERY_RELATION"), ("SELECT nothing FROM users", "UNRESOLVED_QUERY_EXPRESSION"), ("SELECT odd(id) FROM users", "UNRESOLVED_QUERY_FUNCTION"), ("SELEC 1", "INVALID_QUERY"),
    ],
)
def test_refused(spark, r, text, code):
    spark.udf.register("odd", lambda x: x, T.LongType())
    with pytest.raises(EngineError, match=code):
        sql_reads(spark, text, r, {})
    assert compile_artifact(spark, {"q": text}, r)["q"]["policy"] == "no-store"


def test_words_in_strings_are_no_functions(spark, r):
    assert reads(spark, r, "SELECT id, 'now() uuid' AS q FROM users") == [("users", ("id",), ())]


def test_policies_add_dependencies(spark, r):
    tables = {"users": spark.createDataFrame([(1, "on", 1)], "id long, status string, role_id long"), "roles": spark.createDataFrame([(1, "x")], "id long, name string")}
    policies = [Policy("users", "role_id IN (SELECT id FROM roles WHERE name = 'x')")]
    m = with_policies(spark, compile_manifest({"q": Select("users", ("id",))}, r), r, tables, policies)
    assert {(x.resource, x.columns) for x in m.reads["q"]} == {("users", ("id", "role_id")), ("roles", ("id", "name"))}
    assert unproven(m, policies) == {"q": ["users"]}
    with pytest.raises(EngineError, match="UNRESOLVED_RLS_DEPENDENCY"):
        with_policies(spark, compile_manifest({"q": Select("users", ("id",))}, r), r, tables, [Policy("users", "id IN (SELECT id FROM nowhere)")])


def test_bodies_of_sql_functions_are_read(spark, r):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION role_of(k BIGINT) RETURNS STRING RETURN (SELECT max(name) FROM roles WHERE id = k)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION doubled(k BIGINT) RETURNS BIGINT RETURN 2 * k")
    assert {n: b for n, _, b in reads(spark, r, "SELECT role_of(role_id) AS x FROM users WHERE id = :i", i=1)} == {"roles": (), "users": (("id", "i"),)}
    assert [b for _, _, b in reads(spark, r, "SELECT id FROM users WHERE id = doubled(:i)", i=1)] == [()]


def test_shapes_that_group_bind_nothing(spark, r):
    assert [b for _, _, b in reads(spark, r, "SELECT id, status, count(*) AS n FROM users GROUP BY CUBE (id, status) HAVING id = :i", i=1)] == [()]
    assert [x[0] for x in reads(spark, r, "SELECT u.id FROM users u, LATERAL (SELECT max(name) AS m FROM roles WHERE id = u.role_id) x")] == ["roles", "users"]
