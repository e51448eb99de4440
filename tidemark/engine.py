"""The engine: registered queries over versions of tables, and commands that return their impact."""

from __future__ import annotations

import hashlib
import threading
from contextlib import contextmanager
from functools import reduce, wraps
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import EngineError, Limits, Resource, canonical, foreign, validate_resources
from .operators import calculus, capture
from .plans.algebra import Builder, plain
from .plans.inputs import parsed, parser
from .plans.manifest import compile_manifest, needs_no_store, validate_manifest
from .plans.policy import Policy, filtered, with_policies
from .sources.catalog import check_table, schema_fingerprint
from .storage import kept

PROTOCOL = 1


class CommitUnknown(EngineError):
    """It is not known whether a command's tables were written."""


def operation(f):
    """An operation of an open command; one that fails keeps the command from committing, even if its error is caught."""

    @wraps(f)
    def call(self, *args, **kwargs):
        if not self.open:
            raise EngineError("WRITE_CONTEXT_CLOSED")
        if self.owner != threading.get_ident():
            raise EngineError("OVERLAPPING_SAVEPOINT")
        try:
            return f(self, *args, **kwargs)
        except Exception:
            self.failed = True
            raise

    return call


class Command:
    """Writes of one command over copies of the tables; closed when the command ends."""

    def __init__(self, engine: Engine):
        self.engine, self.tables, self.parts, self.open, self.failed = engine, dict(engine.tables), [], True, False
        self.owner, self.inside = threading.get_ident(), 0

    def _resource(self, name: str) -> Resource:
        if name not in self.engine.resources:
            raise EngineError("UNREGISTERED_RESOURCE")
        return self.engine.resources[name]

    def _writable(self, name: str) -> Resource:
        """A resource that commands may write; materialised results are only refreshed."""
        r = self._resource(name)
        if r.refreshed:
            raise EngineError("MATERIALIZED_RESOURCE")
        return r

    def _observed(self, r: Resource) -> list[str]:
        return capture.observed(r, self.engine.manifest)

    @staticmethod
    def _same(a: str, b: str, pairs) -> F.Column:
        return reduce(lambda x, y: x & y, [F.col(f"{a}{x}").eqNullSafe(F.col(f"{b}{y}")) for x, y in pairs])

    @operation
    def add(self, facts: DataFrame) -> None:
        """Facts observed elsewhere; checked before they count."""
        self.parts.append(capture.checked(facts, self.engine.resources))

    @operation
    def insert(self, name: str, rows: DataFrame) -> None:
        r = self._writable(name)
        rows = rows.select(*r.columns)
        self.parts.append(capture.inserted(rows, r, self._observed(r)))
        self.tables[name] = self.tables[name].unionByName(rows)

    @operation
    def copy_in(self, name: str, path: str, fmt: str = "parquet", **options) -> None:
        """Rows of files, read with the table's own types and put in."""
        self.insert(name, self.engine.spark.read.format(fmt).options(**options).schema(self.tables[name].schema).load(path))

    def _gone(self, name: str, old: DataFrame, kind: str) -> None:
        """Rows of `old` have left the resource: those of its children, and theirs, go too."""
        for cascade in self._resource(name).cascades:
            child = self._resource(cascade[0])
            pairs = list(zip(foreign(cascade), self._resource(name).identity, strict=True))
            keys = old.select(*[F.col(k).alias(f"__gone_{k}") for _, k in pairs]).distinct()
            on = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"__gone_{k}") for c, k in pairs])
            table = self.tables[child.id]
            lost = table.join(keys, on, "left_semi")
            self.parts.append(capture.deleted(lost, child, self._observed(child)) if kind == "rows" else capture.all_unknown(self.engine.spark, child))
            self.tables[child.id] = table.join(keys, on, "left_anti")
            self._gone(child.id, lost, kind)

    @operation
    def delete(self, name: str, where) -> None:
        r = self._writable(name)
        hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        old = self.tables[name].filter(hit)
        self.parts.append(capture.deleted(old, r, self._observed(r)))
        self.tables[name] = self.tables[name].filter(~hit)
        self._gone(name, old, "rows")

    @operation
    def delete_keys(self, name: str, keys: DataFrame) -> None:
        """Delete the rows whose identities are in `keys`."""
        r = self._writable(name)
        if not r.identity:
            raise EngineError("EMPTY_IDENTITY")
        k = keys.select(*[F.col(c).alias(f"__k_{c}") for c in r.identity]).distinct()
        on = self._same("", "__k_", [(c, c) for c in r.identity])
        old = self.tables[name].join(k, on, "left_semi")
        self.parts.append(capture.deleted(old, r, self._observed(r)))
        self.tables[name] = self.tables[name].join(k, on, "left_anti")
        self._gone(name, old, "rows")

    @operation
    def update(self, name: str, values: dict[str, str], where: str) -> None:
        """Only the touched rows are compared, not the table; in one pass, unless the identity may change."""
        r = self._writable(name)
        if not set(values) <= set(r.columns):
            raise EngineError("UNREGISTERED_COLUMN")
        hit = F.coalesce(F.expr(where), F.lit(False))
        table = self.tables[name]
        new = {c: F.expr(v).cast(table.schema[c].dataType) for c, v in values.items()}
        if r.identity and not set(r.identity) & set(values):
            self.parts.append(capture.updated_in_place(table.filter(hit), new, r, self._observed(r)))
        else:
            moved = table.filter(hit).select(*[new.get(c, F.col(c)).alias(c) for c in r.columns])
            self.parts.append(capture.updated(table.filter(hit), moved, r, self._observed(r)))
        self.tables[name] = table.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in r.columns])

    @operation
    def merge(self, name: str, rows: DataFrame) -> None:
        """Rows replace those of the same identity, nulls included; others are put in. An identity may occur once."""
        r = self._writable(name)
        if not r.identity:
            raise EngineError("EMPTY_IDENTITY")
        rows, table = rows.select(*r.columns), self.tables[name]
        if rows.groupBy(*r.identity).count().filter("count > 1").limit(1).count():
            raise EngineError("DUPLICATE_IDENTITY")
        self.parts.append(capture.merged(table, rows, r, self._observed(r)))
        k = rows.select(*[F.col(c).alias(f"__k_{c}") for c in r.identity])
        self.tables[name] = table.join(k, self._same("", "__k_", [(c, c) for c in r.identity]), "left_anti").select(*r.columns).unionByName(rows)

    @operation
    def truncate(self, name: str) -> None:
        """The table is emptied, and its children lose the rows that refer to it."""
        r = self._writable(name)
        old = self.tables[name]
        self.parts.append(capture.all_unknown(self.engine.spark, r))
        self.tables[name] = old.limit(0)
        self._gone(name, old, "unknown")

    @operation
    def refresh(self, name: str, rows: DataFrame | None = None) -> None:
        """A materialised result computed anew: everything that reads it may have changed. Without rows it is emptied."""
        r = self._resource(name)
        self.parts.append(capture.all_unknown(self.engine.spark, r))
        self.tables[name] = rows.select(*r.columns) if rows is not None else self.tables[name].limit(0)

    @contextmanager
    def savepoint(self):
        """Undone, with all that failed in it, if it ends in an error."""
        if not self.open:
            raise EngineError("WRITE_CONTEXT_CLOSED")
        tables, parts, failed = dict(self.tables), list(self.parts), self.failed
        self.inside += 1
        depth = self.inside
        try:
            yield self
            if self.inside != depth:
                raise EngineError("OVERLAPPING_SAVEPOINT")
        except Exception:
            self.tables, self.parts, self.failed = tables, parts, failed
            raise
        finally:
            self.inside -= 1

    def facts(self) -> DataFrame:
        if not self.parts:
            return self.engine.spark.createDataFrame([], capture.FACTS)
        return reduce(DataFrame.unionByName, self.parts)

    def states(self) -> DataFrame:
        return capture.states(self.facts())


class Engine:
    """Resources are tables by id; queries are plans by endpoint.

    policies: row policies of the role that reads. certified: resources whose equality is proven (all, if
    None). write_every: after so many commands that touched it, a table's version is written, so that plans
    do not grow with the number of commands.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], resources: list[Resource], queries: dict[str, Any], *, opaque: frozenset[str] = frozenset(), sql_reads=None, limits: Limits = Limits(), parse: dict[str, Any] | None = None, policies: list[Policy] | None = None, certified: list[str] | None = None, write_every: int = 8):
        self.spark, self.tables, self.limits, self.write_every = spark, dict(tables), limits, write_every
        self.opaque, self.sql_reads, self.policies, self.certified = opaque, sql_reads, list(policies or []), certified
        self.touched: dict[str, int] = {}
        self.lock = threading.RLock()
        self.running = False
        self._register(resources, queries, parse)

    def _register(self, resources: list[Resource], queries: dict[str, Any], parse: dict[str, Any] | None) -> None:
        if not isinstance(queries, dict):
            raise EngineError("QUERY_DEFINITIONS_REQUIRED")
        self.resources, self.queries = validate_resources(resources, self.limits), dict(queries)
        self.parse = {e: parser(x) for e, x in (parse or {}).items()}
        for p in self.queries.values():
            plain(p)
        manifest = compile_manifest(self.queries, self.resources, opaque=self.opaque, sql_reads=self.sql_reads, limits=self.limits)
        self.manifest = validate_manifest(with_policies(self.spark, manifest, self.resources, self.tables, self.policies), self.resources, self.limits)
        calculus.check_budget(list(self.queries), self.limits)
        self.reads = calculus.reads_table(self.spark, self.manifest, self.resources)

    def snapshot(self) -> dict[str, DataFrame]:
        """The tables' present versions; later commands do not change them."""
        with self.lock:
            return dict(self.tables)

    def _bound(self, endpoint: str) -> set[str]:
        return {i for r in self.manifest.reads[endpoint] for _, i in r.bindings}

    def _run(self, endpoint: str, inputs: dict | None):
        """Inputs that bind must pass parsing unchanged, the endpoint's own and that of those it calls."""
        bound = {e: self._bound(e) for e in self.queries}
        fields = None if endpoint in self.opaque else frozenset(bound[endpoint])
        given = parsed(self.parse.get(endpoint), dict(inputs or {}), fields)
        tables = {n: filtered(df, n, self.policies) for n, df in self.snapshot().items()}
        return Builder(self.spark, tables, self.resources, self.queries, parse=self.parse, bound=bound, opaque=self.opaque).run(self.queries[endpoint], given, fields)

    def query(self, endpoint: str, inputs: dict | None = None):
        """The plan's DataFrame over the tables' present versions. Bound inputs must pass parsing unchanged."""
        if endpoint not in self.queries:
            raise EngineError("UNKNOWN_QUERY")
        if needs_no_store(self.queries[endpoint], self.queries):
            raise EngineError("QUERY_REQUIRES_NO_STORE_EXECUTION")
        return self._run(endpoint, inputs)

    def query_uncached(self, endpoint: str, inputs: dict | None = None) -> dict:
        """As query, for any endpoint; the result must not be stored."""
        if endpoint not in self.queries:
            raise EngineError("UNKNOWN_QUERY")
        return {"data": self._run(endpoint, inputs), "cachePolicy": "no-store"}

    def copy_out(self, endpoint: str, path: str, inputs: dict | None = None, *, fmt: str = "parquet", mode: str = "error") -> None:
        from .sources.catalog import write_table

        write_table(self.query_uncached(endpoint, inputs)["data"], path, mode, fmt)

    def facts(self, command: Command) -> DataFrame:
        """A command's facts within the limits, written once."""
        facts = command.facts()
        if self.certified is not None:
            facts = capture.uncertified(facts, self.certified)
        facts = kept(facts, "facts")
        if self.limits.facts < 1 << 60:
            pressure = {r["resource"]: (r["facts"], r["bytes"]) for r in capture.sizes(facts).collect()}
            if many := capture.over(pressure, self.limits):
                facts = kept(capture.summarised(facts, many, self.limits), "summaries")
        return facts

    def command(self, work, *, scope=None, conservative: list[str] | None = None, unavailable: list[str] | None = None, report: DataFrame | None = None) -> DataFrame:
        """Run `work(command)`; on success its versions become the engine's and the impact is returned, else nothing changes.

        report: assessments of endpoints (see calculus); conservative and unavailable name such endpoints
        directly. Facts are observed before the versions count, so a failure there changes nothing; if the
        impact cannot be calculated afterwards, the versions stand and every endpoint is unavailable.
        """
        if scope is not None and not isinstance(scope, (str, int, float, bool)):
            raise EngineError("INVALID_SCOPE")
        with self.lock:
            if self.running:
                raise EngineError("OVERLAPPING_SAVEPOINT")
            self.running = True
            c = Command(self)
            try:
                work(c)
                if c.failed:
                    raise EngineError("COMMAND_OPERATION_FAILED")
                facts = self.facts(c)
                written = self._versions(c)
            finally:
                c.open = self.running = False
            self.tables = written
            try:
                codes, loose, gone = {}, list(conservative or []), list(unavailable or [])
                for row in report.collect() if report is not None else ():
                    codes[row["endpoint"]] = row["codes"]
                    (gone if row["status"] == "unavailable" else loose if row["status"] == "conservative" else []).append(row["endpoint"])
                found = calculus.decisions(capture.states(facts), self.reads, scope=None if scope is None else canonical(scope), conservative=loose)
                return calculus.impact(found, list(self.queries), limits=self.limits, unavailable=gone, codes=codes)
            except Exception:  # the write stands: no endpoint may be taken for unaffected
                return calculus.unavailable_impact(self.spark, list(self.queries), "CALCULATION_FAILED")

    def _versions(self, c: Command) -> dict[str, DataFrame]:
        out, counts = dict(c.tables), dict(self.touched)
        for name, df in c.tables.items():
            if df is not self.tables.get(name):
                counts[name] = counts.get(name, 0) + 1
                if counts[name] >= self.write_every:
                    try:
                        out[name] = kept(df, f"version-{name}")
                    except Exception as e:
                        raise CommitUnknown(f"COMMIT_STATE_UNKNOWN:{name}") from e
                    counts[name] = 0
        self.touched = counts
        return out

    def explain(self, states: DataFrame, *, scope=None, conservative: list[str] | None = None) -> DataFrame:
        return calculus.decisions(states, self.reads, scope=None if scope is None else canonical(scope), conservative=conservative)

    def validate(self) -> DataFrame:
        """endpoint, status and codes: what the tables' own state says about every endpoint."""
        report = calculus.validation_report(self.spark, self.manifest)
        for name, r in self.resources.items():
            if found := check_table(self.tables[name], r):
                report = calculus.assess_resource(report, self.manifest, name, "unavailable" if "RESOURCE_DRIFT" in found else "conservative", tuple(found))
        return report

    def fingerprint(self) -> str:
        """A digest of what the engine was registered with; equal registrations have equal ones."""
        what = {"protocol": PROTOCOL, "resources": {n: [list(r.columns), list(r.identity or ()), r.scope, r.table] for n, r in self.resources.items()}, "reads": {n: sorted(canonical([r.resource, list(r.columns) if r.columns is not None else "*", [list(b) for b in r.bindings], [list(f) for f in r.filters]]) for r in rs) for n, rs in self.manifest.reads.items()}}
        return hashlib.sha256(canonical(what).encode()).hexdigest()

    def stored_validation(self, path: str, attempts: int = 3) -> DataFrame:
        """The report stored at `path` if it was made for this registration and these tables' columns; else a new one, stored.

        If the tables' columns change while it is made, it is made again, `attempts` times at most.
        """
        for _ in range(attempts):
            stamp = self.fingerprint() + ":" + schema_fingerprint(self.tables)
            try:
                old = self.spark.read.schema("stamp string, endpoint string, status string, codes array<string>").parquet(path).filter(F.col("stamp") == stamp)
                if old.limit(1).count():
                    return old.drop("stamp")
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
            report = self.validate()
            if stamp == self.fingerprint() + ":" + schema_fingerprint(self.tables):
                report.select(F.lit(stamp).alias("stamp"), "endpoint", "status", "codes").coalesce(1).write.mode("overwrite").parquet(path)
                return report
        raise EngineError("CATALOG_DRIFT")

    def migrate(self, change, resources: list[Resource], queries: dict[str, Any], parse: dict[str, Any] | None = None) -> DataFrame:
        """Tables changed by `change(tables) -> tables` with a new registration; all inputs of every endpoint are affected. All or nothing."""
        with self.lock:
            before = (self.tables, self.resources, self.queries, self.parse, self.manifest, self.reads)
            try:
                self.tables = dict(change(dict(self.tables)))
                self._register(resources, queries, parse)
                for name, r in self.resources.items():
                    if name not in self.tables or set(self.tables[name].columns) != set(r.columns):
                        raise EngineError("RESOURCE_DRIFT")
            except Exception:
                self.tables, self.resources, self.queries, self.parse, self.manifest, self.reads = before
                raise
            return calculus.all_impact(self.spark, self.manifest, self.resources, "CATALOG_DRIFT")
