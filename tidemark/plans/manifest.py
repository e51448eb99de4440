"""Dependencies of plans: which columns of which resources, under which equalities, an endpoint reads."""

from __future__ import annotations

from ..model import EngineError, Limits, Manifest, Read, Resource, byte_length, canonical
from . import algebra as q


def _fields(p) -> set[str]:
    return set().union(*map(_fields, p.parts)) if isinstance(p, q.Logic) and p.parts else set() if isinstance(p, q.Logic) else {p.field}


def _sure(p, kind) -> set[tuple[str, str]]:
    """Equalities that hold in every row that the predicate lets through."""
    if isinstance(p, q.Logic):
        parts = [_sure(x, kind) for x in p.parts]
        if p.op == "and":
            return set().union(*parts) if parts else set()
        return set.intersection(*parts) if p.op == "or" and parts else set()
    if p.op != "=" or not isinstance(p.value, kind):
        return set()
    return {(p.field, p.value.name if kind is q.Input else canonical(p.value.value))}


def select_reads(s: q.Select, resources: dict[str, Resource], inherited: tuple = (), foreign: str | None = None, counted: bool = False) -> list[Read]:
    """inherited: bindings that a parent's join hands down on `foreign`."""
    if s.resource not in resources:
        raise EngineError("UNREGISTERED_RESOURCE")
    joins = [j for j in s.joins if j.required or not counted]
    bindings = {b for p in s.where for b in _sure(p, q.Input)} | {(foreign, i) for i in inherited}
    filters = sorted({f for p in s.where for f in _sure(p, q.Literal)})[: Limits().read_filters]
    used = {f for p in s.where for f in _fields(p)} | {j.local for j in joins} | ({foreign} if foreign else set())
    used |= set() if counted else {o.field for o in s.order}
    if s.columns is None and not counted:
        columns = None
    else:
        columns = tuple(sorted(used | set(() if counted else s.columns or ())))
    if columns and not set(columns) <= set(resources[s.resource].columns):
        raise EngineError("UNREGISTERED_COLUMN")
    out = [Read(s.resource, columns, tuple(sorted(bindings)), tuple(filters))]
    for j in joins:
        out += select_reads(j.child, resources, tuple(i for c, i in bindings if c == j.local), j.foreign)
    return out


def _loose(reads: list[Read]) -> list[Read]:
    return [Read(r.resource, r.columns, (), r.filters) for r in reads]


def plan_reads(plan, queries: dict, resources: dict[str, Resource], sql_reads=None, trail: tuple[str, ...] = ()) -> list[Read]:
    again = lambda p: plan_reads(p, queries, resources, sql_reads, trail)
    if isinstance(plan, q.Select):
        return select_reads(plan, resources)
    if isinstance(plan, q.Count):
        return select_reads(plan.select, resources, counted=True)
    if isinstance(plan, q.Value):
        return []
    if isinstance(plan, q.Call):
        if plan.endpoint in trail:
            raise EngineError("Query cycle")
        if plan.endpoint not in queries:
            raise EngineError("Query missing")
        reads = plan_reads(queries[plan.endpoint], queries, resources, sql_reads, (*trail, plan.endpoint))
        return _loose(reads) if plan.inputs else reads
    if isinstance(plan, q.Combine):
        return [r for _, p in plan.parts for r in again(p)]
    if isinstance(plan, q.When):
        return again(plan.yes) + again(plan.no)
    if isinstance(plan, q.Bind):
        return again(plan.parent) + _loose(again(plan.child))
    if isinstance(plan, q.Map):
        return again(plan.source)
    if isinstance(plan, q.Choose):
        return [r for _, p in plan.choices for r in again(p)]
    if isinstance(plan, q.Sql):
        return [] if plan.no_store else sql_reads(plan.text)
    raise EngineError("QUERY_PLAN_REQUIRED")


def compile_manifest(queries: dict, resources: dict[str, Resource], *, opaque: frozenset[str] = frozenset(), sql_reads=None, limits: Limits = Limits()) -> Manifest:
    """Reads, sources and dependents of every endpoint. Endpoints in `opaque` keep no bindings."""
    if len(queries) > limits.endpoints:
        raise EngineError("MANIFEST_LIMIT")
    reads = {}
    for name, plan in queries.items():
        found = plan_reads(plan, queries, resources, sql_reads, (name,))
        reads[name] = tuple(dict.fromkeys(_loose(found) if name in opaque else found))
    sources = {n: tuple(sorted({r.resource for r in rs})) for n, rs in reads.items()}
    dependents = {r: tuple(sorted(n for n, s in sources.items() if r in s)) for r in sorted({x for s in sources.values() for x in s})}
    return Manifest(reads, sources, dependents)


def needs_no_store(plan, queries: dict, trail: tuple[str, ...] = ()) -> bool:
    """Whether a plan, or any that it is made of, may only be run without storing its result."""
    again = lambda p: needs_no_store(p, queries, trail)
    if isinstance(plan, q.Sql):
        return plan.no_store
    if isinstance(plan, q.Call):
        return plan.endpoint not in trail and plan.endpoint in queries and needs_no_store(queries[plan.endpoint], queries, (*trail, plan.endpoint))
    if isinstance(plan, q.Combine):
        return any(again(p) for _, p in plan.parts)
    if isinstance(plan, q.When):
        return again(plan.yes) or again(plan.no)
    if isinstance(plan, q.Bind):
        return again(plan.parent) or again(plan.child)
    if isinstance(plan, q.Map):
        return again(plan.source)
    if isinstance(plan, q.Choose):
        return any(again(p) for _, p in plan.choices)
    return False


def validate_manifest(manifest: Manifest, resources: dict[str, Resource], limits: Limits = Limits()) -> Manifest:
    """The manifest, or an error: names, columns, bindings and filters must be those registered, and all of it within the limits."""
    plain = {n: [{"resource": r.resource, "columns": list(r.columns) if r.columns is not None else "*", "bindings": [{"column": c, "input": i} for c, i in r.bindings], "filters": [{"column": c, "value": v} for c, v in r.filters]} for r in rs] for n, rs in manifest.reads.items()}
    if len(manifest.reads) > limits.endpoints or byte_length({"reads": plain}) > limits.manifest_bytes:
        raise EngineError("MANIFEST_LIMIT")
    for name, reads in manifest.reads.items():
        if not name or len(name) > 128:
            raise EngineError("INVALID_ENDPOINT")
        for r in reads:
            if r.resource not in resources:
                raise EngineError("UNREGISTERED_RESOURCE")
            if len(r.filters) > limits.read_filters or any(not isinstance(v, str) for _, v in r.filters):
                raise EngineError("INVALID_READ_FILTER")
            if not {*(r.columns or ()), *(c for c, _ in r.bindings), *(c for c, _ in r.filters)} <= set(resources[r.resource].columns):
                raise EngineError("UNREGISTERED_COLUMN")
            if any(not i or len(i) > 128 for _, i in r.bindings):
                raise EngineError("INVALID_BINDING")
    return manifest


def inspect(spark, manifest: Manifest):
    """The graph of endpoints and resources as rows: endpoint, resource, kind (column, binding, filter), name, value."""
    rows = []
    for endpoint, reads in manifest.reads.items():
        for r in reads:
            rows += [(endpoint, r.resource, "column", c, None) for c in (("*",) if r.columns is None else r.columns)]
            rows += [(endpoint, r.resource, "binding", c, i) for c, i in r.bindings] + [(endpoint, r.resource, "filter", c, v) for c, v in r.filters]
    return spark.createDataFrame(rows, "endpoint string, resource string, kind string, name string, value string")
