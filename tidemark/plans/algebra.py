"""The query algebra: plans as frozen dataclasses, built into DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, is_dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import EngineError, Resource
from .inputs import parsed


@dataclass(frozen=True)
class Input:
    name: str


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: Input | Literal | None = None


@dataclass(frozen=True)
class Logic:
    op: str  # and, or, not
    parts: tuple


@dataclass(frozen=True)
class Order:
    field: str
    ascending: bool = True
    nulls_first: bool = False


@dataclass(frozen=True)
class Select:
    resource: str
    columns: tuple[str, ...] | None = None
    where: tuple = ()
    order: tuple[Order, ...] = ()
    limit: int | Input | None = None
    offset: int | Input | None = None
    joins: tuple = ()


@dataclass(frozen=True)
class Join:
    name: str
    child: Select
    local: str
    foreign: str
    many: bool = False
    required: bool = False


@dataclass(frozen=True)
class Count:
    select: Select


@dataclass(frozen=True)
class Value:
    value: Any


@dataclass(frozen=True)
class Call:
    endpoint: str
    inputs: Callable | None = None


@dataclass(frozen=True)
class Combine:
    parts: tuple  # of (name, plan)


@dataclass(frozen=True)
class When:
    test: Callable
    yes: Any
    no: Any


@dataclass(frozen=True)
class Bind:
    parent: Any
    child: Any
    inputs: Callable


@dataclass(frozen=True)
class Map:
    source: Any
    project: Callable


@dataclass(frozen=True)
class Choose:
    choices: tuple  # of (name, plan)
    pick: Callable


@dataclass(frozen=True)
class Sql:
    """SQL text with :name parameters; reads are derived from it (see sqltext) unless no_store."""

    text: str
    no_store: bool = False


#: Fields that may hold a function.
FUNCTIONS = {"inputs", "test", "project", "pick"}


def plain(value, field: str = "") -> None:
    """Raise unless a plan is made of plans, tuples, lists and scalars alone, and of functions where a plan takes one."""
    if is_dataclass(value) and type(value).__module__ == __name__:
        for f in fields(value):
            plain(getattr(value, f.name), f.name)
    elif isinstance(value, (tuple, list)):
        for x in value:
            plain(x)
    elif not (value is None or isinstance(value, (str, int, float, bool)) or field in FUNCTIONS and callable(value)):
        if field == "value" and isinstance(value, dict):
            return
        raise EngineError("NON_PLAIN_PLAN_VALUE")


def eq(field: str, value) -> Compare:
    return Compare(field, "=", value if isinstance(value, (Input, Literal)) else Literal(value))


def compare(field: str, op: str, value) -> Compare:
    return Compare(field, op, value if isinstance(value, (Input, Literal)) or value is None else Literal(value))


def all_of(*parts) -> Logic:
    return Logic("and", parts)


def any_of(*parts) -> Logic:
    return Logic("or", parts)


def not_(part) -> Logic:
    return Logic("not", (part,))


class Builder:
    """Builds plans over one version of the tables.

    parse: the parse functions of endpoints that a plan may call; bound: the inputs that bind, by endpoint;
    opaque: endpoints whose inputs need not come through parsing unchanged.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], resources: dict[str, Resource], queries: dict[str, Any] | None = None, *, parse: dict[str, Callable] | None = None, bound: dict[str, set[str]] | None = None, opaque: frozenset[str] = frozenset()):
        self.spark, self.tables, self.resources, self.queries = spark, tables, resources, queries or {}
        self.parse, self.bound, self.opaque = parse or {}, bound or {}, opaque

    @staticmethod
    def resolve(value, inputs: dict, field: str):
        if isinstance(value, Literal):
            return value.value
        if value.name not in inputs:
            raise EngineError(f"Missing query input for {field}")
        return inputs[value.name]

    def _check(self, resource: str, *fields: str) -> Resource:
        r = self.resources.get(resource)
        if r is None:
            raise EngineError("UNREGISTERED_RESOURCE")
        if not set(fields) <= set(r.columns):
            raise EngineError("UNREGISTERED_COLUMN")
        return r

    def predicate(self, p, resource: str, inputs: dict) -> Column:
        if isinstance(p, Logic):
            parts = [self.predicate(x, resource, inputs) for x in p.parts]
            if p.op == "not":
                return ~parts[0]
            if p.op == "and":
                return reduce(lambda a, b: a & b, parts, F.lit(True))
            return reduce(lambda a, b: a | b, parts, F.lit(False))
        self._check(resource, p.field)
        c = F.col(p.field)
        if p.op == "is-null":
            return c.isNull()
        if p.op == "not-null":
            return c.isNotNull()
        v = self.resolve(p.value, inputs, p.field)
        if p.op == "in":
            if not isinstance(v, (list, tuple)):
                raise EngineError("IN requires an array")
            return c.isin(list(v)) if v else F.lit(False)
        ops = {"=": c.__eq__, "<>": c.__ne__, "<": c.__lt__, "<=": c.__le__, ">": c.__gt__, ">=": c.__ge__}
        if p.op not in ops:
            raise EngineError("INVALID_PREDICATE")
        return ops[p.op](F.lit(v))

    def _page(self, value, inputs: dict, least: int, name: str) -> int | None:
        if value is None:
            return None
        v = self.resolve(value, inputs, name) if isinstance(value, Input) else value
        if isinstance(v, bool) or not isinstance(v, int) or not least <= v <= 10000:
            raise EngineError(f"Invalid query {name}")
        return v

    @staticmethod
    def ordering(order: tuple[Order, ...]) -> list[Column]:
        side = {(True, False): "asc_nulls_last", (True, True): "asc_nulls_first", (False, False): "desc_nulls_last", (False, True): "desc_nulls_first"}
        return [getattr(F.col(o.field), side[o.ascending, o.nulls_first])() for o in order]

    def _rows(self, s: Select, inputs: dict, keep: tuple[str, ...] = ()) -> DataFrame:
        """Filtered rows with joins attached and every column still there; `keep` are the needed ones."""
        r = self._check(s.resource, *(s.columns or ()), *(o.field for o in s.order))
        needed = set(s.columns or r.columns) | set(keep) | {o.field for o in s.order} | {j.local for j in s.joins}
        df = self.tables[s.resource]
        for p in s.where:
            df = df.filter(self.predicate(p, s.resource, inputs))
        df = df.select(*[c for c in r.columns if c in needed])
        for j in s.joins:
            self._check(s.resource, j.local)
            self._check(j.child.resource, j.foreign)
            df = self._join(df, j, inputs)
        return df

    def _join(self, df: DataFrame, j: Join, inputs: dict) -> DataFrame:
        child = self._rows(j.child, inputs, (j.foreign,))
        limit, offset = self._page(j.child.limit, inputs, 1, "limit"), self._page(j.child.offset, inputs, 0, "offset")
        names = [*(j.child.columns or self.resources[j.child.resource].columns), *[x.name for x in j.child.joins if not x.required]]
        key = f"__{j.name}_key"
        if j.required and limit is None and not offset:
            return df.join(child.select(F.col(j.foreign).alias(key)), F.col(j.local) == F.col(key), "left_semi")
        child = child.filter(F.col(j.foreign).isNotNull())
        if j.many and limit is None and not offset:
            return self._gather(df, j, child, names, key)
        if not j.many and not j.required and not offset:
            return self._first(df, j, child, names, key)
        order = self.ordering(j.child.order) or [F.lit(0)]
        child = child.withColumn("__at", F.row_number().over(Window.partitionBy(j.foreign).orderBy(*order)) - 1 - (offset or 0)).filter("`__at` >= 0")
        if limit is not None:
            child = child.filter(F.col("__at") < limit)
        if j.required:
            return df.join(child.select(F.col(j.foreign).alias(key)), F.col(j.local) == F.col(key), "left_semi")
        if j.many:
            return self._gather(df, j, child, names, key, ["__at"])
        first = child.filter("`__at` = 0").select(F.col(j.foreign).alias(key), F.struct(*names).alias(j.name))
        return df.join(first, F.col(j.local) == F.col(key), "left").drop(key)

    @staticmethod
    def _ranks(order: tuple[Order, ...], kinds: dict) -> list[Column] | None:
        """Columns whose ascending order, nulls first, is the wanted one; None if a descending one has no negative."""
        out = []
        for o in order:
            c, kind = F.col(o.field), kinds[o.field]
            null = c.isNull() if not o.nulls_first else c.isNotNull()
            if not o.ascending:
                if not (kind.startswith("decimal") or kind in ("bigint", "int", "smallint", "tinyint", "double", "float")):
                    return None
                c = -c.cast("decimal(38,0)") if kind in ("bigint", "int", "smallint", "tinyint") else -c
            out += [null, c]
        return out

    def _gather(self, df: DataFrame, j: Join, child: DataFrame, names: list[str], key: str, ranks: list | None = None) -> DataFrame:
        """Children as an array of structs, empty where there are none. Sorted within each array; nothing is ranked over a window."""
        ranks = [F.col(c) for c in ranks] if ranks else self._ranks(j.child.order, dict(child.dtypes))
        if ranks is None:
            at = Window.partitionBy(j.foreign).orderBy(*self.ordering(j.child.order))
            child, ranks = child.withColumn("__at", F.row_number().over(at)), [F.col("__at")]
        item = F.struct(*names)
        if ranks:
            held = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*[r.alias(f"r{i}") for i, r in enumerate(ranks)]).alias("rank"), item.alias("item")))), lambda x: x["item"])
        else:
            held = F.collect_list(item)
        grouped = child.groupBy(F.col(j.foreign).alias(key)).agg(held.alias(j.name))
        kind = dict(grouped.dtypes)[j.name]
        return df.join(grouped, F.col(j.local) == F.col(key), "left").drop(key).withColumn(j.name, F.coalesce(F.col(j.name), F.from_json(F.lit("[]"), kind)))

    def _first(self, df: DataFrame, j: Join, child: DataFrame, names: list[str], key: str) -> DataFrame:
        """The first child by order as a struct, null where there is none; a partial aggregate, no window."""
        ranks, item = self._ranks(j.child.order, dict(child.dtypes)), F.struct(*names)
        if ranks is None:
            at = Window.partitionBy(j.foreign).orderBy(*self.ordering(j.child.order))
            child = child.withColumn("__at", F.row_number().over(at)).filter("`__at` = 1")
        one = F.min_by(item, F.struct(*[r.alias(f"r{i}") for i, r in enumerate(ranks)])) if ranks else F.first(item)
        return df.join(child.groupBy(F.col(j.foreign).alias(key)).agg(one.alias(j.name)), F.col(j.local) == F.col(key), "left").drop(key)

    def select(self, s: Select, inputs: dict) -> DataFrame:
        df = self._rows(s, inputs)
        limit, offset = self._page(s.limit, inputs, 1, "limit"), self._page(s.offset, inputs, 0, "offset")
        if s.order:
            df = df.orderBy(*self.ordering(s.order))
        if offset:
            df = df.offset(offset)
        if limit is not None:
            df = df.limit(limit)
        return df.select(*(s.columns or self.resources[s.resource].columns), *[j.name for j in s.joins if not j.required])

    def _call(self, plan: Call, inputs: dict, carried: frozenset[str] | None):
        """The called endpoint over its own parse of the inputs.

        carried: inputs of the endpoint asked for that must reach the rows unchanged; None once a mapping
        has widened the path, below which nothing is checked again.
        """
        if plan.endpoint not in self.queries:
            raise EngineError("Query missing")
        own = plan.inputs is None and plan.endpoint not in self.opaque and carried is not None
        fields = carried | self.bound.get(plan.endpoint, set()) if own else None
        given = parsed(self.parse.get(plan.endpoint), dict(plan.inputs(inputs) if plan.inputs else inputs), fields)
        return self.run(self.queries[plan.endpoint], given, fields)

    def run(self, plan, inputs: dict, carried: frozenset[str] | None = frozenset()):
        again = lambda p: self.run(p, inputs, carried)
        if isinstance(plan, Select):
            return self.select(plan, inputs)
        if isinstance(plan, Count):
            s = plan.select
            slim = replace(s, columns=(), order=(), limit=None, offset=None, joins=tuple(j for j in s.joins if j.required))
            return self._rows(replace(slim, columns=None), inputs).agg(F.count("*").alias("count"))
        if isinstance(plan, Value):
            return plan.value
        if isinstance(plan, Call):
            return self._call(plan, inputs, carried)
        if isinstance(plan, Combine):
            return {name: again(p) for name, p in plan.parts}
        if isinstance(plan, When):
            return again(plan.yes if plan.test(inputs) else plan.no)
        if isinstance(plan, Bind):
            given = plan.inputs(again(plan.parent), inputs)
            return [] if given is None else self.run(plan.child, given, None)
        if isinstance(plan, Map):
            return plan.project(again(plan.source))
        if isinstance(plan, Choose):
            choices = dict(plan.choices)
            name = plan.pick(inputs)
            if name not in choices:
                raise EngineError("Unregistered query choice")
            return again(choices[name])
        if isinstance(plan, Sql):
            for name, df in self.tables.items():
                df.createOrReplaceTempView(name)
            return self.spark.sql(plan.text, args=inputs or None)
        raise EngineError("QUERY_PLAN_REQUIRED")
