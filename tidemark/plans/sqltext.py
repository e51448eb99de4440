"""Dependencies of SQL text, from the analysed plan.

Every resource is a temporary view, and a relation is known by the view that Spark resolved, never by an
alias or the name of a common table expression. Each occurrence of a view has attributes of its own, so a
read has the columns that the plan above it mentions. Parameters are bound to values that the text does not
hold, which mark where they went: a column has a binding if a condition between its relation and the top
demands that it equals a whole parameter, uncast but for a wider integer. A condition counts only where
every row that fails it is without effect: not past an outer join's optional side, an aggregate, a limit,
a window or a set operation. Whatever is unclear widens the read or is refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..model import EngineError, Read, Resource

# Expressions whose value depends on the time, the session, the run or the files' places.
FRESH = {
    "CurrentTimestamp", "CurrentTimestampLike", "Now", "CurrentDate", "CurrentTime", "LocalTimestamp", "CurrentTimeZone", "CurrentUser", "SessionUser", "CurrentDatabase", "CurrentCatalog",
    "Rand", "Randn", "RandStr", "Uniform", "Uuid", "Shuffle", "MonotonicallyIncreasingID", "SparkPartitionID", "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "UnixTimestamp", "SparkVersion", "Version", "CallMethodViaReflection", "TryReflect",
}
OPAQUE = {"PythonUDF", "ScalaUDF", "PythonUDAF", "PythonUDTF", "UserDefinedPythonTableFunction", "HiveSimpleUDF", "HiveGenericUDF", "ScalaUDAF", "ScalaAggregator", "ApplyFunctionExpression", "Invoke", "StaticInvoke"}
INTEGERS = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}
#: Plans that hand every row on, or drop it by a condition on that row.
ROWWISE = {"Project", "Filter", "SubqueryAlias", "View", "Sort"}
#: Which sides of a join are without effect if they fail a condition above it.
SIDES = {"Inner": (True, True), "Cross": (True, True), "LeftOuter": (True, False), "RightOuter": (False, True), "LeftSemi": (True, False), "LeftAnti": (True, False)}
LARGEST = 1 << 20


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _inside(expression):
    """An expression and all below it, without the plans of its subqueries."""
    yield expression
    for child in _items(expression.children()):
        yield from _inside(child)


def _attributes(expression) -> set[int]:
    return {e.exprId().id() for e in _inside(expression) if _name(e) == "AttributeReference"}


@dataclass
class Relation:
    """One occurrence of a resource: its columns by attribute, and the bindings that hold for all its rows."""

    resource: str
    columns: dict[int, str]
    bindings: frozenset[tuple[int, str]]
    odd: frozenset[int]  # attributes whose equality is no equality of texts


class _Walk:
    def __init__(self, resources: dict[str, Resource], marks: dict):
        self.resources, self.marks = resources, marks
        self.found: list[Relation] = []
        self.used: set[int] = set()

    def parameter(self, e) -> str | None:
        """The parameter that an expression is, as it is or as a wider integer."""
        if _name(e) == "Cast" and e.dataType().simpleString() in INTEGERS:
            inner = e.child()
            if _name(inner) == "Literal" and INTEGERS.get(inner.dataType().simpleString(), 9) <= INTEGERS[e.dataType().simpleString()]:
                e = inner
        if _name(e) != "Literal" or e.value() is None:
            return None
        value = e.value()
        return self.marks.get((type(value).__name__ == "int", str(value)) if isinstance(value, int) and not isinstance(value, bool) else (False, e.toString()))

    def column(self, e) -> int | None:
        if _name(e) == "Cast" and INTEGERS.get(e.child().dataType().simpleString(), 9) <= INTEGERS.get(e.dataType().simpleString(), 0):
            e = e.child()
        return e.exprId().id() if _name(e) == "AttributeReference" else None

    def sure(self, e) -> set[tuple[int, str]]:
        """Equalities of a column and a parameter that hold wherever the condition does."""
        kind = _name(e)
        if kind == "And":
            return self.sure(e.left()) | self.sure(e.right())
        if kind == "Or":
            return self.sure(e.left()) & self.sure(e.right())
        if kind != "EqualTo":
            return set()
        for a, b in ((e.left(), e.right()), (e.right(), e.left())):
            column, name = self.column(a), self.parameter(b)
            if column is not None and name:
                return {(column, name)}
        return set()

    def check(self, expression) -> None:
        for e in _inside(expression):
            kind = _name(e)
            if kind in FRESH or (kind not in OPAQUE and not _items(e.children()) and not e.deterministic()):
                raise EngineError("QUERY_REQUIRES_FRESHNESS_POLICY")
            if kind in OPAQUE:
                raise EngineError(f"UNRESOLVED_QUERY_FUNCTION:{kind}")
            if kind == "AttributeReference" and e.name() == "_metadata":
                raise EngineError("UNRESOLVED_QUERY_EXPRESSION")

    def walk(self, node, active: frozenset = frozenset()) -> None:
        kind = _name(node)
        if kind == "View" and node.desc().identifier().table().lower() in self.resources:
            output = _items(node.output())
            odd = frozenset(a.exprId().id() for a in output if "collate" in a.dataType().simpleString())
            self.found.append(Relation(node.desc().identifier().table().lower(), {a.exprId().id(): a.name() for a in output}, active, odd))
            return
        if kind in ("LogicalRelation", "DataSourceV2Relation", "HiveTableRelation", "LogicalRDD", "ExternalRDD", "InMemoryRelation", "UnresolvedRelation"):
            raise EngineError("UNRESOLVED_QUERY_RELATION")
        if kind == "Sample":
            raise EngineError("QUERY_REQUIRES_FRESHNESS_POLICY")
        for e in _items(node.expressions()):
            self.check(e)
            self.used |= _attributes(e)
        for inner in _items(node.subqueries()):
            self.walk(inner)
        children = _items(node.children())
        if kind == "Filter":
            active = active | self.sure(node.condition())
        if kind == "Project":
            named = {e.exprId().id(): self.column(e.child()) for e in _items(node.projectList()) if _name(e) == "Alias"}
            active = active | {(named[c], p) for c, p in active if named.get(c) is not None}
        if kind == "Join":
            sides = SIDES.get(_name(node.joinType()), (False, False))
        elif kind == "LateralJoin":
            sides = SIDES.get(_name(node.joinType()), (False, False))[:1]
        else:
            sides = (kind in ROWWISE,) * len(children)
        for child, keeps in zip(children, sides, strict=True):
            self.walk(child, active if keeps else frozenset())


def parameters(spark: SparkSession, text: str) -> set[str]:
    """The named parameters of one SELECT statement, or an error if the text is anything else."""
    from pyspark.errors import ParseException

    if not text or len(text.encode()) > LARGEST:
        raise EngineError("INVALID_QUERY")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        if isinstance(e, ParseException) or "ParseException" in str(e):
            code = "QUERY_REQUIRES_ONE_STATEMENT" if re.search(r";\s*\S", text) else "INVALID_QUERY"
            raise EngineError(code) from e
        raise
    for refused in ("logical.Command", "logical.ParsedStatement"):
        if spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.{refused}").isInstance(plan):
            raise EngineError("QUERY_REQUIRES_SELECT")
    names: set[str] = set()

    def walk(node) -> None:
        for e in _items(node.expressions()):
            for inner in _inside(e):
                if _name(inner) == "NamedParameter":
                    names.add(inner.name())
                elif "Parameter" in _name(inner):
                    raise EngineError("PARAMETER_MISMATCH")
        for child in [*_items(node.children()), *_items(node.innerChildren())]:
            walk(child)

    walk(plan)
    return names


def marked(text: str, sample: dict) -> tuple[dict, dict]:
    """Arguments of the sample's types whose values the text does not hold, and which parameter each stands for."""
    args, marks = {}, {}
    for i, (name, value) in enumerate(sorted(sample.items())):
        if isinstance(value, int) and not isinstance(value, bool):
            mark = 7_310_000_019 + 1_000_003 * i
            while str(mark) in text:
                mark += 1
            args[name], marks[True, str(mark)] = mark, name
        elif isinstance(value, str):
            mark = f"tidemark-parameter-{i}"
            while mark in text:
                mark += "-"
            args[name], marks[False, mark] = mark, name
        else:
            args[name] = value
    return args, marks


def sql_reads(spark: SparkSession, text: str, resources: dict[str, Resource], sample: dict) -> list[Read]:
    """The reads of a SELECT over views named by the resources' ids; sample: a value of each parameter's type.

    Each occurrence of a resource gives a read of its own, unless it equals another one's.
    """
    if parameters(spark, text) != set(sample):
        raise EngineError("PARAMETER_MISMATCH")
    args, marks = marked(text, sample)
    try:
        plan = spark.sql(text, args=args or None)._jdf.queryExecution().analyzed()
    except Exception as e:
        for condition, code in (("TABLE_OR_VIEW_NOT_FOUND", "UNRESOLVED_QUERY_RELATION"), ("AMBIGUOUS", "AMBIGUOUS_QUERY_RELATION"), ("UNRESOLVED_ROUTINE", "UNRESOLVED_QUERY_FUNCTION"), ("UNRESOLVED_COLUMN", "UNRESOLVED_QUERY_EXPRESSION")):
            if condition in str(e):
                raise EngineError(code) from e
        raise
    w = _Walk({k.lower(): r for k, r in resources.items()}, marks)
    w.walk(plan)
    if not w.found:
        raise EngineError("QUERY_HAS_NO_TRACKED_RELATION")
    used = w.used | {a.exprId().id() for a in _items(plan.output())}
    ids = {k.lower(): k for k in resources}
    once = {a: 0 for r in w.found for a in r.columns}
    for r in w.found:
        for a in r.columns:
            once[a] += 1
    out = []
    for r in w.found:
        own = all(once[a] == 1 for a in r.columns)
        columns = tuple(sorted(n for a, n in r.columns.items() if a in used)) if own else None
        bindings = tuple(sorted({(r.columns[a], p) for a, p in r.bindings if a in r.columns and a not in r.odd})) if own else ()
        out.append(Read(ids[r.resource], columns, bindings))
    return sorted(dict.fromkeys(out), key=repr)


def compile_artifact(spark: SparkSession, sources: dict[str, str], resources: dict[str, Resource], *, samples: dict[str, dict] | None = None, refuse: bool = False) -> dict[str, dict]:
    """Many SQL texts at once: for each its reads and policy, store or no-store with the code of what could not be resolved.

    refuse: raise that code instead.
    """
    out = {}
    for name, text in sorted(sources.items()):
        try:
            out[name] = {"policy": "store", "reads": sql_reads(spark, text, resources, (samples or {}).get(name, {})), "diagnostic": None}
        except EngineError as e:
            if refuse:
                raise EngineError(f"{e}:{name}") from e
            out[name] = {"policy": "no-store", "reads": [], "diagnostic": str(e)}
    return out
