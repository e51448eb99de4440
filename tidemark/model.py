"""Resources, dependencies, limits, codes and the canonical encoding of scalars."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field, replace
from decimal import Decimal


class EngineError(ValueError):
    """An error whose message starts with a stable code."""


@dataclass(frozen=True)
class Limits:
    facts: int = 200
    selectors: int = 100
    read_filters: int = 100
    fact_bytes: int = 131072
    impact_bytes: int = 131072
    manifest_bytes: int = 1048576
    summary_bytes: int = 768
    endpoints: int = 512
    resources: int = 128

    @classmethod
    def unbounded(cls) -> Limits:
        return cls(**{k: 1 << 62 for k in cls.__dataclass_fields__})


@dataclass(frozen=True)
class Resource:
    id: str
    columns: tuple[str, ...]
    table: str = ""
    identity: tuple[str, ...] | None = None
    scope: str | None = None
    cascades: tuple[tuple[str, str | tuple[str, ...]], ...] = ()  # (child resource, its foreign columns, in the order of this one's identity)
    parts: tuple[str, ...] = ()  # physical tables of one logical resource
    refreshed: bool = False  # a materialised result, written by refresh alone


@dataclass(frozen=True)
class Read:
    """columns: None for all of them; bindings: (column, input); filters: (column, canonical value)."""

    resource: str
    columns: tuple[str, ...] | None
    bindings: tuple[tuple[str, str], ...] = ()
    filters: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Manifest:
    reads: dict[str, tuple[Read, ...]]
    sources: dict[str, tuple[str, ...]] = field(default_factory=dict)
    dependents: dict[str, tuple[str, ...]] = field(default_factory=dict)


STATUSES = ("verified", "conservative", "unavailable")
CODES = ("VALIDATION_FAILED", "CATALOG_DRIFT", "RESOURCE_DRIFT", "OBSERVER_UNVERIFIED", "PRECISION_REDUCED", "OBSERVATION_FAILED", "CALCULATION_FAILED")
NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def byte_length(value) -> int:
    return len(canonical(value).encode())


def quoted(name: str) -> str:
    """An identifier for SQL text."""
    if not name or "\0" in name:
        raise EngineError("INVALID_IDENTIFIER")
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Fragment:
    """SQL text with its arguments; parts are put together by `joined`, never by formatting values into text."""

    text: str
    args: tuple[tuple[str, object], ...] = ()

    @staticmethod
    def identifier(name: str) -> Fragment:
        return Fragment(quoted(name))

    @staticmethod
    def value(value) -> Fragment:
        return Fragment("?", (("", value),))

    @staticmethod
    def joined(parts, by: str = " ") -> Fragment:
        parts = list(parts)
        return Fragment(by.join(p.text for p in parts), tuple(a for p in parts for a in p.args))

    def named(self) -> tuple[str, dict[str, object]]:
        """The text with :p0, :p1, ... for its values, and these."""
        pieces = self.text.split("?")
        if len(pieces) != len(self.args) + 1:
            raise EngineError("PARAMETER_MISMATCH")
        text = pieces[0] + "".join(f":p{i}{rest}" for i, rest in enumerate(pieces[1:]))
        return text, {f"p{i}": v for i, (_, v) in enumerate(self.args)}


def number_text(value: float) -> str:
    """The shortest decimal digits of a number: plain from 1e-6 up to 1e21, else with an exponent as in 1.5e-7."""
    if value == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    digits, point = "".join(map(str, digits)), len(digits) + exponent
    if point > 21 or point <= -6:
        text = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    elif point >= len(digits):
        text = digits + "0" * (point - len(digits))
    else:
        text = f"{digits[:point]}.{digits[point:]}" if point > 0 else "0." + "0" * -point + digits
    return "-" * sign + text


def canonical(value) -> str:
    """JSON text of a value, keys in UTF-16 order; equal values have equal texts."""
    if value is None or isinstance(value, bool) or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float)):
        if not math.isfinite(value):
            raise EngineError("NON_JSON_VALUE")
        return str(value) if isinstance(value, int) else number_text(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    raise EngineError("NON_JSON_VALUE")


def foreign(cascade: tuple) -> tuple[str, ...]:
    return (cascade[1],) if isinstance(cascade[1], str) else tuple(cascade[1])


def validate_resources(resources: list[Resource], limits: Limits = Limits()) -> dict[str, Resource]:
    """Resources by id, or an EngineError."""
    size = byte_length({r.id: {"scopeColumn": r.scope, "columns": list(r.columns)} for r in resources})
    if len(resources) > limits.resources or size > limits.manifest_bytes:
        raise EngineError("RESOURCE_LIMIT")
    out: dict[str, Resource] = {}
    tables: set[str] = set()
    for r in resources:
        if not r.id or len(r.id) > 128 or "\0" in r.id or not r.columns or len(set(r.columns)) < len(r.columns) or r.id in out:
            raise EngineError("INVALID_RESOURCE")
        if any(not c or "\0" in c for c in (*r.columns, *(r.parts or (r.table or r.id,)))):
            raise EngineError("INVALID_IDENTIFIER")
        mine = set(r.parts or (r.table or r.id,))
        if mine & tables or len(mine) < len(r.parts or mine):
            raise EngineError("DUPLICATE_TABLE")
        tables |= mine
        if r.identity is not None:
            if not r.identity:
                raise EngineError("EMPTY_IDENTITY")
            if len(set(r.identity)) < len(r.identity):
                raise EngineError("DUPLICATE_IDENTITY_COLUMN")
            if not set(r.identity) <= set(r.columns):
                raise EngineError("UNREGISTERED_COLUMN")
        if r.scope is not None and r.scope not in r.columns:
            raise EngineError("UNREGISTERED_COLUMN")
        out[r.id] = replace(r, columns=tuple(r.columns), table=r.table or r.id, cascades=tuple(r.cascades))
    for r in out.values():
        for cascade in r.cascades:
            child = out.get(cascade[0])
            if child is None or not set(foreign(cascade)) <= set(child.columns):
                raise EngineError("INVALID_CASCADE")
    state: dict[str, int] = {}

    def visit(name: str) -> None:
        if state.get(name) == 1:
            raise EngineError("CASCADE_CYCLE")
        if name not in state:
            state[name] = 1
            for cascade in out[name].cascades:
                visit(cascade[0])
            state[name] = 2

    for name in out:
        visit(name)
    if any(len(foreign(c)) != len(r.identity or ()) for r in out.values() for c in r.cascades):
        raise EngineError("INVALID_CASCADE")
    return out
