"""Inputs of endpoints: how they are parsed, and which of them must come through parsing unchanged."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable

from ..model import EngineError, canonical


def parser(schema) -> Callable[[dict], dict]:
    """One parse function of a function, an object with `parse`, or one with `version` 1 and `validate`, whose result has issues or a value."""
    if callable(getattr(schema, "validate", None)):
        if getattr(schema, "version", None) != 1:
            raise EngineError("UNSUPPORTED_INPUT_SCHEMA_VERSION")

        def check(given: dict) -> dict:
            result = schema.validate(given)
            if issues := getattr(result, "issues", None):
                raise EngineError(f"INVALID_QUERY_INPUT:{'; '.join(map(str, issues))}")
            return result.value

        return check
    if callable(getattr(schema, "parse", None)):
        return schema.parse
    if callable(schema):
        return schema
    raise EngineError("INVALID_QUERY_DEFINITION")


def parsed(parse: Callable[[dict], dict] | None, given: dict, fields: Iterable[str] | None) -> dict:
    """The parsed inputs. `fields` must be the same before and after, absence included; None asks for no such thing.

    Selectors carry the values that the caller gave, while the query runs on the parsed ones, so a schema
    that rewrites one of them would hide an affected result.
    """
    if parse is None:
        return given
    before = copy.deepcopy(given)
    try:
        out = parse(given)
    except EngineError:
        raise
    except (TypeError, ValueError, KeyError) as e:
        raise EngineError(f"INVALID_QUERY_INPUT:{e}") from e
    if not isinstance(out, dict):
        raise EngineError("INVALID_QUERY_INPUT")
    for name in sorted(fields or ()):
        if (name in before) != (name in out) or name in before and canonical(before[name]) != canonical(out[name]):
            raise EngineError(f"QUERY_INPUT_PRESERVATION_VIOLATION:{name}")
    return out
