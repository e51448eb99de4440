"""Row policies: conditions that decide which rows of a resource a role may read.

A policy is SQL text over the resource's own columns; it may look into other resources. What it reads is
derived from the analysed plan of the filtered table, as for any SQL text, and becomes a dependency of
every endpoint that reads the resource.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EngineError, Manifest, Read, Resource, quoted
from .sqltext import sql_reads


@dataclass(frozen=True)
class Policy:
    """permissive policies of a resource let a row through if one of them does, restrictive ones if all do."""

    resource: str
    condition: str
    permissive: bool = True


def condition(resource: str, policies: list[Policy]) -> str | None:
    """The condition on a resource's rows, or None without policies. Restrictive ones alone let nothing through."""
    own = [p for p in policies if p.resource == resource]
    if not own:
        return None
    some = [f"({p.condition})" for p in own if p.permissive]
    every = [f"({p.condition})" for p in own if not p.permissive]
    return " AND ".join(["(" + " OR ".join(some) + ")" if some else "false", *every])


def filtered(df: DataFrame, resource: str, policies: list[Policy]) -> DataFrame:
    """The rows that the policies let through; a condition that is null does not."""
    text = condition(resource, policies)
    return df if text is None else df.filter(F.expr(text))


def policy_reads(spark: SparkSession, resource: Resource, policies: list[Policy], resources: dict[str, Resource]) -> list[Read]:
    """What deciding about the resource's rows reads: its own columns, and other resources whole."""
    text = condition(resource.id, policies)
    if text is None:
        return []
    try:
        found = sql_reads(spark, f"SELECT 1 AS one FROM {quoted(resource.id)} WHERE {text}", resources, {})
    except EngineError as e:
        raise EngineError(f"UNRESOLVED_RLS_DEPENDENCY:{resource.id}") from e
    return found


def with_policies(spark: SparkSession, manifest: Manifest, resources: dict[str, Resource], tables: dict[str, DataFrame], policies: list[Policy]) -> Manifest:
    """The manifest with what policies add: columns to the reads of a resource, and reads of what its policies look into.

    A resource whose policies read another one keeps its bindings: they still hold for its own rows.
    """
    if not policies:
        return manifest
    for p in policies:
        if p.resource not in resources:
            raise EngineError("UNREGISTERED_RESOURCE")
    for name in resources:
        tables[name].createOrReplaceTempView(name)
    added = {n: policy_reads(spark, resources[n], policies, resources) for n in {p.resource for p in policies}}
    reads = {}
    for endpoint, own in manifest.reads.items():
        out: list[Read] = []
        for r in own:
            more = added.get(r.resource, [])
            columns = {c for x in more if x.resource == r.resource for c in x.columns or resources[r.resource].columns}
            out.append(r if r.columns is None else replace(r, columns=tuple(sorted({*r.columns, *columns}))))
            out += [x for x in more if x.resource != r.resource]
        reads[endpoint] = tuple(dict.fromkeys(out))
    sources = {n: tuple(sorted({r.resource for r in rs})) for n, rs in reads.items()}
    dependents = {r: tuple(sorted(n for n, s in sources.items() if r in s)) for r in sorted({x for s in sources.values() for x in s})}
    return Manifest(reads, sources, dependents)


def unproven(manifest: Manifest, policies: list[Policy]) -> dict[str, list[str]]:
    """By endpoint, the resources it reads whose policies look into another resource: their rows can appear without being written."""
    return {e: sorted({r.resource for r in rs} & {p.resource for p in policies}) for e, rs in manifest.reads.items()}
