"""Keyword triage of titles with versioned policies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.functions.text import hits, sorted_union


@dataclass(frozen=True)
class Policy:
    include: Sequence[str] = field(default_factory=tuple)
    exclude: Sequence[str] = field(default_factory=tuple)
    workflow: Sequence[str] = field(default_factory=tuple)
    process: Sequence[str] = field(default_factory=tuple)


def triage(title: Column, policy: Policy) -> Column:
    """struct<decision, matched_terms> of a title in normal form.

    Process terms make it noise; so do excluded ones that stand alone. Excluded terms beside included or
    workflow ones need review, and so do workflow terms alone; included terms make it a candidate.
    Every title gets exactly one decision.
    """
    text = F.coalesce(title, F.lit(""))
    include, exclude, workflow, process = (hits(text, t) for t in (policy.include, policy.exclude, policy.workflow, policy.process))
    some = lambda a: F.size(a) > 0

    def decided(decision: str, terms: Column) -> Column:
        return F.struct(F.lit(decision).alias("decision"), terms.alias("matched_terms"))

    return (
        F.when(some(process), decided("noise", process))
        .when(some(exclude) & ~some(include) & ~some(workflow), decided("noise", exclude))
        .when(some(exclude), decided("needs_review", sorted_union(include, exclude, workflow)))
        .when(some(include), decided("candidate", sorted_union(include, workflow)))
        .when(some(workflow), decided("needs_review", workflow))
        .otherwise(decided("noise", F.array().cast("array<string>")))
    )


def triage_with_policies(notices: DataFrame, policies: DataFrame, title: str, keys: Sequence[str]) -> DataFrame:
    """The same with a policy per row, joined on (id, version); rows without their policy come back with a null decision.

    ``policies``: the key columns and the arrays include_any, exclude_any, workflow_terms, process_terms.
    """
    joined = notices.join(policies, list(keys), "left")
    text = F.coalesce(F.col(title), F.lit(""))
    found = {n: F.filter(F.coalesce(F.col(n), F.array().cast("array<string>")), lambda t: (t != "") & text.contains(t)) for n in ("include_any", "exclude_any", "workflow_terms", "process_terms")}
    joined = joined.select(*notices.columns, F.col("include_any").isNotNull().alias("__known"), *(c.alias(f"__{n}") for n, c in found.items()))
    i, e, w, p = (F.col(f"__{n}") for n in found)
    decision = (
        F.when(F.size(p) > 0, "noise").when((F.size(e) > 0) & (F.size(i) + F.size(w) == 0), "noise").when(F.size(e) > 0, "needs_review")
        .when(F.size(i) > 0, "candidate").when(F.size(w) > 0, "needs_review").otherwise("noise")
    )
    return joined.select(*notices.columns, F.when(F.col("__known"), decision).alias("new_decision"))


def transitions(old: Column, new: Column, df: DataFrame) -> DataFrame:
    """The matrix of decisions before and after a change of policy."""
    return df.groupBy(old.alias("old_decision"), new.alias("new_decision")).agg(F.count("*").alias("n"))
