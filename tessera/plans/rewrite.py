"""Rewrites of plans before they become DataFrames."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ir import Filter, PlanError, QueryPlan


def measure_is_not_filter(plan: QueryPlan, default: str | None) -> QueryPlan:
    """A column fixed by an equality can't be the measure; the entity's default takes its place."""
    fixed = {f[0] for f in plan.filters if f[1] == "eq"}
    if plan.field in fixed and plan.fn not in ("count", "distinct") and default and default not in fixed:
        return replace(plan, field=default)
    return plan


def counted_column(plan: QueryPlan, counts: set[str]) -> QueryPlan:
    """Counting a column that is a count itself means its sum."""
    return replace(plan, fn="sum") if plan.fn == "count" and plan.field in counts else plan


def stated_bar(plan: QueryPlan, stated: set[str]) -> QueryPlan:
    """A figure that is stated, not accumulated, isn't summed over rows."""
    return replace(plan, fn="max") if plan.fn == "sum" and plan.field in stated else plan


BARS = ("gt", "gte", "lt", "lte", "between")


def is_bar(f: Filter) -> bool:
    """An amount's bound; a time that selects nothing is an answer, not a misread bar."""
    bounds = f[2] if isinstance(f[2], tuple) else (f[2],)
    return f[1] in BARS and f[0] != "year" and all(isinstance(x, int | float) for x in bounds)


def separating_bars(plan: QueryPlan, source: DataFrame) -> QueryPlan:
    """Bars that keep all rows or none say nothing about this column and go.  One aggregation for all."""
    bars = [f for f in plan.filters if is_bar(f)]
    if not bars:
        return plan
    from tessera.operators.algebra import predicate

    seen = source.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(predicate(f), F.lit(False))).alias(f"b{i}") for i, f in enumerate(bars)]).first()
    return without_idle(plan, {f: seen[f"b{i}"] for i, f in enumerate(bars)}, seen["n"])


def without_idle(plan: QueryPlan, kept: dict, rows: int) -> QueryPlan:
    """Without bars that keep all rows or none; ``kept``: how many rows each bar keeps."""
    return replace(plan, filters=tuple(f for f in plan.filters if kept.get(f, 1) not in (0, rows) or f not in kept))


def latest_by_default(plan: QueryPlan, source: DataFrame, column: str = "year") -> QueryPlan:
    """Without a year the latest one is meant."""
    if any(f[0] == column for f in plan.filters) or column not in source.columns:
        return plan
    latest = source.agg(F.max(column)).first()[0]
    return plan if latest is None else plan.with_filter((column, "eq", latest))


WHOLE_TABLE = 20  # rows of a table over which a sum without any filter is taken for a misread question


def guard_whole_table(plan: QueryPlan, source: DataFrame, limit: int = WHOLE_TABLE) -> QueryPlan:
    """A sum without any filter over a large table is more likely a misread question."""
    if sums_all(plan) and source.limit(limit + 1).count() > limit:
        raise PlanError(f"sum over all of {plan.entity} without a filter")
    return plan


def sums_all(plan: QueryPlan) -> bool:
    return plan.fn == "sum" and not plan.filters and not plan.group_keys and plan.op is None


UNITS = {"percent": (0, 100), "count": (0, 1e7), "days": (-1e5, 1e5), "money": (-1e15, 1e15)}


def has_unit(plan: QueryPlan, unit: str) -> bool:
    """The plan's answer has this unit whatever its size: days between dates, a share, rows or values counted, amounts."""
    if plan.op in ("spread", "epoch", "datespan", "ratio"):
        return unit == ("percent" if plan.op == "ratio" else "days")
    return unit == ("count" if plan.fn in ("count", "distinct") else "money")


def within_unit(answer: float | None, unit: str) -> float | None:
    """An answer that its unit can't have is unknown."""
    if answer is None:
        return None
    low, high = UNITS[unit]
    return answer if low <= answer <= high else None
