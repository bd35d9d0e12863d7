"""Query plans: a small immutable description of one question.

``select(entity) -> filters -> reduce`` with an optional composition on top.
Plans are checked when they are made, so a wrong column or operator raises
instead of selecting nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date
from typing import Any

PREDICATES = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "exists", "between", "in")
REDUCTIONS = ("count", "distinct", "sum", "mean", "median", "min", "max")
COMPOSITIONS = (None, "delta", "diff", "ratio", "argsel", "groupby", "spread", "epoch", "datespan")

Filter = tuple[str, str, Any]


class PlanError(ValueError):
    """The plan names something that doesn't exist or contradicts itself."""


@dataclass(frozen=True)
class QueryPlan:
    entity: str
    filters: tuple[Filter, ...] = ()
    fn: str = "count"
    field: str | None = None
    op: str | None = None
    years: tuple[int, int] | None = None
    subjects: tuple[Any, Any] | None = None
    key: str | None = None
    subtrahend: tuple[Filter, ...] | None = None
    field_b: str | None = None
    denominator: tuple[Filter, ...] | None = None
    by: str | None = None
    dir: str = "max"
    origin: date | None = None
    absolute: bool | None = None  # None: the composition's own habit
    group_keys: tuple[str, ...] = ()  # one answer per key instead of one
    tiebreak: str | None = None

    def __post_init__(self) -> None:
        if self.fn not in REDUCTIONS:
            raise PlanError(f"unknown reduction {self.fn!r}")
        if self.op not in COMPOSITIONS:
            raise PlanError(f"unknown composition {self.op!r}")
        if self.dir not in ("max", "min"):
            raise PlanError(f"unknown direction {self.dir!r}")
        for f in (*self.filters, *(self.subtrahend or ()), *(self.denominator or ())):
            if f[1] not in PREDICATES:
                raise PlanError(f"unknown predicate {f[1]!r}")
        if self.fn != "count" and self.field is None and self.op not in ("groupby",):
            raise PlanError(f"{self.fn} needs a field")
        wanted = {"delta": self.years, "datespan": self.subjects and self.key, "argsel": self.by, "groupby": self.by, "epoch": self.origin}
        if self.op in wanted and not wanted[self.op]:
            raise PlanError(f"{self.op} lacks a parameter")
        if self.op == "diff" and self.subtrahend is None and self.field_b is None:
            raise PlanError("diff needs a subtrahend or a second field")
        if self.op == "ratio" and self.denominator is None:
            raise PlanError("ratio needs a denominator, () for the whole table")

    def columns(self) -> set[str]:
        used = {f[0] for f in (*self.filters, *(self.subtrahend or ()), *(self.denominator or ()))}
        used |= {c for c in (self.field, self.field_b, self.by, self.key, self.tiebreak) if c} | set(self.group_keys)
        return used | ({"year"} if self.op == "delta" else set())

    def check(self, columns: list[str]) -> None:
        if missing := self.columns() - set(columns):
            raise PlanError(f"{self.entity} has no column {sorted(missing)}")

    def without_duplicates(self) -> QueryPlan:
        return replace(self, filters=tuple(dict.fromkeys(self.filters)))

    def with_filter(self, *more: Filter) -> QueryPlan:
        return replace(self, filters=(*self.filters, *more))
