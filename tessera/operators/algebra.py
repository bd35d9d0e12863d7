"""Plans to DataFrames: predicates, reductions and compositions.

Every composition is one pass: what differs between its parts becomes the
condition of an aggregate, so that one scan and one shuffle serve all.
The result has the group keys, ``answer`` and ``n_rows`` (selected rows).
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.ir import Filter, PlanError, QueryPlan


def predicate(f: Filter) -> Column:
    """A row is kept only if its column has a value that compares as asked."""
    name, op, value = f
    col = F.col(name)
    if op == "exists":
        return col.isNotNull() if value else col.isNull()
    if op == "contains":
        return F.contains(F.lower(col.cast("string")), F.lit(str(value).lower()))
    if op == "between":
        return col.between(*value)
    if op == "in":
        return col.isin(*value)
    return {
        "eq": lambda: col == value, "ne": lambda: col != value, "gt": lambda: col > value,
        "gte": lambda: col >= value, "lt": lambda: col < value, "lte": lambda: col <= value,
    }[op]()


def matches(filters: tuple[Filter, ...]) -> Column:
    return fold(lambda a, b: a & b, [predicate(f) for f in filters], F.lit(True))


def reduction(fn: str, field: str | None, where: Column | None = None) -> Column:
    """An aggregate over the rows for which ``where`` holds; no value gives null, a count 0."""
    if fn == "count":
        return F.count_if(F.coalesce(where, F.lit(False))) if where is not None else F.count(F.lit(1))
    x = F.col(field) if where is None else F.when(where, F.col(field))
    if fn == "mean":
        return F.bround(F.try_divide(F.sum(x).cast("double"), F.count(x)), 0).cast("bigint")
    if fn == "median":
        return F.bround(F.median(x), 0).cast("bigint")
    return {"distinct": F.countDistinct, "sum": F.sum, "min": F.min, "max": F.max}[fn](x)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with two decimals, half to even; null where there is no whole."""
    return F.bround(F.try_divide(part.cast("double") * 10000, F.nullif(whole, F.lit(0))), 0) / 100


def _grouped(df: DataFrame, keys: tuple[str, ...], *aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def _signed(x: Column, absolute: bool) -> Column:
    return F.abs(x) if absolute else x


def run(plan: QueryPlan, source: DataFrame) -> DataFrame:
    """The answer of a plan over an entity view."""
    plan = plan.without_duplicates()
    plan.check(source.columns)
    keys, n_rows = plan.group_keys, F.count(F.lit(1)).alias("n_rows")
    rows = source.filter(matches(plan.filters)) if plan.filters else source
    fn, field = plan.fn, plan.field
    if plan.op is None:
        return _grouped(rows, keys, reduction(fn, field).alias("answer"), n_rows)
    if plan.op == "delta":
        first, second = plan.years
        rows = source.filter(matches(tuple(f for f in plan.filters if f[0] != "year")) & F.col("year").isin(first, second))
        a, b = (reduction(fn, field, F.col("year") == y) for y in (first, second))
        return _grouped(rows, keys, _signed(b - a, plan.absolute is not False).alias("answer"), n_rows)
    if plan.op == "diff":
        if plan.field_b:
            answer = reduction(fn, field) - reduction(fn, plan.field_b)
            return _grouped(rows, keys, _signed(answer, bool(plan.absolute)).alias("answer"), n_rows)
        left, right = matches(plan.filters), matches(plan.subtrahend)
        answer = reduction(fn, field, left) - reduction(fn, field, right)
        return _grouped(source.filter(left | right), keys, _signed(answer, bool(plan.absolute)).alias("answer"), F.count_if(left).alias("n_rows"))
    if plan.op == "ratio":
        part, whole = matches((*plan.filters,)), matches(plan.denominator)
        answer = percent(reduction(fn, field, part), reduction(fn, field, whole))
        return _grouped(source.filter(part | whole), keys, answer.alias("answer"), F.count_if(part).alias("n_rows"))
    if plan.op == "argsel":
        pick = F.max_by if plan.dir == "max" else F.min_by
        rows = rows.filter(F.col(plan.by).isNotNull())
        # ties: the smallest key wins in either direction
        if plan.tiebreak is None:
            return _grouped(rows, keys, pick(field, plan.by).alias("answer"), n_rows)
        order = F.struct(plan.by, (-F.col(plan.tiebreak)).alias("t")) if plan.dir == "max" else F.struct(plan.by, plan.tiebreak)
        return _grouped(rows, keys, pick(F.col(field), order).alias("answer"), n_rows)
    if plan.op == "groupby":
        inner = rows.filter(F.col(plan.by).isNotNull()).groupBy(*keys, plan.by).agg(reduction(fn, field).alias("g"), F.count(F.lit(1)).alias("c"))
        best = F.max("g") if plan.dir == "max" else F.min("g")
        return _grouped(inner, keys, best.alias("answer"), F.sum("c").alias("n_rows"))
    if plan.op == "spread":
        span = F.when(F.count(field) >= 2, F.datediff(F.max(field), F.min(field)))
        return _grouped(rows, keys, span.cast("bigint").alias("answer"), n_rows)
    if plan.op == "epoch":
        end = F.min(field) if fn == "min" else F.max(field)
        return _grouped(rows, keys, F.datediff(end, F.lit(plan.origin)).cast("bigint").alias("answer"), n_rows)
    if plan.op == "datespan":
        one, two = plan.subjects
        rows = rows.filter(F.col(plan.key).isin(one, two))
        dates = [F.min_by(F.when(F.col(plan.key) == s, F.col(field)), F.when(F.col(plan.key) == s, F.col(plan.tiebreak or field))) for s in (one, two)]
        return _grouped(rows, keys, F.abs(F.datediff(*dates)).cast("bigint").alias("answer"), n_rows)
    raise PlanError(plan.op)


def reads(plan: QueryPlan) -> Column | None:
    """The rows that a plan reads; None: all of them."""
    filters = tuple(f for f in plan.filters if f[0] != "year") if plan.op == "delta" else plan.filters
    own = matches(filters) if filters else None
    if plan.op == "delta":
        years = F.col("year").isin(*plan.years)
        return years if own is None else own & years
    other = plan.denominator if plan.op == "ratio" else plan.subtrahend if plan.op == "diff" and not plan.field_b else None
    if other is None:
        return own
    return None if own is None or not other else own | matches(other)


def answer(plan: QueryPlan) -> Column:
    """The plan's answer as one aggregate over its entity's rows, so that one scan answers many plans; ``groupby`` needs its own grouping."""
    fn, field, where = plan.fn, plan.field, matches(plan.filters)
    if plan.op is None:
        return reduction(fn, field, where)
    if plan.op == "delta":
        base = matches(tuple(f for f in plan.filters if f[0] != "year"))
        a, b = (reduction(fn, field, base & (F.col("year") == y)) for y in plan.years)
        return _signed(b - a, plan.absolute is not False)
    if plan.op == "diff":
        other = reduction(fn, plan.field_b, where) if plan.field_b else reduction(fn, field, matches(plan.subtrahend))
        return _signed(reduction(fn, field, where) - other, bool(plan.absolute))
    if plan.op == "ratio":
        return percent(reduction(fn, field, where), reduction(fn, field, matches(plan.denominator)))
    kept = lambda c: F.when(where, c)
    if plan.op == "argsel":
        pick, by, tie = (F.max_by if plan.dir == "max" else F.min_by), F.col(plan.by), plan.tiebreak
        order = by if tie is None else F.struct(by, (-F.col(tie)).alias("t")) if plan.dir == "max" else F.struct(by, F.col(tie))
        return pick(F.col(field), F.when(where & by.isNotNull(), order))
    x = kept(F.col(field))
    if plan.op == "spread":
        return F.when(F.count(x) >= 2, F.datediff(F.max(x), F.min(x)))
    if plan.op == "epoch":
        return F.datediff(F.min(x) if fn == "min" else F.max(x), F.lit(plan.origin))
    if plan.op == "datespan":
        own = [where & (F.col(plan.key) == s) for s in plan.subjects]
        return F.abs(F.datediff(*[F.min_by(F.when(o, F.col(field)), F.when(o, F.col(plan.tiebreak or field))) for o in own]))
    raise PlanError(f"{plan.op} isn't one aggregate")


def relaxed(plan: QueryPlan, source: DataFrame) -> QueryPlan:
    """Drop filters whose column is null on every row that the other filters select.

    Only where the plan selects nothing and has two filters or more.  One
    aggregation per round counts, for every filter, the rows of the others with
    and without a value; a stated disagreement keeps its filter.
    """
    plan.check(source.columns)
    while len(plan.filters) >= 2:
        probes = [F.count_if(F.coalesce(matches(plan.filters), F.lit(False))).alias("all")]
        for i, f in enumerate(plan.filters):
            others = F.coalesce(matches(plan.filters[:i] + plan.filters[i + 1 :]), F.lit(False))
            probes += [F.count_if(others).alias(f"o{i}"), F.count_if(others & F.col(f[0]).isNotNull()).alias(f"v{i}")]
        seen = source.agg(*probes).first()
        drop = next((i for i in range(len(plan.filters)) if seen[f"o{i}"] and not seen[f"v{i}"]), None)
        if seen["all"] or drop is None:
            break
        plan = QueryPlan(**{**plan.__dict__, "filters": plan.filters[:drop] + plan.filters[drop + 1 :]})
    return plan
