"""The answer loop: every question for itself, shapes first, then the planner, never a guess.

A question that is refused or that fails by itself gives no answer and its reason; the others go on.  A job that fails is no
question's own: it raises, so that nothing that wasn't read looks like a result.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce as fold

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import algebra

from . import rewrite
from .compile import Vocabulary, compile_question, with_phrase
from .index import ValueIndex
from .ir import PlanError, QueryPlan
from .mine import Known
from .route import ShapePlan, answer_kind, route, run_clients, run_shape
from .semantic import COUNTS, ENTITIES, STATED

LATEST_BY_DEFAULT = {"order_book", "order_line", "seven_year"}
PLANS_AT_ONCE = 40  # plans that one aggregation answers


@dataclass(frozen=True)
class Answer:
    qid: str
    question: str
    kind: str
    answer: float | None
    plan: str = ""
    source: str = ""  # shape or plan; without one the question was refused, or it failed
    reason: str = ""


def _value(df: DataFrame) -> float | None:
    row = df.first()
    return None if row is None or row["answer"] is None else float(row["answer"])


def prepared(plan: QueryPlan, phrases: tuple[str, ...], source: DataFrame) -> QueryPlan:
    """The plan after all rewrites that need to know the table."""
    entity = ENTITIES.get(plan.entity)
    plan = rewrite.measure_is_not_filter(plan, entity.default if entity else None)
    plan = rewrite.stated_bar(rewrite.counted_column(plan, COUNTS), STATED)
    for phrase in phrases:
        plan = with_phrase(plan, phrase, source)
    if plan.entity in LATEST_BY_DEFAULT:
        plan = rewrite.latest_by_default(plan, source)
    plan = rewrite.separating_bars(plan, source)
    return rewrite.guard_whole_table(plan, source)


def _says_enough(plan: QueryPlan | None) -> bool:
    """A plan for a question that should have named a client: no plain sum over a whole table."""
    return plan is not None and (plan.op is not None or bool(plan.filters) or plan.fn not in ("sum", "count"))


@dataclass(frozen=True)
class _Entry:
    """A question on its way: a shape or a plan, or why there is none."""

    qid: str
    question: str
    kind: str
    plan: QueryPlan | None = None
    shape: ShapePlan | None = None
    phrases: tuple[str, ...] = ()
    reason: str = ""
    failed: bool = False  # for another cause than a refusal

    @property
    def source(self) -> str:
        return "shape" if self.shape else "plan" if self.plan else "failed" if self.failed else ""

    @property
    def sure(self) -> bool:
        """What is computed has the unit that is asked for, so that no size of it is wrong; a shape is chosen by its unit."""
        return self.shape is not None or self.plan is not None and rewrite.has_unit(self.plan, self.kind)


def _fallen(x: _Entry, e: Exception) -> _Entry:
    """The entry without a plan; a ``PlanError`` refuses a question, anything else is a failure."""
    return replace(x, plan=None, shape=None, reason=f"{type(e).__name__}: {e}"[:500], failed=not isinstance(e, PlanError))


def compiled(qid: str, question: str, kind: str | None, known: Known, vocabulary: Vocabulary, tables: dict[str, DataFrame]) -> _Entry:
    """What a question asks for, without any job; whatever fails is the question's own reason."""
    kind = kind or answer_kind(question)
    try:
        if kind not in rewrite.UNITS:
            raise PlanError(f"unknown type of answers {kind!r}")
        shape, why = route(question, known, kind)
        if shape is not None and {"work", "invoice", "credential"} <= tables.keys():
            return _Entry(qid, question, kind, shape=shape)
        made = compile_question(question, vocabulary, kind, known) if why in ("", "planner", "no client named") else None
        if made is None or why == "no client named" and not _says_enough(made.plan):
            return _Entry(qid, question, kind, reason=why if made is None or made.plan is not None else made.reason)
        if made.plan is None:
            return _Entry(qid, question, kind, reason=made.reason)
        if made.plan.entity not in tables:
            return _Entry(qid, question, kind, reason=f"no table {made.plan.entity}")
        made.plan.check(tables[made.plan.entity].columns)
        plan = rewrite.measure_is_not_filter(made.plan, ENTITIES[made.plan.entity].default)
        return _Entry(qid, question, kind, rewrite.stated_bar(rewrite.counted_column(plan, COUNTS), STATED), phrases=made.phrases)
    except Exception as e:  # one question's failure is its own: no job runs here
        return _fallen(_Entry(qid, question, kind), e)


def _judged(x: _Entry, found: float | None) -> tuple[float | None, str]:
    """The answer, or None and why."""
    if found is None:
        return None, "nothing selected"
    return (found, "") if x.sure or rewrite.within_unit(found, x.kind) is not None else (None, f"no {x.kind}: {found}")


def answer_one(qid: str, question: str, kind: str | None, known: Known, vocabulary: Vocabulary, tables: dict[str, DataFrame]) -> Answer:
    """One question for itself, answered at once."""
    x = compiled(qid, question, kind, known, vocabulary, tables)
    try:
        if x.shape is not None:
            found = _value(run_shape(x.shape, tables["work"], tables["invoice"], tables["credential"]))
        elif x.plan is not None:
            table = tables[x.plan.entity]
            x = replace(x, plan=prepared(x.plan, x.phrases, table))
            found = _value(algebra.run(x.plan, table))
        else:
            return Answer(qid, question, x.kind, None, source=x.source, reason=x.reason)
    except (PlanError, AnalysisException) as e:  # the plan's own; a job that fails raises
        x = _fallen(x, e)
        return Answer(qid, question, x.kind, None, source=x.source, reason=x.reason)
    answer, reason = _judged(x, found)
    return Answer(qid, question, x.kind, answer, str(x.shape or x.plan), x.source, reason)


def _probed(entries: list[_Entry], source: DataFrame, strict: bool = False) -> list[_Entry]:
    """Plans of one entity after the rewrites that need to know its rows: one aggregation tells all of them; ``strict``: bars stay."""
    texts = [c for c, t in source.dtypes if t == "string"]
    bars = [] if strict else sorted({f for x in entries for f in x.plan.filters if rewrite.is_bar(f)}, key=str)
    phrases = sorted({p for x in entries for p in x.phrases})
    hit = lambda c, p: F.coalesce(F.contains(F.lower(F.col(c)), F.lit(p.lower())), F.lit(False))
    probes = [F.count(F.lit(1)).alias("n")] + [F.count_if(F.coalesce(algebra.predicate(f), F.lit(False))).alias(f"b{i}") for i, f in enumerate(bars)]
    probes += [F.count_if(hit(c, p)).alias(f"p{i}_{k}") for i, p in enumerate(phrases) for k, c in enumerate(texts)]
    latest = "year" in source.columns and entries[0].plan.entity in LATEST_BY_DEFAULT
    if not (bars or phrases or latest or any(rewrite.sums_all(x.plan) for x in entries)):
        return entries
    seen = source.agg(*probes, *([F.max("year").alias("latest")] if latest else [])).first()
    kept = {f: seen[f"b{i}"] for i, f in enumerate(bars)}
    out = []
    for x in entries:
        plan, reason = x.plan, ""
        for p in x.phrases:
            hits = {c: seen[f"p{phrases.index(p)}_{k}"] for k, c in enumerate(texts)}
            best = max((c for c in texts if 0 < hits[c] < seen["n"]), key=lambda c: hits[c], default=None)
            plan = plan if best is None else plan.with_filter((best, "contains", p))
        if latest and seen["latest"] is not None and not any(f[0] == "year" for f in plan.filters):
            plan = plan.with_filter(("year", "eq", seen["latest"]))
        plan = rewrite.without_idle(plan, kept, seen["n"])
        if rewrite.sums_all(plan) and seen["n"] > rewrite.WHOLE_TABLE:
            plan, reason = None, f"PlanError: sum over all of {plan.entity} without a filter"
        out.append(replace(x, plan=plan, reason=reason))
    return out


def _stacked(row: DataFrame, names: list[list[str]]) -> DataFrame:
    """(qid, answer) from one row with a column an answer, for all questions that ask for it."""
    pairs = F.array(*[F.struct(F.lit(qs).alias("qids"), F.col(f"a{i}").alias("answer")) for i, qs in enumerate(names)])
    return row.select(F.explode(pairs).alias("x")).select(F.explode("x.qids").alias("qid"), "x.answer")


def _answers(entries: list[_Entry], source: DataFrame) -> list[DataFrame]:
    """(qid, answer) of the plans of one entity: equal plans once, one scan for ``PLANS_AT_ONCE`` of them, and one for each column that is grouped by."""
    asked: dict[QueryPlan, list[str]] = {}
    for x in entries:
        asked.setdefault(replace(x.plan, filters=tuple(sorted(set(x.plan.filters), key=str))), []).append(x.qid)
    out, plain = [], [p for p in asked if p.op != "groupby"]
    for at in range(0, len(plain), PLANS_AT_ONCE):
        some = plain[at : at + PLANS_AT_ONCE]
        wanted = [algebra.reads(p) for p in some]
        rows = source if any(w is None for w in wanted) else source.filter(fold(lambda a, b: a | b, wanted))
        out.append(_stacked(rows.agg(*[algebra.answer(p).cast("double").alias(f"a{i}") for i, p in enumerate(some)]), [asked[p] for p in some]))
    for by in sorted({p.by for p in asked if p.op == "groupby"}):
        some = [p for p in asked if p.op == "groupby" and p.by == by]
        seen = lambda p: F.count_if(F.coalesce(algebra.matches(p.filters), F.lit(False)))
        inner = source.filter(F.col(by).isNotNull()).groupBy(by).agg(*[F.when(seen(p) > 0, algebra.reduction(p.fn, p.field, algebra.matches(p.filters))).alias(f"g{i}") for i, p in enumerate(some)])
        best = [(F.max if p.dir == "max" else F.min)(f"g{i}").cast("double").alias(f"a{i}") for i, p in enumerate(some)]
        out.append(_stacked(inner.agg(*best), [asked[p] for p in some]))
    return out


def _shape_answers(entries: list[_Entry], tables: dict[str, DataFrame]) -> list[DataFrame]:
    """(qid, answer) of shapes: a shape with the same parameters is run once for all clients that are asked about."""
    groups: dict[str, list[_Entry]] = {}
    for x in entries:
        alone = x.shape.person is not None or x.shape.client is None
        groups.setdefault(f"{x.qid}" if alone else f"{x.shape.shape} {sorted(x.shape.params.items(), key=str)} {x.shape.scope}", []).append(x)
    out = []
    for some in groups.values():
        first = some[0].shape
        if first.person is not None or first.client is None:
            out += [run_shape(x.shape, tables["work"], tables["invoice"], tables["credential"]).limit(1).select(F.lit(x.qid).alias("qid"), F.col("answer").cast("double").alias("answer")) for x in some]
            continue
        clients = sorted({x.shape.client for x in some})
        found = run_clients(first, clients, tables["work"], tables["invoice"])
        asked = F.create_map(*[F.lit(v) for c in clients for v in (c, [x.qid for x in some if x.shape.client == c])])
        out.append(found.select(F.explode(F.element_at(asked, F.col("client"))).alias("qid"), F.col("answer").cast("double").alias("answer")))
    return out


def answer_all(spark: SparkSession, questions: Iterable[tuple[str, str, str | None]], known: Known, vocabulary: Vocabulary, tables: dict[str, DataFrame], *, strict: bool = False) -> DataFrame:
    """Answers with plan, source and reason.

    Plans of one entity share their scans: one aggregation decides about their rewrites, one answers up to ``PLANS_AT_ONCE`` of them,
    so jobs grow with the entities that are asked about, not with the questions; answers stay in the result and never pass
    the driver.  An entity whose shared probe can't be planned has its plans probed one by one; a job that fails raises.

    A question without an answer says why: its source is empty where it was refused and "failed" where it failed by itself.
    ``strict`` is for questions that must all be answered as they stand: a bar stays even where it keeps no row, and a question
    that is refused, fails, or gets an answer that its unit can't have raises.
    """
    entries = [compiled(qid, text, kind, known, vocabulary, tables) for qid, text, kind in questions]
    done, parts = [x for x in entries if x.plan is None and x.shape is None], []
    for name in sorted({x.plan.entity for x in entries if x.plan is not None}):
        mine = [x for x in entries if x.plan is not None and x.plan.entity == name]
        try:
            mine = _probed(mine, tables[name], strict)
        except AnalysisException:
            mine = [_alone(x, tables[name], strict) for x in mine]
        done += mine
        parts += _answers([x for x in mine if x.plan is not None], tables[name])
    if strict and (lost := [x for x in done if x.plan is None]):
        raise PlanError(f"{len(lost)} of {len(entries)} questions have no answer: " + "; ".join(f"{x.qid}: {x.reason}" for x in lost))
    shaped = [x for x in entries if x.shape is not None]
    parts += _shape_answers(shaped, tables)
    asked = spark.createDataFrame([(x.qid, x.question, x.kind, str(x.plan or x.shape or ""), x.source, x.reason, x.sure) for x in done + shaped], "qid string, question string, answer_type string, plan string, source string, reason string, sure boolean")
    if not parts:
        return asked.select("qid", "question", "answer_type", F.lit(None).cast("double").alias("answer"), "plan", "source", "reason")
    found = fold(lambda a, b: a.unionByName(b), parts)
    low, high = (F.create_map(*[F.lit(v) for k, b in rewrite.UNITS.items() for v in (k, float(b[i]))]) for i in (0, 1))
    fits = F.col("sure") | F.col("answer").between(F.element_at(low, F.col("answer_type")), F.element_at(high, F.col("answer_type")))
    unfit = F.concat(F.lit("no "), F.col("answer_type"), F.lit(": "), F.col("answer").cast("string"))
    silent = F.col("source").isin("shape", "plan") & F.col("answer").isNull()
    reason = F.when(silent, "nothing selected").when(~fits, unfit).otherwise(F.col("reason"))
    answer = F.when(fits, F.col("answer"))
    if strict:
        answer = F.when(~fits, F.raise_error(F.concat("qid", F.lit(": "), unfit)).cast("double")).otherwise(F.col("answer"))
    return asked.join(found, "qid", "left").select("qid", "question", "answer_type", answer.alias("answer"), "plan", "source", reason.alias("reason"))


def _alone(x: _Entry, source: DataFrame, strict: bool = False) -> _Entry:
    try:
        return _probed([x], source, strict)[0]
    except AnalysisException as e:
        return _fallen(x, e)


def known_for(index: ValueIndex, questions: Iterable[str], work: DataFrame, *, states: Iterable[str] = (), own_names: Iterable[str] = ()) -> Known:
    """Names that these questions may mean, by an index of ``work`` (and ``credential``): the driver gets candidates, not the store.

    Titles come with their clients, people with the client of all their works where that is one.
    """
    asked = list(questions)
    names, counts = index.names(asked, [("work", "client"), ("work", "lead"), ("work", "work")])
    values, _ = index.said(asked)
    of = lambda table, column: tuple(sorted(values.get(table, {}).get(column, {}).values()))
    people, titles = names.get(("work", "lead"), ()), names.get(("work", "work"), ())
    has = set(work.columns)
    works: dict[str, str] = {}
    led: dict[str, tuple[str, ...]] = {}
    if titles and {"work", "client"} <= has:
        found = work.filter(F.col("work").isin(*titles)).groupBy("work").agg(F.min("client").alias("client"), *([F.min("lead").alias("lead")] if "lead" in has else []))
        for r in sorted(found.collect()):
            works[r["work"]] = r["client"]
            if "lead" in has and r["lead"]:
                led[r["lead"]] = (*led.get(r["lead"], ()), r["work"])
    alone: dict[str, str] = {}
    if people and {"lead", "client"} <= has:
        per = work.filter(F.col("lead").isin(*people)).groupBy("lead").agg(F.min("client").alias("client"), F.max("client").alias("last"))
        alone = {r["lead"]: r["client"] for r in per.filter(F.col("client") == F.col("last")).collect()}
    return Known(
        clients=names.get(("work", "client"), ()), people=people, works=works, led=led, categories=of("work", "category"), gradings=of("work", "grading"), roles=of("work", "role"),
        credentials=of("credential", "credential"), states=frozenset(s.lower() for s in states), own_names=tuple(own_names), only_client=alone,
        client_counts=tuple(sorted(counts.get(("work", "client"), {}).items())),
    )


def known_of(work: DataFrame, people: DataFrame, credential: DataFrame, *, states: Iterable[str] = (), own_names: Iterable[str] = ()) -> Known:
    """All names of a small store, collected once per session; ``known_for`` asks an index instead."""
    rows = work.select("work", "client", *[c for c in ("lead", "category", "grading", "role") if c in work.columns]).distinct().collect()
    stated = lambda c: tuple(sorted({r[c] for r in rows if c in r and r[c]}))
    led: dict[str, tuple[str, ...]] = {}
    for r in sorted(rows, key=str):
        if "lead" in r and r["lead"] and r["work"]:
            led[r["lead"]] = (*led.get(r["lead"], ()), r["work"])
    kinds = credential.select("credential").distinct().collect() if "credential" in credential.columns else []
    return Known(
        clients=stated("client"), people=tuple(sorted(r["name"] for r in people.select("name").distinct().collect() if r["name"])),
        works={r["work"]: r["client"] for r in rows if r["work"] and r["client"]}, led=led, categories=stated("category"), gradings=stated("grading"), roles=stated("role"),
        credentials=tuple(sorted(r["credential"] for r in kinds if r["credential"])), states=frozenset(s.lower() for s in states), own_names=tuple(own_names),
    )
