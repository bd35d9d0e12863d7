"""The same question in other words: a registry of rewrites, and what a planner makes of them.

A rewrite changes how a question is put and not what it asks; one that doesn't apply returns the
question as it was and isn't counted.  ``stress`` answers all rewordings as one batch and counts, for
each rewrite, which answers stay, which questions are refused, and which come out wrong: a refusal is
no wrong answer.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from random import Random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .answer import answer_all
from .compile import Vocabulary
from .mine import Known
from .semantic import PIVOTS

Rewrite = Callable[[str, Random], str]
BANKS: dict[str, dict[str, Rewrite]] = {}


def _bank(bank: str, **rewrites: Rewrite) -> None:
    BANKS.setdefault(bank, {}).update(rewrites)


def _swap(q: str, pairs: Iterable[tuple[str, str]]) -> str:
    """The first phrase that stands in the question, replaced."""
    for a, b in pairs:
        out = re.sub(rf"(?<![\w-]){re.escape(a)}(?![\w-])", b, q, count=1, flags=re.IGNORECASE)
        if out != q:
            return out
    return q


def _typo(change: Callable[[str, Random], str]) -> Rewrite:
    """One changed word among those whose spelling is corrected."""

    def rewrite(q: str, rng: Random) -> str:
        ws = [m for m in re.finditer(r"[A-Za-z]+", q) if m.group().lower() in PIVOTS and len(m.group()) >= 6]
        if not ws:
            return q
        m = rng.choice(ws)
        return q[: m.start()] + change(m.group(), rng) + q[m.end() :]

    return rewrite


def _inner(word: str, rng: Random) -> int:
    return rng.randrange(1, len(word) - 2)


def _exchanged(word: str, rng: Random) -> str:
    spots = [k for k in range(1, len(word) - 2) if word[k] != word[k + 1]]
    k = rng.choice(spots)
    return word[:k] + word[k + 1] + word[k] + word[k + 2 :]


def _fronted(q: str, rng: Random) -> str:
    m = re.match(r"^(.*\S)\s+(in|from)\s+([A-Z][\w-]*)\?$", q)
    return f"{m.group(2).capitalize()} {m.group(3)}, {m.group(1)[0].lower()}{m.group(1)[1:]}?" if m else q


def _respelt(q: str, form: Callable[[float], str]) -> str:
    return re.sub(r"INR (\d+) Cr\b", lambda m: form(float(m.group(1))), q)


def _grouped(n: int) -> str:
    """Digits in the Indian way: three, then by twos."""
    head, tail = str(n)[:-3], str(n)[-3:]
    parts = [head[max(0, k - 2) : k] for k in range(len(head), 0, -2)][::-1]
    return ",".join([*parts, tail]) if head else tail


_bank(
    "form",
    capitals=lambda q, r: q.upper(), small=lambda q, r: q.lower(), unmarked=lambda q, r: q.rstrip("?"), spaced=lambda q, r: q.replace(" ", "  "), broken=lambda q, r: q.replace(" ", "\n", 2),
    dotted=lambda q, r: q.rstrip("?") + " ...?", twice_marked=lambda q, r: q + "??",
)
_bank(
    "manners",
    please=lambda q, r: f"Please tell us: {q}", kindly=lambda q, r: f"Could you kindly say: {q}", thanks=lambda q, r: f"{q} Thank you.", greeting=lambda q, r: f"Dear Sir, {q}", regards=lambda q, r: f"{q} Regards.",
    want=lambda q, r: f"We want to know: {q}", records=lambda q, r: f"By our records, {q[0].lower()}{q[1:]}", as_asked=lambda q, r: f"Here is what they ask: {q}",
)
_bank(
    "noise",
    believed=lambda q, r: f"{q} I believe it was INR 77 Cr.", told=lambda q, r: f"We were told INR 5 Cr. {q}", thought=lambda q, r: f"They think it is 12 lakh. {q}", reference=lambda q, r: f"Ref BOARD/2026/003. {q}",
    standard=lambda q, r: f"As per ISO 9001:2015, {q[0].lower()}{q[1:]}",
)
_bank(
    "typing",
    exchanged=_typo(_exchanged), left_out=_typo(lambda w, r: (lambda k: w[:k] + w[k + 1 :])(_inner(w, r))), doubled=_typo(lambda w, r: (lambda k: w[:k] + w[k] + w[k:])(_inner(w, r))),
    mistaken=_typo(lambda w, r: (lambda k: w[:k] + ("x" if w[k] != "x" else "z") + w[k + 1 :])(_inner(w, r))),
)
_bank(
    "synonyms",
    things=lambda q, r: _swap(q, [("works", "projects"), ("projects", "works"), ("equipment", "machines")]), mean=lambda q, r: _swap(q, [("average", "mean")]), big=lambda q, r: _swap(q, [("largest", "biggest"), ("highest", "largest")]),
    little=lambda q, r: _swap(q, [("smallest", "lowest")]), number=lambda q, r: _swap(q, [("how many", "what is the number of")]), aside=lambda q, r: _swap(q, [("outside", "other than in"), ("besides", "aside from"), ("rather than", "except")]),
    bounds=lambda q, r: _swap(q, [("more than", "above"), ("at least", "not less than"), ("or less", "or below"), ("not more than", "up to")]), earlier=lambda q, r: _swap(q, [("completed before", "completed prior to"), ("completed after", "completed later than"), ("completed until", "completed up to"), ("from 1997 onwards", "since 1997")]),
    done=lambda q, r: _swap(q, [("completed", "finished")]), altogether=lambda q, r: _swap(q, [("total", "combined")]),
)
_bank(
    "order_and_figures",
    fronted=_fronted, in_crore=lambda q, r: _respelt(q, lambda n: f"{n:g} crore"), in_lakh=lambda q, r: _respelt(q, lambda n: f"Rs. {n * 100:g} lakh"), in_digits=lambda q, r: _respelt(q, lambda n: "INR " + _grouped(int(n * 10_000_000))),
)


def rewordings(question: str, seed: int = 1) -> dict[str, str]:
    """Every rewrite that changes the question, by ``bank.name``."""
    out = {}
    for bank, rewrites in BANKS.items():
        for name, rewrite in rewrites.items():
            new = rewrite(question, Random(f"{seed} {name} {question}"))
            if new != question:
                out[f"{bank}.{name}"] = new
    return out


def reworded_answers(spark: SparkSession, questions: Iterable[tuple[str, str]], known: Known, vocabulary: Callable[[list[str]], Vocabulary], tables: dict[str, DataFrame]) -> DataFrame:
    """(qid, rewrite, question, answer, reason) of every rewording of (qid, question), as one batch."""
    rows = [(qid, name, text) for qid, q in questions for name, text in rewordings(q).items()]
    asked = [(f"{qid}|{name}", text, None) for qid, name, text in rows]
    out = answer_all(spark, asked, known, vocabulary([text for _, text, _ in asked]), tables)
    parts = F.split("qid", "[|]")
    return out.select(parts[0].alias("qid"), parts[1].alias("rewrite"), "question", "answer", "reason")


def stress(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """(rewrite, n, same, refused, wrong): ``answers`` as above against ``gold`` (qid, answer)."""
    both = answers.join(gold.select("qid", F.col("answer").alias("right")), "qid")
    same = F.col("answer").eqNullSafe(F.col("right"))
    return both.groupBy("rewrite").agg(F.count("*").alias("n"), F.count_if(same).alias("same"), F.count_if(F.col("answer").isNull() & ~same).alias("refused"), F.count_if(F.col("answer").isNotNull() & ~same).alias("wrong"))
