"""Quality rules with adaptive thresholds, on DataFrame functions alone.

Fixed base rules come first.  What passes is judged against its own kind: for
each language and source, mergeable quantile sketches (built per partition, merged
by the aggregation, at three levels in one rollup) give the quartiles of every
ratio, and a document is rejected where a ratio lies beyond the quartile by more than
``FENCE`` times the spread between quartiles (at least a floor, so that a group of equal
values rejects nothing near them).  Groups with fewer than ``LEAST`` documents
take the thresholds of their language, and languages with fewer those of all.

Defined results: null, empty and blank texts have zero counts and fail the base
rules; null languages and sources are groups of their own; repeated rows count
once each; an empty table gives no rows; other columns may have any names.

The quartiles are exact while a group has fewer than about ``ACCURACY`` values; beyond that
their rank is off by at most 1 / ``ACCURACY`` of the group, and as partial sketches merge
in the order in which they arrive, two runs may differ within that bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 5
LEAST = 50
FENCE = 3.0
ACCURACY = 10_000
#: ratio: (least spread between quartiles, whether low values are rejected too)
RATIOS = {"symbols": (0.1, False), "dup_lines": (0.1, False), "repeats": (0.05, False), "word_size": (1.0, True)}
_SPACE = " \t\n\x0b\f\r"
_M = "__rule_"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def _repeated(words: Column, hashes: Column) -> Column:
    """Words in windows that occur twice or more; hashes: of the windows by position."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def covered(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        twice = F.filter(s, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda x: x["p"]))
        begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
        step = lambda acc, p: F.struct(
            (p + WINDOW).alias("end"), (acc["total"] + p + WINDOW - F.greatest(p, acc["end"])).alias("total")
        )
        return F.aggregate(starts, begin, step, lambda acc: acc["total"])

    # the sorted windows are bound once, as the only element of an array
    return F.get(F.transform(F.array(placed), covered), F.lit(0))


def with_measures(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of every whole text in columns of reserved names."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = F.size(f"{_M}words")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(f"{_M}words", i, WINDOW)))).otherwise(
        F.array().cast("array<bigint>")
    )
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _SPACE, "")) > 0)
    out = docs.withColumns({f"{_M}words": _words(text), f"{_M}lines": lines}).withColumn(f"{_M}hashes", hashes)
    distinct = F.size(F.array_distinct(f"{_M}hashes"))
    counts = {
        "n_words": n,
        "word_chars": F.length(F.translate(text, _SPACE, "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")),
        "n_lines": F.size(f"{_M}lines"),
        "n_dup_lines": F.size(f"{_M}lines") - F.size(F.array_distinct(f"{_M}lines")),
        "n_repeat_words": F.when(distinct == F.size(f"{_M}hashes"), 0).otherwise(_repeated(F.col(f"{_M}words"), F.col(f"{_M}hashes"))),
    }
    # made by a generator: no later filter can be pushed below it, which would count every text again for every use
    made = F.explode(F.array(F.struct(*[count.cast("long").alias(f"{_M}{name}") for name, count in counts.items()]))).alias(f"{_M}made")
    own = [F.col(c) for c in docs.columns]
    out = out.select(*own, made).select(*own, f"{_M}made.*")
    failed = (F.col(f"{_M}n_words") < 10) | (100 * F.col(f"{_M}n_repeat_words") > 20 * F.col(f"{_M}n_words"))
    return out.withColumn(f"{_M}failed", failed)


def with_groups(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Group keys (null is a key too) and the ratios that are judged."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    words = F.greatest(F.col(f"{_M}n_words"), F.lit(1))
    return docs.withColumns({
        f"{_M}lang": key(lang_col), f"{_M}source": key(source_col),
        f"{_M}symbols": F.col(f"{_M}n_symbols") / words,
        f"{_M}dup_lines": F.col(f"{_M}n_dup_lines") / F.greatest(F.col(f"{_M}n_lines"), F.lit(1)),
        f"{_M}repeats": F.col(f"{_M}n_repeat_words") / words,
        f"{_M}word_size": F.col(f"{_M}word_chars") / words,
    })


def thresholds(measured: DataFrame) -> DataFrame:
    """Per language and source: lowest and highest accepted value of every ratio."""
    lang, source = f"{_M}lang", f"{_M}source"
    sketches = [F.percentile_approx(f"{_M}{r}", [0.25, 0.75], ACCURACY).alias(r) for r in RATIOS]
    some = measured.filter(~F.col(f"{_M}failed"))
    levels = written(some.rollup(lang, source).agg(F.grouping_id().alias("level"), F.count("*").alias("size"), *sketches), "quartiles")
    low = lambda r: F.get(r, F.lit(0)) - FENCE * F.greatest(F.get(r, F.lit(1)) - F.get(r, F.lit(0)), F.lit(RATIOS[r][0]))
    high = lambda r: F.get(r, F.lit(1)) + FENCE * F.greatest(F.get(r, F.lit(1)) - F.get(r, F.lit(0)), F.lit(RATIOS[r][0]))
    own = levels.filter("level = 0")
    wider = levels.filter("level = 1").select(lang, F.col("size").alias("wide_size"), *[F.col(r).alias(f"wide_{r}") for r in RATIOS])
    whole = levels.filter("level = 3").first()  # one row of quartiles
    joined = own.join(wider, lang)
    for r in RATIOS:
        of_all = F.array(*[F.lit(float(x)) for x in whole[r]]) if whole and whole[r] else F.col(r)
        joined = joined.withColumn(r, F.when(F.col("size") >= LEAST, F.col(r)).when(F.col("wide_size") >= LEAST, F.col(f"wide_{r}")).otherwise(of_all))
    bounds = [c for r in RATIOS for c in (low(r).alias(f"{_M}low_{r}"), high(r).alias(f"{_M}high_{r}"))]
    return written(joined.select(lang, source, *bounds), "thresholds")


def judged(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """``measured`` with the verdict; documents of a group without passing ones have none to be measured by."""
    tests = [F.col(f"{_M}{r}") <= F.col(f"{_M}high_{r}") for r in RATIOS] + [F.col(f"{_M}{r}") >= F.col(f"{_M}low_{r}") for r, (_, both) in RATIOS.items() if both]
    fits = F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(True))
    return measured.join(bounds, [f"{_M}lang", f"{_M}source"], "left").withColumn(f"{_M}kept", ~F.col(f"{_M}failed") & fits)


def apply_rules(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that pass, with their own columns.

    Every text is measured once: the documents are written with their measures, the
    thresholds come from the measures alone, and the verdict filters what is read back.  Own
    columns travel under their positions, so no name of theirs can clash.
    """
    at = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*at.values())
    measured = written(with_groups(with_measures(own, text_col=at[text_col]), lang_col=at[lang_col], source_col=at[source_col]), "measured", compression="zstd")
    kept = judged(measured, thresholds(measured)).filter(f"{_M}kept")
    return kept.select(*[F.col(new).alias(old) for old, new in at.items()])


def rule_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts and verdict of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    measured = written(with_groups(with_measures(rows)).drop("text"), "measures")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = judged(measured, thresholds(measured))
    return out.select("doc_id", *[F.col(f"{_M}{c}").alias(c) for c in names], F.col(f"{_M}failed").alias("base_failed"), F.col(f"{_M}kept").alias("kept"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
m AS (
  SELECT doc_id, lang, source, text, w, l, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
         len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines
  FROM d),
win AS (
  SELECT doc_id, p, w[p] || ' ' || w[p+1] || ' ' || w[p+2] || ' ' || w[p+3] || ' ' || w[p+4] AS g
  FROM (SELECT doc_id, w, unnest(range(1, n_words - 3)) AS p FROM m WHERE n_words >= 5)),
twice AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cover AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM twice) GROUP BY doc_id),
r AS (
  SELECT m.*, coalesce(c.n_repeat_words, 0) AS n_repeat_words,
         n_words < 10 OR 100 * coalesce(c.n_repeat_words, 0) > 20 * n_words AS base_failed,
         n_symbols / greatest(n_words, 1) AS symbols, n_dup_lines / greatest(n_lines, 1) AS dup_lines,
         coalesce(c.n_repeat_words, 0) / greatest(n_words, 1) AS repeats, word_chars / greatest(n_words, 1) AS word_size
  FROM m LEFT JOIN cover c USING (doc_id)),
long AS (
  SELECT lang, source, x.k AS k, x.v AS v
  FROM (SELECT lang, source, unnest([{'k': 'symbols', 'v': symbols}, {'k': 'dup_lines', 'v': dup_lines}, {'k': 'repeats', 'v': repeats}, {'k': 'word_size', 'v': word_size}]) AS x
        FROM r WHERE NOT base_failed)),
ranked AS (
  SELECT k, lang, source, v,
         row_number() OVER (PARTITION BY k, lang, source ORDER BY v) AS i0, count(*) OVER (PARTITION BY k, lang, source) AS c0,
         row_number() OVER (PARTITION BY k, lang ORDER BY v) AS i1, count(*) OVER (PARTITION BY k, lang) AS c1,
         row_number() OVER (PARTITION BY k ORDER BY v) AS i2, count(*) OVER (PARTITION BY k) AS c2
  FROM long),
q0 AS (SELECT k, lang, source, max(c0) AS c, max(v) FILTER (i0 = ceil(c0 * 0.25)) AS a, max(v) FILTER (i0 = ceil(c0 * 0.75)) AS b FROM ranked GROUP BY ALL),
q1 AS (SELECT k, lang, max(c1) AS c, max(v) FILTER (i1 = ceil(c1 * 0.25)) AS a, max(v) FILTER (i1 = ceil(c1 * 0.75)) AS b FROM ranked GROUP BY ALL),
q2 AS (SELECT k, max(v) FILTER (i2 = ceil(c2 * 0.25)) AS a, max(v) FILTER (i2 = ceil(c2 * 0.75)) AS b FROM ranked GROUP BY ALL),
q AS (
  SELECT q0.k, q0.lang, q0.source,
         CASE WHEN q0.c >= 50 THEN q0.a WHEN q1.c >= 50 THEN q1.a ELSE q2.a END AS a,
         CASE WHEN q0.c >= 50 THEN q0.b WHEN q1.c >= 50 THEN q1.b ELSE q2.b END AS b,
         CASE q0.k WHEN 'repeats' THEN 0.05 WHEN 'word_size' THEN 1.0 ELSE 0.1 END AS least
  FROM q0 JOIN q1 ON q0.k = q1.k AND q0.lang IS NOT DISTINCT FROM q1.lang JOIN q2 ON q0.k = q2.k),
bad AS (
  SELECT DISTINCT r.doc_id FROM r JOIN q ON r.lang IS NOT DISTINCT FROM q.lang AND r.source IS NOT DISTINCT FROM q.source
  WHERE CASE q.k WHEN 'symbols' THEN r.symbols WHEN 'dup_lines' THEN r.dup_lines WHEN 'repeats' THEN r.repeats ELSE r.word_size END > q.b + 3.0 * greatest(q.b - q.a, q.least)
     OR q.k = 'word_size' AND r.word_size < q.a - 3.0 * greatest(q.b - q.a, q.least))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM r
"""
