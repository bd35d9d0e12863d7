"""Entity resolution that refuses rather than guesses.

Batch form: mentions are matched with a table of names by exact key, then by
containment of tokens weighted by rarity.  What counts is what was said: names that hold the
same said words tie, however much else they hold; unless just one of them is said whole, the
mention resolves to null and is flagged ambiguous, which isn't the same as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.work import settled

RECALL = 0.30  # least share of a name's weight that a mention must carry
SMALL = ("the", "our", "a", "an", "of", "for", "and", "we", "us", "client", "account", "file")  # say nothing about which name is meant
SALTED = 50  # names of one token that a join key holds about


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def token_table(names: DataFrame) -> DataFrame:
    """(n, t, df, full, left, size) of names: their tokens, in how many names each stands, the name's whole weight, what the tokens
    up to this one (the most frequent first) weigh, and how many tokens it has."""
    words = names.select("n", F.explode(F.array_distinct(tokens(F.col("n")))).alias("t"))
    df = words.groupBy("t").agg(F.count("*").alias("df"))
    of_name = Window.partitionBy("n")  # as many rows as a name has words
    so_far = of_name.orderBy(F.desc("df"), "t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weight = 1 / F.col("df")
    return words.join(df, "t").select("n", "t", "df", F.sum(weight).over(of_name).alias("full"), F.sum(weight).over(so_far).alias("left"), F.count("*").over(of_name).alias("size"))


def resolve(mentions: DataFrame, names: DataFrame, *, mention: str = "mention", name: str = "name") -> DataFrame:
    """(mention, name, confidence, ambiguous) of every distinct mention.

    The join is on each name's rarest tokens, however frequent they are: those without
    which the rest weighs less than RECALL, so that every name that reaches it is a
    candidate.  A token of many names is dealt out over salted keys.  A mention that
    reaches no name so, but whose words all stand in one name and no other, is that name;
    where they stand in several it is ambiguous.  Words under which no name is keyed are asked nowhere, however
    many names hold them.  Names with their tokens are written once,
    and so are the mentions with theirs.
    """
    said = settled(mentions.select(F.trim(mention).alias("m")).filter(F.col("m").isNotNull()).distinct().withColumn("ts", F.array_distinct(tokens(F.col("m")))))
    known = names.select(F.trim(name).alias("n")).filter(F.col("n").isNotNull()).distinct()
    held = settled(token_table(known))
    spelt = held.select(F.lower("n").alias("k"), "n").distinct().groupBy("k").agg(F.min("n").alias("n"), F.count("*").alias("c"))
    exact = said.join(spelt, F.lower("m") == F.col("k")).select("m", F.when(F.col("c") == 1, F.col("n")).alias("n"), F.lit(1.0).alias("confidence"), (F.col("c") > 1).alias("ambiguous"))
    rest = said.join(exact.select("m"), "m", "left_anti")
    keyed = held.filter(F.col("left") >= RECALL * F.col("full") - 1e-9).select("n", "t")
    pairs = _met(rest.select("m", F.explode("ts").alias("t")), keyed).select("m", "n").distinct()
    scored = pairs.join(rest, "m").join(held, "n").filter(F.array_contains("ts", F.col("t")))
    scored = scored.groupBy("m", "n").agg(F.round(F.sum(1 / F.col("df")), 9).alias("got"), F.first("full").alias("full"), (F.count("*") == F.first("size")).alias("whole"))
    good = scored.filter(F.col("got") / F.col("full") >= RECALL - 1e-9)
    per = good.groupBy("m", "got").agg(F.count("*").alias("c"), F.min("n").alias("n"), F.count_if("whole").alias("wholes"), F.min(F.when(F.col("whole"), F.col("n"))).alias("w"), F.max(F.col("got") / F.col("full")).alias("share"))
    best = per.groupBy("m").agg(F.max_by(F.struct("c", "n", "wholes", "w", "share"), "got").alias("x")).select("m", "x.*")
    one = F.when(F.col("c") == 1, F.col("n")).when(F.col("wholes") == 1, F.col("w"))
    fuzzy = best.select("m", one.alias("n"), F.when(one.isNotNull(), F.col("share")).otherwise(0.0).alias("confidence"), one.isNull().alias("ambiguous"))
    found = settled(exact.unionByName(fuzzy))
    found = found.unionByName(_contained(said.join(found.select("m"), "m", "left_anti"), held))
    return said.join(found, "m", "left").select(F.col("m").alias(mention), F.col("n").alias(name), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def _met(asked: DataFrame, keyed: DataFrame) -> DataFrame:
    """``asked`` (m, t) with the names of ``keyed`` (n, t) under the same word; a word under which many stand is dealt out over salted keys."""
    many = keyed.groupBy("t").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("salts"))
    dealt = keyed.join(many, "t").withColumn("salt", F.pmod(F.xxhash64("n"), F.col("salts")).cast("int")).drop("salts")
    return asked.join(many, "t").select("m", "t", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(dealt, ["t", "salt"])


def _contained(said: DataFrame, held: DataFrame) -> DataFrame:
    """(m, n, confidence, ambiguous) of mentions all of whose words, but for small ones, stand in names."""
    small = F.array(*[F.lit(w) for w in SMALL])
    heard = said.select("m", F.array_except("ts", small).alias("ts")).filter(F.size("ts") > 0)
    words = heard.select("m", F.size("ts").alias("want"), F.explode("ts").alias("t")).join(held.select("t", "df").distinct(), "t")
    rarest = words.groupBy("m").agg(F.min_by("t", F.struct("df", "t")).alias("t"), F.count("*").alias("known"), F.first("want").alias("want")).filter(F.col("known") == F.col("want"))
    found = _met(rarest.select("m", "t"), held.select("n", "t", "size"))
    of_name = held.groupBy("n").agg(F.collect_set("t").alias("has"))  # as many as a name has words
    whole = found.join(heard, "m").join(of_name, "n").filter(F.size(F.array_except("ts", "has")) == 0).withColumn("want", F.size("ts"))
    per = whole.groupBy("m").agg(F.min("n").alias("n"), F.max("n").alias("last"), F.max(F.col("want") / F.col("size")).alias("share"))
    one = F.col("n") == F.col("last")
    return per.select("m", F.when(one, F.col("n")).alias("n"), F.when(one, F.col("share")).otherwise(0.0).alias("confidence"), (~one).alias("ambiguous"))


def within_one_edit(a: Column, b: Column) -> Column:
    """One insertion, deletion, substitution or swap of neighbours."""
    size = F.least(F.length(a), F.length(b))
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))),
        lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b,
    )
    return (F.levenshtein(a, b) <= 1) | (F.length(a) == F.length(b)) & swapped


def contiguous_run(text: Column, phrase: Column) -> Column:
    """Longest number of the phrase's tokens, in order and unbroken, that stand unbroken in the text."""
    words = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    want = tokens(phrase)
    size = F.size(want)
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(size, F.lit(1))),
        lambda i: F.aggregate(
            F.sequence(i, F.greatest(size, F.lit(1))), F.lit(0),
            lambda best, j: F.when(F.contains(words, F.concat(F.lit(" "), F.array_join(F.slice(want, i, j - i + 1), " "), F.lit(" "))), F.greatest(best, j - i + 1)).otherwise(best),
        ),
    )
    return F.when(size > 0, F.array_max(runs)).otherwise(0)
