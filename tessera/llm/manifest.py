"""Merkle manifest of a dataset by superblock reduction.

Every row is a leaf; leaves of one group (a source) stand in the order of their
ids, and every ``FANOUT`` consecutive nodes become one.  A superblock is the
``FANOUT ** LEVELS`` leaves below one node that is ``LEVELS`` levels higher:
``applyInPandas`` collapses each to its root, the roots are reduced in the same
way until one node a group remains, and the groups' roots are reduced likewise
to the root of the manifest.  Going down again, a superblock's rows get the
siblings within it in front of those of its own root, so proofs are concatenated
from lower and upper parts and no group is ever held whole: a task sees one
superblock of 4,096 digests at most, however many rows a source has.

Places come from a range partition by (group, id) that is written once: counts
of its parts give each part's first place.  The window over these counts has as
many rows as there are parts; what the driver sees is the largest group's size.

Results for odd input: null values are digested as ``-``; a null source is a group of
its own and the first one; null ids come first and are never tampered with; rows with equal ids
stand in the order of their leaves (so repeated rows are leaves of their own,
with equal digests and each its own proof); texts of any length are digested on the JVM; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_crc, released, written

#: Nodes that become one; levels that one superblock spans.
FANOUT, LEVELS = 16, 3
BLOCK = FANOUT**LEVELS
#: Where this divides the id's checksum, the text is tampered with before the check.
TAMPERED = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def said(*values: Column) -> Column:
    """One text of all values: ``-`` for null, else the bytes' count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts))


def levels(n: Column) -> Column:
    """How often nodes must be joined until one remains: the hexadecimal digits of the last place."""
    return F.when(n <= 1, 0).otherwise(F.length(F.hex(n - 1)))


def placed(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with their place ``idx`` within ``grp`` in the given order, and the group's size ``n``."""
    by = [F.asc_nulls_first(c) for c in order]
    parts = written(rows.repartitionByRange(F.asc("grp"), *by).withColumn("part", F.spark_partition_id()), f"{label}-parts")
    counts, before = parts.groupBy("grp", "part").count(), Window.partitionBy("grp").orderBy("part")
    starts = counts.select(
        "grp", "part", (F.sum("count").over(before) - F.col("count")).alias("start"), F.sum("count").over(Window.partitionBy("grp")).alias("n"),
    )
    within = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*by))
    out = written(parts.join(starts, ["grp", "part"]).withColumn("idx", F.col("start") + within - 1).drop("part", "start"), f"{label}-placed")
    released(parts)
    return out


def _blocks(nodes: DataFrame, *columns: str) -> DataFrame:
    return nodes.select("grp", F.floor(F.col("idx") / BLOCK).alias("block"), "idx", "n", F.least(levels(F.col("n")), F.lit(LEVELS)).alias("depth"), "digest", *columns)


def _runs(nodes: list[str]) -> list[str]:
    """Consecutive nodes as joined text, one run for each node above."""
    return ["".join(nodes[k : k + FANOUT]) for k in range(0, len(nodes), FANOUT)]


def _collapse(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    """A superblock's root."""
    block = block.sort_values("idx")
    nodes, n = block["digest"].tolist(), int(block["n"].iloc[0])
    for _ in range(block["depth"].iloc[0]):
        nodes = [_digest(run) for run in _runs(nodes)]
    return pd.DataFrame({"grp": [key[0]], "idx": [key[1]], "n": [-(-n // BLOCK)], "digest": nodes})


def reduced(leaves: DataFrame, label: str) -> list[DataFrame]:
    """Tables of nodes (grp, idx, n, digest): the leaves, their superblocks' roots, and so on to one root a group."""
    tables = [leaves]
    while len(tables) == 1 or (tables[-1].agg(F.max("n")).first()[0] or 1) > 1:
        roots = _blocks(tables[-1]).groupBy("grp", "block").applyInPandas(_collapse, "grp string, idx long, n long, digest string")
        tables.append(written(roots, f"{label}-roots"))
    return tables


def _proofs(block: pd.DataFrame, upper: list[str]) -> list[list[str]]:
    """Each node's siblings by level, as ``before:after``, in the order of the block; the block's own follow."""
    nodes, at, out = block["digest"].tolist(), list(range(len(block))), [[] for _ in range(len(block))]
    width = len(_digest(""))
    for _ in range(block["depth"].iloc[0]):
        runs = _runs(nodes)
        for k, proof in enumerate(out):
            run, place = runs[at[k] // FANOUT], at[k] % FANOUT * width
            proof.append(f"{run[:place]}:{run[place + width :]}")
            at[k] //= FANOUT
        nodes = [_digest(run) for run in runs]
    return [[*own, *upper] for own in out]


def _descend(key: tuple, block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    block, top = block.sort_values("idx"), above.iloc[0]
    return pd.DataFrame({"grp": block["grp"], "idx": block["idx"], "proof": _proofs(block, list(top["proof"])), "subroot": top["subroot"], "root": top["root"]})


def _check(key: tuple, block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """Leaves with their proofs' digest and the root that follows from what is there now."""
    block, top = block.sort_values("idx"), above.iloc[0]
    proofs, folded = [], []
    for proof, leaf, now in zip(_proofs(block, list(top["proof"])), block["digest"], block["now"], strict=True):
        node = now or leaf
        for level in proof:
            before, _, after = level.partition(":")
            node = _digest(before + node + after)
        folded.append(node)
        proofs.append(_digest("".join(proof).replace(":", "")))
    out = pd.DataFrame({"doc_id": block["doc_id"].astype("Int64"), "leaf": block["digest"], "subroot": top["subroot"], "root": top["root"], "proof_sha256": proofs, "folded_root": folded})
    return out.assign(verified=out["folded_root"] == out["root"])


_ABOVE = "grp string, idx long, proof array<string>, subroot string, root string"


def _with_above(nodes: DataFrame, above: DataFrame, fn, schema: str, *columns: str) -> DataFrame:
    up = above.withColumnRenamed("idx", "block")
    return _blocks(nodes, *columns).groupBy("grp", "block").cogroup(up.groupBy("grp", "block")).applyInPandas(fn, schema)


def descended(tables: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``tops`` (one row a group) carried down to the roots of the leaves' superblocks."""
    above = tops
    for nodes in reversed(tables[1:-1]):
        above = _with_above(nodes, above, _descend, _ABOVE)
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether it still verifies after tampering."""
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.pmod(id_crc("doc_id"), F.lit(TAMPERED)) == 0, F.sha2(said(*values, F.translate("text", UPPER, LOWER)), 256))
    rows = docs.select(
        F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("source"))).alias("grp"), "doc_id",
        F.sha2(said(*values, F.col("text")), 256).alias("digest"), tampered.alias("now"),
    )
    leaves = placed(rows, ["doc_id", "digest"], "leaves")
    tables = reduced(leaves, "source")
    sources = placed(tables[-1].select(F.lit("").alias("grp"), F.col("grp").alias("source"), F.col("digest")), ["source"], "sources")
    over = reduced(sources, "manifest")
    root = over[-1].select("grp", "idx", F.array().cast("array<string>").alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    proofs = _with_above(sources, descended(over, root), _descend, _ABOVE).select("idx", "proof", "root")
    tops = sources.join(proofs, "idx").select(F.col("source").alias("grp"), F.lit(0).cast("long").alias("idx"), "proof", F.col("digest").alias("subroot"), "root")
    above = written(descended(tables, tops), "above")
    released(*tables[1:], *over, sources)
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _with_above(leaves, above, _check, schema, "doc_id", "now")


def _sql_said(text: str) -> str:
    parts = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"CASE WHEN {p} IS NULL THEN '-' ELSE octet_length(encode({p})) || ':' || {p} END" for p in parts) + ")"


def _sql_tree(name: str, leaves: str, key: str) -> str:
    return f"""{name}({key}, level, idx, n, digest) AS (
  SELECT {key}, 0, idx, n, digest FROM {leaves}
  UNION ALL SELECT {key}, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY {key}, level, idx // 16, n)"""


def _sql_sides(tree: str, key: str) -> str:
    frame = f"OVER (PARTITION BY {key}, level, idx // 16 ORDER BY idx ROWS BETWEEN"
    return f"""SELECT {key}, level, idx, coalesce(string_agg(digest, '') {frame} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(digest, '') {frame} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {tree} WHERE n > 1"""


def oracle_sql(crc: str) -> str:
    """The same in DuckDB; ``crc`` is the SQL of a text's checksum with ``{0}`` for the text."""
    fold = "list_reduce(list_prepend({'b': coalesce(now, digest), 'a': ''}, sides), lambda x, y: {'b': sha256(y.b || x.b || y.a), 'a': ''}).b"
    return f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS grp, {_sql_said("text")} AS digest,
    CASE WHEN {crc.format("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_sql_said(f"translate(text, '{UPPER}', '{LOWER}')")} END AS now FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM docs
), {_sql_tree("tree", "leaves", "grp")},
subroots AS (SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n, 0 AS every FROM tree WHERE n = 1),
{_sql_tree("above", "subroots", "every")},
sides AS ({_sql_sides("tree", "grp")}), above_sides AS ({_sql_sides("above", "every")}),
steps AS (
  SELECT l.grp, l.idx, s.level, s.a, s.b FROM leaves l JOIN sides s ON s.grp = l.grp AND s.idx = l.idx // CAST(pow(16, s.level) AS BIGINT)
  UNION ALL SELECT l.grp, l.idx, 100 + s.level, s.a, s.b FROM leaves l JOIN subroots r ON r.grp = l.grp JOIN above_sides s ON s.idx = r.idx // CAST(pow(16, s.level) AS BIGINT)
), proofs AS (SELECT grp, idx, list({{'b': b, 'a': a}} ORDER BY level) AS sides FROM steps GROUP BY grp, idx),
checked AS (
  SELECT l.doc_id, l.digest AS leaf, r.digest AS subroot, t.digest AS root, list_transform(coalesce(p.sides, []), lambda x: x.b || x.a) AS proof,
    CASE WHEN p.sides IS NULL THEN coalesce(now, l.digest) ELSE {fold.replace("digest", "l.digest")} END AS folded_root
  FROM leaves l JOIN subroots r ON r.grp = l.grp JOIN above t ON t.n = 1 LEFT JOIN proofs p ON p.grp = l.grp AND p.idx = l.idx
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM checked
"""
