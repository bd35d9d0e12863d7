"""The Merkle manifest against a plain tree."""

import zlib
from hashlib import sha256

from tessera.llm import manifest


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = [*row[:4], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """All levels of one tree, and each leaf's (before, after) by level."""
    sides = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, own in enumerate(sides):
            run, place = nodes[at[k] // 16 * 16 : at[k] // 16 * 16 + 16], at[k] % 16
            own.append(("".join(run[:place]), "".join(run[place + 1 :])))
            at[k] //= 16
        nodes = [h("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0], sides


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        now = row[4]
        if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and now is not None:
            now = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in now)
        groups.setdefault(row[1], []).append((row[0], leaf_of(row, row[4]), leaf_of(row, now)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = climb([r[1] for r in groups[s]])
    if not order:
        return []
    root, above = climb([trees[s][0] for s in order])
    out = []
    for s, upper in zip(order, above, strict=True):
        for (doc_id, leaf, node), own in zip(groups[s], trees[s][1], strict=True):
            for before, after in own + upper:
                node = h(before + node + after)
            out.append((doc_id, leaf, trees[s][0], root, h("".join(b + a for b, a in own + upper)), node, node == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_levels_groups_and_odd_rows(spark):
    """Two rounds of superblocks for one source, a last run of one node, lone leaves, nulls anywhere, repeated rows."""
    rows = [(k * 3, "hot", "en", k, f"Text {k} É") for k in range(4097)]
    rows += [(k, f"s{k % 19}", None, None, "Ab" * (k % 7)) for k in range(500)] + [(7, "alone", "en", 1, None), (8, "", "en", 1, "")]
    rows += [(None, None, None, None, None), (None, None, None, None, "X"), (5, None, "de", 2, "Long " * 20000), (5, "s1", "de", 2, "Twice"), (5, "s1", "de", 2, "Twice"), (-4, "s1", "en", 1, "É")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    want = plain(rows)
    assert got(manifest.manifest(df)) == sorted(want, key=repr)
    assert {r[6] for r in want} == {True, False}


def test_small_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "en", 3, "One", 9, "x", 4)], SCHEMA + ", grp long, digest string, idx long")
    assert got(manifest.manifest(docs)) == plain([(1, "a", "en", 3, "One")])
    assert manifest.manifest(docs.filter("false")).collect() == []
    sources = [(k, f"source {k}", "en", 1, "T") for k in range(40)]
    assert got(manifest.manifest(spark.createDataFrame(sources, SCHEMA))) == sorted(plain(sources), key=repr)
