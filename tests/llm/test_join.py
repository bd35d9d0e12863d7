import random

import numpy as np
import pandas as pd
import pytest

from tessera.llm import ngram_join

from .conftest import ODD, plain_components


def family_docs(seed=3):
    """Families of near copies at many distances, chains, subsets, a passage that all share, and copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 5)))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([6, 12, 30, 80, 200]))]
        if rng.random() < 0.5:
            base = base[: rng.randint(0, len(base))] + passage[: rng.randint(10, 60)] + base
        for _ in range(rng.randint(1, 7)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                k = rng.randrange(len(text))
                text[k : k + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
            cut = rng.choice([0, 0, 0, len(text) // 6])
            out.append(" ".join(text[cut:]) if rng.random() < 0.8 else "\n".join(text).upper())
    out += out[::9]
    for size in (20, 40, 60):  # one passage with more and more words of their own behind it
        out += [" ".join(passage[:size] + [f"own{k}x{j}" for j in range(k)]) for k in range(0, 16) for _ in range(2)]
        out += [" ".join([f"mine{k}x{j}" for j in range(k)] + passage[:size]) for k in range(1, 16, 3)]
    return list(enumerate(out, start=100))


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize(("block", "hot", "batch"), [(1024, 64, 2048), (3, 1, 16), (2, 2, 7)])
def test_join_is_exact(spark, monkeypatch, block, hot, batch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    monkeypatch.setattr(ngram_join, "LOCALLY_HOT", hot)
    monkeypatch.setattr(ngram_join, "BATCH_DOCS", batch)
    docs = family_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = plain_components(docs)
    assert len({c for _, c in want.values()}) < len(want)
    assert got(ngram_join.join_components(df)) == want


def test_blocks_find_what_all_pairs_find():
    docs = family_docs(9)
    want = plain_components(docs)
    sets = {i: ngram_join.shingles(t) for i, t in docs}
    rows = ngram_join.block_links(list(sets), [len(s) for s in sets.values()], [0] * len(sets), list(sets.values()))
    assert {a: b for a, b, _ in rows} == {i: c for i, (_, c) in want.items()}
    overlap = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    whole = ngram_join.block_links(list(sets), [len(s) for s in sets.values()], [10**6] * len(sets), list(sets.values()))
    for a, _, reach in whole:  # nobody is done, so every reach is the farthest
        partners = [9 * overlap(a, b) // 4 - len(sets[b]) for b in sets if b != a and len(sets[b]) and overlap(a, b) >= ngram_join.needed(len(sets[a]), len(sets[b]))]
        assert reach == max([9 * len(sets[a]) // 4 - len(sets[a]), *partners])


def test_odd_rows(spark, odd_docs, no_docs):
    rows = ngram_join.join_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    want = plain_components([(i, t) for i, t in enumerate(ODD)])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == want
    assert want[5][1] == want[6][1] == 5
    assert {(r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is None} == {(1, None), (0, None)}
    assert ngram_join.join_components(no_docs).count() == 0
    kept = ngram_join.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [i for i in range(len(ODD)) if i != 6]
    assert kept.filter("doc_id is null").count() == 2
    assert ngram_join.representatives(no_docs).count() == 0


def test_repeated_ids_with_other_texts(spark, monkeypatch):
    """An id has the links of all its rows, and speaks for each of their kinds alone."""
    passage, other = (" ".join(f"{w}{k}" for k in range(84)) for w in ("shared", "common"))  # 80 shingles each
    docs = [(1, passage), (1, other)] + [(10 + k, f"{passage} " + " ".join(f"own{k}x{j}" for j in range(20 + k))) for k in range(4)]
    docs += [(20 + k, f"{other} " + " ".join(f"mine{k}x{j}" for j in range(k))) for k in range(1, 24)]
    plain = plain_components([(100 * k + i, t) for k, (i, t) in enumerate(docs)])
    joined = {i: {c % 100 for k, (j, _) in enumerate(docs) if j == i for c in [plain[100 * k + j][1]]} for i, _ in docs}
    for block in (256, 2):
        monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
        rows = got(ngram_join.join_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)))
        assert {i: c == 1 for i, (_, c) in rows.items()} == {i: joined[i] == {1} for i in joined}
    assert joined[10] == {1} != joined[11] and joined[40] == {1} != joined[41]


def test_boundary_of_eighty_percent(spark):
    base = [f"w{k}" for k in range(94)]  # 90 shingles
    at = [*base[:-10], *[f"x{k}" for k in range(10)]]  # shares 80 of 100
    below = [*base[:-11], *[f"y{k}" for k in range(11)]]  # shares 79 of 101
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(at)), (3, " ".join(below))], "doc_id long, text string")
    assert got(ngram_join.join_components(df)) == {1: (90, 1), 2: (90, 1), 3: (90, 3)}


def labels_and_rounds(spark, monkeypatch, edges):
    made = []
    keep = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, label: made.append(label) or keep(df, label))
    labels = {r["v"]: r["label"] for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    return labels, made.count("edges"), made.count("pointers")


def test_components_of_long_chains(spark, monkeypatch):
    """Rounds grow with the logarithm, whatever the order of ids along the chain."""
    n = 2000
    rng = random.Random(1)
    zigzag = [k // 2 if k % 2 == 0 else n - 1 - k // 2 for k in range(n)]
    shuffled = rng.sample(range(n), n)
    for ids in (list(range(n)), zigzag, shuffled):
        edges = list(zip(ids, ids[1:], strict=False)) + [(5000, 5001), (7, 7)]
        labels, rounds, pointers = labels_and_rounds(spark, monkeypatch, edges)
        assert labels == {**{i: 0 for i in range(n)}, 5000: 5000, 5001: 5000}
        assert rounds <= 12 and pointers <= 24


def test_components_of_stars_and_nothing(spark, monkeypatch):
    labels, rounds, _ = labels_and_rounds(spark, monkeypatch, [(999, k) for k in range(100)] + [(500, 998), (998, 999)])
    assert set(labels.values()) == {0} and len(labels) == 103 and rounds <= 5
    assert labels_and_rounds(spark, monkeypatch, [])[0] == {}


def test_many_documents_around_one_passage(spark, monkeypatch):
    """Documents that share four fifths of their text and nothing else: one kind, whose rows travel once."""
    passage = " ".join(f"shared{k}" for k in range(84))  # 80 shingles
    docs = [(i, f"{passage} " + " ".join(f"own{i}x{k}" for k in range(20 + i % 2))) for i in range(4000)]  # 100 or 101: overlaps of 80, 89 or more are needed
    docs += [(10_000, passage), (10_001, passage + " tail")]
    made = {}
    keep = ngram_join.written

    def counting(df, label):
        out = keep(df, label)
        made[label] = made.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "written", counting)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = got(ngram_join.join_components(df))
    # the passage alone has 80 shingles: with one of 100 it needs 80
    assert {c for i, (_, c) in rows.items() if i % 2 == 0 or i >= 10_000} == {0}
    assert all(c == i for i, (_, c) in rows.items() if i % 2 == 1 and i < 10_000)
    assert made["spoken"] <= 10 and made.get("members", 0) <= 10 and made.get("meet", 0) <= 10


def test_sql_says_the_same(spark):
    import duckdb

    docs = pd.DataFrame(family_docs(5), columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", docs)
    rows = con.execute(ngram_join.ORACLE_SQL).fetchall()
    assert {i: (n, c) for i, n, c in rows} == plain_components(list(docs.itertuples(index=False, name=None)))


def test_what_batches_send_for_themselves_is_spread():
    homes = [ngram_join._home((task << 24) + k, 6) for task in range(200) for k in range(4)]
    assert max(homes.count(b) for b in range(64)) < 4 * len(homes) / 64 and set(homes) <= set(range(64))


def test_work_tables_can_be_released(spark):
    from pathlib import Path

    from tessera.llm import common

    table = common.written(spark.range(3).toDF("x"), "some")
    assert table.count() == 3 and Path(table.written_at).exists()
    common.released(table, table, spark.range(2))
    assert not Path(table.written_at).exists()


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from tessera.llm import common

    conf = SimpleNamespace(get=lambda *_: None)
    session = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.work_root(session("spark://host:7077"))
    assert common.work_root(session("local[2]"))
    shared = SimpleNamespace(get=lambda *_: "/shared/folder/")
    assert common.work_root(SimpleNamespace(conf=shared, sparkContext=None)) == "/shared/folder"


def test_a_step_takes_its_tables_along(spark):
    from pathlib import Path

    from tessera.llm import common

    first = common.written(spark.range(5).toDF("x"), "first")
    inner = []

    def step():
        inner.append(common.written(first.filter("x > 1"), "inner"))
        return inner[0].filter("x > 2")

    second = common.settled(step, "second", first)
    assert second.count() == 2 and Path(second.written_at).exists()
    assert not Path(inner[0].written_at).exists() and not Path(first.written_at).exists()
