"""The name join against all pairs, and its defined results for odd input."""

import random
import zlib

import pytest

from tessera.llm import name_join


def osa(a, b):
    """Optimal string alignment over the whole table."""
    if abs(len(a) - len(b)) > 2:
        return 3
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def edited(rng, name, alphabet):
    chars = list(name)
    for _ in range(rng.choice([0, 1, 2, 2, 2, 3])):
        k = rng.randrange(len(chars) + 1)
        kind = rng.choice(["insert", "delete", "replace", "swap", "swap"])
        if kind == "insert":
            chars.insert(k, rng.choice(alphabet))
        elif k < len(chars) and kind == "delete":
            del chars[k]
        elif k < len(chars) and kind == "replace":
            chars[k] = rng.choice(alphabet)
        elif k + 1 < len(chars):
            chars[k], chars[k + 1] = chars[k + 1], chars[k]
    return "".join(chars)


@pytest.mark.parametrize(("seed", "alphabet", "longest"), [(1, "ab", 7), (2, "abcdefgh", 24), (3, "abö😀z", 16)])
def test_all_pairs(seed, alphabet, longest):
    """Every qualifying pair shares a key, and the block's distance is the table's."""
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(25)]
    names = [x for x in {edited(rng, rng.choice(base), alphabet) for _ in range(130)} | set(base) if x]
    keys = {x: dict(enumerate(name_join.known_keys(x))).values() for x in names}
    by_key = {}
    for x, pairs in keys.items():
        for key, left, *_ in pairs:
            by_key.setdefault(key, []).append((left, x))
    missed = wrong = true = 0
    for a in names:
        met = {x for key, left, *_ in name_join.asking_keys(a) for other, x in by_key.get(key, ()) if other != left}
        near = names
        found = name_join._distances([a] * len(near), near).tolist()
        for b, distance in zip(near, found, strict=True):
            want = osa(a, b)
            wrong += (distance if distance <= 2 else 3) != min(want, 3)
            true += want <= 2
            missed += want <= 2 and b not in met
    assert true > 1.5 * len(names) and not missed and not wrong


def plain_join(clients, vendors):
    out = {}
    for vendor_id, stored in vendors:
        h = zlib.crc32(str(vendor_id).encode()) if vendor_id is not None else 1
        name = stored
        if name and len(name) >= 2 and h % 2 == 0:
            at = h % (len(name) - 1)
            name = name[:at] + name[at + 1] + name[at] + name[at + 2 :]
        for client_id, other in clients:
            if name and other and (distance := osa(name, other)) <= 2:
                out.setdefault((vendor_id, distance), []).append(client_id)
    return {k: (len(v), min((x for x in v if x is not None), default=None), sum(zlib.crc32(str(x).encode()) for x in v if x is not None)) for k, v in out.items()}


def test_figures_per_vendor(spark):
    rng = random.Random(7)
    base = ["Joelma Dalmaberber", "J. Dalmaberber", "Ann Lee", "Bo", "x", "Méni Leyvicströmez", "n" * 90, "😀 Ko", "Elsada oSngumani"]
    clients = [(k, edited(rng, rng.choice(base), "abe ö") or None) for k in range(150)] + [(900 + k, base[0]) for k in range(40)]
    clients += [(None, "Ann Lee"), (5, "Ann Lee"), (5, "Ann Lee"), (6, ""), (None, None), (7, " ")]
    vendors = [(k, edited(rng, name, "abe ö")) for k, name in enumerate(base * 2)] + [(0, base[0]), (0, base[0]), (None, "Ann Lee"), (50, None), (51, ""), (None, None)]
    c = spark.createDataFrame([(*r, "x", 1) for r in clients], "client_id long, name string, distance string, n long").repartition(5)
    v = spark.createDataFrame([(*r, "x", 1) for r in vendors], "vendor_id long, name string, asking string, key long")
    got = {(r["vendor_id"], r["distance"]): (r["n_clients"], r["first_client_id"], r["clients_crc"] or 0) for r in name_join.join_vendors(c, v).collect()}
    assert got == plain_join(clients, vendors)
    assert len(got) > 20


def test_hot_keys_are_split_without_loss(spark, monkeypatch):
    """Names with one ending for all: every key is split, and the pairs are the same."""
    rng = random.Random(9)
    base = [f"{''.join(rng.choice('abcd') for _ in range(rng.randint(0, 9)))} & Co Limited"[-22:] for _ in range(25)] + ["ab", "a", "Limited"]
    names = sorted({edited(rng, rng.choice(base), "abL ") for _ in range(220)} - {""})
    asking, known = (spark.createDataFrame([(n,) for n in some], f"{c} string") for some, c in ((names[::2], "asking"), (names, "known")))
    want = {(a, b, osa(a, b)) for a in names[::2] for b in names if osa(a, b) <= 2}
    for limit in (1 << 22, 400, 0):
        monkeypatch.setattr(name_join, "HOT_PAIRS", limit)
        assert {tuple(r) for r in name_join.near_names(asking, known).collect()} == want
    assert len(want) > 300


def test_empty_tables_and_no_growing_broadcast(spark):
    c = spark.createDataFrame([(1, "Ann Lee")], "client_id long, name string")
    v = spark.createDataFrame([], "vendor_id long, name string")
    assert name_join.join_vendors(c, v).count() == 0
    assert name_join.join_vendors(c.filter("false"), spark.createDataFrame([(1, "Ann Lee")], "vendor_id long, name string")).count() == 0
    plan = name_join.join_vendors(c, v)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()
