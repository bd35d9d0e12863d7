"""Plain versions that the tests compare with."""

import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")

ODD = [
    None, "", " \n\t ", "one", "one two three four", "a b c d e", "A b C d e", "\x00 \x0b x", "é" * 40, "😀 漢字 ▁ text", "x " * 3000,
    "password: hunter2hunter2 and AKIA" + "A1" * 8, "<|endoftext|> It's 42", "word\n\nword\nword\nother", "a" * 5000,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t or ""), i, "x") for i, t in enumerate(ODD)]
    rows += [(5, "a b c d e", "en", "s", 9, 1, "y"), (None, "null id text here now", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long, piece string")


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def plain_components(docs):
    """doc_id: (set size, class) by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in docs}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}
