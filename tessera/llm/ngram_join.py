"""Jaccard self-join of documents on word shingles, exact at any corpus size.

Documents link when 100 * |A & B| >= 80 * |A | B| over their sets of
five-word shingles; the result is the connected component of every document.
The way there:

1. *Sets.*  Every batch of documents becomes sorted 64-bit shingle hashes; equal
   sets within a batch send one copy.  Hashes travel packed, dealt by their
   leading bits, so each bucket counts the documents of its shingles; the number of
   buckets follows the bytes of text.  A shingle that is frequent within one batch is
   sent once for all its documents.
2. *Only shared shingles can match.*  They go back to their documents with
   their frequency.  A document with fewer shared shingles than the least
   overlap it needs has no partner and is done; most are.
3. *Kinds.*  Documents with the same shared shingles differ in size alone, so they overlap
   with any other document alike, and a smaller one links wherever a larger one does.
   The smallest speaks for its kind; the others need no more than the *reach* of the kind:
   the largest size that some partner still links with.  A passage that thousands of
   documents share is one kind.
4. *Families.*  Among kinds, shingles are ordered by (frequency, hash).  Two
   linked documents must share one of the first n - ceil(0.8 n) + 1, so
   components over these few rare shingles keep all possible partners together.
5. *T-occurrence search* within a family, in blocks of bounded size: DivideSkip.
   The longest inverted lists are set aside, the short ones are heap-merged, and
   documents that occur often enough there are probed in the long lists by binary
   search until they reach the required overlap.  Partners that are already connected are
   skipped, as only connectivity (and reach) is asked for.  Families larger than a block
   are first joined in two random partitions into blocks.  Then they are dealt anew by their
   rarest shingle, and what is outside the family's largest component, or has reach to
   gain, is searched in those blocks that hold one of its rare shingles and a size
   it can link with; no pair of different components that could link stays unexamined.  A task
   holds one block and a bounded number of those that ask.
6. *Components* of the links found, in a logarithmic number of rounds; copies get the class of
   their set.

Hashes are made with 64 bits; a bucket sees the lower 48 and the up to 16 by which it was dealt.
Within the two sets of a pair of a thousand shingles each a false match has a chance of about
1e-9 at the fewest buckets.  Nothing is sampled or capped, and no list of documents is
collected: the driver sees counts alone.

Defined results: null, empty and blank texts have no shingles and no links; texts
of one to four words have their whole word sequence as one shingle; rows with a
null id have their own set size and a null component; repeated ids are one document
with the links of all their rows; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, settled, sliced, written

WORDS = 5
BATCH_DOCS = 2048
LOCALLY_HOT = 64  # more documents of a batch share a shingle: it is sent once
BLOCK_DOCS = 256
ASKING_DOCS = 2048  # documents that ask in a block, per task
BUCKET_BYTES = 1 << 25  # packed shingles a bucket holds about
MOST_BITS = 20
MU = 0.0085  # weight of the merge cost in DivideSkip's number of long lists
CACHE_WORDS = 250_000
_NONE = 0xFFFF
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S32, _S48, _S16 = np.uint64(32), np.uint64(48), np.uint64(16)
_LOW48 = np.uint64((1 << 48) - 1)
_SEEN: dict[bytes, int] = {}


def needed(n: int, m: int) -> int:
    """Least intersection of sets of n and m that links them."""
    return (4 * (n + m) + 8) // 9


def least_needed(n: int) -> int:
    """Least intersection with any partner: that of the smallest possible one."""
    return (4 * n + 4) // 5


def shingles(text: str | None) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes fold A-Z only and split at ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    try:
        h = np.fromiter(map(_SEEN.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(_SEEN) + len(words) > CACHE_WORDS:
            _SEEN.clear()
        for w in words:
            if w not in _SEEN:
                _SEEN[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(_SEEN.__getitem__, words), np.uint64, len(words))
    size = len(h) - WORDS + 1
    out = h[:size].copy()
    for k in range(1, WORDS):
        out = (out ^ (out >> _S32)) * _P + h[k : k + size]
    out = (out ^ (out >> _S32)) * _Q
    out ^= out >> _S32
    out.sort()
    keep = np.ones(size, bool)
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    return out[keep]


# ---------------------------------------------------------------- 1 and 2: sets and shared shingles

_DOC = np.dtype([("id", "<i8"), ("null", "?"), ("n", "<i4"), ("hi", "<i8"), ("lo", "<i8"), ("at", "<u2")])
_SHARED = np.dtype([("token", "<u8"), ("df", "<u4"), ("at", "<u2")])
_TRAVEL = "bucket int, batch long, kind string, payload binary"


def _sets(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() << 24
        for arrow in sliced(batches, BATCH_DOCS):
            ids, texts = (c.to_pylist() for c in arrow.columns)
            yield _one_batch(batch, ids, texts, bits)
            batch += 1
        _SEEN.clear()  # later stages run in the same worker

    return run


def _home(batch: int, bits: int) -> int:
    """Bucket of what a batch sends for itself: mixed, as the numbers of batches count up from every task's own start."""
    return xxhash.xxh3_64_intdigest(batch.to_bytes(8, "little")) & ((1 << bits) - 1)


def _one_batch(batch: int, ids: list, texts: list, bits: int) -> pa.RecordBatch:
    docs = np.zeros(len(ids), _DOC)
    docs["at"] = _NONE
    first: dict[tuple[int, int], int] = {}
    sets: dict[int, np.ndarray] = {}
    for k in range(len(ids)):
        h = shingles(texts[k])
        hi, lo = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), "<i8").tolist()
        docs[k] = (ids[k] or 0, ids[k] is None, len(h), hi, lo, _NONE)
        if len(h) and ids[k] is not None:
            old = first.get((hi, lo))
            if old is None:
                first[hi, lo] = k
                sets[k] = h
            elif ids[k] < ids[old]:  # the smallest id stands for equal sets
                first[hi, lo] = k
                sets[k] = sets.pop(old)
    for at, k in enumerate(sets):
        docs["at"][k] = at
    home = _home(batch, bits)
    buckets, kinds, payloads = [home], ["docs"], [docs.tobytes()]
    if sets:
        h = np.concatenate(list(sets.values()))
        at = np.repeat(np.arange(len(sets), dtype=np.uint64), [len(x) for x in sets.values()])
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        runs = np.diff(np.r_[starts, len(h)])
        if (hot := runs > LOCALLY_HOT).any():
            members = np.repeat(hot, runs)
            own = np.zeros(int(members.sum()), _SHARED)
            own["token"], own["at"] = h[members], at[members]
            buckets.append(home)
            kinds.append("hot")
            payloads.append(own.tobytes())
            marks = h[starts[hot]]
            h, at = np.concatenate((h[~members], marks)), np.concatenate((at[~members], np.full(len(marks), _NONE, np.uint64)))
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
        packed = (h & _LOW48) << _S16 | at
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        ends = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        for b in np.unique(bucket).tolist():
            buckets.append(b)
            kinds.append("set")
            payloads.append(packed[ends[b] : ends[b + 1]].tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int32()), pa.array([batch] * len(buckets), pa.int64()), pa.array(kinds), pa.array(payloads, pa.binary())],
        names=["bucket", "batch", "kind", "payload"],
    )


def _count_bucket(bits: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        passed = rows[rows["kind"] != "set"]
        rows = rows[rows["kind"] == "set"]
        out = [passed]
        if len(rows):
            parts = [np.frombuffer(x, "<u8") for x in rows["payload"]]
            packed = np.concatenate(parts)
            source = np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts])
            order = np.argsort(packed >> _S16, kind="stable")
            packed, source = packed[order], source[order]
            token, at = packed >> _S16, (packed & np.uint64(_NONE)).astype(np.uint16)
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            weight = np.where(at == _NONE, LOCALLY_HOT + 1, 1)
            df = np.repeat(np.add.reduceat(weight, starts), np.diff(np.r_[starts, len(token)]))
            keep = df > 1
            back = np.zeros(int(keep.sum()), _SHARED)
            top = np.uint64(int(key[0]) << 48) if bits <= 16 else np.uint64(int(key[0]) >> (bits - 16) << 48)
            back["token"] = top << np.uint64(max(0, 16 - bits)) | token[keep]
            back["df"], back["at"] = np.minimum(df[keep], 0xFFFFFFFF), at[keep]
            order = np.argsort(source[keep], kind="stable")
            back, source = back[order], source[keep][order]
            ends = np.searchsorted(source, np.arange(len(parts) + 1))
            batches = rows["batch"].to_numpy()
            some = [k for k in range(len(parts)) if ends[k] < ends[k + 1]]
            out.append(pd.DataFrame({
                "bucket": np.int32(key[0]), "batch": batches[some], "kind": "shared",
                "payload": [back[ends[k] : ends[k + 1]].tobytes() for k in some],
            }))
        return pd.concat(out)[["bucket", "batch", "kind", "payload"]]

    return run


def _assembly(bits: int):
    travels = _LOW48 | ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> np.uint64(min(bits, 16)))  # the bits of a hash that buckets see
    return lambda rows: _assemble(rows, travels)


def _assemble(rows: pd.DataFrame, travels: np.uint64) -> pd.DataFrame:
    """Documents of a batch that have enough shared shingles, in the common order."""
    docs = np.concatenate([np.frombuffer(x, _DOC) for x in rows.loc[rows["kind"] == "docs", "payload"]] or [np.zeros(0, _DOC)])
    shared = np.concatenate([np.frombuffer(x, _SHARED) for x in rows.loc[rows["kind"] == "shared", "payload"]] or [np.zeros(0, _SHARED)])
    marks = np.sort(shared[shared["at"] == _NONE], order="token")
    shared = [shared[shared["at"] != _NONE]]
    for x in rows.loc[rows["kind"] == "hot", "payload"]:
        own = np.frombuffer(x, _SHARED).copy()
        own["token"] &= travels
        own["df"] = marks["df"][np.searchsorted(marks["token"], own["token"])]
        shared.append(own)
    shared = np.concatenate(shared)
    docs = docs[docs["at"] != _NONE]
    n = np.zeros(len(docs), np.int64)
    n[docs["at"]] = docs["n"]
    ids = np.zeros(len(docs), np.int64)
    ids[docs["at"]] = docs["id"]
    have = np.bincount(shared["at"], minlength=len(docs))
    kept = have >= (4 * n + 4) // 5
    shared = shared[kept[shared["at"]]]
    shared = shared[np.lexsort((shared["token"], shared["df"], shared["at"]))]
    ends = np.searchsorted(shared["at"], np.arange(len(docs) + 1))
    out = []
    for k in np.flatnonzero(kept).tolist():
        tokens = shared["token"][ends[k] : ends[k + 1]].astype("<u8")
        size = int(n[k])
        first = size - least_needed(size) + 1 - (size - len(tokens))  # unshared ones stand before all others
        kind = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), "<i8").tolist()
        out.append((int(ids[k]), size, *kind, tokens.tobytes(), tokens[:first].view("<i8").tolist()))
    return pd.DataFrame(out, columns=["doc_id", "n", "kind_hi", "kind_lo", "tokens", "prefix"])


# ---------------------------------------------------------------- 4: T-occurrence search


class Index:
    """Inverted lists over the documents of one block, sorted by set size."""

    def __init__(self, ids: list[int], sizes: list[int], largest: list[int], tokens: list[np.ndarray]) -> None:
        self.order = order = sorted(range(len(ids)), key=lambda k: (sizes[k], ids[k]))
        self.ids, self.sizes, self.largest = [ids[k] for k in order], [sizes[k] for k in order], [largest[k] for k in order]
        self.tokens = [tokens[k] for k in order]
        every = np.concatenate(self.tokens) if ids else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(ids)), [len(t) for t in self.tokens])
        by = np.argsort(every, kind="stable")
        every, owner = every[by], owner[by]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
        self.keys = every[first]
        self.owner = owner.tolist()
        # places of all postings as one ascending sequence: list number, then rank
        self.place = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(every)])) * len(ids) + owner

    def lists(self, tokens: np.ndarray, low: int, high: int) -> list[list[int]]:
        """Non-empty inverted lists of tokens within the rank window, shortest first."""
        at = np.minimum(np.searchsorted(self.keys, tokens), len(self.keys) - 1)
        at = at[self.keys[at] == tokens] * len(self.ids)
        begin, end = np.searchsorted(self.place, at + low), np.searchsorted(self.place, at + high)
        some = begin < end
        return sorted((self.owner[a:b] for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True)), key=len)

    def search(self, tokens: np.ndarray, n: int, low: int, high: int, skip: np.ndarray) -> Iterator[tuple[int, int]]:
        """(rank, overlap) in [low, high) of those that reach the overlap; those marked in skip are left out as they come up."""
        least = needed(n, self.sizes[low])
        lists = self.lists(tokens, low, high)
        if len(lists) < least:
            return
        longest = len(lists[-1])
        long = min(least - 1, int(least / (MU * math.log2(longest + 1) + 1)), len(lists) - 1)
        short, probed = lists[: len(lists) - long], lists[len(lists) - long :]
        for rank, run in groupby(heapq.merge(*short)):
            if skip[rank]:
                continue
            found, target = sum(1 for _ in run), needed(n, self.sizes[rank])
            if found < target - long:
                continue
            for k, ranks in enumerate(probed):
                if found + len(probed) - k < target:
                    break
                at = bisect_left(ranks, rank)
                found += at < len(ranks) and ranks[at] == rank
            if found >= target:
                yield rank, found


def least_reach(n: int, tokens: int) -> int:
    """Largest size of the own kind that its smallest, of size n, links with."""
    return 9 * tokens // 4 - n


def block_links(ids: list[int], sizes: list[int], largest: list[int], tokens: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(id, smallest connected id, reach) of all documents of a block, in their order; largest: size in its kind, 0 where it is alone."""
    index = Index(ids, sizes, largest, tokens)
    count = len(ids)
    label = np.arange(count)
    reach = [least_reach(n, len(t)) for n, t in zip(index.sizes, index.tokens, strict=True)]
    done = np.array([r >= m for r, m in zip(reach, index.largest, strict=True)], bool)
    nothing = np.zeros(count, bool)

    def meet(q: int, r: int, overlap: int) -> None:
        label[label == label[q]] = label[r]
        for one, other in ((q, r), (r, q)):
            reach[one] = max(reach[one], 9 * overlap // 4 - index.sizes[other])
            done[one] = reach[one] >= index.largest[one]

    low = 0
    for q in range(count):
        n = index.sizes[q]
        while 5 * index.sizes[low] < 4 * n:
            low += 1
        if low == q:
            continue
        for r, overlap in index.search(index.tokens[q], n, q - 1, q, nothing):  # neighbours in size are often copies
            meet(q, r, overlap)
        skip = done & (label == label[q]) if done[q] else nothing.copy()
        skip[q - 1] = True
        if skip[low:q].all():
            continue
        for r, overlap in index.search(index.tokens[q], n, low, q, skip):
            meet(q, r, overlap)
            if done[q]:
                skip |= done & (label == label[q])
    smallest: dict[int, int] = {}
    for k, c in zip(index.ids, label.tolist(), strict=True):
        smallest[c] = min(k, smallest.get(c, k))
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * count
    for place, k, c, far in zip(index.order, index.ids, label.tolist(), reach, strict=True):
        out[place] = (k, smallest[c], far)
    return out


def _tokens(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in rows["tokens"]]


_LINKS = "a long, b long, reach long, kind long"  # reach is that of a's kind, as a repeated id may speak for several


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    found = block_links(rows["doc_id"].tolist(), rows["n"].tolist(), rows["largest"].tolist(), _tokens(rows))
    return pd.DataFrame(found, columns=["a", "b", "reach"]).assign(kind=rows["kind"].to_numpy()).astype("int64")


def _asked(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of those that ask with one block of their family: one for each component met, with the farthest reach."""
    here, queries = rows[~rows["asks"]], rows[rows["asks"]]
    out: list[tuple[int, int, int, int]] = []
    if len(here) and len(queries):
        index = Index(here["doc_id"].tolist(), here["n"].tolist(), here["largest"].tolist(), _tokens(here))
        class_of = dict(zip(here["doc_id"], here["label"], strict=True))
        label = np.array([class_of[i] for i in index.ids])
        own_rank = {i: k for k, i in enumerate(index.ids)}
        for doc_id, n, largest, tokens, own, reach, kind in zip(*(queries[c] for c in ("doc_id", "n", "largest")), _tokens(queries), *(queries[c] for c in ("label", "reach", "kind")), strict=True):
            low, high = bisect_left(index.sizes, -(-4 * n // 5)), bisect_left(index.sizes, 5 * n // 4 + 1)
            done = reach >= largest
            skip = label == own if done else np.zeros(len(label), bool)
            if doc_id in own_rank:
                skip[own_rank[doc_id]] = True
            if low >= high or skip[low:high].all():
                continue
            met: dict[int, int] = {}
            for r, overlap in index.search(tokens, n, low, high, skip):
                met.setdefault(int(label[r]), r)
                reach = max(reach, 9 * overlap // 4 - index.sizes[r])
                if done:
                    skip |= label == label[r]
            out += [(doc_id, index.ids[r], reach, kind) for r in met.values()]
    return pd.DataFrame(out, columns=["a", "b", "reach", "kind"]).astype("int64")


# ---------------------------------------------------------------- 6: components


def components(edges: DataFrame) -> DataFrame:
    """(v, label): every vertex with the smallest id of its component.

    A round points every vertex to its smallest neighbour or itself, follows these pointers to
    their ends by doubling, and rewrites the edges to the ends.  An end has no smaller neighbour; of
    two ends that meet over a vertex in between, the larger has a smaller neighbour in the next
    round, so two rounds at least halve the vertices.  All tables are written, so lineage stays short.
    """
    edges = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
    rounds = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = _followed(written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("v"), F.least("a", "least").alias("p")), "pointers"))
        rounds.append(to)
        left, right = to.select(F.col("v").alias("a"), F.col("p").alias("pa")), to.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        ends = edges.join(left, "a").join(right, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).filter("a <> b")
        old, edges = edges, written(ends.distinct(), "edges")
        released(old)
    if not rounds:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("label"))
    released(edges)
    labels = rounds.pop().withColumnRenamed("p", "label")
    while rounds:  # from the few vertices of the last round back to all
        to = rounds.pop()
        further = labels.withColumnRenamed("v", "p")
        labels = written(to.join(further, "p", "left").select("v", F.coalesce("label", "p").alias("label")), "labels")
    return labels


def _followed(to: DataFrame) -> DataFrame:
    """(v, p) with every pointer at its end: pointers of pointers until none is left to follow."""
    while True:
        ends = to.filter("v = p").select("p")
        if to.select("p").distinct().join(ends, "p", "left_anti").isEmpty():
            return to
        old, to = to, written(to.join(to.select(F.col("v").alias("p"), F.col("p").alias("q")), "p").select("v", F.col("q").alias("p")), "pointers")
        released(old)


def _family_links(members: DataFrame) -> DataFrame:
    """(a, b, reach, kind): links that connect what is connected; members: doc_id, kind, n, largest, tokens, prefix, family."""
    sizes = members.groupBy("family").agg(F.count("*").alias("size"))
    blocks = written(sizes.withColumn("blocks", F.ceil(F.col("size") / BLOCK_DOCS).cast("int")).select("family", "blocks"), "families")
    members = members.join(blocks, "family")

    def dealt(rows: DataFrame, seed: int) -> DataFrame:
        return rows.drop("prefix").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("int"))

    links = written(dealt(members, 1).groupBy("family", "block").applyInPandas(_block, _LINKS), "links")
    if blocks.filter("blocks > 1").isEmpty():
        return links
    large = members.filter("blocks > 1")
    again = written(dealt(large, 2).groupBy("family", "block").applyInPandas(_block, _LINKS), "links")
    links = links.unionByName(again)
    known = components(links)
    reach = links.groupBy(F.col("a").alias("doc_id"), "kind").agg(F.max("reach").alias("reach"))
    large = large.join(known.withColumnRenamed("v", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")).join(reach, ["doc_id", "kind"])
    # dealt by the rarest shingle, so that a block holds few different ones; a frequent one has blocks of its own
    rarest = F.get("prefix", F.lit(0))
    per_token = large.groupBy(rarest.alias("rarest")).agg(F.count("*").alias("docs"))
    salt = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("docs") / BLOCK_DOCS))
    block = F.when(F.col("docs") > BLOCK_DOCS, F.xxhash64("family", "rarest", salt)).otherwise(F.xxhash64("family", F.pmod(F.xxhash64("rarest"), F.col("blocks"))))
    large = written(large.withColumn("rarest", rarest).join(per_token, "rarest").withColumn("block", block).drop("rarest", "docs", "blocks"), "large")
    counts = large.groupBy("family", "label").agg(F.count("*").alias("c"))
    main = counts.groupBy("family").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    asks = large.join(main, "family").filter("label <> main or reach < largest").select("doc_id", "n", "prefix")
    rare = F.explode("prefix").alias("token")
    held = large.select("block", "n", rare).groupBy("block", "token").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    meet = asks.select("doc_id", "n", rare).join(held, "token").filter("5 * n >= 4 * low and 5 * high >= 4 * n").select("doc_id", "block").distinct()
    meet = written(meet, "meet")
    tasks = meet.groupBy("block").agg(F.ceil(F.count("*") / ASKING_DOCS).cast("int").alias("tasks"))
    columns = ["block", "task", "doc_id", "kind", "n", "largest", "tokens", "label", "reach", "asks"]
    questions = meet.join(tasks, "block").withColumn("task", F.pmod(F.xxhash64("doc_id", "block"), F.col("tasks")).cast("int"))
    questions = questions.join(large.drop("block"), "doc_id").withColumn("asks", F.lit(True)).select(columns)
    here = large.join(tasks, "block").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).withColumn("asks", F.lit(False)).select(columns)
    more = written(here.unionByName(questions).groupBy("block", "task").applyInPandas(_asked, _LINKS), "links")
    released(known, large, meet)
    return links.unionByName(more)


def _bits(rows: DataFrame) -> int:
    """Leading bits that deal shingles to buckets: by the bytes of all texts, and no fewer than keep all tasks busy."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_BITS, max(1, math.ceil(math.log2(max(tasks, 1.4 * size / BUCKET_BYTES)))))


def join_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bits = _bits(rows)
    parts = 1 << bits
    many = parts > 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def by(df: DataFrame, key: str) -> DataFrame:
        return df.repartition(parts, key) if many else df  # more input than the session's partitions are meant for

    sets = by(rows.mapInArrow(_sets(bits), _TRAVEL), "bucket")
    counted = written(sets.groupBy("bucket").applyInPandas(_count_bucket(bits), _TRAVEL), "counted")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                d = np.frombuffer(x, _DOC)
                ids = pa.array(d["id"].astype(np.int64), mask=d["null"].copy())
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(d[c].astype(np.int64)) for c in ("n", "hi", "lo"))], names=["doc_id", "n", "hi", "lo"]
                )

    every = written(counted.filter("kind = 'docs'").select("payload").mapInArrow(unpack, "doc_id long, n long, hi long, lo long"), "docs")
    classes = written(every.filter("doc_id is not null and n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")), "classes")
    schema = "doc_id long, n long, kind_hi long, kind_lo long, tokens binary, prefix array<long>"
    shared = written(by(counted, "batch").groupBy("batch").applyInPandas(_assembly(bits), schema), "shared")
    released(counted)
    # equal sets of other batches are one document from here on, and the smallest of a kind speaks for it
    light = shared.select("doc_id", "n", "kind_hi", "kind_lo").join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    light = written(light, "kinds")
    kinds = light.groupBy("kind_hi", "kind_lo").agg(F.min(F.struct("n", "doc_id")).alias("least"), F.max("n").alias("largest"), F.count("*").alias("docs"))
    alone = F.when(F.col("docs") > 1, F.col("largest")).otherwise(0).alias("largest")
    speakers = written(kinds.select("kind_hi", "kind_lo", F.col("least.doc_id").alias("doc_id"), alone), "speakers")
    shared_of = written(shared.join(speakers, ["doc_id", "kind_hi", "kind_lo"]).withColumnRenamed("kind_hi", "kind").drop("kind_lo"), "spoken")
    released(shared)
    rare = shared_of.select("doc_id", F.explode("prefix").alias("token"))
    meets = written(rare.groupBy("token").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("token", "first"), "meets")
    families = components(rare.join(meets, "token").select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    members = written(shared_of.join(families.select(F.col("v").alias("doc_id"), F.col("label").alias("family")), "doc_id"), "members")
    links = _family_links(members)
    # those that others speak for: linked with the speaker as far as the kind reaches
    own = shared_of.filter("largest > 0").select("doc_id", "kind", (F.floor(F.length("tokens") / 8 * 9 / 4).cast("long") - F.col("n")).alias("reach"))
    reach = links.select(F.col("a").alias("doc_id"), "kind", "reach").unionByName(own).groupBy("doc_id", "kind").agg(F.max("reach").alias("reach"))
    spoken = speakers.filter("largest > 0").join(reach.withColumnRenamed("kind", "kind_hi"), ["doc_id", "kind_hi"]).select("kind_hi", "kind_lo", F.col("doc_id").alias("a"), "reach")
    quiet = light.join(spoken, ["kind_hi", "kind_lo"]).filter("n <= reach and doc_id <> a").select("a", F.col("doc_id").alias("b"))
    found = components(links.select("a", "b").unionByName(quiet))
    known = classes.join(found.withColumnRenamed("v", "rep"), "rep", "left").select("hi", "lo", F.coalesce("label", "rep").alias("component_id"))
    out = every.join(written(known, "classes"), ["hi", "lo"], "left")
    released(shared_of, members, light, speakers, meets, families, classes)
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id.

    Rows with a null id stay, as nothing links them; of rows that repeat an id
    the one with the first text in order stays.
    """
    classes = settled(lambda: join_components(docs, id_col=id_col, text_col=text_col), "components")
    kept = written(classes.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")).withColumnRenamed("doc_id", "__kept_id"), "kept")
    key = F.col(f"`{id_col}`").cast("long")
    # dealt by id at every size, with the ids as the hashed side: texts are neither sorted nor is anything broadcast
    out = docs.join(kept.filter("rows = 1").hint("shuffle_hash"), key == F.col("__kept_id"), "left_semi")
    if not kept.filter("rows > 1").isEmpty():
        again = docs.join(kept.filter("rows > 1").hint("shuffle_hash"), key == F.col("__kept_id"), "left_semi")
        first = Window.partitionBy(id_col).orderBy(text_col)
        again = again.withColumn("__kept_row", F.row_number().over(first)).filter("__kept_row = 1").drop("__kept_row")
        out = out.unionByName(again)
    return out.unionByName(docs.filter(key.isNull()))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared.c >= 80 * (x.c + y.c - shared.c)),
edge AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON r.other = e.a)
SELECT d.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) m USING (doc_id)
"""
