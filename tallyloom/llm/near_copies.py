"""Near-copies by the Jaccard similarity of word shingles, found by deletion variants of SimHash fingerprints.

Documents link where their sets of five-word shingles have a Jaccard similarity of 0.8 or more.  Pairs
to look at come from SimHash: of each set's shingles, majority bits under independent seeds are cut into
PRINTS fingerprints of PARTS parts each, and a fingerprint is indexed once for each of its parts with that part
deleted.  Two sets of similarity 0.8 differ in at most 0.162 of the bits, so in all parts but one of some fingerprint they agree
with a chance of 0.9997 (more above 0.8, and more for most sizes).  Sets of fewer than ten shingles have too few votes for that: they are indexed
themselves and with one or two shingles deleted, which finds every pair at 0.8.  Rows of a key that differ in more than FAR of 128
further bits aren't held together.  Each pair that counts is verified over the whole sets.

Equal sets are collapsed first.  Every row is held against one, of the least rows of its keys the one that it has most keys in common with: a pair a row, which mostly joins them.
Where rows whose keys have rows in common are still in parts, they meet with their sets, in groups of two blocks of bounded size, each row once for every block;
very many of them meet key by key.  What each two of a group have in common is a product of matrices, and only pairs that join two parts leave it, so no table has all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import LOWER, free_name, sent, settle, texts, unsettle
from tallyloom.llm.simhash import components

SEED = 42
WORDS = 5
#: Fingerprints of a set, parts of a fingerprint and bits of a part; keys of a set.
PRINTS, PARTS, BITS = 36, 3, 7
BANDS = PRINTS * PARTS
#: The share of bits in which two sets of ten shingles or more differ at a similarity of 0.8, at most (12 of 15 shingles in common).
DIFFER = 0.162
#: Bits of 128 that such sets have different at most, but for a chance of 0.00003.
FAR = 37
#: Shingles of a short set: one of fewer than the first is like no other set, of fewer than the last is like sets of up to SHORT[1].
SHORT = (4, 11, 10)
#: Rows of a key whose fingerprints are compared pair by pair at once, and at most.
FEW, MOST = 64, 4096
#: The least similarity, as a fraction.
SIMILAR = (4, 5)
#: Rows of a key that are held together, and columns of a matrix.
BLOCK, COLUMNS = 768, 4096
#: Blocks of rows of several keys that are held together as one at most.
GATHERED = 16


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The different hashes of a text's word shingles, in order; a text of fewer words is one shingle, one of none has none."""
    parts = text.translate(LOWER).split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(joined[a:b], SEED) for a, b in zip(starts, (ends[-n:] - 1).tolist(), strict=True)], np.uint64))


def identity(own: np.ndarray) -> int:
    """The hash of a set of shingles, as a signed long."""
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - 2**63


def shape(rows: int) -> tuple[int, int]:
    """(prints, bits): of more than four million rows the parts get longer, so that a key has 256 random rows at most, and fingerprints more, so that as many pairs are found."""

    def met(bits: int) -> float:
        same = (1 - DIFFER) ** bits
        return same**PARTS + PARTS * (1 - same) * same ** (PARTS - 1)

    bits = max(BITS, ceil((log2(max(rows, 1)) - 8) / (PARTS - 1)))
    return ceil(PRINTS * log(1 - met(BITS)) / log(1 - met(bits))), bits


@cache
def _seeds(words: int) -> tuple[np.ndarray, np.ndarray]:
    terms, factors = np.random.default_rng(SEED).integers(0, 2**64, (2, words), np.uint64)
    return terms, factors | np.uint64(1)


def simhash(own: np.ndarray, prints: int, bits: int) -> bytes:
    """128 majority bits of a set's shingles to compare, and those of its fingerprints."""
    words = 2 + -(-prints * PARTS * bits // 64)
    terms, factors = _seeds(words)
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(own), 1024):
        h = (own[at : at + 1024, None] ^ terms) * factors
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        counts += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(counts * 2 > len(own)).tobytes()


def shortened(own: np.ndarray) -> list[int]:
    """Keys of a short set: hashes of it and of it without one shingle, of ten or more also without two; all are negative."""
    least, most, two = SHORT
    n = len(own)
    if not least <= n <= most:
        return []
    gone = [(), *combinations(range(n), 1), *(combinations(range(n), 2) if n >= two else ())]
    return sorted({(xxhash.xxh64_intdigest(np.delete(own, x).tobytes() if x else own.tobytes(), SEED) >> 1) - 2**63 for x in gone})


def signatures(docs: DataFrame, prints: int = PRINTS, bits: int = BITS) -> DataFrame:
    """(doc_id, v, print, short) of every row: the identity of its shingles, their majority bits (null for a short set), and the keys of a short set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in texts(batch.column(1))]
            prints_ = pa.array([simhash(s, prints, bits) if len(s) >= SHORT[2] else None for s in sets], pa.binary())
            short = pa.array([shortened(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([identity(s) for s in sets], pa.int64()), prints_, short], ["doc_id", "v", "print", "short"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, v long, print binary, short array<long>")


def deletions(print_: np.ndarray, prints: int, bits: int) -> np.ndarray:
    """The keys of rows of fingerprints, as bits: number of the fingerprint, number of the part that is deleted, and the others."""
    parts = print_.reshape(len(print_), prints, PARTS, bits) @ (1 << np.arange(bits, dtype=np.int64))
    keys = []
    for gone in range(PARTS):
        key = np.broadcast_to(np.arange(prints, dtype=np.int64) * PARTS + gone, parts.shape[:2])
        for part in range(PARTS):
            key = key if part == gone else key << bits | parts[:, :, part]
        keys.append(key)
    return np.concatenate(keys, axis=1)


def variants(distinct: DataFrame, prints: int = PRINTS, bits: int = BITS) -> DataFrame:
    """(key, v, low, high): every set under each of its keys, with the 128 bits to compare, which are zero under a key of a short set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                v, short = batch.column(0).to_numpy(), batch.column(2).to_pylist()
                sizes = np.fromiter(map(len, short), np.int64, len(short))
                own = np.flatnonzero(~batch.column(1).is_null().to_numpy(zero_copy_only=False))
                raw = np.frombuffer(b"".join(batch.column(1).drop_null().to_pylist()), np.uint8)
                raw = raw.reshape(len(own), -1) if len(own) else np.zeros((0, 16 + -(-prints * PARTS * bits // 8)), np.uint8)
                keys = deletions(np.unpackbits(raw[:, 16:], axis=1)[:, : prints * PARTS * bits], prints, bits)
                low, high = np.ascontiguousarray(raw[:, :16]).view(np.int64).T
                none = np.zeros(sizes.sum(), np.int64)
                rows = [
                    np.concatenate([keys.ravel(), np.array([k for s in short for k in s], np.int64)]),
                    np.concatenate([np.repeat(v[own], keys.shape[1]), np.repeat(v, sizes)]),
                    *(np.concatenate([np.repeat(x, keys.shape[1]), none]) for x in (low, high)),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["key", "v", "low", "high"])

    return distinct.select("v", "print", "short").mapInArrow(run, "key long, v long, low long, high long")


def parted(k: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each row, in order of the keys *k*, the first row of its key that a chain of rows with FAR different bits at most leads to; -1 for a row without another."""
    n = len(k)
    cuts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
    size = np.diff(cuts)
    label = np.arange(n)
    few = np.repeat(size <= FEW, size)
    i, d, hits = np.flatnonzero((k[1:] == k[:-1]) & few[1:]), 1, [np.zeros((2, 0), np.int64)]
    while len(i):
        far = np.bitwise_count((low[i] ^ low[i + d]).view(np.uint64)) + np.bitwise_count((high[i] ^ high[i + d]).view(np.uint64))
        hits.append(np.stack([i, i + d])[:, far <= FAR])
        d += 1
        i = i[i + d < n]
        i = i[k[i + d] == k[i]]
    a, b = np.concatenate(hits, axis=1)
    while (label[a] != label[b]).any():
        lower = np.minimum(label[a], label[b])
        np.minimum.at(label, a, lower)
        np.minimum.at(label, b, lower)
    near = np.zeros(n, bool)
    near[a] = near[b] = True
    for start, end in zip(cuts[:-1][size > FEW].tolist(), cuts[1:][size > FEW].tolist(), strict=True):
        left = np.arange(start, end)
        while len(left):
            first, left, todo = int(left[0]), left[1:], [int(left[0])]
            while todo and len(left):
                x = todo.pop()
                far = np.bitwise_count((low[left] ^ low[x]).view(np.uint64)) + np.bitwise_count((high[left] ^ high[x]).view(np.uint64))
                found = left[far <= FAR]
                if len(found):
                    label[found], near[found], near[first] = first, True, True
                    left = left[far > FAR]
                    todo += found.tolist()
    return np.where(near, label, -1)


def suspects(keyed: DataFrame) -> DataFrame:
    """(key, v): the rows of *keyed* that have others like them under their key, which is told apart by whom they are like.

    A key of more than MOST rows stays as it is, with all of them.
    """

    def told(k: np.ndarray, by: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        key = (k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (by.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(v)], ["key", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, whole = [np.zeros(0, np.int64)] * 4, None

        def of(k: np.ndarray, v: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
            label = parted(k, low, high)
            near = label >= 0
            return told(k[near], v[label[near]], v[near])

        for batch in batches:
            held = [np.concatenate([a, b.to_numpy()]) for a, b in zip(held, batch.columns, strict=True)]
            if whole is not None:
                n = int(np.searchsorted(held[0], whole, "right"))
                yield told(held[0][:n], np.zeros(n, np.int64), held[1][:n])
                held = [x[n:] for x in held]
            if not len(held[0]):
                continue
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield of(*(x[:last] for x in held))
                held, whole = [x[last:] for x in held], None
            if len(held[0]) > MOST:
                whole = held[0][0]
                yield told(held[0], np.zeros(len(held[0]), np.int64), held[1])
                held = [x[:0] for x in held]
        if len(held[0]):
            yield of(*held)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, v long")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(v, own): the shingles of each identity in *wanted*."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()  # copies are sent once by a task
        for batch in batches:
            v = [identity(shingles(t)) for t in texts(batch.column(0))]
            new = [i for i, x in enumerate(v) if x not in told and not told.add(x)]
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in new], pa.int64()), batch.column(0).take(pa.array(new, pa.int64()))], ["v", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                own = [shingles(t).view(np.int64) for t in texts(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], ["v", "own"])

    named = docs.select(F.col("text").cast("string")).mapInArrow(name, "v long, text string")
    return named.join(sent(wanted), "v", "left_semi").dropDuplicates(["v"]).mapInArrow(cut, "v long, own array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    both = pairs.join(sets.select(F.col("v").alias("a"), F.col("own").alias("own_a")), "a").join(sets.select(F.col("v").alias("b"), F.col("own").alias("own_b")), "b")
    over, under = SIMILAR
    p, q = F.size("own_a"), F.size("own_b")
    near = F.size(F.array_intersect("own_a", "own_b")) * (over + under) >= (p + q) * over
    return both.where((F.least(p, q) * under >= F.greatest(p, q) * over) & near).select("a", "b")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("v", "other").alias("a"), F.greatest("v", "other").alias("b")).distinct()


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """(key, part, side, v, label): the rows of each key in groups of two blocks at most, so that each two rows of a key meet in one group.

    Within a block all rows are on one side; in a group of two blocks only rows of different sides are to be compared.
    """
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    mine = F.pmod(F.xxhash64("v", F.lit(BANDS)), F.col("blocks"))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.struct(F.least(b, "mine").alias("a"), F.greatest(b, "mine").alias("b")))
    own = rows.join(sizes, "key").withColumn("mine", mine).withColumn("part", F.explode(parts))
    return own.select("key", "part", (F.col("mine") == F.col("part.b")).alias("side"), "v", "label")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set on the left has in common with each on the right, as products of matrices of those that more than one set has."""
    sizes = np.fromiter(map(len, [*left, *right]), np.int64, len(left) + len(right))
    _, at, counts = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    shared = counts > 1
    column = (np.cumsum(shared) - 1)[at]
    row, column = row[shared[at]], column[shared[at]]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(shared.sum()), COLUMNS):
        own = (column >= first) & (column < first + COLUMNS)
        has = np.zeros((len(sizes), COLUMNS), np.float32)
        has[row[own], column[own] - first] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out


def forest(v: np.ndarray, label: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs (a, b), a < b, of similar sets that join all components of a group that such pairs join."""
    left, right = (np.flatnonzero(side == x) for x in (side.min(), side.max()))
    over, under = SIMILAR
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    both = overlaps([sets[i] for i in left], [sets[i] for i in right])
    i, j = np.nonzero((both * (over + under) >= (size[left][:, None] + size[right][None, :]) * over) & (label[left][:, None] != label[right][None, :]))
    root = {x: x for x in label.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(left[i].tolist(), right[j].tolist(), strict=True):
        x, y = find(int(label[a])), find(int(label[b]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((min(int(v[a]), int(v[b])), max(int(v[a]), int(v[b]))))
    return out


def links(groups: DataFrame) -> DataFrame:
    """(a, b) of forest for each group of *groups*: (key, part, side, v, label, own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None

        def told() -> pa.RecordBatch:
            pairs = forest(*(np.array([r[k] for r in held]) for k in range(3)), [r[3] for r in held]) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], ["a", "b"])

        for whole in batches:
            for at in range(0, len(whole), BLOCK):
                batch = whole.slice(at, BLOCK)
                sets = batch.column(5)
                ends, values = sets.offsets.to_numpy(), sets.values.to_numpy()
                for k, (key, a, b, side, v, label) in enumerate(zip(batch.column(0).to_pylist(), *(x.to_pylist() for x in batch.column(1).flatten()), *(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                    if (key, a, b) != name:
                        if held:
                            yield told()
                        held, name = [], (key, a, b)
                    held.append((v, label, side, values[ends[k] : ends[k + 1]].copy()))
        if held:
            yield told()

    return groups.repartition("key", "part").sortWithinPartitions("key", "part").select("key", "part", "side", "v", "label", "own").mapInArrow(run, "a long, b long")


def apart(crowd: DataFrame, stars: DataFrame, best: DataFrame, label: DataFrame, most: int) -> DataFrame:
    """(key, v, label): the rows of *crowd* that are to be held together as some of them are still in parts.

    Keys that have rows in common are one key, so that two of them meet once, if these are at most *most*; of two that are all, *best* has told.
    """
    first = components(best.select(F.col("other").alias("a"), F.col("v").alias("b")).union(stars.select("other", "other")).distinct()).select(F.col("v").alias("end"), F.col("label").alias("first"))
    ends = stars.select(F.col("v").alias("end"), "other").join(first, "end").select(F.col("first").alias("b"), "other").join(first.withColumnRenamed("end", "other"), "other").select(F.col("first").alias("a"), "b")
    more = components(ends.where("a <> b").distinct()).select(F.col("v").alias("first"), F.col("label").alias("least"))
    whole = settle(first.join(more, "first", "left").select(F.col("end").alias("v"), F.coalesce("least", "first").alias("whole")))
    named = settle(whole.join(label, "v", "left").withColumn("label", F.coalesce("label", "v")))
    parts = named.groupBy("whole").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low < high and size > 2").select("whole", "size")
    own = settle(named.join(parts, "whole"))
    small = own.where(F.col("size") <= most).select(F.col("whole").alias("key"), "v", "label")
    rows = crowd.select("key", "v").join(own.where(F.col("size") > most).select("v", "label"), "v")
    torn = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return settle(small.union(rows.join(torn, "key", "left_semi").select("key", "v", "label")))


def joined(docs: DataFrame, signed: DataFrame, prints: int = PRINTS, bits: int = BITS) -> DataFrame:
    """(v, label): the component of every identity that is similar to another one."""
    found = settle(suspects(variants(signed.select("v", "print", "short").dropDuplicates(["v"]), prints, bits)))
    shared = found.groupBy("key").agg(F.min("v").alias("other"))
    crowd = settle(found.join(shared, "key"))
    unsettle(found)
    sets = settle(sets_of(docs, settle(crowd.select("v").distinct())))
    stars = settle(crowd.where("v <> other").groupBy("v", "other").count())
    best = settle(stars.groupBy("v").agg(F.min(F.struct(-F.col("count"), "other")).alias("best")).select("v", "best.other"))
    edges = settle(verified(_pairs(best), sets))
    groups = dealt(apart(crowd, stars, best, components(edges), GATHERED * BLOCK), BLOCK).join(sets, "v")
    return components(settle(edges.union(links(groups))))


def keep_one(docs: DataFrame) -> DataFrame:
    """*docs* without the near-copies: of each component the row of the least doc_id stays.

    Texts are lower-cased (A-Z) and cut at ASCII white space; those without words are copies of each other.  Of
    repeated rows of one doc_id all stay with it; rows without a doc_id stay.
    """
    prints, bits = shape(docs.count())
    signed = settle(signatures(docs, prints, bits))
    group = joined(docs, signed, prints, bits)
    least = signed.groupBy("v").agg(F.min("doc_id").alias("least")).join(group, "v", "left").select("v", F.coalesce("label", "v").alias("label"), "least")
    first = least.groupBy("label").agg(F.min("least").alias("first"))
    named = least.join(first, "label").select("v", "first")
    gone_id = free_name(docs.columns, "gone_id")
    gone = settle(signed.join(named, "v").where(F.col("doc_id") > F.col("first")).select(F.col("doc_id").alias(gone_id)).distinct())
    return docs.join(sent(gone), F.col("doc_id").cast("long") == F.col(gone_id), "left_anti")
