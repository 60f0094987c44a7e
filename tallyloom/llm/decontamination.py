"""Benchmark decontamination by a prefix-filtered containment join.

Each benchmark item is cut into windows of consecutive words.  A window is the set of
its word shingles; a document holds the window only if it holds all of them, so a
prefix of one shingle, the rarest over all documents, is all that must be looked up.
A document shingle that is some window's rarest gives a candidate; its place in the
window fixes where the window would lie (positional bound), which must be inside the
document (length bound); then every word is compared.

The frequencies come from one pass over all documents, counted within each task
and summed by shingle.  The index of windows is sent to the executors in blocks of at most
``block_words`` benchmark words, so what is broadcast is bounded; further blocks are
further steps over the same rows, without a shuffle.  Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import each_batch, free_name, texts

#: ASCII letters and digits and all bytes of other characters stay, A-Z as a-z; the rest parts words.
WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD).split() if text else []


def shingles(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash for every *n* consecutive word numbers; zero where one of them isn't a benchmark word."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    own = ids.astype(np.uint64)
    out, known = np.zeros(len(ids) - n + 1, np.uint64), np.ones(len(ids) - n + 1, bool)
    for k in range(n):
        part = own[k : k + len(out)]
        out = (out ^ (part * P1)) * P2
        out ^= out >> np.uint64(29)
        known &= part > 0
    out[~known] = 0
    return out


class Windows:
    """The different windows of a block of items, each with its items: their words as numbers from 1, and their shingles."""

    def __init__(self, items: list[tuple[object, list[bytes]]], size: int, shingle: int) -> None:
        self.shingle, self.numbers, self.windows, self.owners = shingle, {}, [], []
        self.items = [item for item, _ in items]
        place: dict[bytes, int] = {}
        for owner, (_, words) in enumerate(items):
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            for at in range(max(1, len(ids) - size + 1)) if ids else ():
                window = np.array(ids[at : at + size], np.int64)
                k = place.setdefault(window.tobytes(), len(self.windows))
                if k == len(self.windows):
                    self.windows.append(window)
                    self.owners.append(set())
                self.owners[k].add(owner)
        own = [shingles(w, min(shingle, len(w))) for w in self.windows]
        self.codes = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        self._own = own
        self.lengths = sorted({min(shingle, len(w)) for w in self.windows})

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.numbers.get
        return np.fromiter([get(w, 0) for w in words], np.int64, len(words))

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the document, hash) of every benchmark shingle in a document."""
        if not ids.any():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        places, codes = [], []
        for n in self.lengths:
            h = shingles(ids, n)
            at = np.flatnonzero(h)
            own = h[at]
            k = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
            hit = self.codes[k] == own
            places.append(at[hit])
            codes.append(own[hit])
        return np.concatenate(places), np.concatenate(codes)

    def index(self, counts: dict[int, int]) -> None:
        """Choose each window's rarest shingle (the first of equals) as its prefix."""
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, own in enumerate(self._own):
            at = min(range(len(own)), key=lambda i: (counts.get(int(own[i]), 0), i))
            self.prefix.setdefault(int(own[at]), []).append((k, at))
        self.rare = np.array(sorted(self.prefix), np.uint64)
        self._own = []

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, list]:
        """Which words of a document a window covers, and the items of those windows."""
        covered, found = np.zeros(len(ids) + 1, np.int64), set()
        if not len(self.rare) or not ids.any():
            return covered[:0], []
        for n in self.lengths:
            h = shingles(ids, n)
            at = np.flatnonzero(h)
            k = np.minimum(np.searchsorted(self.rare, h[at]), len(self.rare) - 1)
            for place in at[self.rare[k] == h[at]].tolist():
                for window, offset in self.prefix[int(h[place])]:
                    own, start = self.windows[window], place - offset
                    if min(self.shingle, len(own)) == n and start >= 0 and start + len(own) <= len(ids) and np.array_equal(ids[start : start + len(own)], own):
                        covered[start] += 1
                        covered[start + len(own)] -= 1
                        found.add(window)
        items = sorted(set().union(*(self.owners[w] for w in found)))
        return np.cumsum(covered[:-1]) > 0 if found else covered[:0], [self.items[i] for i in items]


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    block, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string").cast("binary")).distinct().orderBy("item_id", "text").toLocalIterator():
        words = words_of(bytes(row[1]) if row[1] is not None else None)
        if block and n + len(words) > block_words:
            yield block
            block, n = [], 0
        block.append((row[0], words))
        n += len(words)
    yield block


def _counts(docs: DataFrame, windows: Windows) -> dict[int, int]:
    """How often each benchmark shingle occurs in all documents; at most one entry for each of the block's shingles."""
    sent = docs.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        total = np.zeros(len(index.codes), np.int64)
        for batch in batches:
            for text in texts(batch.column(0)):
                _, codes = index.found(index.ids(words_of(text)))
                if len(codes):
                    np.add.at(total, np.searchsorted(index.codes, codes), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(index.codes[at].view(np.int64)), pa.array(total[at])], ["code", "n"])

    if not len(windows.codes):
        return {}
    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return {int(np.int64(r.code).view(np.uint64)): r.n for r in rows}


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, block_words: int = 200_000) -> DataFrame:
    """*docs* with n_words, n_hit (words inside an occurring window) and items (ids of the items hit, as strings, sorted).

    Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z in
    lower case.  An item of fewer than *window* words is one window; one without words, or
    null, is none.  A null or empty text has no words.  Items that share an id count as
    one; a null item_id counts as the item "" in *items*.  Repeated rows of documents are
    judged one by one.  Columns n_words, n_hit and items of *docs* are replaced.
    """
    docs = docs.drop("n_words", "n_hit", "items")
    names = docs.columns
    hit_words = free_name(names, "hit_words")
    own = {"n_words": T.LongType(), "n_hit": T.LongType(), "items": T.ArrayType(T.StringType()), hit_words: T.BinaryType()}
    out = T.StructType([*docs.schema.fields, *(T.StructField(k, t) for k, t in own.items())])
    state = docs.withColumns({k: F.lit(None).cast(t) for k, t in own.items()})
    for block in _blocks(benchmark, block_words):
        windows = Windows(block, window, shingle)
        windows.index(_counts(docs, windows))
        sent = docs.sparkSession.sparkContext.broadcast(windows)

        def mark(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            index, hits, items, n = sent.value, batch.column(hit_words).to_pylist(), batch.column("items").to_pylist(), []
            for i, text in enumerate(texts(batch.column("text").cast(pa.string()))):
                words = words_of(text)
                n.append(len(words))
                covered, new = index.hits(index.ids(words))
                items[i] = items[i] or []
                if new:
                    before = np.unpackbits(np.frombuffer(hits[i], np.uint8), count=len(words)).astype(bool) if hits[i] else False
                    hits[i] = np.packbits(covered | before).tobytes()
                    items[i] = sorted({*items[i], *(x or "" for x in new)})
            n_hit = [int(np.bitwise_count(np.frombuffer(h, np.uint8)).sum()) if h else 0 for h in hits]
            found = [pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(hits, pa.binary())]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found], [*names, *own])

        state = state.mapInArrow(each_batch(mark), out)
    return state.drop(hit_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """The rows of *docs* in which no window of the benchmark occurs, unchanged."""
    return contamination(docs, benchmark, window, shingle).where(F.col("n_hit") == 0).select(*docs.columns)
