"""Line dedup with a once-seen and a twice-seen Bloom filter.

Pass 1 hashes each document's line keys.  A task knows of itself which keys two of its documents hold: those
are suspected repeats at once.  Of every other key it hands on one row, a digest and the document, dealt by digest to shards.

A shard inserts its rows into two Bloom filters: a key whose bits are
all set in the once-seen filter is put into the twice-seen filter, any other into the
once-seen filter.  No key that comes to the shard twice can be missing from the second.  Then the shard's rows are
probed: what is not in the twice-seen filter is unique and goes no further.

Only suspected repeats shuffle on, as (digest, document), for the exact count of documents and the choice of the one that
keeps the line, so a false positive of a filter costs a shuffled row and never changes the result.

Scale.  The number of shards follows the number of keys, so a shard's rows and filters have one size whatever the input, and
nothing is broadcast or collected.  A line that is in a third of all documents is a row a task in its shard; its suspects are
counted by (key, document) first, and the join that hands the decision back is a sort-merge join whose hot partitions Spark splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import SPACE, each_batch, free_name, settle, texts

#: Rows of a shard, by which their number is chosen.
SHARD_ROWS = 1_000_000
#: Keys that a task remembers before it hands them on.
HELD = 300_000
#: Bits of a filter for each key, at least.
BITS = 16
#: Bytes of a key's digest, the first of its SHA-256.
DIGEST = 16

SEEN = "digest binary, doc_id long, text_hash long, repeated boolean"


def key_of(line: bytes, least: int) -> bytes | None:
    """The key of a line, or None where it has fewer than *least* code points."""
    key = line.strip(SPACE).lower()
    if len(key) < least or not key.isascii() and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


def digest_of(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:DIGEST]


def _digests(text: bytes | None, least: int) -> set[bytes]:
    if not text or len(text) < least:
        return set()
    keys = {key_of(line, least) for line in text.split(b"\n") if len(line) >= least}
    return {digest_of(k) for k in keys if k is not None}


def document() -> list[Column]:
    """doc_id and text_hash, which together name a document: of rows without an id those of one text are one document."""
    id_ = F.col("doc_id").cast("long")
    return [id_.alias("doc_id"), F.when(id_.isNull(), F.xxhash64(F.col("text").cast("string"))).otherwise(F.lit(0).cast("long")).alias("text_hash")]


class Filter:
    """A Bloom filter of two places a key, over whole arrays of hashes."""

    def __init__(self, keys: int, bits_a_key: int) -> None:
        self.bits = max(10, (keys * bits_a_key).bit_length())
        self.bitmap = np.zeros(1 << self.bits >> 3, np.uint8)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64), mixed.astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self._places(hashes):
            out &= (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return out

    def put(self, hashes: np.ndarray) -> None:
        for at in self._places(hashes):
            np.bitwise_or.at(self.bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))


def suspected(parts: list[np.ndarray], bits_a_key: int = BITS) -> list[np.ndarray]:
    """Which hashes of each array, in their order, may occur twice; every one that does is among them."""
    total = sum(map(len, parts))
    once, twice = Filter(total, bits_a_key), []
    for hashes in parts:
        fresh, n = np.unique(hashes, return_counts=True)
        twice.append(fresh[(n > 1) | once.has(fresh)])
        once.put(fresh)
    found = np.unique(np.concatenate(twice)) if twice else np.zeros(0, np.uint64)
    second = Filter(len(found), bits_a_key)
    second.put(found)
    return [second.has(hashes) for hashes in parts]


def seen_keys(docs: DataFrame, least: int) -> DataFrame:
    """(digest, doc_id, text_hash, repeated): a task's keys with their documents; repeated where two of its documents hold one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple] = {}  # the document of a key that one document holds
        again: set[bytes] = set()
        rows: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            every = [(d, *doc, True) for d, doc in rows]
            # A repeated key is told to its shard too: another task may hold it once.
            every += [(d, None, None, True) for d in again]
            every += [(d, *doc, False) for d, doc in first.items()]
            cols = list(zip(*every, strict=True)) or [[], [], [], []]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["digest", "doc_id", "text_hash", "repeated"])
            rows.clear()

        for batch in batches:
            for *doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                doc = tuple(doc)
                for d in _digests(text, least):
                    if d in again:
                        rows.append((d, doc))
                    elif (before := first.setdefault(d, doc)) != doc:
                        del first[d]
                        again.add(d)
                        rows += [(d, before), (d, doc)]
                if len(first) + len(again) + len(rows) > HELD:
                    yield from out()
                    first.clear()
                    again.clear()
        yield from out()

    return docs.select(*document(), F.col("text").cast("string")).mapInArrow(run, SEEN)


def suspects(seen: DataFrame, bits_a_key: int = BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(digest, doc_id, text_hash): the rows of :func:`seen_keys` whose key may be held by two documents."""
    told = F.col("repeated") & F.col("text_hash").isNotNull()
    dealt = seen.where(~told)
    shards = max(1, -(-dealt.count() // shard_rows))
    schema = seen.drop("repeated").schema

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one shard's rows
        hashes = [np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64)[::2] for b in held]
        # What a task has seen twice counts twice.
        twice = [b.column(3).to_numpy(zero_copy_only=False) for b in held]
        marks = suspected([np.concatenate((h, h[t])) for h, t in zip(hashes, twice, strict=True)], bits_a_key)
        for batch, mark in zip(held, marks, strict=True):
            mine = mark[: len(batch)] & ~batch.column(3).to_numpy(zero_copy_only=False)
            yield batch.select(["digest", "doc_id", "text_hash"]).filter(pa.array(mine))

    found = dealt.repartition(shards, "digest").mapInArrow(probe, schema)
    return seen.where(told).drop("repeated").union(found)


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, bits_a_key: int = BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, text_hash, keys): for each document, as :func:`document` names it, the digests of the line keys that it loses."""
    seen = settle(seen_keys(docs, min_chars))
    # Written, so that no aggregate stands between the join and its exchanges: Spark then splits a hot key's partition.
    found = settle(suspects(seen, bits_a_key, shard_rows))
    confirmed = settle(found.groupBy("digest").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= min_docs).select("digest", "keep"))
    lost = found.join(confirmed, "digest").where(~F.col("doc_id").eqNullSafe(F.col("keep")))
    return lost.groupBy("doc_id", "text_hash").agg(F.collect_set("digest").alias("keys"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, bits_a_key: int = BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """*docs* with its ``text`` cut to the lines that stay, and n_lines, n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z in lower
    case.  A key of at least *min_chars* code points in at least *min_docs* documents
    keeps its lines only in the largest doc_id that holds it, all of them there.

    A null or empty text is one empty line; the text given is then empty.  Rows with
    one doc_id are one document for the count, and each of them is cut alike.  A null
    doc_id is never counted nor kept from, and loses its confirmed lines.  Columns of
    *docs* named n_lines or n_dropped are replaced; all others pass through.
    """
    docs = docs.drop("n_lines", "n_dropped")
    id_, hash_, keys_ = (free_name(docs.columns, c) for c in ("lost_id", "lost_hash", "lost_keys"))
    lost = repeated_lines(docs, min_chars, min_docs, bits_a_key, shard_rows).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("keys").alias(keys_))
    own = document()
    joined = docs.join(lost, own[0].eqNullSafe(F.col(id_)) & (own[1] == F.col(hash_)), "left").drop(id_, hash_)
    out = docs.withColumns({"text": F.col("text").cast("string"), "n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema
    names = out.names

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        new, n, dropped = [], [], []
        for text, keys in zip(texts(batch.column("text")), batch.column(keys_).to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            stay = lines
            if keys:
                gone = set(keys)
                stay = [x for x in lines if len(x) < min_chars or (k := key_of(x, min_chars)) is None or digest_of(k) not in gone]
            new.append(b"\n".join(stay) if keys else text or b"")
            n.append(len(lines))
            dropped.append(len(lines) - len(stay))
        own = {"text": pa.array(new, pa.binary()).cast(pa.string()), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
        return pa.RecordBatch.from_arrays([own[c] if c in own else batch.column(c) for c in names], names)

    return joined.mapInArrow(each_batch(cut), out)
