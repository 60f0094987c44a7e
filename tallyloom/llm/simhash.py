"""SimHash near-dedup by deletion-variant signatures.

A fingerprint is cut into two halves.  Of two fingerprints that differ in at most
three bits, one half differs in at most one.  Each half is indexed once as it is and
once for each of its bits with that bit as a wildcard; an equality of such keys finds
every pair, which is then verified over all 64 bits.

Equal fingerprints are collapsed first, so copies cost one row.  Within the rows of
one key only a spanning forest of the verified links is emitted, never all pairs.
A half that very many fingerprints share is dealt into blocks; each pair of
blocks is a group of its own, so no task holds an unbounded group.  The links become
components by label propagation with pointer jumping, all in DataFrames, each
round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import LOWER, each_batch, free_name, settle, texts, unsettle

SEED = 42
HALF = 32
#: Fingerprints of one half that stay in one group; more are dealt into blocks.
BLOCK = 4096


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The 64-bit majority fingerprint of a text's word shingles, repeats included."""
    parts = text.translate(LOWER).split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    h = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return h(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)])
    n = len(starts)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        counts += np.unpackbits(np.frombuffer(raw[at * 8 : (at + 65536) * 8], np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed 64-bit long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, words) for t in texts(batch.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each_batch(run), "doc_id long, fp long")


def forest(fps: np.ndarray, side: np.ndarray, bits: int, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links (smallest, member) of the components under "differs in at most *bits* bits".

    Where *side* has two values, only links across them are sought.
    """
    order = np.argsort(fps)
    fps, side = fps[order], side[order]
    raw = fps.view(np.uint64)  # of signed numbers only the absolute value would be counted
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    across = side.min() != side.max()
    left, right = (np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())) if across else (np.arange(len(fps)),) * 2
    for at in range(0, len(left), rows):
        own = left[at : at + rows]
        i, j = np.nonzero(np.bitwise_count(raw[own][:, None] ^ raw[right][None, :]) <= bits)
        i, j = own[i], right[j]
        differ = root[i] != root[j]
        for a, b in zip(i[differ].tolist(), j[differ].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        for k in range(len(root)):
            root[k] = root[root[k]]
    top = np.array([find(i) for i in range(len(fps))], np.int64)
    at = np.flatnonzero(top != np.arange(len(fps)))
    return fps[top[at]], fps[at]


def _packed(blocks: Column) -> Column:
    """Half, wildcard, pair of blocks and value in 63 bits, without loss up to 4096 blocks; past that some groups merge."""
    tag = (F.col("seg") * (HALF + 1) + F.col("wild") + 1).cast("long")
    return F.shiftleft(tag, 56).bitwiseOR(F.shiftleft(blocks, HALF)).bitwiseOR(F.col("value"))


def _keys(distinct: DataFrame, block: int) -> DataFrame:
    """(key, side, fp): every fingerprint under each of its keys and blocks."""
    fp = F.col("fp")
    halves = [F.shiftrightunsigned(fp, HALF), fp.bitwiseAND(F.lit((1 << HALF) - 1))]
    both = distinct.select("fp", F.posexplode(F.array(*halves)).alias("seg", "half"))
    crowd = both.groupBy("seg", "half").count().where(F.col("count") > block).select("seg", "half", F.ceil(F.col("count") / block).alias("blocks"))
    # A wildcard's group joins two values of a half: the larger number of blocks of the two counts for both.
    step = F.explode(F.sequence(F.lit(-1), F.lit(HALF - 1))).alias("wild")
    flip = F.when(F.col("wild") < 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, wild)"))
    groups = crowd.select("seg", "half", "blocks", step).select("seg", "wild", F.col("half").bitwiseAND(F.bitwise_not(flip)).alias("value"), "blocks").groupBy("seg", "wild", "value").agg(F.max("blocks").alias("blocks"))
    keyed = both.select("fp", "seg", "half", step).select("fp", "seg", "wild", F.col("half").bitwiseAND(F.bitwise_not(flip)).alias("value"), (F.col("half").bitwiseAND(flip) != 0).alias("side"))
    if crowd.isEmpty():
        return keyed.select(_packed(F.lit(0).cast("long")).alias("key"), "side", "fp")
    dealt = keyed.join(groups, ["seg", "wild", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("mine")).alias("a"), F.greatest(b, F.col("mine")).alias("b")))
    split = dealt.withColumn("mine", mine).select("fp", "seg", "wild", "value", "side", F.explode(pairs).alias("p"))
    return split.select(_packed(F.pmod(F.col("p.a") * 4096 + F.col("p.b"), F.lit(1 << 24))).alias("key"), "side", "fp")


def links(distinct: DataFrame, bits: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b): links between different fingerprints that join all that are within *bits* bits.

    Each link is a path of true links within one key's rows; a < b.
    """
    if bits > 3:
        raise ValueError("two halves and one wildcard find at most three differing bits")
    keyed = _keys(distinct, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]

        def groups(k: np.ndarray, side: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
            size = np.diff(cuts)
            out_a, out_b = [], []
            two = cuts[:-1][size == 2]
            a, b = fp[two], fp[two + 1]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= bits
            out_a.append(np.minimum(a, b)[near])
            out_b.append(np.maximum(a, b)[near])
            for at, n in zip(cuts[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                a, b = forest(fp[at : at + n], side[at : at + n], bits)
                out_a.append(a)
                out_b.append(b)
            pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()]
            k, side, fp = (np.concatenate(x) for x in zip(rest, new, strict=True))
            last = int(np.searchsorted(k, k[-1])) if len(k) else 0
            rest = [k[last:], side[last:], fp[last:]]
            if last:
                yield groups(k[:last], side[:last], fp[:last])
        if len(rest[0]):
            yield groups(*rest)

    sorted_keys = keyed.repartition("key").sortWithinPartitions("key")
    return sorted_keys.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, label): for each vertex of the links (a, b) the least vertex of its component.

    Rounds of least-neighbour labels and pointer jumping until no label changes;
    the number of rounds grows with the logarithm of a component's diameter.
    """
    both = settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = settle(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")))
    while True:
        seen = both.join(label.select(F.col("v").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("v")).agg(F.min("near").alias("near"))
        lower = label.join(seen, "v").select("v", F.least("label", "near").alias("next"), F.col("label").alias("was"))
        jump = label.select(F.col("v").alias("next"), F.col("label").alias("far"))
        after = settle(lower.join(jump, "next", "left").select("v", F.least(F.col("next"), F.coalesce("far", "next")).alias("label"), "was"))
        moved = after.where(F.col("label") != F.col("was")).limit(1).count()
        unsettle(label)
        label = after.select("v", "label")
        if not moved:
            return label


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, bits: int = 3, words: int = 3, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of *docs*.

    Texts are lower-cased (A-Z), cut at ASCII white space and shingled by
    *words* words; a text of fewer words is one shingle, a null, empty or blank text has
    the fingerprint zero and links like any other.  A bit is set where over half of the
    shingles' XXH64 have it.  Documents link at *bits* (at most 3) or fewer differing
    bits; component_id is the least doc_id of the component.  Repeated rows give
    repeated rows; a null doc_id is linked but never becomes a component_id unless
    its component has no other.  Further columns of *docs* are not read.
    """
    fps = settle(fingerprints(docs, words))
    least = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    group = components(links(least.select("fp"), bits, block))
    ends = least.join(group.withColumnRenamed("v", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "least")
    first = ends.groupBy("label").agg(F.min("least").alias("component_id"))
    named = ends.join(first, "label").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bits: int = 3, words: int = 3) -> DataFrame:
    """*docs* without the near-duplicates: of each component the row of the least doc_id stays.

    Of repeated rows of one doc_id all stay with it.
    """
    gone_id = free_name(docs.columns, "gone_id")
    found = near_duplicates(docs, bits, words).where(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(found, F.col("doc_id").cast("long") == F.col(gone_id), "left_anti")
