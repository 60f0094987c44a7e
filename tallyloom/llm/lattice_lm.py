"""LM scoring by the likelihood of the subword lattice.

The model is a unigram model over the pieces of an existing public vocabulary.  The
probability of a word is the sum over all its segmentations, by a forward recursion in log space;
pieces never span words, so a document's log probability is the sum over its words
plus that of its end.

The vocabulary's own scores are merge ranks, not probabilities, so the weights are
estimated here: the pieces of the vocabulary's own segmentation, weighted by how often
each word occurs in all training documents.

Dataflow.  Documents stay where they lie.  A task numbers what it reads in blocks of a fixed size of text; within a block each
word has a number, and a document becomes the numbers of its words, in no order that matters.  This and one row for each different word of a block, with its count in training, is
written once, and texts are not read again nor ever shuffled.  Words are counted over all blocks and run through the lattice
once each over the whole corpus; count and score go back to the blocks that hold the word, under its number there, and meet the
documents' numbers.  A very frequent word costs a row a block, and is summed before it meets in one task.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import LOWER, settle, texts
from tallyloom.llm.lattice import VOCABULARY, log_weights, pieces

SMOOTHING = 0.1
SPACES = re.compile(rb"[ \t\n\x0b\x0c\r]")
#: Bytes of text at which a block ends.
BLOCK_BYTES = 12_000_000
#: Different words at which a block ends.
BLOCK_WORDS = 500_000
#: Bytes of a text that are cut into words at once.
SLICE = 4_000_000

CODED = T.StructType([T.StructField("block", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("word", T.BinaryType()), T.StructField("c", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("learned", T.BooleanType()), T.StructField("words", T.BinaryType())])


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text in order, of a long text in several lists."""
    at = 0
    while text is not None and at < len(text):
        end = space.start() if len(text) - at > SLICE and (space := SPACES.search(text, at + SLICE)) else len(text)
        yield text[at:end].translate(LOWER).split()
        at = end


def packed(numbers: np.ndarray) -> bytes:
    """Numbers in order, as their differences by planes of bytes, of which the upper ones are nearly all zero."""
    return np.diff(np.sort(numbers), prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)


class Block:
    """The words of one block, numbered as they come, and how often each occurs in documents that are learned from."""

    def __init__(self, number: int) -> None:
        self.number, self.size = number, 0
        self.place: defaultdict[bytes, int] = defaultdict()
        self.place.default_factory = self.place.__len__
        self.learned: list[np.ndarray] = []

    def code(self, text: bytes | None, learned: bool) -> bytes:
        parts = [np.array(list(map(self.place.__getitem__, words)), np.int32) for words in words_of(text)]
        own = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.size += len(text or b"")
        if learned:
            self.learned.append(own)
        return packed(own)

    def full(self, block_bytes: int) -> bool:
        return self.size >= block_bytes or len(self.place) >= BLOCK_WORDS

    def rows(self) -> pa.RecordBatch:
        n = len(self.place)
        c = np.bincount(np.concatenate([*self.learned, np.zeros(0, np.int32)]), minlength=n)
        return _coded(np.full(n, self.number), place=pa.array(np.arange(n, dtype=np.int32)), word=pa.array(list(self.place), pa.binary()), c=pa.array(c[:n]))


def _coded(block: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"place": pa.int32(), "word": pa.binary(), "c": pa.int64(), "doc_id": pa.int64(), "learned": pa.bool_(), "words": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *(columns.get(k, pa.nulls(len(block), t)) for k, t in kinds.items())], ["block", *kinds])


def coded(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Rows of documents (block, doc_id, learned, words) and of words (block, place, word, c) of (doc_id, learned, text).

    A block ends with the document that fills it, and with its task; a text of any length is in one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(TaskContext.get().partitionId() << 32)
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                numbers, words = [], []
                for learned, text in zip(batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                    words.append(block.code(text, learned))
                    numbers.append(block.number)
                    if block.full(block_bytes):
                        yield block.rows()
                        block = Block(block.number + 1)
                yield _coded(np.array(numbers, np.int64), doc_id=batch.column(0), learned=batch.column(1), words=pa.array(words, pa.binary()))
        yield block.rows()

    return docs.mapInArrow(run, CODED)


def _pieces_of(words: DataFrame, model: str) -> np.ndarray:
    """Piece counts over (word, c), the end of a text apart; at most one row for each piece reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        total = np.zeros(own.size, np.int64)
        for batch in batches:
            encoded = own.encode([w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()])
            total += own.counts(encoded, batch.column(1).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])

    rows = words.where(F.col("c") > 0).select("word", "c").mapInArrow(count, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(pieces(model).size)
    counts[rows.column("piece").to_numpy()] = rows.column("n").to_numpy()
    return counts


def log_likelihood(docs: DataFrame, learn_from: Column, model: str = VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score) for every row of *docs*.

    Words are cut at ASCII white space, A-Z in lower case; the end of a text is one more
    token.  Rows with *learn_from* train.  n_known: tokens that occur in training.
    base_score: sum over tokens of log10((c + 0.5) / (N + 0.5 (V + 1))).  score: log10 of the
    probability under the lattice model, in which the end has the share (D + 0.5) / (P + D + 1) of
    D training documents and P training pieces, and pieces share the rest.

    A null or empty text is the end alone.  Without training rows all counts are zero
    and the base is that of V = 0.  Repeated rows count and are scored each; a null
    doc_id is like any other value.  Other columns are not read.
    """
    learned = F.coalesce(learn_from, F.lit(False)).alias("learned")
    own = settle(coded(docs.select(F.col("doc_id").cast("long"), learned, F.col("text").cast("string")), block_bytes))
    # A word's blocks come together by parts of the tasks, so that no row holds the blocks of all.
    places = settle(own.where("word IS NOT NULL").groupBy("word", F.shiftright("block", 42).alias("part")).agg(F.sum("c").alias("c"), F.collect_list(F.struct("block", "place")).alias("at")))
    words = settle(places.groupBy("word").agg(F.sum("c").alias("c")))
    total = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    told = own.where("words IS NOT NULL").select("block", "doc_id", "learned", "words")
    ends = told.where("learned").count()
    counts = _pieces_of(words, model)
    n, v = (total.n or 0) + ends, total.v + (ends > 0)
    weights = log_weights(counts[:, None], SMOOTHING)
    share = (ends + 0.5) / (counts.sum() + ends + 1)
    weights += math.log1p(-share)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run_lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for whole in batches:
            for at in range(0, len(whole), 4096):
                batch = whole.slice(at, 4096)
                logs = own.forward([w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()], sent.value)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(logs)], ["word", "c", "log_p"])

    scored = words.mapInArrow(run_lattice, "word binary, c long, log_p double")
    back = places.select("word", "at").join(scored, "word").select(F.explode("at").alias("at"), "c", "log_p").select("at.block", "at.place", "c", "log_p")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("learned", T.BooleanType()), *(T.StructField(k, T.LongType()) for k in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(k, T.DoubleType()) for k in ("base_score", "score"))])
    base, end = math.log10(n + 0.5 * (v + 1)), math.log(share)

    def sums(_: tuple, rows: pa.Table, table: pa.Table) -> pa.Table:
        place, size = table.column("place").to_numpy(), len(rows)
        c, log_p = np.zeros(len(table), np.int64), np.zeros(len(table))
        c[place], log_p[place] = table.column("c").to_numpy(), table.column("log_p").to_numpy()
        per_word = (c > 0).astype(np.float64), np.log10(c + 0.5) - base, log_p / math.log(10)
        found = np.zeros((4, size))
        for i, data in enumerate(x for part in rows.column("words").chunks for x in part.to_pylist()):
            at = unpacked(data)
            found[:, i] = len(at), *(float(x[at].sum()) for x in per_word)
        n_tokens, n_known, base_score, score = found
        base_score += math.log10(ends + 0.5) - base
        score += end / math.log(10)
        counts = [pa.array((x + y).astype(np.int64)) for x, y in ((n_tokens, 1), (n_known, int(ends > 0)))]
        return pa.table({"doc_id": rows.column("doc_id"), "learned": rows.column("learned"), "n_tokens": counts[0], "n_known": counts[1], "train_tokens": pa.array([n] * size, pa.int64()), "base_score": pa.array(base_score), "score": pa.array(score)})

    return told.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(sums, schema)
