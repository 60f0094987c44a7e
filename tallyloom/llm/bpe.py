"""Byte-pair encoding with a public vocabulary, and decoding, of texts of any length.

A text of up to two leaves is encoded where it lies.  A longer one is cut into leaves, wherever a leaf is full; leaves are dealt to
all tasks and encoded alone, and a tree joins them two by two.  At a join a window of tokens on both sides is encoded anew;
it grows until its first and its last token are those that the sides have at these places.

Why that is exact.  Within a stretch that the pattern doesn't split, tokens are the encoding of the stretch if and only if each two
neighbours are the encoding of their own bytes.  Both sides have this of all neighbours outside the window, the window has it inside, and one token in common at
either end links them.  The pattern itself looks at what follows a cut only across white space, an apostrophe or a special token.  So a window never begins or ends behind white
space or beside an apostrophe, and reaches further than the longest special token; where no such place is left it takes the whole side.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tallyloom.llm.common import free_name, settle, unsettle

#: A public vocabulary; its path is a parameter of every operator that uses it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern that splits texts before merging, which belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points of a leaf.
LEAF = 32_768
#: Tokens on each side of a join that are encoded anew at first.
WINDOW = 32
#: Rows that a task encodes or decodes at once.
ROWS = 256
#: Code points before a cut among which there is no apostrophe: the longest that the pattern joins to one.
AFTER_APOSTROPHE = 3


def _alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary's file: printable ones for themselves, the others from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """A byte-level vocabulary whose merges are in the order of their ids."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        byte_of = _alphabet()
        special = {t["content"]: t["id"] for t in held["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, name)): i for name, i in held["model"]["vocab"].items() if name not in special}
        made = [bytes(map(byte_of.__getitem__, "".join(m) if isinstance(m, list) else m.replace(" ", "", 1))) for m in held["model"]["merges"]]
        if [ranks.get(m) for m in made] != list(range(256, 256 + len(made))):
            raise ValueError(f"{path}: the merges aren't in the order of their tokens' ids")
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        names = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in special.items()}
        #: The bytes of every id; of a number that is none, nothing.
        self.bytes = [names.get(i, b"") for i in range(max(names) + 1)]
        #: What a window has at least on each side.
        self.reach = max((len(s.encode()) for s in special), default=0) + AFTER_APOSTROPHE

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; the strings of special tokens are these tokens."""
        return self.fast.encode_to_numpy(text, allowed_special="all").view(np.int32)

    def joined_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; unknown ids give nothing, bytes that are no UTF-8 the replacement character."""
        if min(ids, default=0) >= 0 and max(ids, default=0) < len(self.bytes):
            out = b"".join(map(self.bytes.__getitem__, ids))
        else:
            out = b"".join(self.bytes[i] for i in ids if 0 <= i < len(self.bytes))
        return out.decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str = VOCABULARY) -> Codec:
    return Codec(path)


def may_cut(own: Codec, ids: np.ndarray, at: int) -> bool:
    """Whether a window may begin or end before token *at*: between two characters, not behind white space, not beside an apostrophe or what the pattern joins to one."""
    after = own.joined_bytes(ids[at : at + 4])[:4]
    if not after or 0x80 <= after[0] < 0xC0:
        return False
    before = own.joined_bytes(ids[max(0, at - 16) : at])[-16:].decode("utf-8", "ignore")[-AFTER_APOSTROPHE:]
    return bool(before) and not before[-1].isspace() and "'" not in before and after[:1] != b"'"


def joined(own: Codec, a: np.ndarray, b: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The encoding of two texts one behind the other, from those of each."""
    size = max(window, own.reach)
    while True:
        i, j = max(0, len(a) - size), min(len(b), size)
        while i and not may_cut(own, a, i):
            i -= 1
        while j < len(b) and not may_cut(own, b, j):
            j += 1
        # Leaves are cut between code points, so what is whole on both sides is valid.
        mid = own.encode((own.joined_bytes(a[i:]) + own.joined_bytes(b[:j])).decode("utf-8"))
        if (not i or mid[0] == a[i]) and (j == len(b) or mid[-1] == b[j - 1]):
            return np.concatenate((a[:i], mid, b[j:]))
        size *= 4


def int_lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *parts]), pa.int32()))


def in_parts(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An iterator function for mapInArrow that applies *fn* to so few rows at once that a task holds little besides the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                yield fn(batch.slice(at, ROWS))

    return run


def lists_of(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column of integers, in numpy; a null list is an empty one, a null in a list -1."""
    ends, values = column.offsets.to_numpy(), column.values.fill_null(-1).to_numpy()
    return [values[a:b] if known else values[:0] for a, b, known in zip(ends, ends[1:], column.is_valid().to_pylist(), strict=False)]


_IDS = ArrayType(IntegerType(), False)


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str = VOCABULARY, leaf: int = LEAF, window: int = WINDOW) -> DataFrame:
    """*docs* with the column *out*, the ids of each whole text, as the vocabulary's own library encodes it.

    No special token is added; where a text has the string of one, it is that token.  A null or empty text has no ids.  Repeated rows are rows each.  A column named
    *out* is replaced; all others stay as they are.  An empty table gives an empty one.
    """
    docs = docs.drop(out)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    schema = StructType([*docs.schema, StructField(out, _IDS, False)])
    column, size = docs.columns.index(text), free_name(docs.columns, "size")

    def alone(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        ids = int_lists([own.encode(t or "") for t in batch.column(column).cast(pa.string()).to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, out])

    short = docs.where(F.length(whole) <= 2 * leaf).mapInArrow(in_parts(alone), schema)
    # Written once, so that a row keeps its number.
    number = free_name(docs.columns, "number")
    long = settle(docs.where(F.length(whole) > 2 * leaf).withColumns({number: F.monotonically_increasing_id(), size: F.ceil(F.length(whole) / leaf).cast("int")}))
    most = long.agg(F.max(size)).first()[0]
    if most is None:
        return short
    parts = F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"(?s).{{1,{leaf}}}"), F.lit(0))
    cut = long.select(F.col(number).alias("n"), F.posexplode(parts).alias("at", "t"))

    def leaves(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), int_lists([own.encode(t) for t in batch.column(2).to_pylist()])], ["n", "at", "ids"])

    def joins(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        both = zip(lists_of(batch.column(2)), lists_of(batch.column(3)), strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), int_lists([joined(own, a, b, window) if len(b) else a for a, b in both])], ["n", "at", "ids"])

    kind = "n long, at int, ids array<int>"
    nodes = settle(cut.repartition("n", "at").mapInArrow(in_parts(leaves), kind))
    for _ in range(math.ceil(math.log2(most))):
        half = F.shiftright("at", 1)
        left = nodes.where(F.col("at") % 2 == 0).select("n", half.alias("at"), "ids")
        right = nodes.where(F.col("at") % 2 == 1).select("n", half.alias("at"), F.col("ids").alias("more"))
        old, nodes = nodes, settle(left.join(right, ["n", "at"], "left").mapInArrow(in_parts(joins), kind))
        unsettle(old)
    met = long.join(nodes.select(F.col("n").alias(number), F.col("ids").alias(out)), number).select(*docs.columns, out)
    return short.union(met)


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", path: str = VOCABULARY) -> DataFrame:
    """*rows* with the column *out*, the text of the ids; special tokens are their strings.

    Ids that the vocabulary doesn't have, null ones included, give nothing; null lists an empty text; bytes that are no UTF-8 replacement characters.  A column named *out* is replaced.
    """
    rows = rows.drop(out)
    column = rows.columns.index(ids)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        found = [own.decode(x.tolist()) for x in lists_of(batch.column(column))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, out])

    return rows.mapInArrow(in_parts(run), StructType([*rows.schema, StructField(out, StringType(), False)]))
