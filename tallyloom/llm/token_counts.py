"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole.  The tokens' byte lengths give their
character spans; these are joined to the spans of its sections or fields, both in
order, by binary search.  A token that reaches over a boundary is allocated by a stated rule:

* ``start``: all of it to the section of its first character,
* ``end``: all of it to the section of its last character,
* ``majority``: all of it to the section with most of its characters, the first of equals,
* ``share``: to every section in proportion to the characters there (fractions).

Under every rule the sections of a document add up to its tokens.  A token of a part of a
character's bytes belongs to that character.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import texts

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RULES = ("start", "end", "majority", "share")


@functools.lru_cache(maxsize=2)
def encoding(ranks: str):
    """(encoder, byte length of every token) of a rank file, one for a worker process."""
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(own.values()) + 1, np.int64)
    lengths[list(own.values())] = list(map(len, own))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={}), lengths


def encode(text: str, ranks: str = RANKS) -> np.ndarray:
    """The tokens of a whole text; for runs of white space too long for the encoder's pattern matcher, piece by piece."""
    encoder, _ = encoding(ranks)
    try:
        return encoder.encode_to_numpy(text, disallowed_special=())
    except ValueError:
        import public_tokenizers
        import regex

        pieces = regex.finditer(public_tokenizers.PATTERN, text)
        return np.array([t for m in pieces for t in encoder._encode_single_piece(m.group().encode())], np.int64)


def token_spans(text: bytes, ranks: str = RANKS) -> tuple[np.ndarray, np.ndarray]:
    """The first character of every token and the character after its last."""
    ends = np.cumsum(encoding(ranks)[1][encode(text.decode("utf-8", "replace"), ranks)])
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    if text.isascii():
        return starts, ends
    char = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return char[starts] - 1, char[ends - 1]


def line_starts(text: bytes) -> np.ndarray:
    """The first character of every line; a line break belongs to the line that it ends."""
    raw = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(raw == 10) + 1
    if not text.isascii():
        at = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[at]
    return np.concatenate(([0], at))


def allocate(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens that cross a boundary) of every section; *sections*: their first characters, from 0."""
    n = len(sections)
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, ends - 1, "right") - 1
    owner = last if rule == "end" else first
    across = np.flatnonzero(first != last)
    crossing = np.bincount(owner[across], minlength=n)
    tokens = np.bincount(owner, minlength=n).astype(np.float64)
    if rule in ("majority", "share") and len(across):
        crossing = np.zeros(n, np.int64)
        for t in across.tolist():
            own = np.arange(first[t], last[t] + 1)
            cuts = np.concatenate(([starts[t]], sections[own[1:]], [ends[t]]))
            sizes = np.diff(cuts)
            tokens[first[t]] -= 1
            if rule == "majority":
                tokens[own[sizes.argmax()]] += 1
            else:
                tokens[own] += sizes / sizes.sum()
            crossing[own[sizes.argmax()]] += 1
    return tokens, crossing


def _attributed(df: DataFrame, sections: Callable[[bytes, object], np.ndarray], rule: str, ranks: str) -> DataFrame:
    """*df*: (id, text, cuts).  One row for each section of each row."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                size, found = [], []
                for text, cuts in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    text = text or b""
                    starts, ends = token_spans(text, ranks)
                    own = sections(text, cuts)
                    tokens, crossing = allocate(starts, ends, own, rule)
                    size.append(len(own))
                    total = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
                    found.append((np.arange(len(own)), own, np.concatenate((own[1:], [total])), tokens, crossing))
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), size)))
                cols = [np.concatenate(x) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in cols)], ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    return df.mapInArrow(run, "doc_id long, section long, char_start long, char_end long, n_tokens double, n_crossing long")


def section_tokens(docs: DataFrame, rule: str = "start", ranks: str = RANKS) -> DataFrame:
    """(doc_id, section, char_start, char_end, n_tokens, n_crossing): a row for every line of every text.

    Sections are lines, from 0, each with its line break; their spans are in code points and
    end exclusive.  n_crossing: tokens that touch more than one section, at
    the section that *rule* gives them to (``share``: the one with most of them).  A null or empty text is one
    section without tokens.  Repeated rows are counted each; a null doc_id stays null; other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(0).alias("cuts"))
    return _attributed(own, lambda text, _: line_starts(text), rule, ranks)


def field_tokens(df: DataFrame, fields: list[str], id_col: str = "doc_id", separator: str = "\n", rule: str = "start", ranks: str = RANKS) -> DataFrame:
    """As section_tokens, where the sections are *fields* of a row, joined by *separator* and encoded as one text.

    The separator belongs to the field before it; a null field is empty.  Of empty fields that start at
    one character the last gets the tokens there.
    """
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    ends = [F.lit(0)]
    for p in parts[:-1]:
        ends.append(ends[-1] + F.length(p) + len(separator))
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.concat_ws(separator, *parts).alias("text"), F.array(*(e.cast("long") for e in ends)).alias("cuts"))
    return _attributed(own, lambda _, cuts: np.array(cuts, np.int64), rule, ranks)
