"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary.
Training counts the pieces of the vocabulary's own segmentation of the labelled words;
prediction sums over all segmentations of each word by the forward recursion, so a text's
likelihood doesn't hang on one segmentation.  Pieces never span words, so a text's
log likelihood is the sum over its words, and each distinct word is run once by a
task as far as a bounded memory of words reaches.

What goes to the driver and out to the executors is the table of pieces by language, a block of languages at a time: the
vocabulary times ``block``, whatever the size of the input and whatever its labels hold.  Further blocks are further steps over the
same rows, which carry the best language so far and the sum over all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import each_batch, free_name, settle, texts
from tallyloom.llm.lattice import VOCABULARY, log_weights, pieces

#: ASCII letters in lower case and the bytes of all other characters stay; the rest parts words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words that a task remembers the scores of.
KNOWN = 300_000
SMOOTHING = 0.1
#: Languages whose pieces are sent out together.
BLOCK = 256
UNDETERMINED = "und"
#: Letters that a random text is made of, and the end of a word.
CHARACTERS = 27


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(LETTERS).split() if text else []


def has_letter(text: bytes | None) -> bool:
    """Whether any character is a letter in Unicode's sense."""
    if not text:
        return False
    if any(w.isascii() for w in words_of(text)):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def with_letters(docs: DataFrame) -> DataFrame:
    """The rows of *docs* whose text has a letter."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([has_letter(t) for t in texts(batch.column("text").cast(pa.string()))], pa.bool_()))

    return docs.mapInArrow(each_batch(run), docs.schema)


def plain(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower()


class Scorer:
    """Log likelihoods of words by language, remembering up to KNOWN of them."""

    def __init__(self, model: str, weights: np.ndarray) -> None:
        self.pieces, self.weights = pieces(model), weights
        self._clear()

    def _clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.scores = np.zeros((1024, self.weights.shape[1]))

    def learn(self, words: Iterator[bytes]) -> None:
        new = [w for w in words if w not in self.at]
        if not new:
            return
        first = len(self.at)
        if first + len(new) > len(self.scores):
            self.scores = np.vstack([self.scores, np.zeros((first + len(new), self.weights.shape[1]))])
        self.scores[first : first + len(new)] = self.pieces.forward([plain(w) for w in new], self.weights)
        self.at.update(zip(new, range(first, first + len(new)), strict=True))

    def score(self, documents: list[list[bytes]]) -> np.ndarray:
        """A row of log likelihoods for each document."""
        if len(self.at) > KNOWN:
            self._clear()
        self.learn(iter({w for words in documents for w in words}))
        at = self.at
        return np.array([self.scores[[at[w] for w in words]].sum(axis=0) if words else np.zeros(self.weights.shape[1]) for words in documents])


@dataclass
class Blocks:
    """Counts of pieces by language, as a table (lang, piece, n), of more languages than are sent out together."""

    counts: DataFrame
    langs: list[str]
    size: int
    block: int

    def __iter__(self) -> Iterator[tuple[list[str], np.ndarray]]:
        for at in range(0, len(self.langs), self.block):
            own = self.langs[at : at + self.block]
            yield own, _weights(self.counts.where(F.col("lang").isin(own)), own, self.size)


def _weights(counts: DataFrame, langs: list[str], size: int) -> np.ndarray:
    """Log piece probabilities of some languages."""
    rows, place = counts.toArrow(), {lang: i for i, lang in enumerate(langs)}
    table = np.zeros((size, len(langs)))
    table[rows.column("piece").to_numpy(), [place[x] for x in rows.column("lang").to_pylist()]] = rows.column("n").to_numpy()
    return log_weights(table, SMOOTHING)


def train(docs: DataFrame, learn_from: Column, model: str = VOCABULARY, block: int = BLOCK) -> tuple[list[str], np.ndarray | Blocks]:
    """(languages, log piece probabilities by language) from the rows with *learn_from* and a lang.

    Every value of lang is learned.  Of more than *block* values the counts are a written table, and the probabilities come from it a block at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        totals: dict[str, np.ndarray] = {}
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(1).to_pylist(), texts(batch.column(0)), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
            for lang, counter in words.items():
                if len(known) > KNOWN:
                    known.clear()
                new = [w for w in counter if w not in known]
                known.update(zip(new, own.encode([plain(w) for w in new]), strict=True))
                totals[lang] = totals.get(lang, 0) + own.counts((known[w] for w in counter), list(counter.values()))
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "piece", "n"])

    labelled = docs.where(learn_from & F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    langs = sorted(r.lang for r in labelled.select("lang").distinct().toLocalIterator())
    size = pieces(model).size
    if not langs:
        return langs, log_weights(np.zeros((size, 0)), SMOOTHING)
    counts = labelled.mapInArrow(count, "lang string, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    return langs, _weights(counts, langs, size) if len(langs) <= block else Blocks(settle(counts), langs, size, block)


def predict(docs: DataFrame, langs: list[str], weights: np.ndarray | Blocks, model: str = VOCABULARY, margin: bool = False) -> DataFrame:
    """*docs* with lang_pred and score, the posterior of that language under equal priors.

    With *margin* there are also the columns characters, of its words and their ends, and margin: by how much, in log10, the whole text is likelier in that language than
    as random characters, each with a chance of one in CHARACTERS.  A text of none of the learned languages, or of no language, is far below 0.

    A text that is null, empty or without a letter is "und" with score 0, with nulls for both, as is every
    text where no language was learned.  Ties go to the first language by code
    points.  Repeated rows are predicted alike; columns of *docs* named as the new ones
    are replaced, other columns pass through and aren't read.
    """
    docs = docs.drop("lang_pred", "score", *(("margin", "characters") if margin else ()))
    names = docs.columns
    name, best, total, size = (free_name(names, c) for c in ("own_name", "own_best", "own_total", "own_size"))
    kinds = {name: "string", best: "double", total: "double", size: "long"}
    state = docs.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})
    schema = state.schema
    for block in ([(langs, weights)] if isinstance(weights, np.ndarray) else weights) if langs else ():
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            langs, weights = sent.value
            scorer = Scorer(model, weights)
            for whole in batches:
                for at in range(0, len(whole), 512):
                    batch = whole.slice(at, 512)
                    own = texts(batch.column("text").cast(pa.string()))
                    letters = np.array([has_letter(t) for t in own], bool)
                    words = [words_of(t) if known else [] for t, known in zip(own, letters.tolist(), strict=True)]
                    logs = scorer.score(words) if len(own) else np.zeros((0, len(langs)))
                    # A null is a text that no block has seen: nothing is likelier.
                    so_far, summed = (batch.column(c).fill_null(-np.inf).to_numpy() for c in (best, total))
                    most = logs.max(axis=1)
                    here = most + np.log(np.exp(logs - most[:, None]).sum(axis=1))
                    better = most > so_far
                    pred = [langs[k] if new else old for k, new, old in zip(logs.argmax(axis=1).tolist(), better.tolist(), batch.column(name).to_pylist(), strict=True)]
                    found = [
                        pa.array(pred, pa.string(), mask=~letters), pa.array(np.where(better, most, so_far), mask=~letters),
                        pa.array(np.logaddexp(summed, here), mask=~letters), pa.array(np.array([len(b" ".join(w).decode("utf-8", "replace")) + 1 for w in words], np.int64), mask=~letters),
                    ]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found], schema.names)

        state = state.mapInArrow(run, schema)
    told = {"lang_pred": F.coalesce(F.col(name), F.lit(UNDETERMINED)), "score": F.when(F.col(best).isNull(), 0.0).otherwise(F.least(F.exp(F.col(best) - F.col(total)), F.lit(1.0)))}
    if margin:
        told |= {"margin": (F.col(best) + F.col(size) * F.lit(float(np.log(CHARACTERS)))) / F.lit(float(np.log(10))), "characters": F.col(size)}
    return state.select(*names, *(c.alias(n) for n, c in told.items()))


def identify(docs: DataFrame, learn_from: Column, model: str = VOCABULARY) -> DataFrame:
    """Learn from the rows with *learn_from* and predict every row; see :func:`predict`."""
    return predict(docs, *train(docs, learn_from, model), model)
