"""The lattice of all segmentations of a word into pieces of a fixed public vocabulary.

A word is written with the vocabulary's word-start mark before it.  Every substring
that is a piece is an edge of its lattice; a single character that is no piece is an
edge too, with the "unknown" weight.  The forward recursion, in log space, sums over all paths.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable
from itertools import chain

import numpy as np
import sentencepiece

MARK = "▁"
#: A public vocabulary; its path is a parameter of every operator that uses it.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words of so many characters are run by themselves, others together.
LONG = 128
#: Words that are run together.
TOGETHER = 16_384


class Trie:
    """The pieces' characters as a tree; its branches are in a table of open addresses, so that many steps are looked up at once."""

    def __init__(self, names: list[str]) -> None:
        branches: dict[tuple[int, int], int] = {}
        ends = {}
        for number, name in enumerate(names):
            node = 0
            for c in name:
                node = branches.setdefault((node, ord(c)), len(branches) + 1)
            ends[node] = number
        self.piece = np.full(len(branches) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())
        self.bits = max(4, (len(branches) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.nodes = np.zeros(1 << self.bits, np.int64)
        keys = np.array([n << 21 | c for n, c in branches], np.int64)
        for key, slot, node in zip(keys.tolist(), self._slot(keys).tolist(), branches.values(), strict=True):
            while self.keys[slot] >= 0:
                slot = slot + 1 & (1 << self.bits) - 1
            self.keys[slot], self.nodes[slot] = key, node

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, characters: np.ndarray) -> np.ndarray:
        """The node after each character, -1 where there is none."""
        keys = nodes << 21 | characters
        slot = self._slot(keys)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        while len(left):
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.nodes[slot[left[hit]]]
            left = left[~hit & (held >= 0)]
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
        return out


class Pieces:
    """The pieces of a SentencePiece model, without control and byte pieces; the last number is "unknown"."""

    def __init__(self, model: str) -> None:
        self.encoder = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.encoder.get_piece_size()
        plain = [i for i in range(n) if not (self.encoder.is_control(i) or self.encoder.is_unknown(i) or self.encoder.is_byte(i))]
        self.names = [self.encoder.id_to_piece(i) for i in plain]
        self.number = {p: i for i, p in enumerate(self.names)}
        self.unknown = len(self.names)
        self.size = len(self.names) + 1
        self.longest = max(map(len, self.names))
        self._of = np.full(n, self.unknown, np.int64)
        self._of[plain] = np.arange(len(plain))
        self.trie = Trie(self.names)

    def encode(self, words: list[str]) -> list[list[int]]:
        """The vocabulary's own segmentation of each word, for counts()."""
        return self.encoder.encode(words, num_threads=1) if words else []

    def counts(self, encoded: Iterable[list[int]], times: list[int]) -> np.ndarray:
        """How often each piece occurs in encoded words that occur so many times."""
        encoded = list(encoded)
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter(chain.from_iterable(encoded), np.int64, sizes.sum())
        return np.bincount(self._of[flat], weights=np.repeat(np.array(times, np.int64), sizes), minlength=self.size).astype(np.int64)

    def edges(self, marked: str, end: int) -> Iterable[tuple[int, int]]:
        """(start, piece) of the edges that end at *end*."""
        get = self.number.get
        for start in range(max(0, end - self.longest), end):
            piece = get(marked[start:end])
            if piece is not None:
                yield start, piece
            elif start == end - 1:
                yield start, self.unknown

    def forward(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """log of the summed probability of all segmentations: a row for each word, a column for each model.

        *weights*: log probabilities, a row for each piece and a column for each model.
        """
        out = np.empty((len(words), weights.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) < LONG]
        for i, w in enumerate(words):
            if len(w) >= LONG:
                out[i] = self._forward_one(MARK + w, weights)
        for at in range(0, len(short), TOGETHER):
            own = short[at : at + TOGETHER]
            out[own] = self._forward_many([MARK + words[i] for i in own], weights)
        return out

    def _forward_many(self, marked: list[str], weights: np.ndarray) -> np.ndarray:
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(marked)), sizes)
        stop = first[word] + sizes[word]
        # All edges: every place of every word walks down the tree together.
        at, node, found = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
        for k in range(1, self.longest + 1):
            inside = at + k <= stop[at]
            at, node = at[inside], node[inside]
            node = self.trie.step(node, codes[at + k - 1])
            piece = np.where(node >= 0, self.trie.piece[node], -1)
            if k == 1:
                found.append((at, np.full(len(at), 1), np.where(piece >= 0, piece, self.unknown)))
            else:
                hit = piece >= 0
                found.append((at[hit], np.full(int(hit.sum()), k), piece[hit]))
            at, node = at[node >= 0], node[node >= 0]
            if not len(at):
                break
        start, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        # A word has a place before each character and one at its end; edges go by where they end, then by length.
        end = start - first[word[start]] + length
        order = np.argsort(end * (self.longest + 1) + length, kind="stable")
        source, length, piece = (start + word[start])[order], length[order], piece[order]
        key = (end * (self.longest + 1))[order] + length
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
        alpha = np.full((len(codes) + len(marked), weights.shape[1]), -np.inf)
        alpha[first + np.arange(len(marked))] = 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            target = source[a:b] + length[a]
            alpha[target] = np.logaddexp(alpha[target], alpha[source[a:b]] + weights[piece[a:b]])
        return alpha[first + np.arange(len(marked)) + sizes]

    def _forward_one(self, marked: str, weights: np.ndarray) -> np.ndarray:
        """As forward, for one word, keeping only as many positions as a piece is long."""
        alpha = {0: np.zeros(weights.shape[1])}
        for end in range(1, len(marked) + 1):
            total = np.full(weights.shape[1], -np.inf)
            for start, piece in self.edges(marked, end):
                total = np.logaddexp(total, alpha[start] + weights[piece])
            alpha[end] = total
            alpha.pop(end - self.longest, None)
        return alpha[len(marked)]


@functools.lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    """One vocabulary for a worker process."""
    return Pieces(model)


def log_weights(counts: np.ndarray, smoothing: float) -> np.ndarray:
    """Log piece probabilities, a column for each model, by additive smoothing."""
    own = counts + smoothing
    return np.log(own / own.sum(axis=0, keepdims=True))
