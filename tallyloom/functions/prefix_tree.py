"""All near pairs of terms and names: the recurrence of similarity.warped_distance along a tree of the names' letters.

Names in order are a tree: those that begin alike stand together.  A branch's column of the recurrence is made once for all names below it.  Costs are never below zero, so a column whose
least cost has reached the threshold ends its branch, exactly.  A branch isn't begun where a bound by letters says that no name below it is near:
every letter of a term, and of a name, costs at least what it costs with the best letter of the other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tallyloom.functions.similarity import BORDER, NEIGHBOURS, letter_cost

#: Terms that go down the tree together.
TOGETHER = 64
#: Columns that are worked on at once.
COLUMNS = 1 << 18
#: What no cost reaches.
FAR = np.int32(1 << 20)


def cost_table(rows: list[str], columns: list[str], case_penalty: bool = True) -> np.ndarray:
    """letter_cost of each letter of *rows* to each of *columns*."""
    at = {c: k for k, c in enumerate(columns)}
    alike: dict[str, list[str]] = {}
    for c in columns:
        alike.setdefault(c.lower(), []).append(c)
    out = np.full((len(rows), len(columns)), BORDER, np.float32)
    for k, c in enumerate(rows):
        for other in {*alike.get(c.lower(), ()), *NEIGHBOURS.get(c, "")} & at.keys():
            out[k, at[other]] = letter_cost(c, other, case_penalty)
    return out


def letter_counts(names: list[str], letters: list[str]) -> np.ndarray:
    """How often each name has each letter."""
    at = {c: k for k, c in enumerate(letters)}
    out = np.zeros((len(names), len(letters)), np.float32)
    owner = np.repeat(np.arange(len(names)), [len(n) for n in names])
    np.add.at(out, (owner, np.fromiter((at[c] for n in names for c in n), np.int64, len(owner))), 1)
    return out


def best_costs(counts: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """For each name, of each letter of the other side, the cost with the best of its own letters; *costs*: own letters by others."""
    out = np.full((len(counts), costs.shape[1]), BORDER, np.float32)
    for k in range(counts.shape[1]):
        has = counts[:, k] > 0
        out[has] = np.minimum(out[has], costs[k])
    return out


@dataclass
class Found:
    """Near pairs by the places of term and name, their distances, and how many cells of the recurrence were made."""

    term: np.ndarray
    name: np.ndarray
    dist: np.ndarray
    cells: int


def _codes(names: list[str], letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
    at = {c: k for k, c in enumerate(letters)}
    lengths = np.fromiter(map(len, names), np.int64, len(names))
    out = np.zeros((len(names), int(lengths.max(initial=0))), np.int64)
    for row, name in enumerate(names):
        out[row, : len(name)] = [at[c] for c in name]
    return out, lengths


def near_pairs(terms: list[str], names: list[str], threshold: float, case_penalty: bool = True) -> Found:
    """The pairs nearer than *threshold*; *names* are all different and in the order of their code points."""
    mine, other = (sorted(set().union(*map(set, x)) if x else ()) for x in (terms, names))
    costs = cost_table(mine, other, case_penalty)
    code, length = _codes(names, other)
    # How many letters a name shares with the one before it: where a new branch begins.
    same = np.zeros(len(names), np.int64)
    if len(names) > 1:
        differ = code[1:] != code[:-1]
        both = np.minimum(length[1:], length[:-1])
        same[1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), code.shape[1]), both)
    counts = letter_counts(names, other)
    back = best_costs(counts, costs.T.copy())
    out, cells = [], 0
    order = np.argsort([len(t) for t in terms], kind="stable")
    for at in range(0, len(order), TOGETHER):
        own = order[at : at + TOGETHER]
        some = [terms[i] for i in own]
        mine_counts = letter_counts(some, mine)
        bound = np.maximum(mine_counts @ back.T, best_costs(mine_counts, costs) @ counts.T)
        pairs, made = _descend(some, _codes(some, mine), code, length, same, bound, costs.astype(np.int32), threshold)
        cells += made
        out += [(own[t], n, d) for t, n, d in pairs]
    parts = [np.concatenate([np.empty(0, np.int64), *(x[k] for x in out)]) for k in range(3)]
    return Found(*parts, cells)


def _descend(terms, coded, code, length, same, bound, costs, threshold) -> tuple[list[tuple[np.ndarray, ...]], int]:
    """Pairs (term, name, distance) of a few terms of like length, and the cells made."""
    term_code, term_length = coded
    width, out, cells = term_code.shape[1], [], 0
    beyond = np.arange(width + 1)[None, :] > term_length[:, None]
    if len(length) and not length[0]:
        t = np.flatnonzero(term_length * BORDER < threshold)
        out.append((t, np.zeros(len(t), np.int64), term_length[t] * BORDER))
    # Branches of the level above, each a stretch of names, and the pairs of branch and term that are alive.
    starts = np.zeros(min(1, len(length)), np.int64)
    branch, term = np.zeros(len(terms) * len(starts), np.int64), np.arange(len(terms) * len(starts))
    column = np.broadcast_to(np.arange(width + 1, dtype=np.int32) * BORDER, (len(term), width + 1))
    for depth in range(1, code.shape[1] + 1):
        new = np.flatnonzero((length >= depth) & (same < depth))
        if not len(new) or not len(term):
            break
        of = np.searchsorted(starts, new, side="right") - 1
        first = np.searchsorted(of, np.arange(len(starts)))
        number = np.searchsorted(of, np.arange(len(starts)), side="right") - first
        # What is below a branch: the names up to where the next one begins, at this depth or above.
        ends = np.flatnonzero(same < depth)
        stop = np.append(ends, len(length))[np.searchsorted(ends, new, side="right")]
        least = np.minimum.reduceat(np.concatenate((bound, np.full((len(terms), 1), FAR)), axis=1), np.stack((new, stop), axis=1).ravel(), axis=1)[:, ::2]
        kept_branch, kept_term, kept_column = [], [], []
        step = max(1, COLUMNS // max(1, int(number.max())))
        for a in range(0, len(term), step):
            b, t = branch[a : a + step], term[a : a + step]
            n = number[b]
            row = np.repeat(np.arange(len(b)), n)
            child = np.repeat(first[b], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            alive = least[t[row], child] < threshold
            row, child = row[alive], child[alive]
            t, before = t[row], column[a : a + step][row]
            letter = code[new[child], depth - 1]
            after = np.empty_like(before)
            after[:, 0] = depth * BORDER
            for x in range(1, width + 1):
                after[:, x] = costs[term_code[t, x - 1], letter] + np.minimum(np.minimum(before[:, x], before[:, x - 1]), after[:, x - 1])
            cells += int(term_length[t].sum())
            done = np.flatnonzero(length[new[child]] == depth)
            dist = after[done, term_length[t[done]]]
            near = dist < threshold
            out.append((t[done][near], new[child[done]][near], dist[near].astype(np.int64)))
            low = np.where(beyond[t], FAR, after).min(axis=1) < threshold
            kept_branch.append(child[low])
            kept_term.append(t[low])
            kept_column.append(after[low])
        starts, branch, term = new, np.concatenate(kept_branch), np.concatenate(kept_term)
        column = np.concatenate(kept_column)
    return out, cells
