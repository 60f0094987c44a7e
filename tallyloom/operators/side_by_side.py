"""The walks of reconcile over many runs at once: all distances of their places together, then each run's next step in the same round.

Most runs are short, so what a run costs is what is done run by run.  Here nothing is: the distances of all places of all runs of a batch are made column by column of the recurrence,
and in a round every run takes its next match, the least of its near places that are still before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tallyloom.functions.prefix_tree import cost_table
from tallyloom.functions.similarity import BORDER

#: Letters of a name up to which a distance fits a byte, with room for a step.
SHORT = 64
#: Pairs of names whose distances are made at once.
PAIRS = 1 << 13
#: Pairs that are held at once.
HELD = 1 << 20
#: Lines, and entities, of a run up to which a step's key is a number.
LINES = 1 << 15
FAR = np.iinfo(np.int64).max


@dataclass
class Runs:
    """The lists of some runs, one after the other; *lines* and *entities*: how many of them each run has.

    Of lines the names, null ones too; of entities whether they have none; of the aliases of those with a name, whose they are.
    """

    lines: np.ndarray
    names: list[str | None]
    entities: np.ndarray
    unread: np.ndarray
    aliases: list[str]
    owner: np.ndarray


@dataclass
class Rows:
    """Rows of the walks: run, kind, places within the run (-1 for none), the line whose name it is (-1 for none), and distance and difference of places where *scored*."""

    run: np.ndarray
    kind: np.ndarray
    line: np.ndarray
    entity: np.ndarray
    name: np.ndarray
    dist: np.ndarray
    diff: np.ndarray
    scored: np.ndarray


#: Kinds by their number.
KINDS = ("match", "missing", "unread", "skipped")


def spans(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, number) of all numbers of some stretches."""
    which = np.repeat(np.arange(len(first)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count - first, count)


def _codes(names: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Each name's letters as numbers, its length, and the letters."""
    length = np.fromiter((len(n) if n is not None else 0 for n in names), np.int64, len(names))
    width = max(1, int(length.max(initial=0)))
    text = np.array([n if n is not None else "" for n in names], f"U{width}").view(np.uint32).reshape(len(names), width)
    letters = np.flatnonzero(np.bincount(text.ravel(), minlength=1))
    number = np.zeros(int(letters.max(initial=0)) + 1, np.int64)
    number[letters] = np.arange(len(letters))
    return number[text], length, [chr(c) for c in letters.tolist()]


def distances(names: list[str | None], aliases: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """similarity.warped_distance of the pairs of names *a* and aliases *b*, none of them longer than SHORT."""
    (mine, mine_length, mine_letters), (other, other_length, other_letters) = _codes(names), _codes(aliases)
    costs = cost_table(mine_letters, other_letters).astype(np.uint8).ravel()
    mine, other = np.ascontiguousarray(mine.T) * len(other_letters), np.ascontiguousarray(other.T)
    out = np.empty(len(a), np.uint8)
    # Pairs of like lengths go together.
    order = np.argsort((mine_length[a] * (SHORT + 1) + other_length[b]).astype(np.uint16), kind="stable")
    for at in range(0, len(order), PAIRS):
        own = order[at : at + PAIRS]
        size_a, size_b = mine_length[a[own]], other_length[b[own]]
        left, right = (code[: int(size.max())].take(i, axis=1) for code, i, size in ((mine, a[own], size_a), (other, b[own], size_b)))
        every, height = np.arange(len(own)), len(right)
        row = np.repeat((np.arange(height + 1) * BORDER).astype(np.uint8)[:, None], len(own), axis=1)
        found, after = row[size_b, every], np.empty_like(row)
        cells, cost = np.empty_like(right), np.empty(right.shape, np.uint8)
        for x, letter in enumerate(left, 1):
            np.take(costs, np.add(right, letter, out=cells), out=cost, mode="clip")
            low = np.minimum(row[1:], row[:-1])
            after[0] = x * BORDER
            for y in range(height):
                np.minimum(low[y], after[y], out=after[y + 1])
                after[y + 1] += cost[y]
            row, after = after, row
            done = np.flatnonzero(size_a == x)
            found[done] = row[size_b[done], done]
        out[own] = found
    return out


def near_places(runs: Runs, at_most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entity, line, distance) of all places of a run that are a match, by entity; of an entity's aliases the nearest one counts."""
    first = np.cumsum(runs.lines) - runs.lines
    run_of = np.repeat(np.arange(len(runs.entities)), runs.entities)
    run = run_of[runs.owner]
    upto = np.cumsum(runs.lines[run])
    known = np.fromiter((n is not None for n in runs.names), bool, len(runs.names))
    found = [np.empty((3, 0), np.int64)]
    at = 0
    while at < len(run):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + HELD, side="right")))
        which, line = spans(first[run[at:to]], runs.lines[run[at:to]])
        which, line = which[known[line]] + at, line[known[line]]
        far = distances(runs.names, runs.aliases, line, which)
        near = far <= at_most
        found.append(np.stack((runs.owner[which[near]], line[near], far[near].astype(np.int64))))
        at = to
    entity, line, far = np.concatenate(found, axis=1)
    order = np.lexsort((far, line, entity))
    entity, line, far = entity[order], line[order], far[order]
    new = np.ones(len(entity), bool)
    new[1:] = (entity[1:] != entity[:-1]) | (line[1:] != line[:-1])
    return entity[new], line[new], far[new]


def walks(runs: Runs, at_most: int) -> Rows:
    """The rows that reconcile.walk gives for each run, in no order.

    Places are numbered over all runs.  A place's wave and the way to a match follow from how many entities without a name lie before it, as in reconcile.next_match and reconcile.way.
    """
    line_to, entity_to = np.cumsum(runs.lines), np.cumsum(runs.entities)
    line_from, entity_from = line_to - runs.lines, entity_to - runs.entities
    total = int(runs.entities.sum())
    free = np.concatenate(([0], np.cumsum(runs.unread))).astype(np.int64)
    named = np.append(np.where(runs.unread, total, np.arange(total)), total)
    named = np.minimum.accumulate(named[::-1])[::-1]
    i, e, far = near_places(runs, at_most)
    run = np.repeat(np.arange(len(runs.entities)), runs.entities)[i]
    e0, i0 = line_from.copy(), entity_from.copy()
    steps = [np.empty((6, 0), np.int64)]

    def key(wave: np.ndarray, i: np.ndarray, e: np.ndarray, of: np.ndarray) -> np.ndarray:
        return (wave * (LINES + 1) + i - entity_from[of]) * (LINES + 1) + line_to[of] - e

    while len(run):
        own = np.unique(run)
        rows, columns = line_to[own] - e0[own], entity_to[own] - i0[own]
        by_line = rows <= columns
        first = np.minimum(named[i0[own]], entity_to[own])
        last_i = np.where(by_line, np.minimum(first, i0[own] + rows), entity_to[own])
        last_e = np.where(by_line, line_to[own], e0[own] + free[entity_to[own]] - free[i0[own]])
        ends = key(np.minimum(rows, columns), last_i, last_e, own)
        wave = i - i0[run] + np.maximum(0, e - e0[run] - (free[i] - free[i0[run]]))
        starts = np.searchsorted(run, own)
        keys = key(wave, i, e, run)
        best = np.minimum.reduceat(keys, starts)
        best = np.where(best < ends, best, -1)
        hit = np.flatnonzero(keys == np.repeat(best, np.diff(np.append(starts, len(run)))))
        r = run[hit]
        steps.append(np.stack((r, e0[r], i0[r], e[hit], i[hit], far[hit])))
        over = np.ones(len(line_to), bool)
        over[r] = False
        e0[r], i0[r] = e[hit] + 1, i[hit] + 1
        left = ~over[run] & (e >= e0[run]) & (i >= i0[run])
        run, e, i, far = run[left], e[left], i[left], far[left]
    run, e0, i0, e, i, far = np.concatenate(steps, axis=1)
    none, zero = np.full(len(run), -1), np.zeros(len(run), np.int64)
    found = [(run, zero, e, i, e, far, np.abs((e - line_from[run]) - (i - entity_from[run])))]
    beyond = np.maximum(0, e - e0 - (free[i] - free[i0]))
    first = named[i0]
    step, line = spans(e0 + first - i0, beyond)
    none = np.full(len(step), -1)
    found.append((run[step], np.full(len(step), 1), line, none, line, none, none))
    step, at = spans(free[i0], free[i] - free[i0])
    entity = np.flatnonzero(runs.unread)[at]
    none = np.full(len(step), -1)
    found.append((run[step], np.full(len(step), 2), none, entity, none, none, none))
    spot = e0[step] + free[entity] - free[i0[step]] + np.where(entity > first[step], beyond[step], 0)
    own = (spot < e[step]) & (spot > line_from[run[step]])
    step, spot, entity = step[own], spot[own], entity[own]
    r = run[step]
    found.append((r, np.full(len(r), 3), spot, entity, spot, np.full(len(r), 100), (spot - line_from[r]) - (entity - entity_from[r])))
    run, kind, line, entity, name, far, diff = (np.concatenate(x) for x in zip(*found, strict=True))
    return Rows(run, kind, np.where(line < 0, -1, line - line_from[run]), np.where(entity < 0, -1, entity - entity_from[run]), name, far, diff, (kind == 0) | (kind == 3))
