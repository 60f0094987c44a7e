"""Reconciling an external ordered list of names with the tracked one, and reports on it.

The walk over both lists is order-dependent, so one run is one task, which holds both lists and nothing that grows with the pairs of places; runs are independent.
Short runs are walked together (side_by_side), so that what a task costs isn't what is done run by run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.prefix_tree import best_costs, cost_table, letter_counts
from tallyloom.functions.similarity import warped_distance, warped_pairs
from tallyloom.operators.side_by_side import KINDS, LINES, SHORT, Rows, Runs, walks
from tallyloom.operators.windows import islands

MATCH_AT_MOST = 12
#: Pairs of names up to which one after the other is faster.
FEW = 12
#: Possible matches that are scored at once.
FEW_PLACES = 4096
#: Waves, and entities, whose bounds are one product.
TILE = 512
#: Places of the waves that are looked at together, but for those beside nameless entities.
MOST_PLACES = 1 << 20
#: Pairs of a line and an alias up to which a run is walked together with others.
FEW_PAIRS = 1 << 14
#: Rows that are given at once.
TOLD = 1 << 16
SCHEMA = "run_id string, kind string, ext_index long, int_index long, name string, dist long, index_diff long"


def nearest(names: Sequence[str], aliases: Sequence[Sequence[str | None]]) -> list[int | None]:
    """For each name the least distance to the aliases beside it, None where there are none."""
    pairs = [(at, name, a) for at, (name, own) in enumerate(zip(names, aliases, strict=True)) for a in own if a is not None]
    far = warped_pairs([p[1] for p in pairs], [p[2] for p in pairs]).tolist() if len(pairs) > FEW else [warped_distance(*p[1:]) for p in pairs]
    out: list[int | None] = [None] * len(names)
    for (at, *_), x in zip(pairs, far, strict=True):
        out[at] = x if out[at] is None else min(out[at], x)
    return out


class Lists:
    """The two lists of a run as the walk needs them: which entities have a name, how many have none before each, and letters for lower bounds.

    Each letter of either name meets at least one of the other, so what its letters cost with the best one each adds up to no more than the distance.  An
    entity's aliases are bounded together.
    """

    def __init__(self, external: Sequence[str | None], tracked: Sequence[tuple[str | None, Sequence[str | None]]]) -> None:
        self.external, self.aliases = list(external), [[a for a in own if a is not None] for _, own in tracked]
        self.read = np.array([name is not None for name in self.external], bool)
        names = [name or "" for name in self.external]
        self.named = np.array([name is not None and bool(own) for (name, _), own in zip(tracked, self.aliases, strict=True)], bool)
        self.nameless = np.concatenate(([0], np.cumsum([name is None for name, _ in tracked]))).astype(np.int64)
        mine, other = (sorted(set().union(*map(set, some)) if some else ()) for some in (names, [a for own in self.aliases for a in own]))
        costs = cost_table(mine, other)
        self.letters = letter_counts(names, mine)
        self.back = best_costs(self.letters, costs)
        # All aliases of an entity as one name, and what each of them has at least.
        together = ["".join(own) for own in self.aliases]
        self.costs = best_costs(letter_counts(together, other), costs.T.copy())
        first = np.cumsum([0, *map(len, self.aliases)])
        each = letter_counts([a for own in self.aliases for a in own], other)
        self.least = np.array([each[a:b].min(axis=0) if b > a else np.zeros(len(other)) for a, b in zip(first, first[1:], strict=False)], np.float32).reshape(len(self.aliases), len(other))

    def unread(self, i: int) -> bool:
        return bool(self.nameless[i + 1] > self.nameless[i])

    def possible(self, rows: slice, columns: slice) -> tuple[np.ndarray, np.ndarray]:
        """(external, entity) places of a rectangle that can be a match."""
        near = (self.letters[rows] @ self.costs[columns].T <= MATCH_AT_MOST) & self.named[columns] & self.read[rows, None]
        e, i = np.nonzero(near & (self.back[rows] @ self.least[columns].T <= MATCH_AT_MOST))
        return e + rows.start, i + columns.start


def told(before: tuple[int, int], after: tuple[int, int], named: bool, external: Sequence[str]) -> list[tuple]:
    """The rows that a step of the walk leaves."""
    e, i = before
    if named:
        return [("missing", e, None, external[e], None, None)] if after[0] > e else []
    rows = [("unread", None, i, None, None, None)]
    # An external index of 0 isn't noted as skipped.
    return [*rows, ("skipped", e, i, external[e], 100, e - i)] if after[0] > e > 0 else rows


def possible_in(lists: Lists, start: tuple[int, int], waves: range) -> np.ndarray:
    """(wave, entity, minus external index) of places in some waves that can be a match, in the order in which the walk comes to them."""
    e0, i0 = start
    free = lists.nameless - lists.nameless[i0]
    found = [np.empty((0, 3), np.int64)]
    to_wave = min(len(lists.named), i0 + waves.stop)
    for at in range(i0, to_wave, TILE):
        to = min(to_wave, at + TILE)
        # A column before a wave's number has one place in it; in the column of that number lie all places that the nameless before it leave.
        low = 0 if to - 1 - i0 >= waves.start else int(free[to - 1]) + waves.start - (to - 1 - i0)
        high = int(free[to - 1]) + max(0, waves.stop - (at - i0))
        rows = slice(e0 + low, min(len(lists.external), e0 + high + 1))
        if rows.start < rows.stop:
            e, i = lists.possible(rows, slice(at, to))
            wave = i - i0 + np.maximum(0, e - e0 - free[i])
            own = (wave >= waves.start) & (wave < waves.stop)
            found.append(np.stack((wave[own], i[own], -e[own]), axis=1))
    every = np.concatenate(found)
    return every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]


def next_match(lists: Lists, start: tuple[int, int]) -> tuple[int, int, int] | None:
    """(external, entity, distance) of the next match from *start*; None where a list ends before.

    A step goes on by one in one list, past an entity without a name by one in both or in the entities alone.  So a place is as many steps away as there are entities on the way, and as many more as
    there are external names beyond the nameless among these.  Places are looked at by waves, those of one number of steps, with the first entity and then the
    last external name first; waves are taken one, then more at a time, and nothing of a wave is kept.
    """
    e0, i0 = start
    rows, columns = len(lists.external) - e0, len(lists.named) - i0
    if rows > 0 and columns > 0 and not lists.unread(i0) and lists.read[e0]:
        # Mostly the next names match at once.
        far = nearest([lists.external[e0]], [lists.aliases[i0]])[0]
        if far is not None and far <= MATCH_AT_MOST:
            return e0, i0, far
    first = i0
    while first < i0 + columns and lists.unread(first):
        first += 1
    # The first place that is beyond a list ends the walk.
    end = (rows, min(first, i0 + rows), -(e0 + rows)) if rows <= columns else (columns, i0 + columns, -(e0 + int(lists.nameless[i0 + columns] - lists.nameless[i0])))
    wave, width = 0, 1
    while wave <= end[0]:
        near = [p for p in map(tuple, possible_in(lists, start, range(wave, wave + width)).tolist()) if p < end]
        for at in range(0, len(near), FEW_PLACES):
            some = near[at : at + FEW_PLACES]
            far = nearest([lists.external[-e] for _, _, e in some], [lists.aliases[i] for _, i, _ in some])
            for (_, i, e), x in zip(some, far, strict=True):
                if x is not None and x <= MATCH_AT_MOST:
                    return -e, i, x
        wave, width = wave + width, max(1, min(2 * width, TILE, MOST_PLACES // (wave + 1)))
    return None


def way(lists: Lists, start: tuple[int, int], hit: tuple[int, int]) -> list[tuple]:
    """The rows from *start* to before a match.

    Of several ways the first is taken: external names beyond the nameless entities are passed at the first entity with a name, and of the nameless as many
    as are needed take an external name with them, the first ones.
    """
    (e, i), (last, stop) = start, hit
    beyond = max(0, last - e - int(lists.nameless[stop] - lists.nameless[i]))
    rows: list[tuple] = []
    while (e, i) != (last, stop):
        named = not lists.unread(i)
        if named and beyond:
            beyond, after = beyond - 1, (e + 1, i)
        else:
            after = (e + (not named and e < last), i + 1)
        rows += told((e, i), after, named, lists.external)
        e, i = after
    return rows


def walk(external: Sequence[str], tracked: Sequence[tuple[str | None, Sequence[str]]]) -> list[tuple]:
    """(kind, ext_index, int_index, name, dist, index_diff) rows of both lists side by side.

    *tracked*: (name, aliases).  Kinds: "match"; "skipped" for an external name beside an entity without a name;
    "unread" for such an entity; "missing" for an external name without an entity.  From each match the walk goes on
    with the closest next one, by steps; what follows the last match is not reported.
    """
    out: list[tuple] = []
    lists, place = Lists(external, tracked), (0, 0)
    while (hit := next_match(lists, place)) is not None:
        e, i, far = hit
        out += [*way(lists, place, (e, i)), ("match", e, i, lists.external[e], far, abs(e - i))]
        place = e + 1, i + 1
    return out


def _is_short(runs: Runs, pairs: np.ndarray) -> np.ndarray:
    """The runs whose distances are all made: few lines, entities and pairs, and no long name."""
    long = np.zeros(len(runs.lines), np.int64)
    for names, of in ((runs.names, np.repeat(np.arange(len(runs.lines)), runs.lines)), (runs.aliases, np.repeat(np.arange(len(runs.entities)), runs.entities)[runs.owner])):
        length = np.fromiter((len(n) if n is not None else 0 for n in names), np.int64, len(names))
        long[of[length > SHORT]] = 1
    return (pairs <= FEW_PAIRS) & (runs.lines < LINES) & (runs.entities < LINES) & (long == 0)


def _of(runs: Runs, own: np.ndarray) -> tuple[Runs, np.ndarray]:
    """Some of the runs, and the numbers of their lines."""
    lines, entities = np.repeat(own, runs.lines), np.repeat(own, runs.entities)
    number = np.cumsum(entities) - 1
    aliases = np.flatnonzero(entities[runs.owner])
    kept = np.flatnonzero(lines)
    return Runs(runs.lines[own], [runs.names[k] for k in kept.tolist()], runs.entities[own], runs.unread[entities], [runs.aliases[k] for k in aliases.tolist()], number[runs.owner[aliases]]), kept


def _walked(runs: Runs) -> list[Rows]:
    """The rows of all runs: of the short ones together, of the others one after the other."""
    run_of = np.repeat(np.arange(len(runs.entities)), runs.entities)
    pairs = runs.lines * np.bincount(run_of[runs.owner], minlength=len(runs.lines))
    short = _is_short(runs, pairs)
    if short.all():
        return [walks(runs, MATCH_AT_MOST)]
    some, lines = _of(runs, short)
    got = walks(some, MATCH_AT_MOST)
    got.run = np.flatnonzero(short)[got.run]
    got.name = np.where(got.name < 0, -1, np.append(lines, -1)[got.name])
    out = [got]
    line_from, entity_from = np.cumsum(runs.lines) - runs.lines, np.cumsum(runs.entities) - runs.entities
    alias_from = np.searchsorted(runs.owner, np.append(np.arange(len(runs.unread)), len(runs.unread)))
    for r in np.flatnonzero(~short).tolist():
        own = range(int(entity_from[r]), int(entity_from[r] + runs.entities[r]))
        tracked = [(None if runs.unread[k] else "", runs.aliases[alias_from[k] : alias_from[k + 1]]) for k in own]
        rows = walk(runs.names[line_from[r] : line_from[r] + runs.lines[r]], tracked)
        kind, line, entity, _, dist, diff = (list(x) for x in zip(*rows, strict=True)) if rows else [[]] * 6
        number = [np.array([-1 if x is None else x for x in c], np.int64) for c in (line, entity, dist, diff)]
        kinds = np.array([KINDS.index(k) for k in kind], np.int64)
        out.append(Rows(np.full(len(rows), r), kinds, number[0], number[1], np.where(number[0] < 0, -1, number[0] + line_from[r]), number[2], number[3], (kinds == 0) | (kinds == 3)))
    return out


def _reconciled(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of some whole runs, which lie together."""
    rows = rows.combine_chunks()
    ids = rows["run_id"].combine_chunks()
    new = np.concatenate(([True], pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)))
    run, first = np.cumsum(new) - 1, np.flatnonzero(new)
    line, there, unread = (np.flatnonzero(rows[c].to_numpy()) if c != "unread" else rows[c].to_numpy() for c in ("line", "there", "unread"))
    names = rows["external"].combine_chunks().take(pa.array(line))
    unread = unread[there].astype(bool)
    # Aliases are those of entities with a name; null lists and null aliases are none.
    aliases = rows["aliases"].combine_chunks().take(pa.array(there))
    owner, alias = pc.list_parent_indices(aliases).to_numpy(), pc.list_flatten(aliases)
    own = np.flatnonzero(~unread[owner] & alias.is_valid().to_numpy(zero_copy_only=False))
    n = len(first)
    runs = Runs(np.bincount(run[line], minlength=n), names.to_pylist(), np.bincount(run[there], minlength=n), unread, alias.take(pa.array(own)).to_pylist(), owner[own].astype(np.int64))
    for got in _walked(runs):
        some = [
            pc.take(ids, pa.array(first[got.run])).cast(pa.string()), pc.take(pa.array(KINDS), pa.array(got.kind)), pa.array(got.line, mask=got.line < 0), pa.array(got.entity, mask=got.entity < 0),
            pc.take(names, pa.array(got.name, mask=got.name < 0)).cast(pa.string()), pa.array(got.dist, mask=~got.scored), pa.array(got.diff, mask=~got.scored),
        ]
        yield from pa.Table.from_arrays(some, names=[c.split()[0] for c in SCHEMA.split(", ")]).to_batches(max_chunksize=TOLD)


def _each_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows in order of their runs, a run's rows being held until its last one is there."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("run_id")
        if held and held[-1].column("run_id")[-1] != ids[0]:
            yield from _reconciled(pa.Table.from_batches(held))
            held = []
        last = pc.index(ids, ids[-1]).as_py()
        if last:
            yield from _reconciled(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        held.append(batch.slice(last))
    if held:
        yield from _reconciled(pa.Table.from_batches(held))


def reconcile_together(both: DataFrame) -> DataFrame:
    """Rows of walk by run.  *both*: (run_id, place, line, external, there, unread, aliases), in which a row may be a line of the external list, an entity of the tracked one (there), or both.

    Both lists are in order of place, null last; a line without a name is passed like one that nothing matches.  Runs without an id have no rows.
    """
    own = both.where(F.col("run_id").isNotNull()).repartition("run_id").sortWithinPartitions("run_id", F.col("place").asc_nulls_last())
    return own.select("run_id", "line", "external", "there", "unread", "aliases").mapInArrow(_each_run, SCHEMA)


def reconcile(external: DataFrame, tracked: DataFrame) -> DataFrame:
    """Rows of walk by run.  *external*: (run_id, line_no, name), *tracked*: (run_id, entity, name, aliases)."""
    yes, no = F.lit(True), F.lit(False)
    lines = external.where(F.col("name").isNotNull()).select("run_id", F.col("line_no").alias("place"), yes.alias("line"), F.col("name").alias("external"), no.alias("there"), no.alias("unread"), F.lit(None).cast("array<string>").alias("aliases"))
    entities = tracked.select("run_id", "entity", no, F.lit(None).cast("string"), yes, F.col("name").isNull(), "aliases")
    return reconcile_together(lines.union(entities))


def report(found: DataFrame) -> DataFrame:
    """One row a run: matches, mean score, mean over distinct scores, index mean, unread and missing counts.

    Everything is one pass over *found*, as different scores are bits of a number: distances of matches are small.
    """
    hit = F.when(F.col("kind") == "match", F.col("dist"))
    sums = found.groupBy("run_id").agg(
        F.sum("index_diff").alias("index"), F.count(F.when(F.col("kind") == "match", 1)).alias("n"), F.sum(hit).alias("score"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), hit.cast("int"))).alias("scores"),
        F.count(F.when(F.col("kind") == "unread", 1)).alias("unread"), F.count(F.when(F.col("kind") == "missing", 1)).alias("missing"),
    )
    n = F.when(F.col("n") > 0, F.col("n"))
    return sums.select("run_id", (F.col("index") / n).alias("index_mean"), "unread", "missing", n.alias("matches"), (F.col("score") / n).alias("score_mean"), (F.col("score") / F.bit_count("scores")).alias("mean_per_distinct_score"))


def offset_stretches(found: DataFrame) -> DataFrame:
    """(run_id, index_diff, first, last, n): consecutive external indexes of one difference."""
    return islands(found.where("index_diff is not null"), ["run_id"], ["ext_index"], "index_diff")


def score_report(found: DataFrame, keys: list[str], score: str, sets: list[list[str]]) -> DataFrame:
    """(keys, n, low, median, high, mean) of a score, for each of several groupings at once; a key that a grouping leaves out is null.

    Everything comes from the histogram, which is small: rows are counted by keys and score once.  median is exact, the mean of the two middle scores where their number is even.
    low and high are the exact quartiles, each the least score that as many scores are not above.  Rows without a score count nothing; a null key is a value like any other.
    """
    counts = found.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("__score")).agg(F.count("*").alias("__n"))
    grouped = counts.groupingSets([[*(F.col(k) for k in own), F.col("__score")] for own in sets], *keys, "__score").agg(F.sum("__n").alias("__n"), F.grouping_id(*keys, "__score").alias("__set"))
    own = ["__set", *keys]
    w = Window.partitionBy(*own)
    upto = grouped.withColumns({"__all": F.sum("__n").over(w), "__upto": F.sum("__n").over(w.orderBy("__score").rowsBetween(Window.unboundedPreceding, 0))})

    def at(place) -> Column:
        """The score of a place, counted from 1."""
        return F.min(F.when(F.col("__upto") >= place, F.col("__score")))

    n = F.col("__all")
    middle = (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2
    told = upto.groupBy(*own).agg(F.sum("__n").alias("n"), at(F.ceil(n / 4)).alias("low"), middle.alias("median"), at(F.ceil(n * 3 / 4)).alias("high"), (F.sum(F.col("__score") * F.col("__n")) / F.sum("__n")).alias("mean"))
    return told.drop("__set")
