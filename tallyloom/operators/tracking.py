"""The tracker of one run: frames of slots in, entities and a log of frames out.

A fold over frames in order, with a small state; the same function serves batch
(one group a run) and streams (state by run).

Lengths of names are either all measured, or looked for: a quick look only tells whether a name has one given length,
so the lengths that tell most among the expected ones are tried at the slots where they could be now, until two agree on an offset.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.align import color_offset, length_scores, visual_offset

SCREEN = 24
#: Frames a second, and seconds without a name after which a run is over.
FPS, QUIET_SECONDS = 30, 5
#: Offsets beyond these are not applied.
MOST_SHIFT, LEAST_SHIFT = 6, -2

LOG = "run_id string, frame_id long, offset int, good boolean, by string, status string, visible int, first_index int, shown string, expected string, applied boolean"


@dataclass
class Entity:
    length: int | None = None
    color: str | None = None
    seen: bool = False
    entered: int | None = None
    left: int | None = None
    name: str | None = None
    processing: bool = False


@dataclass
class Slot:
    """A slot of a frame; *how* its length was found: "quick", "unknown", "match" or "read", or None where all are measured."""

    appear: bool
    length: int | None = None
    checked: bool = False
    color: str | None = None
    how: str | None = None


@dataclass
class Run:
    """State of a run."""

    entities: list[Entity] = field(default_factory=list)
    #: The number of the first entity that is held; those before it have left.
    base: int = 0
    first: int = 0
    known: bool = False
    quiet: int = 0
    last_frame: int = -1
    status: str = "READING"

    def expect(self, frame: int) -> list[Entity]:
        """The entities of a full screen from the cursor, new ones where there are none yet."""
        while self.base + len(self.entities) < self.first + SCREEN:
            self.entities.append(Entity(entered=frame if self.known else None))
        return self.entities[self.first - self.base : self.first - self.base + SCREEN]


# The letter of a visible slot by how its length was found.
HOW = {"quick": "Q", "unknown": "U", "match": "K", "read": "G"}


def glyph_visible(s: Slot) -> str:
    if s.appear:
        return "D" if s.checked and s.length is None else HOW.get(s.how, "A")
    return "_" if s.length else "?"


def glyph_expected(e: Entity) -> str:
    if e.name or e.processing:
        return "N" if e.name else "O"
    return ("L" if e.length else "S") if e.seen else "*"


def quick_search(expected: list[int | None], slots: dict[int, Slot], look: Callable[[int, int], bool]) -> tuple[int | None, bool, int]:
    """(offset, good, number of looks): try expected lengths, the most telling first, until the offset is certain.

    *look*: whether the name in a slot has a length.  Every length is tried from where its entity would now be upwards, as it is and one more, in visible slots of
    unknown length; the first hit ends it.
    """
    offset, good, looks = 0, False, 0
    for _, at in length_scores(expected):
        tries = ((v, n) for v in range(max(0, at - (offset or 0)), -1, -1) if v in slots and slots[v].appear and slots[v].length is None for n in (expected[at], expected[at] + 1))
        for v, n in tries:
            looks += 1
            if look(v, n):
                slots[v].length, slots[v].how = n, "quick"
                break
        offset, good = visual_offset(expected, {v: s.length for v, s in slots.items() if s.appear and s.length is not None})
        if good:
            break
    return offset, good, looks


def fallback(offset: int | None, visible: dict[int, Slot]) -> tuple[int | None, bool]:
    """(offset, whether to skip the frame) where no offset is certain: with more than three names in sight one that some length speaks for is taken."""
    if len(visible) > 3:
        return offset, offset is None or all(s.length is None for s in visible.values())
    return offset or 0, False


def step(run: Run, frame: int, slots: Iterable[tuple[int, bool, int | None, bool, str | None]], quick: bool = False, looks: Mapping[int, Collection[int]] | None = None) -> dict | None:
    """Take one frame's slots (vidx, appear, length, checked, color); None for a frame that is late or comes after the end.

    With *quick* a given length is what a measurement would find, and only those of the slots that need one are taken.  A look finds the lengths that *looks* has for the slot, or
    without *looks* what a measurement would.
    """
    if run.status == "COMPLETE" or frame <= run.last_frame:
        return None
    run.last_frame = frame
    truth = {v: Slot(a, n, c, k) for v, a, n, c, k in sorted(slots, key=lambda x: x[0])}
    screen = {v: Slot(s.appear, None if quick else s.length, not quick and s.checked, s.color) for v, s in truth.items()}
    visible = {v: s for v, s in screen.items() if s.appear}
    log = {"frame_id": frame, "offset": None, "good": False, "by": "none", "visible": len(visible), "applied": False, "expected": ""}
    if not visible:
        run.quiet += 1
        if run.quiet > QUIET_SECONDS * FPS:
            run.status = "COMPLETE"
        return log | {"status": run.status, "first_index": run.first, "shown": "".join(map(glyph_visible, screen.values()))}
    run.quiet = 0
    expected = run.expect(frame)
    lengths = [e.length for e in expected]
    offset, good, by = 0, False, "none"
    skip = False
    if any(lengths):
        if quick:
            offset, good, _ = quick_search(lengths, screen, lambda v, n: truth[v].length == n if looks is None else n in looks.get(v, ()))
        else:
            offset, good = visual_offset(lengths, {v: s.length for v, s in visible.items() if s.length is not None})
        by = "length"
        if not good and any(e.color for e in expected):
            offset, good = color_offset([e.color for e in expected], {v: s.color for v, s in screen.items()})
            by = "color"
        if not good:
            offset, skip = fallback(offset, visible)
    if offset is not None and 0 < offset <= MOST_SHIFT:
        for e in run.entities[run.first - run.base : run.first - run.base + offset]:
            e.left = frame
        run.first += offset
        expected = run.expect(frame)
    if not skip:
        last = max(visible)
        for v, s in screen.items():
            e = expected[v]
            if s.appear and not e.seen:
                e.seen = True
                if run.known:
                    e.entered = frame
            if quick and v <= last and s.appear and s.length is None and not e.length:
                s.length, s.checked, s.how = truth[v].length, truth[v].checked, "unknown"
            if s.appear and s.length is not None and s.length < 0:
                e.length = s.length
            if s.color is not None:
                e.color = s.color
        run.known = True
    shown = "".join(map(glyph_visible, screen.values()))
    return log | {"offset": offset, "good": bool(good), "by": by, "status": run.status, "first_index": run.first, "applied": not skip, "shown": shown, "expected": "".join(map(glyph_expected, expected))}


def frames_of(rows: pd.DataFrame) -> Iterator[tuple[int, list[tuple], dict[int, frozenset[int]] | None]]:
    """(frame_id, slots, looks) in order; looks are None where there is no such column."""
    own = rows.astype(object).where(rows.notna(), None)
    for frame, part in own.groupby("frame_id", sort=True):
        looks = {int(v): frozenset() if x is None else frozenset(map(int, x)) for v, x in zip(part["vidx"], part["looks"], strict=True)} if "looks" in part else None
        yield int(frame), [(int(v), bool(a), None if n is None else int(n), bool(c), k) for v, a, n, c, k in zip(part["vidx"], part["appear"], part["length"], part["len_checked"], part["color"], strict=True)], looks


def log_of(run_id: str, run: Run, rows: pd.DataFrame, quick: bool = False) -> pd.DataFrame:
    """The log of the frames in *rows*, with *run* taken on."""
    out = [{"run_id": run_id, **x} for f, slots, looks in frames_of(rows) if (x := step(run, f, slots, quick, looks)) is not None]
    table = pd.DataFrame(out, columns=[c.split()[0] for c in LOG.split(", ")])
    return table.astype({"offset": "Int32", "visible": "int32", "first_index": "int32"})


def track(observations: DataFrame, quick: bool = False) -> DataFrame:
    """The log of every frame.  *observations*: (run_id, frame_id, vidx, appear, length, len_checked, color), and looks if a look is more than its length; *quick*: see step."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return log_of(key[0], Run(), rows, quick)

    return observations.groupBy("run_id").applyInPandas(run, LOG)


def action(vidx: Column, appear: Column, checked: Column, expected_length: Column, ready: Column, has_image: Column, last_visible: Column) -> Column:
    """What to do with a slot: "length", "read", "capture", or null for nothing."""
    unchecked = appear & ~checked
    readable = vidx != SCREEN - 1
    return F.when(vidx > last_visible, None).when(expected_length.isNull() & unchecked, "length").when(readable & ready & unchecked, "read").when(~has_image & readable & (vidx >= last_visible), "capture")


def glyphs(df: DataFrame, keys: list[str], vidx: str, appear: Column, length: Column, checked: Column) -> DataFrame:
    """(keys, glyphs): one letter a slot, in order, as glyph_visible gives; slots without a number are last."""
    letter = F.when(appear & checked & length.isNull(), "D").when(appear, "A").when(length.isNotNull() & (length != 0), "_").otherwise("?")
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(vidx).isNull(), vidx, letter.alias("letter")))), lambda x: x["letter"]), "").alias("glyphs"))
