"""Golden values of scalar functions and plain folds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import color, scalars, similarity
from tallyloom.operators import align, reconcile


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("aa", "a", 0), ("aaaab", "abbbb", 0), ("Dodger2", "Dodger2", 0), ("Eurega", "Eureka", 2), ("", "abc", 6), ("abc", "", 6)],
)
def test_warped_distance(a, b, want):
    assert similarity.warped_distance(a, b) == want


def plain(a, b):
    row = [2 * y for y in range(len(b) + 1)]
    for x, c in enumerate(a, 1):
        new = [2 * x]
        for y, e in enumerate(b, 1):
            new.append(similarity.letter_cost(c, e) + min(row[y], row[y - 1], new[-1]))
        row = new
    return row[-1]


def test_one_long_name_pads_no_other():
    names = ["ab"] * 5000 + ["x" * 200_000, ""]
    assert similarity.warped_distances("abc", names).tolist() == [plain("abc", "ab")] * 5000 + [plain("abc", "x" * 200_000), 6]


def test_distances_of_many_names_are_those_of_each(spark):
    rng = np.random.default_rng(2)
    letters = list("oO0nitrlaeL1Aa48dz")
    names = ["".join(rng.choice(letters, rng.integers(0, 12))) for _ in range(200)]
    for term in names[:8]:
        assert similarity.warped_distances(term, names).tolist() == [plain(term, n) for n in names]
    df = spark.createDataFrame([(names[i], names[-i - 1]) for i in range(30)] + [(None, "x")], "a string, b string")
    for r in df.select("a", "b", similarity.pair_distance("a", "b").alias("d"), similarity.warped_distance_column(F.col("a"), F.col("b")).alias("e")).collect():
        assert r.d == (None if r.a is None else plain(r.a, r.b))
        assert r.a is None or r.e == r.d


def test_letter_costs_are_asymmetric():
    assert similarity.letter_cost("0", "o") == 1
    assert similarity.letter_cost("o", "0") == 2
    assert similarity.letter_cost("a", "A") == 1
    assert similarity.letter_cost("a", "A", case_penalty=False) == 0


def test_found_letters_score(spark):
    cases = [("ab", "ab", -2), ("xb", "ab", 1), ("aa", "a", None), ("", "ab", 0), ("ab", "", 4), ("cab", "abcc", -3 + 3), ("bcb", "abcb", -3), ("dca", "abcd", -3 + 2 + 3)]
    df = spark.createDataFrame(cases, "test string, match string, want int")
    for r in df.withColumn("got", similarity.found_letters_score(F.col("test"), F.col("match"))).collect():
        assert r.got == r.want, r


def test_labels(spark):
    got = [value(spark, similarity.match_label(F.lit(x))) for x in (0, 2, 3, 9, 10, 99)]
    assert got == ["PERFECT", "LIKELY", "UNLIKELY", "BAD", "UNKNOWN", "UNKNOWN"]


@pytest.mark.parametrize("kinds", [1, 2, 5])
def test_edges_are_changes_counted_anew_for_each_place(kinds):
    rng = np.random.default_rng(kinds)
    for n in range(1, 30):
        own = rng.integers(0, kinds * 3, n).tolist()
        for alike in (lambda a, b: a == b, lambda a, b: a // 3 == b // 3):
            want = [sum(not alike(own[k], own[k - 1]) for k in range(1, i + 1)) for i in range(n)]
            assert align.edges_by_index(own, alike) == (want if n > 1 else None)


def telling(own):
    """Scores by what the rule says of each length alone: half of what it differs from its neighbours, and one, over how many lie within one of it on either side."""
    out = {}
    for i, x in enumerate(own):
        if not x:
            continue
        near = [own[k] for k in (i - 1, i + 1) if 0 <= k < len(own) and own[k] is not None]
        shared = [sum(y in pair for y in own if y) for pair in ((x - 1, x), (x, x + 1))]
        out[i] = (sum(abs(x - y) for y in near) / 2 + 1) / shared[0] / shared[1]
    return out


def test_length_scores():
    rng = np.random.default_rng(12)
    for _ in range(200):
        own = [None if rng.random() < 0.2 else -int(x) for x in rng.integers(0, 12, int(rng.integers(0, 15)))]
        got, want = align.length_scores(own), telling(own)
        assert {i: round(s, 9) for s, i in got} == {i: round(s, 9) for i, s in want.items()}
        assert [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)


def first_common(predicted, visible):
    """The offset by narrowing down sets: lists of the slots that match anything, shortest first if one has several, each nearest to 0 first."""
    found = [[p - v for p, n in enumerate(predicted) if n is not None and n == length] for v, length in visible.items()]
    found = [x for x in found if x]
    if max(map(len, found), default=0) > 1:
        found = sorted((sorted(x, key=abs) for x in found), key=len)
    held = set(found[0]) if found else set()
    best = found[0][0] if found else None
    for x in found[1:]:
        best = next((o for o in x if o in held), None)
        held = {best}
        if best is None:
            break
    return best, best is not None and len(found) >= 2


def test_visual_offset():
    rng = np.random.default_rng(21)
    seen = set()
    for _ in range(400):
        own = [None if rng.random() < 0.15 else -int(x) for x in rng.choice(np.arange(40, 40 + int(rng.integers(3, 60))), 10)]
        shift = int(rng.integers(-3, 4))
        shown = {v: own[v + shift] if rng.random() < 0.85 else -999 for v in sorted(rng.choice(10, int(rng.integers(0, 6)), replace=False).tolist()) if 0 <= v + shift < 10}
        shown = {v: n for v, n in shown.items() if n is not None}
        assert align.visual_offset(own, shown) == first_common(own, shown)
        seen.add(align.visual_offset(own, shown)[1])
    assert seen == {True, False}
    distinct = [-3 * i - 1 for i in range(9)]
    assert all(align.visual_offset(distinct, {v: distinct[v + k] for v in (1, 4)}) == (k, True) for k in range(-1, 5))


def test_color_offset():
    assert align.color_offset(["w", "b", "w", "b"], {0: "w", 1: "b"}) == (2, True)
    assert align.color_offset(["w", "w", "w"], {0: "w", 1: "w"}) == (1, False)
    assert align.color_offset([None, None], {0: "w"}) == (None, False)
    assert align.color_offset(["w"], {}) == (None, False)


def test_walk():
    ext = ["Aaron", "Bella", "Casper", "Quentin Longname", "Dora"]
    own = [("Aaron", ["Aaron"]), (None, []), ("Casper", ["Casper", "Caspar"]), ("Dora", ["Dora"])]
    rows = reconcile.walk(ext, own)
    assert [(k, e, i) for k, e, i, *_ in rows if k == "match"] == [("match", 0, 0), ("match", 2, 2), ("match", 4, 3)]
    assert [r[0] for r in rows] == ["match", "unread", "skipped", "match", "missing", "match"]
    assert reconcile.walk(["abcdefghijklmnop"] * 40, [("zzzzzzzzzzzzzzzzzzzz", ["zzzzzzzzzzzzzzzzzzzz"])] * 40) == []


def test_colors(spark):
    blue = tuple(F.lit(x) for x in (115, 145, 245))
    assert value(spark, color.box_name(blue)) == "SUB_BLUE"
    assert value(spark, color.box_name(tuple(F.lit(x) for x in (0, 0, 0)))) is None
    turn = [[0.0, 0.0, 1.0], [0.0, 1.0, 0.0], [-1.0, 0.0, 0.0]]
    assert [value(spark, c) for c in color.rotate(turn, tuple(F.lit(x) for x in (100.0, 0.0, 0.0)))] == [0.0, 0.0, 100.0]
    packed = color.pack(F.lit(1), F.lit(200), F.lit(255))
    assert [value(spark, c) for c in color.unpack(packed)] == [1, 200, 255]
    assert value(spark, color.hex_of(F.lit(1), F.lit(200), F.lit(255))) == "#01c8ff"
    assert value(spark, color.fall_off(F.lit(0.0), F.lit(True))) == 0
    assert value(spark, color.fall_off(F.lit(color.FARTHEST), F.lit(False))) == 255
    assert value(spark, color.add_clamped(F.lit(200), F.lit(100))) == 255
    assert value(spark, color.redmean((F.lit(0),) * 3, (F.lit(255),) * 3)) == pytest.approx(math.sqrt((2 + 127.5 / 256 + 4 + 2 + 127.5 / 256) * 255**2))


def test_random_values(spark):
    got = spark.range(200).select(scalars.random_int(5, 2, seed=1).alias("n"), scalars.chance(0.3, seed=2).alias("c")).collect()
    assert {r.n for r in got} == {2, 3, 4} and 30 < sum(r.c for r in got) < 90


def test_scalars(spark):
    assert value(spark, scalars.exit_times(F.lit(0))) == (None, None) and value(spark, scalars.exit_times(F.lit(10), 60)) == (83.5, 87.0)
    assert value(spark, scalars.on_screen(F.lit(10), F.lit(163))) and not value(spark, scalars.on_screen(F.lit(10), F.lit(164))) and not value(spark, scalars.on_screen(F.lit(None).cast("int"), F.lit(1)))
    assert value(spark, scalars.to_percent(F.lit(0.12345))) == "12.35%"
    for ms, want in ((5, "5ms"), (1500, "1s 500ms"), (60_000, "1m"), (3_661_001, "1h 1ms 1s 1m"), (86_400_000, "24h")):
        assert value(spark, scalars.duration_text(F.lit(ms))) == want
    assert value(spark, scalars.duration_text(F.lit(1500), many=False)) == "1.50s"
    assert value(spark, scalars.half_open(5)) == [0, 1, 2, 3, 4]
    assert value(spark, scalars.half_open(2, 5)) == [5, 4, 3]
    assert value(spark, scalars.reversed_half_open(5, 2)) == [4, 3, 2]
    assert value(spark, scalars.reversed_half_open(-1, 1)) == [0, 1]
    assert value(spark, scalars.last_n(F.array(*(F.lit(i) for i in range(3))), 24)) == [0, 1, 2]
    assert value(spark, scalars.last_n(F.array(*(F.lit(i) for i in range(30))), 24)) == list(range(6, 30))
    assert value(spark, scalars.non_zero(F.create_map(F.lit("a"), F.lit(0), F.lit("b"), F.lit(2)))) == {"b": 2}
