"""Queries of the catalogue take all rows of their tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import reconcile
from tallyloom.plans import catalog


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One user of 100 events, and one customer of 60 orders."""
    path = tmp_path_factory.mktemp("long")
    e = spark.range(100).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.timestamp_seconds(F.col("id")).alias("ts"), F.element_at(F.array(*map(F.lit, ("click", "view", "error"))), (F.col("id") % 3 + 1).cast("int")).alias("event_type"), ((F.col("id") * 37) % 101).cast("double").alias("value"))
    e.write.parquet(str(path / "events.parquet"))
    o = spark.range(60).select((F.col("id") * 1_000_003 % 10**9).alias("o_orderkey"), F.lit(1).cast("long").alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"))
    o.write.parquet(str(path / "orders.parquet"))
    return str(path)


def test_every_frame_is_tracked(spark, folder):
    log = catalog.track_frames(spark, folder).orderBy("frame_id").collect()
    assert [r.frame_id for r in log] == list(range(100))
    assert [r.visible for r in log] == [min(20, 100 - f) for f in range(100)]


def test_every_page_has_its_offset(spark, folder):
    got = catalog.page_offsets(spark, folder).orderBy("page").collect()
    assert [(r.page, r.offset, r.votes) for r in got] == [(p, 4, 4) for p in range(1, 25)]


def test_all_orders_are_reconciled(spark, folder):
    found = catalog.reconcile_lists(spark, folder)
    # 48 of the 60 orders are in the external list, one of every seven entities has no name.
    assert found.where("kind = 'match'").agg(F.max("ext_index")).first()[0] == 47
    report = catalog.accuracy_report(spark, folder).first()
    assert report.matches > 30 and report.unread == found.where("kind = 'unread'").count() >= 5


def test_a_length_of_0_is_measured_too(spark, tmp_path):
    data = [(2, 1, "error", 0.0), (1, 1, "error", 90.5), (None, 1, "view", 1.0), (3, 1, "view", 0.0), (5, 1, "error", -0.5), (4, 1, "view", 95.0), (6, 1, "error", None)]
    e = spark.createDataFrame(data, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    e.write.parquet(str(tmp_path / "events.parquet"))
    assert [tuple(r) for r in catalog.glyph_string(spark, str(tmp_path)).collect()] == [(1, "?_AD_?A")]


def by_all_paths(external, tracked):
    """The walk with every path to a state kept."""
    out, queue, seen = [], [(0, 0, ())], set()
    while queue:
        e, i, path = queue.pop(0)
        if e >= len(external) or i >= len(tracked):
            break
        if (e, i, path) in seen:
            continue
        seen.add((e, i, path))
        name, aliases = tracked[i]
        if name is None:
            unread = ("unread", None, i, None, None, None)
            both = (unread, ("skipped", e, i, external[e], 100, e - i)) if e else (unread,)
            queue += [(e + 1, i + 1, path + both), (e, i + 1, (*path, unread))]
            continue
        scores = [reconcile.warped_distance(external[e], a) for a in aliases]
        if scores and min(scores) <= reconcile.MATCH_AT_MOST:
            out += [*path, ("match", e, i, external[e], min(scores), abs(e - i))]
            queue, seen = [(e + 1, i + 1, ())], set()
        else:
            queue += [(e + 1, i, (*path, ("missing", e, None, external[e], None, None))), (e, i + 1, path)]
    return out


def test_the_first_path_is_the_one_that_counts():
    rng = np.random.default_rng(2)
    for _ in range(150):
        names = [c * 16 for c in rng.choice(list("abcdefgh"), 9)]
        own = [(None, []) if rng.random() < 0.4 else (n, [n]) for n in (c * 16 for c in rng.choice(list("abcdefgh"), 8))]
        assert reconcile.walk(names, own) == by_all_paths(names, own)


def test_long_stretches_are_walked_to_their_end(monkeypatch):
    monkeypatch.setattr(reconcile, "nearest", lambda names, aliases: [0 if n in a else 100 for n, a in zip(names, aliases, strict=True)])
    names = [*(f"external {i}" for i in range(460)), "both", *(f"later {i}" for i in range(500))]
    own = [(n, [n]) for n in (*(f"own {i}" for i in range(460)), "both", *(f"after {i}" for i in range(500)))]
    rows = reconcile.walk(names, own)
    assert rows[-1][:3] == ("match", 460, 460) and sum(r[0] == "missing" for r in rows) == 460
    rows = reconcile.walk([*map(str, range(25)), "both"], [(None, [])] * 25 + [("both", ["both"])])
    assert rows[-1][:3] == ("match", 25, 25)


def test_distances_to_aliases_are_those_of_each():
    names, aliases = ["Sam", "Berta", "x", "Dora"] * 5, [["San", None], ["Barta", "Berta"], [], ["Dorothea"]] * 5
    want = [1, 0, None, reconcile.warped_distance("Dora", "Dorothea")]
    assert reconcile.nearest(names[:4], aliases[:4])[1:] == want[1:]
    assert reconcile.nearest(names, aliases) == reconcile.nearest(names[:4], aliases[:4]) * 5


def by_waves(external, tracked):
    """The walk by waves that are held as lists, every place remembering the one that first led to it."""
    out, start = [], (0, 0)
    while start is not None:
        came, wave, found = {start: None}, [start], None
        while found is None:
            for e, i in wave:
                if e >= len(external) or i >= len(tracked):
                    return out
                far = reconcile.nearest([external[e]], [tracked[i][1]])[0] if tracked[i][0] is not None else None
                if far is not None and far <= reconcile.MATCH_AT_MOST:
                    found = (e, i, far)
                    break
            after = []
            for e, i in wave if found is None else []:
                for to in ((e + 1, i), (e, i + 1)) if tracked[i][0] is not None else ((e + 1, i + 1), (e, i + 1)):
                    if to not in came:
                        came[to] = (e, i)
                        after.append(to)
            wave = after
        e, i, far = found
        path = [(e, i)]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        for a, b in zip(path, path[1:], strict=False):
            out += reconcile.told(a, b, tracked[a[1]][0] is not None, external)
        out.append(("match", e, i, external[e], far, abs(e - i)))
        start = (e + 1, i + 1)
    return out


@pytest.mark.parametrize("unread", [0.0, 0.2, 0.6, 1.0])
def test_places_and_ways_are_those_of_all_waves(unread):
    rng = np.random.default_rng(int(unread * 10))

    def name():
        return "".join(rng.choice(list("abcdefghZ0OÉ"), int(rng.integers(0, 22))))

    hits = 0
    for _ in range(250):
        names = [name() for _ in range(int(rng.integers(0, 14)))]
        own = [(None, []) if rng.random() < unread else (n, [n, *(name() for _ in range(int(rng.integers(0, 3)))), None][int(rng.random() < 0.1) :]) for n in (name() if rng.random() < 0.7 or not names else str(rng.choice(names)) for _ in range(int(rng.integers(0, 14))))]
        own = [(n, []) if rng.random() < 0.1 else (n, a) for n, a in own]
        got = reconcile.walk(names, own)
        assert got == by_waves(names, own)
        hits += sum(r[0] == "match" for r in got)
    assert hits > (100 if unread < 1 else -1)


def test_bounds_are_not_above_distances():
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list("aAbcgqoO0il1|sz"), int(rng.integers(0, 9)))) for _ in range(60)]
    lists = reconcile.Lists(names, [(n, [n, n[1:]]) for n in reversed(names)])
    first, second = lists.letters @ lists.costs.T, lists.back @ lists.least.T
    for e, name in enumerate(names):
        for i, own in enumerate(lists.aliases):
            far = min(reconcile.warped_distance(name, a) for a in own)
            assert first[e, i] <= far and second[e, i] <= far
