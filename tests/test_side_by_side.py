"""Many runs walked together against the walk of each, and how often a report walks."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.functions.similarity import warped_distance
from tallyloom.operators import reconcile, side_by_side
from tallyloom.plans import catalog

FLAT = pa.schema([("run_id", pa.string()), ("line", pa.bool_()), ("external", pa.string()), ("there", pa.bool_()), ("unread", pa.bool_()), ("aliases", pa.list_(pa.string()))])


def some_runs(seed, n):
    """Runs of lists of all kinds: empty ones, null lines, entities without aliases, long names, and lists that are much alike."""
    rng = np.random.default_rng(seed)

    def name():
        return "".join(rng.choice(list("abcdefghZ0OÉ\U0001f600"), int(rng.integers(0, 22)))) * (1 if rng.random() < 0.98 else 5)

    out = {}
    for k in range(n):
        names = [name() if rng.random() < 0.95 else None for _ in range(int(rng.integers(0, 14)))]
        alike = [x for x in names if x is not None]
        unread = rng.choice([0.0, 0.2, 0.6, 1.0])
        own = []
        for _ in range(int(rng.integers(0, 14))):
            x = str(rng.choice(alike)) if alike and rng.random() < 0.4 else name()
            own.append((None if rng.random() < unread else x, [] if rng.random() < 0.1 else [*([None] if rng.random() < 0.1 else []), x, *(name() for _ in range(int(rng.integers(0, 3))))]))
        out[f"{k:04}"] = (names, own)
    return out


def flat(runs):
    rows = []
    for run, (names, own) in runs.items():
        rows += [{"run_id": run, "line": True, "external": n, "there": False, "unread": False, "aliases": None} for n in names]
        rows += [{"run_id": run, "line": False, "external": None, "there": True, "unread": n is None, "aliases": a} for n, a in own]
    return pa.Table.from_pylist(rows, FLAT)


def told(batches):
    return sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=repr)


@pytest.mark.parametrize(("size", "few"), [(10_000, 1 << 14), (37, 1 << 14), (1, 1 << 14), (500, 40)])
def test_runs_together_are_those_one_by_one(monkeypatch, size, few):
    monkeypatch.setattr(reconcile, "FEW_PAIRS", few)
    monkeypatch.setattr(side_by_side, "HELD", 1000)
    monkeypatch.setattr(side_by_side, "PAIRS", 300)
    runs = some_runs(size, 400)
    want = sorted(((run, *r) for run, lists in runs.items() for r in reconcile.walk(*lists)), key=repr)
    assert told(reconcile._each_run(iter(flat(runs).to_batches(max_chunksize=size)))) == want
    assert {r[1] for r in want} == set(side_by_side.KINDS) and len(want) > 500


def test_distances_are_those_of_each_pair():
    rng = np.random.default_rng(3)
    names = ["".join(rng.choice(list("aAbcgqoO0il1|szß"), int(rng.integers(0, 65)))) for _ in range(40)]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
    assert side_by_side.distances(names, names[::-1], a, b).tolist() == [warped_distance(names[x], names[39 - y]) for x, y in zip(a, b, strict=True)]


def test_two_lists_are_walked_without_a_call_a_run(spark):
    runs = some_runs(8, 60)
    external = spark.createDataFrame([(run, k, n) for run, (names, _) in runs.items() for k, n in enumerate(names)][::-1], "run_id string, line_no long, name string")
    tracked = spark.createDataFrame([(run, k, n, a) for run, (_, own) in runs.items() for k, (n, a) in enumerate(own)][::-1], "run_id string, entity long, name string, aliases array<string>")
    found = reconcile.reconcile(external, tracked)
    want = [(run, *r) for run, (names, own) in runs.items() for r in reconcile.walk([n for n in names if n is not None], own)]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(want, key=repr)
    assert "CoGroup" not in found._jdf.queryExecution().toString()


def test_a_report_walks_once(spark, tmp_path):
    data = [(k, k % 9, "1-URGENT") for k in range(180)] + [(900, None, "5-LOW"), (901, 1, None), (None, 2, "5-LOW")]
    spark.createDataFrame(data, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    report = catalog.accuracy_report(spark, str(tmp_path))
    assert report._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
    found = catalog.reconcile_lists(spark, str(tmp_path)).collect()
    got = {r.run_id: r for r in report.collect()}
    assert set(got) == {str(k) for k in range(9)} == {r.run_id for r in found}
    for run, r in got.items():
        hits = [x for x in found if x.run_id == run and x.kind == "match"]
        assert (r.matches, r.unread, r.missing) == (len(hits), *(sum(x.run_id == run and x.kind == k for x in found) for k in ("unread", "missing")))
        assert r.score_mean == sum(x.dist for x in hits) / len(hits) and r.mean_per_distinct_score == sum(x.dist for x in hits) / len({x.dist for x in hits})
        assert r.index_mean == sum(x.index_diff or 0 for x in found if x.run_id == run) / len(hits)
    none = reconcile.report(spark.createDataFrame([("r", "unread", None, None)], "run_id string, kind string, dist long, index_diff long")).first()
    assert tuple(none) == ("r", None, 1, 0, None, None, None)
    assert reconcile.report(spark.createDataFrame([("r", "match", 3, 0)], "run_id string, kind string, dist long, index_diff long").where(F.lit(False))).collect() == []
