"""Near pairs by a tree of letters against every pair; searches with a table of terms."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.prefix_tree import best_costs, cost_table, letter_counts, near_pairs
from tallyloom.functions.similarity import letter_cost, warped_distance, warped_distances
from tallyloom.operators import search


def every_pair(terms, names, threshold, case_penalty=True):
    return sorted((i, j, int(d)) for i, t in enumerate(terms) if names for j, d in enumerate(warped_distances(t, names, case_penalty)) if d < threshold)


def pairs(found):
    return sorted(zip(found.term.tolist(), found.name.tolist(), found.dist.tolist(), strict=True))


@pytest.mark.parametrize("letters", ["aoO0cel1iI", "abz", "aAbBcC é日"])
def test_pairs_are_those_of_a_scan(letters):
    rng = random.Random(letters)
    for _ in range(60):
        names = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 40))})
        terms = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 90))]
        threshold, case_penalty = rng.choice([0, 1, 3, 6, 12, 100]), rng.random() < 0.7
        assert pairs(near_pairs(terms, names, threshold, case_penalty)) == every_pair(terms, names, threshold, case_penalty)


def some_names(n, seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abcdefghijklmnoprstuvwxyzAEO01") for _ in range(rng.randint(3, 7))) for _ in range(60)]
    return sorted({f"{rng.choice(parts)}_{rng.choice(parts)}{rng.choice(parts)}{rng.randrange(99)}" for _ in range(n)})


def test_a_thousand_terms_make_far_fewer_cells():
    names = some_names(3000, 1)
    rng = random.Random(2)
    terms = [n[: rng.randint(4, 20)] + rng.choice("xyz") for n in rng.sample(names, 1000)]
    whole = sum(map(len, terms)) * sum(map(len, names))
    wide, narrow = near_pairs(terms, names, 12), near_pairs(terms, names, 4)
    assert pairs(wide) == every_pair(terms, names, 12) and pairs(narrow) == every_pair(terms, names, 4)
    assert wide.cells < whole / 4 and narrow.cells < whole / 100


def test_bounds_are_those_of_letters():
    mine, other = sorted("aoO1x"), sorted("0aAcil")
    costs = cost_table(mine, other)
    assert costs.tolist() == [[letter_cost(a, b) for b in other] for a in mine]
    assert best_costs(letter_counts(["", "ax"], mine), costs).tolist() == [[2.0] * 6, costs[[mine.index("a"), mine.index("x")]].min(axis=0).tolist()]


def test_a_table_of_terms(spark):
    names = some_names(400, 3)
    rng = random.Random(4)
    entities = spark.createDataFrame([(i, [n, rng.choice(names), None]) for i, n in enumerate(names)], "entity long, aliases array<string>").repartition(3)
    terms = [n[:-1] for n in rng.sample(names, 40)]
    table = spark.createDataFrame([(t,) for t in [*terms, terms[0], None]], "term string")
    got = sorted((r.term, r.rank, r.dist, r.entity) for r in search.find_all(entities, table, block=16).collect())
    held = entities.collect()
    want = []
    for term in sorted(set(terms)):
        best = sorted((min(warped_distance(term, a) for a in r.aliases if a), r.entity) for r in held)[:5]
        want += [(term, k, d, e) for k, (d, e) in enumerate(best, 1) if d < 12]
    assert got == want
    assert search.find_all(entities, table.limit(0)).collect() == []
    assert search.score_aliases(entities.select("entity", F.lit("same").alias("alias")), ["same"]).count() == len(names)
