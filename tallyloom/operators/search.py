"""Fuzzy search of names: each term against every alias, the best alias of an entity counts."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.prefix_tree import near_pairs
from tallyloom.functions.similarity import match_label, normalised

#: Terms of one search; they are a stated list and go to the executors as they are.
MOST_TERMS = 10_000


def score_aliases(aliases: DataFrame, terms: list[str], threshold: float = 12, case_penalty: bool = True) -> DataFrame:
    """(term, entity, alias, dist) of all aliases nearer than *threshold*.  *aliases*: (entity, alias).

    One narrow pass: within an Arrow batch the different names are a tree of letters that all terms go down together, and only near ones leave it.
    """
    if len(terms) > MOST_TERMS:
        raise ValueError(f"at most {MOST_TERMS} terms a search")
    kind = dict(aliases.dtypes)["entity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            names = coded.dictionary.to_pylist()
            place = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
            found = near_pairs(terms, [names[i] for i in place], threshold, case_penalty)
            # Every row of the batch that has a name, for each term that is near it.
            own = coded.indices.to_numpy()
            order = np.argsort(own, kind="stable")
            ends = np.searchsorted(own[order], np.arange(len(names) + 1))
            name = place[found.name] if len(place) else found.name
            n = np.diff(ends)[name]
            row = order[np.repeat(ends[:-1][name], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            term = pa.array(terms, pa.string()).take(pa.array(np.repeat(found.term, n)))
            yield pa.RecordBatch.from_arrays([term, batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(np.repeat(found.dist, n))], ["term", "entity", "alias", "dist"])

    return aliases.where(F.col("alias").isNotNull()).select("entity", F.col("alias").cast("string")).mapInArrow(run, f"term string, entity {kind}, alias string, dist long")


def _blocks(terms: DataFrame, size: int) -> Iterator[list[str]]:
    """The different terms of a table, so many at a time; the driver holds one block."""
    block: list[str] = []
    for row in terms.select(F.col("term").cast("string").alias("term")).where(F.col("term").isNotNull()).distinct().toLocalIterator():
        block.append(row.term)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def find_all(entities: DataFrame, terms: DataFrame, k: int = 5, threshold: float = 12, case_penalty: bool = True, block: int = MOST_TERMS) -> DataFrame:
    """As find, for a table of terms: (term) as text.  Each block of terms meets each alias once; without terms there are no rows."""
    parts = [find(entities, own, k, threshold, case_penalty) for own in _blocks(terms, block)]
    return functools.reduce(DataFrame.union, parts) if parts else find(entities, [], k, threshold, case_penalty)


def find(entities: DataFrame, terms: list[str], k: int = 5, threshold: float = 12, case_penalty: bool = True) -> DataFrame:
    """(term, rank, dist, match_status, entity, alias, share): the k nearest entities of each term.

    *entities*: (entity, aliases array).  dist is strictly below *threshold*; ties go to the smaller entity.
    """
    scored = score_aliases(entities.select("entity", F.explode("aliases").alias("alias")), terms, threshold, case_penalty)
    best = scored.groupBy("term", "entity").agg(F.min(F.struct("dist", "alias")).alias("best")).select("term", "entity", "best.*")
    order = Window.partitionBy("term").orderBy("dist", "entity")
    top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("term", "rank", "dist", match_label(F.col("dist")).alias("match_status"), "entity", "alias", normalised(F.col("dist"), F.col("term"), F.col("alias")).alias("share"))


def find_aliases(entities: DataFrame, terms: list[str], k: int = 10, threshold: float = 12) -> DataFrame:
    """As find, where each alias is a result of its own."""
    scored = score_aliases(entities.select("entity", F.explode("aliases").alias("alias")), terms, threshold)
    order = Window.partitionBy("term").orderBy("dist", "entity", "alias")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def by_name(entities: DataFrame, name: str) -> DataFrame:
    return entities.where(F.array_contains("aliases", name))


def by_index(entities: DataFrame, entity: int) -> DataFrame:
    return entities.where(F.col("entity") == entity)
