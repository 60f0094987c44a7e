"""A Merkle manifest of a data set: a tree of digests for each value of a column, and one over these trees' roots.

The tree is built by levels, each a table.  Leaves have numbers from 0 in their order; the nodes of one number divided by the fanout are a run, whose digests, sorted by number
and put one behind the other, give the parent's.  A run of number 0 with one node is what remains of a tree.  Then the levels are gone through
from the top: a run's children get what their parent has for its proof, with their own siblings before it, so every level is joined once, and a level has as many rows as nodes.

A proof is text: for each level, from below, the run with ``*`` at the node's own place, with commas between.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyloom.llm.common import settle
from tallyloom.llm.mixing import running

#: A node's own place in its run.
OWN = "*"
#: Levels that are joined in one plan on the way down.
AT_ONCE = 4


def told(value: Column) -> Column:
    """A value as text that can't be taken for another: its number of UTF-8 bytes, a colon, the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(told, values)), 256)


def siblings_hash(proof: Column) -> Column:
    """The digest of all siblings of a proof, from below, left to right."""
    return F.sha2(F.translate(proof, f"{OWN},", ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    steps = F.filter(F.split(proof, ","), lambda x: x != "")
    return F.aggregate(steps, leaf, lambda own, step: F.sha2(F.replace(step, F.lit(OWN), own), 256))


def _digests(run: Column) -> Column:
    return F.array_join(F.transform(run, lambda x: x["hash"]), "")


def grow(nodes: DataFrame, most: int, fanout: int) -> list[DataFrame]:
    """The levels above *nodes* (key, idx, hash), as (key, idx, run, alone, hash); *most*: of the nodes of a key.  *alone*: the run is what remains of its tree, and stays as it is."""
    out = []
    for _ in range(_height(most, fanout) + 1):
        below = out[-1].where(~F.col("alone")) if out else nodes
        runs = below.groupBy("key", F.floor(F.col("idx") / fanout).alias("idx")).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("at"), "hash"))).alias("run"))
        alone = (F.col("idx") == 0) & (F.size("run") == 1)
        out.append(settle(runs.withColumn("alone", alone).withColumn("hash", F.when(alone, F.get("run", F.lit(0))["hash"]).otherwise(F.sha2(_digests(F.col("run")), 256)))))
    return out


def _height(most: int, fanout: int) -> int:
    out = 0
    while most > 1:
        most, out = math.ceil(most / fanout), out + 1
    return out


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(key, idx, subroot, proof) of every node below the first of *levels*.  *tops*: (key, level, subroot, proof) of what remains of each tree, its level counted from the leaves."""
    above = None
    for level in range(len(levels) - 1, -1, -1):
        own = tops.where(F.col("level") == level).select("key", F.lit(0).cast("long").alias("idx"), "subroot", "proof")
        if above is not None:
            runs = levels[level].where(~F.col("alone")).select("key", "idx", "run").join(above, ["key", "idx"])
            runs = runs.select("key", "subroot", "proof", "run", F.explode("run").alias("own"))
            mine = F.array_join(F.transform("run", lambda x: F.when(x["at"] == F.col("own")["at"], F.lit(OWN)).otherwise(x["hash"])), "")
            own = own.union(runs.select("key", F.col("own")["at"], "subroot", F.concat_ws(",", mine, F.when(F.col("proof") != "", F.col("proof")))))
        above = settle(own) if level % AT_ONCE == 0 else own
    return above


def _tree(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame | None]:
    """The levels above *nodes* (key, idx, hash), and (key, level, hash) of what remains of each tree; None without nodes."""
    most = nodes.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    levels = grow(nodes, most or 0, fanout)
    tops = None
    for level, own in enumerate(levels):
        found = own.where("alone").select("key", F.lit(level).alias("level"), "hash")
        tops = found if tops is None else tops.union(found)
    return levels, settle(tops) if most else None


def manifest(leaves: DataFrame, by: str = "lang", order: tuple[str, ...] = ("doc_id",), leaf: str = "leaf", fanout: int = 2) -> DataFrame:
    """*leaves* with the columns subroot (the root of the tree of the row's *by*), root, and proof (the row's siblings up to root).

    Leaves of one value of *by* go by *order*, nulls first; rows that are equal there go by their digest, so repeated rows stand side by side and each is a leaf.
    Null is a value of its own.  Subroots go by that value's UTF-8 bytes, null first.  Columns of these names are replaced, others stay.  An empty table gives an empty one.
    """
    if fanout < 2:
        raise ValueError("a run has two nodes at least")
    names = [c for c in leaves.columns if c not in ("subroot", "root", "proof")]
    key = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    own = leaves.select(key.alias("key"), F.col(leaf).alias("hash"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.struct(*names).alias("row"))
    sort = [*(F.col(f"o{i}").asc_nulls_first() for i in range(len(order))), F.col("hash").asc()]
    placed = settle(running(own, sort, {"place": F.lit(1).cast("long")}, ["key"]).select("key", (F.col("place") - 1).alias("idx"), "hash", "row"))
    levels, tops = _tree(placed.select("key", "idx", "hash"), fanout)
    if tops is None:
        return leaves.sparkSession.createDataFrame([], StructType([*leaves.select(*names).schema, *(StructField(c, StringType()) for c in ("subroot", "root", "proof"))]))
    # The tree of the subroots is one tree, under one key; its nodes' own keys are the trees below.
    numbered = settle(running(tops, [F.col("key").asc()], {"place": F.lit(1).cast("long")}).withColumn("idx", F.col("place") - 1))
    roots, last = _tree(numbered.select(F.lit("").alias("key"), "idx", "hash"), fanout)
    root = last.first()["hash"]
    proofs = descend(roots, last.select("key", "level", F.col("hash").alias("subroot"), F.lit("").alias("proof")))
    tops = settle(numbered.join(proofs.select("idx", "proof"), "idx").select("key", "level", F.col("hash").alias("subroot"), "proof"))
    met = placed.select("key", "idx", "row").join(descend(levels, tops), ["key", "idx"])
    return met.select("row.*", "subroot", F.lit(root).alias("root"), "proof")
