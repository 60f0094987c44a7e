"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each source must give a target number of words.  Of all rates w with sum(w size) = target and 0 <= w <= cap
the one closest to one copy of every document in relative entropy is w = min(cap, exp(lambda z)), z the size over the
source's mean size.  lambda solves the convex dual, one equation a source, by Newton's method with a bracket:
every iteration sums w z and w z^2 over the documents, by source.

Documents enter the iterations as counts of (source, size), made in one pass, which carries all that the dual
needs; a source of a third of all rows is no more than its distinct sizes there.  Rates become
copies by systematic rounding along the sizes of a source, so each source misses its target by about one document,
and which documents of one size get the further copy goes by a hash of the id, within cells of bounded size.
Sums along an order (of sizes, of sources) are taken in two levels, by range and within it, so no task holds a whole source or all sources.
Reruns agree: no random numbers and no order of rows are used, and what is rounded is summed in whole numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.common import free_name, settle, unsettle

#: Documents of one source and size that are ranked in one group.
CELL = 256
#: Newton iterations; a source that isn't solved then has its bracket halved each time, and after so many more than double precision needs it is an error.
NEWTON, ITERATIONS = 40, 200
#: Of a source's target, what its solved rates may miss it by.
TOLERANCE = 1e-9


def words(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """*df* with the sums of *sums* over all rows up to and including each, by *order*, for every value of *keys*.

    Rows are dealt by range of (keys, order) and written with the number of their range.  A range's totals are one row for each value of the keys
    in it, and the sums of what lies before a range are taken over these.  *order* must tell any two rows of one value of the keys apart.
    """
    keys = keys or []
    own = df.repartitionByRange(*(F.col(k).asc_nulls_last() for k in keys), *order)
    own = settle(own.withColumn("__part", F.spark_partition_id()))
    parts = own.groupBy(*keys, "__part").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "__part", *(F.sum(f"__{n}").over(before).alias(f"__{n}") for n in sums))
    within = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({n: F.sum(c).over(within) for n, c in sums.items()})
    met = F.col("a.__part") == F.col("b.__part")
    for k in keys:
        met = met & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = own.alias("a").join(parts.alias("b"), met).select("a.*", *(f"b.__{n}" for n in sums))
    return both.withColumns({n: F.col(n) + F.coalesce(f"__{n}", F.lit(0)) for n in sums}).drop("__part", *(f"__{n}" for n in sums))


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): *sources* has (source, source_size), one row a source.

    Sources by code point, null last, take *weights* in turn.  Targets share *share* of all sizes by weight; a target stops at *cap* times
    its source's size, and the excess is shared again among the others, until none is above.  That is one
    level of size per weight, found from the sources in the order of their own stops.
    """
    own = running(sources, [F.col("source").asc_nulls_last()], {"place": F.lit(1).cast("long")})
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    own = own.withColumn("weight", F.get(cycle, ((F.col("place") - 1) % len(weights)).cast("int"))).withColumn("stop", F.col("source_size") * F.lit(float(cap)))
    exact = "decimal(28,6)"  # so that no sum hangs on its order
    own = settle(running(own, [F.col("stop") / F.col("weight"), F.col("place")], {"at": F.lit(1).cast("long"), "stopped": F.col("stop").cast(exact), "gone": F.col("weight").cast(exact)}))
    total = own.agg(F.sum("source_size").alias("sizes"), F.sum(F.col("weight").cast(exact)).cast("double").alias("weights")).first()
    level = (F.lit(float((total.sizes or 0) * share)) - (F.col("stopped").cast("double") - F.col("stop"))) / (F.lit(total.weights) - F.col("gone").cast("double") + F.col("weight"))
    # The first source, in that order, that the level doesn't stop gives the level of all that aren't stopped.
    found = own.withColumn("level", level).agg(F.min(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.struct("at", "level"))).alias("least")).first().least
    return own.select("source", "source_size", (F.col("stop") if found is None else F.least(F.col("stop"), F.lit(found.level) * F.col("weight"))).alias("target"))


def _rate(cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(F.col("lam") * F.col("z"), F.lit(50.0))))


def solve(cells: DataFrame, cap: float = 2.0) -> DataFrame:
    """(source, lam): the dual solution.  *cells*: (source, size, n, z, want), z and want in the source's mean sizes.

    A source whose target is all that the cap allows has no finite solution; its lam is the bracket's upper end, at
    which every document that has a word is at the cap.  Sources without a word have no row.
    """
    own = cells.where("z > 0").groupBy("source").agg(F.min("z").alias("least"), F.first("want").alias("want"), (F.sum(F.col("n") * F.col("z")) * F.lit(cap)).alias("full"))
    # At the upper end exp(lam z) reaches the cap for all z; at the lower end it is nothing for any.
    state = settle(own.select("source", "want", "full", (F.lit(-700.0) / F.col("least")).alias("low"), (F.lit(math.log(cap)) / F.col("least") * F.lit(1 + 1e-9)).alias("high"), F.lit(0.0).alias("lam"), F.lit(False).alias("done")))
    for turn in range(ITERATIONS):
        w = _rate(cap)
        joined = cells.select("source", "n", "z").alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("s.*", "n", "z")
        # Each sum is pre-aggregated; a source is one row after the shuffle.
        sums = joined.groupBy("source", "want", "full", "low", "high", "lam").agg(F.sum(F.col("n") * F.col("z") * w).alias("value"), F.sum(F.when(w < cap, F.col("n") * F.col("z") * F.col("z") * w).otherwise(0.0)).alias("slope"))
        gap = F.col("value") - F.col("want")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        moved = sums.withColumns({"gap": gap, "newton": F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope")), "low": low, "high": high})
        at_end = F.col("want") >= F.col("full") * (1 - 1e-12)
        narrow = F.col("high") - F.col("low") <= F.abs(F.col("high")) * 1e-15
        moved = moved.withColumns({"at_end": at_end, "done": at_end | (F.abs("gap") <= F.col("want") * TOLERANCE) | narrow})
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")) & F.lit(turn < NEWTON)
        lam = F.when(F.col("at_end"), F.col("high")).when(F.col("done"), F.col("lam")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        old, state = state, settle(moved.withColumn("lam", lam).select("source", "want", "full", "low", "high", "lam", "done"))
        unsettle(old)
        if state.where(~F.col("done")).isEmpty():
            return state.select("source", "lam")
    raise RuntimeError(f"no rates for {state.where(~F.col('done')).count()} sources after {ITERATIONS} iterations")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) for every row of *docs*.

    size: words of the text, 0 for null.  target: of the row's source, see :func:`targets`.  rate: the solved copies,
    from 0 to *cap*; copies: the rate rounded down or up; taken: copies times size.  A source's
    copies add up to its target but for about one of its largest documents.  Documents without a word
    have the rate 1.  A null source is a source.  Repeated rows are documents each.  An empty table
    gives an empty one.  Other columns are not read.
    """
    own = settle(docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size")))
    counts = settle(own.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    wanted = settle(targets(sources.select("source", "source_size"), weights, share, float(cap)).alias("t").join(sources.select("source", "docs").alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select("t.*", "docs"))
    mean = F.col("source_size") / F.col("docs")
    cells = settle(counts.alias("c").join(wanted.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.*", F.when(mean > 0, F.col("size") / mean).otherwise(0.0).alias("z"), F.when(mean > 0, F.col("target") / mean).otherwise(0.0).alias("want")))
    lam = solve(cells, float(cap))
    # The order of a sum can change its last bits; rounded, reruns agree.
    rate = F.round(F.when(F.col("z") > 0, _rate(float(cap))).otherwise(F.lit(1.0)), 9)
    rated = cells.alias("c").join(lam.alias("l"), F.col("c.source").eqNullSafe(F.col("l.source")), "left").select("c.source", "size", "n", rate.alias("rate"))
    # A size that many documents share is dealt into cells, so that no group is ranked as a whole.
    parts = F.ceil(F.col("n") / CELL).cast("long")
    named = own.alias("d").join(rated.select("source", "size", "rate", parts.alias("parts")).alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.size") == F.col("r.size"))).select("d.*", "rate", "parts")
    lot = F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix"))
    named = settle(named.withColumn("lot", lot).withColumn("cell", F.pmod(F.shiftrightunsigned("lot", 20), F.col("parts"))))
    per_cell = named.groupBy("source", "size", "cell", "rate").agg(F.count("*").alias("n"))
    # Copies beyond the whole ones, in units of 1e-9, which rates are rounded to.
    part = F.round((F.col("rate") - F.floor("rate")) * 1e9).cast("decimal(20,0)") * F.col("n")
    upto = running(per_cell.withColumn("part", part.cast("decimal(38,0)")), [F.col("size"), F.col("cell")], {"upto": F.col("part")}, ["source"])

    def whole(x: Column) -> Column:
        return F.floor((x.cast("double") + 5e8) / 1e9)

    extra = upto.select("source", "size", "cell", (whole(F.col("upto")) - whole(F.col("upto") - F.col("part"))).alias("extra"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "cell").orderBy("lot", "doc_id")))
    done = ranked.alias("d").join(extra.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.size") == F.col("e.size")) & (F.col("d.cell") == F.col("e.cell"))).select("d.*", "extra")
    copies = (F.floor("rate") + F.when(F.col("rank") <= F.col("extra"), 1).otherwise(0)).cast("long")
    full = done.alias("d").join(wanted.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("doc_id", "d.source", "size", "source_size", "target", "rate", copies.alias("copies"))
    return full.withColumn("taken", F.col("copies") * F.col("size"))


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of *docs* as often as *mixed* says, for tables in which doc_id is unique; a null id is one too."""
    id_, n_, i_ = (free_name(docs.columns, c) for c in ("mixed_id", "mixed_n", "mixed_i"))
    wanted = mixed.where("copies > 0").select(F.col("doc_id").alias(id_), F.col("copies").alias(n_))
    return docs.join(wanted, F.col("doc_id").eqNullSafe(F.col(id_))).withColumn(i_, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n_)))).select(*docs.columns)
