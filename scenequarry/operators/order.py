"""Exact order statistics of groups of any size: quantiles by histogram refinement, ranks by range partitions and running counts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenequarry.operators.camera import BROADCAST_ROWS, small
from scenequarry.operators.stored import remove_stored, stored

#: Values of an interval that one task sorts; bins of a round; rounds at most.
KEEP, BINS, ROUNDS = 65_536, 1_024, 120


def _log(value: Column) -> Column:
    """Rises with the value, by its order of magnitude."""
    return F.signum(value) * (F.log(F.greatest(F.abs(value), F.lit(5e-324))) + 746)


def group_quantiles(rows: DataFrame, keys: Sequence[str], wanted: Mapping[str, Sequence[float]], keep: int = KEEP, bins: int = BINS) -> DataFrame:
    """``(keys…, n, {c}_min, {c}_max, {c}_q0, {c}_q1, …)``: exact quantiles of each column of each group, between neighbours by linear interpolation.

    The values of a group between its ends are counted in ``bins`` equal bins; the bins that hold a wanted rank are kept, with the least and
    greatest value that they really have, and are divided again, until each has at most ``keep`` values or one distinct value. Bins of
    every other round are equal on a logarithmic scale, so that values of all magnitudes are told apart in few rounds. A round hands on at most ``bins`` counts for
    each kept interval; only intervals of ``keep`` values or fewer are ever sorted, so that no group is one task's work. Where no group has more than
    ``keep`` rows, one aggregate does it all. Nulls don't count, values are finite, keys are not null; ``n`` counts the group's rows. A group without values
    has null quantiles. ``rows`` are read once a round.
    """
    keys, axes = list(keys), list(wanted)
    # One pass for sizes and ends; the groups' sizes are read from what it stored.
    ends = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[f.alias(f"{c}_{k}") for c in axes for k, f in (("min", F.min(c).cast("double")), ("max", F.max(c).cast("double")), ("n", F.count(c)))]), "quantile-ends")
    sizes = ends.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    if sizes[1] <= keep:
        at_once = [F.percentile(c, q).alias(f"{c}_q{i}") for c in axes for i, q in enumerate(wanted[c])]
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[f(c).cast("double").alias(f"{c}_{k}") for c in axes for k, f in (("min", F.min), ("max", F.max))], *at_once)
    # A group has no more intervals than ranks: a bound on all that is broadcast.
    few = sizes[0] * sum(2 * len(q) for q in wanted.values()) <= BROADCAST_ROWS
    hint = F.broadcast if few else (lambda df: df)
    place = lambda c, q: (F.col(f"{c}_n") - 1) * F.lit(float(q))
    ranks = lambda c: F.array_distinct(F.array(*[f(place(c, q)).cast("long") for q in wanted[c] for f in (F.floor, F.ceil)]))
    # An interval: values from lo to hi, ``size`` of them, after ``before`` lower ones of the group.
    starts = F.array(*[F.struct(F.lit(i).alias("axis"), F.lit(0).alias("slot"), F.col(f"{c}_min").alias("lo"), F.col(f"{c}_max").alias("hi"), F.lit(0).cast("long").alias("before"), F.col(f"{c}_n").alias("size"), ranks(c).alias("ranks")) for i, c in enumerate(axes)])
    parts = ends.select(*keys, F.inline(starts)).where("size > 0")
    values = rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(c).cast("double").alias("value")) for i, c in enumerate(axes)]))).where("value IS NOT NULL")
    group = [*keys, "axis"]
    for turn in range(ROUNDS):
        wide = parts.where((F.col("size") > keep) & (F.col("lo") < F.col("hi")))
        if wide.isEmpty():
            break
        placed = _in_intervals(values, hint, wide, group)
        # Halves, so that the distance between the ends of the doubles is finite.
        scale = _log if turn % 2 else lambda v: v / 2
        share = (scale(F.col("value")) - scale(F.col("lo"))) / (scale(F.col("hi")) - scale(F.col("lo")))
        binned = placed.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.coalesce(F.when(F.isnan(share), 0.0).otherwise(share), F.lit(0.0)) * bins)))
        counts = binned.groupBy(*group, "slot", "bin").agg(F.count(F.lit(1)).alias("c"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        lower = F.coalesce(F.sum("c").over(Window.partitionBy(*group, "slot").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        joined = counts.withColumn("lower", lower).join(hint(wide.drop("lo", "hi", "size")), [*group, "slot"])
        # A name of its own: within a lambda, an alias of the same select would hide the column.
        begun = joined.withColumn("start", F.col("before") + F.col("lower")).drop("before")
        inside = F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("c")))
        narrow = begun.withColumn("inside", inside).where(F.size("inside") > 0).select(*group, "lo", "hi", F.col("start").alias("before"), F.col("c").alias("size"), F.col("inside").alias("ranks"))
        rest = parts.where((F.col("size") <= keep) | (F.col("lo") >= F.col("hi"))).drop("slot")
        both = narrow.select(*rest.columns).unionByName(rest).withColumn("slot", F.row_number().over(Window.partitionBy(*group).orderBy("before")))
        last, parts = parts, stored(both, "quantile-parts")
        if turn:
            remove_stored(rows.sparkSession, last)
    one = parts.where("lo = hi").select(*group, F.explode("ranks").alias("rank"), F.col("lo").alias("value"))
    sorted_ = _in_intervals(values, hint, parts.where("lo < hi"), group).groupBy(*group, "slot").agg(F.sort_array(F.collect_list("value")).alias("sorted"))
    few = sorted_.join(hint(parts.select(*group, "slot", "before", "ranks")), [*group, "slot"])
    picked = few.select(*group, F.explode(F.transform("ranks", lambda r: F.struct(r.alias("rank"), F.get("sorted", (r - F.col("before")).cast("int")).alias("value")))).alias("p")).select(*group, "p.*")
    table = one.unionByName(picked).groupBy(*keys).agg(*[F.map_from_entries(F.collect_list(F.when(F.col("axis") == i, F.struct("rank", "value")))).alias(f"__{c}") for i, c in enumerate(axes)])
    found = ends.join(table, keys, "left")

    def at(c: str, q: float) -> Column:
        where = place(c, q)
        low, high = F.floor(where).cast("long"), F.ceil(where).cast("long")
        return F.when(low == high, F.col(f"__{c}")[low]).otherwise((high - where) * F.col(f"__{c}")[low] + (where - low) * F.col(f"__{c}")[high])

    return found.select(*keys, "n", *[F.col(f"{c}_{k}") for c in axes for k in ("min", "max")], *[at(c, q).alias(f"{c}_q{i}") for c in axes for i, q in enumerate(wanted[c])])


def _in_intervals(values: DataFrame, hint: Callable[[DataFrame], DataFrame], parts: DataFrame, group: list[str]) -> DataFrame:
    """Values with the slot and ends of the interval that they lie in. Intervals of a group are disjoint and few, so one row a group has them all."""
    packed = parts.groupBy(*group).agg(F.collect_list(F.struct("slot", "lo", "hi")).alias("__p"))
    mine = F.get(F.filter("__p", lambda p: (F.col("value") >= p["lo"]) & (F.col("value") <= p["hi"])), F.lit(0))
    return values.join(hint(packed), group).withColumn("__m", mine).where("__m IS NOT NULL").select(*group, "value", "__m.*")


def group_ranks(rows: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], rank: str, size: str | None = None) -> DataFrame:
    """Stored ``rows`` with their place (from 0) among the rows of equal ``keys``, and, if asked for, the number of those rows.

    ``order`` holds columns and whether each falls. Rows are sorted into ranges by key and order; a range numbers its rows, and running counts of a key's
    rows over the ranges before give where each begins. A key's rows spread over as many tasks as they fill: what a task sorts is a
    range, not a group. Rows alike in ``order`` get different places. Null keys are a group.
    """
    by = [*[F.col(f"`{k}`").asc() for k in keys], *[F.col(f"`{c}`").desc() if falls else F.col(f"`{c}`").asc() for c, falls in order]]
    placed = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id()), "ranges")
    heads = placed.groupBy(F.shiftrightunsigned("__id", 33).alias("__part"), *keys).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__c"))
    mine = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__c").over(mine.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = stored(heads.withColumns({"__before": before, "__all": F.sum("__c").over(mine)}), "range-heads").withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    same = F.shiftrightunsigned("__id", 33) == F.col("__part")
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
    joined = placed.join(small(heads), same).withColumn(rank, F.col("__id") - F.col("__first") + F.col("__before"))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], rank, *([F.col("__all").alias(size)] if size else []))
