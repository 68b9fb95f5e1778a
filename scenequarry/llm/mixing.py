"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same number of copies on average, target / source size. Its whole
part is given to all; the fractional part is decided by pivotal steps: two documents exchange words
(copies times size stay the same in sum) at random, without bias, until one of them has a whole number.
A chunk of documents leaves at most one undecided; these residuals meet again in groups of ``FAN_IN``,
level by level, until one is left in a source, which a coin decides. So a source's words miss their
target by less than its largest document. What is decided is a row: rows that repeat a source, id and text are as many units, told
apart by a number. All chance comes from hashes of id, text and number: reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenequarry.llm.shared import mix, native_word_count, store

WEIGHTS, MAX_COPIES = (5.0, 2.0, 1.0), 3.0
#: Documents of a chunk, about, and residuals that meet at once.
CHUNK, FAN_IN = 20_000, 1_000
#: Equal rows that one task numbers.
RUN = 100_000
_TINY = 1e-9


def _uniform(a: np.ndarray | int, seed: int) -> float:
    return int(mix(np.array([a], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[0] >> np.uint64(11)) / 2.0**53


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MAX_COPIES) -> DataFrame:
    """``sizes(source, size)`` to ``(source, source_size, target)``.

    Sources by code point (null last) take the weights in turn. The total of all sizes is shared by
    weight; a target stops at ``most`` times its source's size and the excess goes to the others by
    weight, until none is above. Only sums over sources reach the driver, one row for each round.
    """
    spark = sizes.sparkSession
    per = store(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), "mix-sources")
    # Ranks without one task for all: a range sort, then a running count over partitions.
    parts = store(per.repartitionByRange(F.asc_nulls_last("source")).withColumn("__part", F.spark_partition_id()), "mix-ranges")
    before = parts.groupBy("__part").count().withColumn("__before", F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select("__part", F.coalesce("__before", F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(F.asc_nulls_last("source"))) - 1 + F.col("__before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = store(parts.join(before, "__part").select("source", "source_size", "n_docs", weight.alias("__w")), "mix-ranked")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    cap = F.col("source_size") * F.lit(float(most))
    level, capped = 0.0, F.lit(False)
    while True:
        row = ranked.agg(F.sum(F.when(capped, cap)).alias("full"), F.sum(F.when(~capped, F.col("__w"))).alias("open"), F.count(F.when(capped, 1)).alias("n")).first()
        if not row["open"]:
            break
        level = (total - (row["full"] or 0.0)) / row["open"]
        capped = F.col("__w") * F.lit(level) >= cap
        if ranked.where(capped).count() == row["n"]:
            break
    return ranked.select("source", "source_size", "n_docs", F.least(cap, F.col("__w") * F.lit(level)).alias("target"))


#: A unit: its source, the row that it stands for (``named`` is false for a null id), its size, and the fraction still to be decided.
UNIT = "source string, named boolean, doc_id long, text_hash long, unit long, size long, fraction double"
_CARRIED = ["source", "named", "doc_id", "text_hash", "unit", "size"]


def _rounded(frames: Iterator[pd.DataFrame], last: bool) -> Iterator[pd.DataFrame]:
    """Walk rows sorted by (source, group, unit): pivotal steps within each group; a group's residual is handed on."""
    held = None  # [group key, unit, size, fraction, the row as it came]
    for frame in frames:
        units, sizes, x = frame.unit.to_numpy(), frame["size"].to_numpy().astype(float), frame.fraction.to_numpy().copy()
        marks = list(zip(frame.source.tolist(), frame.group.tolist(), strict=True))
        done = np.ones(len(units), bool)
        tail: list[tuple] = []
        row = lambda i, frame=frame: tuple(frame[_CARRIED].iloc[i])
        for i in range(len(units)):
            if held is not None and held[0] != marks[i]:
                tail.append(_left(held, last))
                held = None
            if x[i] <= _TINY or x[i] >= 1 - _TINY or sizes[i] <= 0:
                x[i] = 0.0 if sizes[i] <= 0 else round(x[i])
                continue
            if held is None:
                held = [marks[i], units[i], sizes[i], x[i], (frame, i)]
                done[i] = False
                continue
            _, other, hs, hx, at = held
            # Words that may go from the newcomer to the held one, and back.
            up, down = min((1 - hx) * hs, x[i] * sizes[i]), min(hx * hs, (1 - x[i]) * sizes[i])
            seed = (int(units[i]) * 1_000_003 + int(other)) & 0x7FFFFFFFFFFFFFFF
            moved = up if _uniform(seed, 17) * (up + down) < down else -down
            hx, mine = hx + moved / hs, x[i] - moved / sizes[i]
            held_done = hx <= _TINY or hx >= 1 - _TINY
            mine_done = mine <= _TINY or mine >= 1 - _TINY
            if held_done:
                if at[0] is frame:
                    x[at[1]], done[at[1]] = round(hx), True
                else:
                    tail.append((*tuple(at[0][_CARRIED].iloc[at[1]]), float(round(hx))))
                held = None
            else:
                held[3] = hx
            if mine_done:
                x[i] = round(mine)
            else:
                done[i] = False
                held = [marks[i], units[i], sizes[i], mine, (frame, i)]
        keep = frame[_CARRIED].assign(fraction=x)[done]
        if held is not None:
            # Only the row is kept of a frame that is done.
            held[4] = (held[4][0].iloc[[held[4][1]]], 0)
        yield pd.concat([keep, _frame(tail)], ignore_index=True) if tail else keep
    if held is not None:
        yield _frame([_left(held, last)])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    kinds = {"named": "bool", "doc_id": "int64", "text_hash": "int64", "unit": "int64", "size": "int64", "fraction": "float64"}
    return pd.DataFrame(rows, columns=[*_CARRIED, "fraction"]).astype(kinds)


def _left(held: list, last: bool) -> tuple:
    """A group's residual: decided by a coin at the last level, else handed on."""
    _, unit, _, x, (frame, i) = held
    return *tuple(frame[_CARRIED].iloc[i]), float(_uniform(int(unit), 29) < x) if last else x


def pivotal_rounding(rows: DataFrame, largest_source: int, chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """``rows`` (columns of ``UNIT``) with fractions rounded to 0 or 1, keeping each source's sum of size times fraction near.

    Chunks are (source, hash of the unit), so that a hot source spreads over many tasks. A level leaves one
    residual a chunk; the next level groups these by ``fan_in``. Levels are few: log(largest source) / log(fan_in).
    """
    done = None
    groups = max(1, -(-largest_source // chunk))
    while True:
        last = groups == 1
        placed = rows.withColumn("group", F.pmod(F.xxhash64("unit", F.lit(groups)), F.lit(groups)))
        placed = placed.repartition("source", "group").sortWithinPartitions("source", "group", "unit", "size")
        out = store(placed.mapInPandas(lambda it, last=last: _rounded(it, last), UNIT), "mix-level")
        whole = (F.col("fraction") == 0) | (F.col("fraction") == 1)
        settled = out.where(whole)
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done
        rows, groups = out.where(~whole), max(1, -(-groups // fan_in))


def _units(groups: DataFrame) -> DataFrame:
    """Equal rows, ``groups(…, __times)``, as numbered units; many equal ones are dealt to tasks in runs before they are numbered."""
    few = groups.where(F.col("__times") <= RUN).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1)))
    runs = groups.where(F.col("__times") > RUN).withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1, F.lit(RUN).cast("long"))))
    many = runs.repartition("source", "doc_id", "__from").withColumn("__k", F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + RUN, F.col("__times")) - 1))).drop("__from")
    return few.unionByName(many).withColumn("unit", F.xxhash64("doc_id", "text_hash", "__k"))


def _decided(documents: DataFrame, weights: Sequence[float], most: float, size: Column | None) -> DataFrame:
    """A row for each row of ``documents``: source, named, doc_id, text_hash, size, source_size, target, copies."""
    amount = native_word_count(F.col("text")) if size is None else size
    sizes = documents.select(
        F.col("source").cast("string"), F.col("doc_id").isNotNull().alias("named"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), amount.cast("long").alias("size")
    )
    sizes = store(sizes, "mix-sizes")
    targets = store(source_targets(sizes, weights, most), "mix-targets")
    largest = targets.agg(F.coalesce(F.max("n_docs"), F.lit(0))).first()[0]
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shares = targets.select(F.col("source").alias("__s"), "source_size", "target", share.alias("__share")).withColumn("__whole", F.least(F.floor(F.col("__share") + 1e-9), F.lit(int(most))).cast("long"))
    shares = F.broadcast(shares) if _few(targets) else shares
    of_source = F.col("source").eqNullSafe(F.col("__s"))
    grouped = sizes.groupBy("source", "named", "doc_id", "text_hash", "size").agg(F.count(F.lit(1)).alias("__times"))
    fraction = F.greatest(F.lit(0.0), F.col("__share") - F.col("__whole"))
    rows = _units(grouped).join(shares, of_source).select(*_CARRIED, fraction.alias("fraction"))
    decided = pivotal_rounding(rows, largest).join(shares, of_source)
    return decided.select("source", "named", "doc_id", "text_hash", "size", "source_size", "target", (F.col("__whole") + F.col("fraction").cast("long")).alias("copies"))


def mix_sources(documents: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MAX_COPIES, size: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (words taken, repeats counted), a row for each row of ``documents``.

    Sizes are words; null or empty texts have 0 and are never taken. A null source is a source of its own, last in
    order. Rows that repeat a doc_id, or have none, are decided each on its own. An empty table gives no rows; extra
    columns are ignored.
    """
    made = _decided(documents, weights, most, size)
    return made.select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _few(targets: DataFrame) -> bool:
    """At most a few thousand sources: small enough for every executor."""
    return targets.limit(5_001).count() <= 5_000


def take_copies(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``documents`` as many times as it is taken, with the columns of ``documents``.

    Rows with one source, id and text share their copies as evenly as whole numbers allow: each is taken as often as the least of them, and the
    one that comes first by its other columns has the rest. Null texts are never taken; an empty table gives no rows.
    """
    keys = ["__source", "__named", "__doc", "__hash"]
    decided = _decided(documents, **({"weights": WEIGHTS, "most": MAX_COPIES, "size": None} | options))
    group = decided.groupBy(*[F.col(c).alias(k) for k, c in zip(keys, ("source", "named", "doc_id", "text_hash"), strict=True)]).agg(F.count(F.lit(1)).alias("__n"), F.sum("copies").alias("__sum")).where("__sum > 0")
    group = store(group, "mix-copies")
    keyed = documents.withColumns({"__ks": F.col("source").cast("string"), "__kn": F.col("doc_id").isNotNull(), "__kd": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "__kh": F.xxhash64(F.col("text").cast("string"))})
    same = F.col("__ks").eqNullSafe(F.col("__source")) & (F.col("__kn") == F.col("__named")) & (F.col("__kd") == F.col("__doc")) & (F.col("__kh") == F.col("__hash"))
    each = F.explode(F.sequence(F.lit(1), F.col("__c").cast("int")))
    columns = [F.col(f"`{c}`") for c in documents.columns]
    alone = keyed.join(group.where("__n = 1"), same).select(*columns, F.col("__sum").alias("__c"))
    # Of rows that are told apart by nothing, one stands for all with their sum; rows that differ in other columns take whole shares in order.
    plain = [f.name for f in documents.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    others = [c for c in documents.columns if c not in plain]
    repeated = keyed.join(group.where("__n > 1"), same)
    repeated = repeated.groupBy(*keys, "__n", "__sum", *[F.col(f"`{c}`") for c in plain]).agg(F.count(F.lit(1)).alias("__m"), *[F.first(F.col(f"`{c}`")).alias(c) for c in others])
    before = F.sum("__m").over(Window.partitionBy(*keys).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in plain])).rowsBetween(Window.unboundedPreceding, -1))
    # Units numbered from 0 in this order: the first ``sum mod n`` of them have one copy more.
    until = F.coalesce(before, F.lit(0))
    extra = F.least(F.greatest(F.pmod(F.col("__sum"), F.col("__n")) - until, F.lit(0)), F.col("__m"))
    repeated = repeated.withColumn("__c", F.floor(F.col("__sum") / F.col("__n")) * F.col("__m") + extra).where("__c > 0").select(*columns, "__c")
    return alone.unionByName(repeated).withColumn("__i", each).select(*columns)
