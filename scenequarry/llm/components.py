"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequarry.llm.shared import remove_stored, store


#: Ids of a graph up to which its labels, two numbers each, are broadcast.
BROADCAST_IDS = 100_000


def components(edges: DataFrame, max_rounds: int = 60, most: int = BROADCAST_IDS) -> DataFrame:
    """``edges(a, b)`` to ``(id, component)``, the component being its smallest id; ids without an edge don't appear.

    Each round takes the label of each label, which doubles the reach, then the least label among neighbours
    (a map-side combined minimum, so a hub costs no more than its edges). Each round's labels are stored; those
    of a graph of up to ``most`` ids are broadcast, so that a round is two shuffles. Null ends and loops are ignored; repeated edges change nothing; no edges give no rows.
    """
    both = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = store(both.select("a", "b").union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels, last = store(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "cc-labels"), None
    # The ids stay the same from round to round, and so does their number: a bound on what is broadcast.
    hint = F.broadcast if labels.count() <= most else (lambda df: df)
    for _ in range(max_rounds):
        jumped = labels.join(hint(labels.select(F.col("id").alias("component"), F.col("component").alias("__root"))), "component", "left")
        jumped = jumped.select("id", F.least("component", F.coalesce("__root", "component")).alias("component"), F.col("component").alias("__old"))
        near = both.join(hint(jumped.select(F.col("id").alias("b"), "component")), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("__m"))
        # The node that an id is labelled with takes the least label next to the id as well, so that rounds grow with the logarithm of a path.
        offers = near.join(hint(jumped.select("id", "component")), "id").select(F.explode(F.array("id", "component")).alias("id"), "__m")
        every = jumped.select("id", F.col("component").alias("__m"), "__old").union(offers.select("id", "__m", F.lit(None).cast(jumped.schema["__old"].dataType).alias("__old")))
        low = store(every.groupBy("id").agg(F.min("__m").alias("component"), F.min("__old").alias("__old")), "cc-labels")
        if last is not None:
            remove_stored(low.sparkSession, last)
        last, labels = low, low.select("id", "component")
        if low.where(F.col("component") != F.col("__old")).isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
