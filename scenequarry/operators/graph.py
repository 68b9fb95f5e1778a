"""Connected components and span forests as iterative joins."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenequarry.operators.order import group_ranks
from scenequarry.operators.stored import remove_stored, stored


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``nodes(scene_id, node)`` and ``edges(scene_id, a, b)`` to ``(scene_id, node, component)``; the component is its least node.

    Each round a node, and the node that it is labelled with, take the least label next to it; then each label takes its own
    label. Rounds grow with the logarithm of the longest path. Lone nodes are their own. A finished round's table is deleted.
    """
    both = stored(edges.select("scene_id", "a", "b").union(edges.select("scene_id", F.col("b"), F.col("a"))).where("a != b").distinct(), "component-edges")
    label, last = nodes.select("scene_id", "node", F.col("node").alias("component")).distinct(), None
    for _ in range(max_rounds):
        near = both.join(label.select("scene_id", F.col("node").alias("b"), "component"), ["scene_id", "b"]).groupBy("scene_id", F.col("a").alias("node")).agg(F.min("component").alias("__m"))
        offers = near.join(label, ["scene_id", "node"]).select("scene_id", "__m", F.explode(F.array("node", "component")).alias("node")).groupBy("scene_id", "node").agg(F.min("__m").alias("__m"))
        low = label.join(offers, ["scene_id", "node"], "left").select("scene_id", "node", F.least("component", F.coalesce("__m", "component")).alias("component"), F.col("component").alias("__old"))
        root = low.select("scene_id", F.col("node").alias("component"), F.col("component").alias("__r"))
        low = stored(low.join(root, ["scene_id", "component"], "left").select("scene_id", "node", F.least("component", F.coalesce("__r", "component")).alias("component"), "__old"), "components")
        if last is not None:
            remove_stored(low.sparkSession, last)
        last = low
        label = low.select("scene_id", "node", "component")
        if low.where("component != __old").isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def climb(links: DataFrame, carried: Mapping[str, tuple[Column, Callable[[Column, Column], Column]]] | None = None) -> DataFrame:
    """``(span_id, top, …)`` of ``links(span_id, parent_span_id, …)``: the span that each one's parents lead to, and what is carried on the way there.

    A span whose parent isn't among the rows is a top, its own. ``carried`` has a start for each span and how the value of the upper stretch joins that of the lower one; a stretch
    begins at its span and ends before the span reached, so a top's own value is joined last. Each round doubles the stretches: a span takes over where the span that it has reached
    stands. Rounds are the logarithm of the depth. Rows on a cycle, or below one, reach no top and are left out. Ids are unique.
    """
    carried = dict(carried or {})
    known = links.select(F.col("span_id").alias("parent_span_id"), F.lit(True).alias("__known"))
    marked = links.join(known, "parent_span_id", "left")
    at = F.when(F.col("__known"), F.col("parent_span_id")).otherwise(F.col("span_id"))
    state = stored(marked.select("span_id", at.alias("at"), F.col("__known").isNull().alias("top"), *[v.alias(c) for c, (v, _) in carried.items()]), "climb")
    tops = stored(state.where("top").select(F.col("span_id").alias("at"), F.lit(True).alias("__t")), "climb-tops")
    # Done is a span that stands on a top.
    state = stored(state.join(tops, "at", "left").select("span_id", "at", "top", F.col("__t").isNotNull().alias("done"), *carried), "climb")
    reach, count = 1, state.count()
    while reach <= count and not (left := state.where("NOT done")).isEmpty():
        upper = state.select(F.col("span_id").alias("at"), F.col("at").alias("__at"), F.col("done").alias("__done"), *[F.col(c).alias(f"__{c}") for c in carried])
        moved = left.join(upper, "at").select("span_id", F.col("__at").alias("at"), "top", F.col("__done").alias("done"), *[join(F.col(f"__{c}"), F.col(c)).alias(c) for c, (_, join) in carried.items()])
        last, state = state, stored(state.where("done").unionByName(moved), "climb")
        remove_stored(state.sparkSession, last)
        reach *= 2
    found = state.where("done")
    own = stored(found.where("top").select("at", *[F.col(c).alias(f"__{c}") for c in carried]), "climb-tops")
    ended = found.join(own, "at")
    return ended.select("span_id", F.col("at").alias("top"), *[F.when(F.col("top"), F.col(c)).otherwise(join(F.col(f"__{c}"), F.col(c))).alias(c) for c, (_, join) in carried.items()])


def span_forest(spans: DataFrame, max_depth: int | None = None, paths: bool = False) -> DataFrame:
    """``spans(span_id, parent_span_id, …)`` with root_id and depth, and with the path (ids from the root, joined by ``/``) if asked for.

    A span whose parent isn't among the rows is a root. Rows on a cycle reach no root and are left out. Rounds are the logarithm of the depth; a path is
    as long as its span is deep. A forest deeper than ``max_depth``, where given, is an error.
    """
    carried = {"depth": (F.lit(1), lambda up, own: up + own)}
    if paths:
        carried["path"] = (F.col("span_id").cast("string"), lambda up, own: F.concat_ws("/", up, own))
    found = climb(spans.select("span_id", "parent_span_id"), carried).withColumn("depth", F.col("depth") - 1).withColumnRenamed("top", "root_id")
    if max_depth is not None and (found.agg(F.max("depth")).first()[0] or 0) > max_depth:
        raise RuntimeError(f"spans are nested deeper than {max_depth}")
    return spans.join(found, "span_id")


def stage_subtrees(forest: DataFrame, names: DataFrame, prefix: str) -> DataFrame:
    """Rows of ``forest(span_id, parent_span_id, …)`` at or below the topmost span of each branch whose name starts with ``prefix``, with that span's id as ``matched_root``.

    ``names(span_id, span_name)``. A stretch of ancestors carries its topmost match, and stretches double.
    """
    named = forest.select("span_id", "parent_span_id").join(names.select("span_id", F.startswith("span_name", F.lit(prefix)).alias("__m")), "span_id", "left")
    match = F.when(F.col("__m"), F.col("span_id").cast("string"))
    top = climb(named, {"matched_root": (match, lambda up, own: F.coalesce(up, own))}).where("matched_root IS NOT NULL")
    return forest.join(top.select("span_id", "matched_root"), "span_id")


def preorder(forest: DataFrame) -> DataFrame:
    """``forest(span_id, parent_span_id, root_id, …)`` with ``place``: from 1 within its root, parents before children, siblings in order of id (as padded text).

    The walk around a tree goes down into each span and up from it again; ranking its steps by doubling counts the ways down before each. Every step has one
    step after it, so that neither a deep nor a wide tree is one task's work, and rounds are the logarithm of the tree's size.
    """
    key = F.col("span_id").cast("string")
    nodes = stored(forest.select("span_id", "parent_span_id", "root_id", F.when(F.length(key) < 20, F.lpad(key, 20, "0")).otherwise(key).alias("__key")), "walk-nodes")
    below = nodes.where("span_id != root_id")
    first = below.groupBy(F.col("parent_span_id").alias("span_id")).agg(F.min_by("span_id", "__key").alias("__first"))
    ranked = group_ranks(below.select("span_id", "parent_span_id", "__key"), ["parent_span_id"], [("__key", False)], "__r")
    after = ranked.select("parent_span_id", (F.col("__r") - 1).alias("__r"), F.col("span_id").alias("__next"))
    following = ranked.join(after, ["parent_span_id", "__r"], "left").select("span_id", "__next")
    whole = nodes.join(first, "span_id", "left").join(following, "span_id", "left")
    # Flat columns: structs take three times the room in a shuffle.
    last_of = F.when(F.col("span_id") != F.col("root_id"), F.col("parent_span_id"))
    down = whole.select("span_id", F.lit(True).alias("down"), F.coalesce("__first", "span_id").alias("to"), F.col("__first").isNotNull().alias("to_down"), F.lit(1).cast("long").alias("left"))
    up = whole.select("span_id", F.lit(False).alias("down"), F.coalesce(F.col("__next"), last_of).alias("to"), F.col("__next").isNotNull().alias("to_down"), F.lit(0).cast("long").alias("left"))
    walk = stored(down.unionByName(up), "walk")
    while not (open_ := walk.where("to IS NOT NULL")).isEmpty():
        ahead = walk.select(F.col("span_id").alias("to"), F.col("down").alias("to_down"), F.col("to").alias("__to"), F.col("to_down").alias("__down"), F.col("left").alias("__left"))
        moved = open_.join(ahead, ["to", "to_down"]).select("span_id", "down", F.col("__to").alias("to"), F.col("__down").alias("to_down"), (F.col("left") + F.col("__left")).alias("left"))
        last, walk = walk, stored(walk.where("to IS NULL").unionByName(moved), "walk")
        remove_stored(walk.sparkSession, last)
    # Ways down from here on to the walk's end, less than those of its whole.
    left = walk.where("down").select("span_id", "left")
    sizes = forest.groupBy("root_id").agg(F.count(F.lit(1)).alias("__n"))
    return forest.join(left, "span_id").join(sizes, "root_id").withColumn("place", F.col("__n") - F.col("left") + 1).drop("left", "__n")
