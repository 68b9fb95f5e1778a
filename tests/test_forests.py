"""Deep, wide and broken span forests."""

import random
import time

import pytest
from pyspark.sql import functions as F

from scenequarry.operators import graph

LINKS = "span_id long, parent_span_id long, span_name string"


def test_a_long_chain(spark):
    """A hundred thousand spans, each the parent of the next: rounds, not levels."""
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("span_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_span_id"), F.when(F.col("id") == 7, "stage.x").otherwise("y").alias("span_name"))
    began = time.time()
    forest = graph.span_forest(chain.drop("span_name"))
    row = forest.agg(F.count(F.lit(1)).alias("n"), F.max("root_id").alias("r"), F.count_if(F.col("depth") != F.col("span_id")).alias("wrong")).first()
    assert (row["n"], row["r"], row["wrong"]) == (n, 0, 0)
    assert time.time() - began < 120
    below = graph.stage_subtrees(forest, chain, "stage.")
    assert below.count() == n - 7 and below.where("matched_root != '7'").isEmpty()


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_against_walks(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, -5, *range(i)]) if i % 9 else None, rng.choice(["stage.a", "b"])) for i in range(1, 160)]
    rows += [(500 + i, 0, "b") for i in range(60)] + [(0, None, "stage.root")]
    rows += [(1000, 1001, "b"), (1001, 1000, "b"), (1002, 1000, "b"), (1003, 1003, "b")]
    parent = {i: p for i, p, _ in rows}
    name = {i: n for i, _, n in rows}

    def up(i):
        line = []
        while i in parent and len(line) < 2_000:
            line.append(i)
            i = parent[i]
        return None if len(line) == 2_000 else line[::-1]

    lines = {i: line for i in parent if (line := up(i))}
    spans = spark.createDataFrame(rows, LINKS)
    forest = graph.span_forest(spans.drop("span_name"), paths=True)
    assert {r.span_id: (r.root_id, r.depth, r.path) for r in forest.collect()} == {i: (x[0], len(x) - 1, "/".join(map(str, x))) for i, x in lines.items()}
    first = {i: next((str(j) for j in x if name[j].startswith("stage.")), None) for i, x in lines.items()}
    assert {r.span_id: r.matched_root for r in graph.stage_subtrees(forest, spans, "stage.").collect()} == {i: m for i, m in first.items() if m}
    places = {}
    for root in {x[0] for x in lines.values()}:
        places |= {i: k + 1 for k, i in enumerate(sorted((i for i, x in lines.items() if x[0] == root), key=lambda i: [str(j).zfill(20) for j in lines[i]]))}
    assert {r.span_id: r.place for r in graph.preorder(forest).collect()} == places
    assert graph.span_forest(spans.limit(0)).isEmpty()
