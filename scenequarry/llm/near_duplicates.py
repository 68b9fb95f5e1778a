"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A document's set of word shingles gives a signature of ``POSITIONS`` symbols of ``BITS`` bits, one for
each hash; two sets of similarity J differ in about (1 - J) of them. Every pair that differs in at most
``radius`` symbols is found, with certainty, by the pigeonhole principle: symbols are cut into chunks, of
which some must agree exactly and some may have one error (enumerated by leaving out each of their
symbols in turn). With x exact and y one-error chunks, a pair within ``radius <= x + 2y - 1`` meets in a
key: to keep all chunks apart costs x + 2y errors. ``radius`` is set so that a pair at the similarity
threshold lies outside with a probability under ``MISS``.

Links are then confirmed on the full sets. Texts with one set are one vertex first. Within a key's
bucket, members are first compared with the bucket's least id only. What is then still in different
components is compared in full, in blocks of bounded size, and only links leave a block: no bucket is expanded
into all pairs nor held by one task. Before that, an exact bound thins the buckets out: a shingle that no other document
of an open bucket has can't be shared, so with p such shingles of n a document has no similarity above (n - p) / n
to any of them, and two documents none above m / (n1 + n2 - m), m being the lesser count of the other shingles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequarry.llm.components import components
from scenequarry.llm.shared import TEXT_HASH, Slice, map_slices, mix, store, with_text_hash

POSITIONS, BITS, MISS = 128, 16, 1e-5
_RNG = np.random.default_rng(771)
_XOR = _RNG.integers(0, 2**63, POSITIONS, dtype=np.uint64)
_ODD = _RNG.integers(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Symbols of a key. Sets of similarity J share a key of this width with probability J ** WIDTH.
WIDTH = 4
#: Documents of a family that are compared with as many others at once.
BLOCK = 1024


@dataclass(frozen=True)
class ChunkPlan:
    """Keys of a signature: the positions that each key reads."""

    radius: int
    keys: tuple[tuple[int, ...], ...]


@lru_cache
def chunk_plan(percent: int, positions: int = POSITIONS, width: int = WIDTH, miss: float = MISS) -> ChunkPlan:
    """The cheapest chunks (fewest keys) that cover the radius for a similarity of ``percent`` per cent.

    If no cover of this width fits in the positions, keys become narrower: more candidates, the same guarantee.
    """
    p, above, radius = 1 - percent / 100, 1.0, -1
    while above > miss:
        radius += 1
        above -= comb(positions, radius) * p**radius * (1 - p) ** (positions - radius)
    for w in range(width, 0, -1):
        fits = [(x + (w + 1) * y, x, y) for y in range(positions // (w + 1) + 1) for x in [max(0, radius + 1 - 2 * y)] if x * w + y * (w + 1) <= positions]
        if fits:
            _, x, y = min(fits)
            keys, at = [], 0
            for _ in range(x):
                keys.append(tuple(range(at, at + w)))
                at += w
            for _ in range(y):
                chunk = range(at, at + w + 1)
                keys += [tuple(i for i in chunk if i != out) for out in chunk]
                at += w + 1
            return ChunkPlan(radius, tuple(keys))
    raise ValueError(f"no chunks cover {radius} errors in {positions} positions")


def _profile(k: int):
    def work(batch: pa.RecordBatch, s: Slice) -> dict:
        h, doc, _ = s.shingles(s.word_hashes(), k)
        sizes, low, high, marks = np.zeros(s.n, np.int64), np.zeros(s.n, np.int64), np.zeros(s.n, np.int64), [None] * s.n
        if len(h):
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[fresh], doc[fresh]
            begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            there = doc[begin]
            sizes[there] = np.diff(np.append(begin, len(doc)))
            low[there] = np.add.reduceat(h, begin).view(np.int64)
            high[there] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), begin).view(np.int64)
            symbols = np.empty((len(begin), POSITIONS), np.uint16)
            for j in range(POSITIONS):
                symbols[:, j] = (mix(np.minimum.reduceat((h ^ _XOR[j]) * _ODD[j], begin)) >> np.uint64(48)).astype(np.uint16)
            for i, row in zip(there.tolist(), symbols, strict=True):
                marks[i] = row.tobytes()
        return {"n_shingles": sizes, "set_low": low, "set_high": high, "signature": pa.array(marks, pa.binary())}

    return work


def signatures(documents: DataFrame, shingle: int = 5, keep: Iterable[str] = ()) -> DataFrame:
    """doc_id, ``keep``, n_shingles (distinct), a 128-bit sum that identifies the set, and the signature (null for an empty set)."""
    return map_slices(documents, ["doc_id", *keep], "text", _profile(shingle), "n_shingles long, set_low long, set_high long, signature binary", lower=True)


def shingle_sets(documents: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id and its whole set of shingle hashes, distinct."""

    def work(batch: pa.RecordBatch, s: Slice) -> dict:
        h, doc, _ = s.shingles(s.word_hashes(), shingle)
        parts = np.split(h, np.searchsorted(doc, np.arange(1, s.n))) if s.n else []
        return {"shingles": pa.array([np.unique(x).view(np.int64) for x in parts], pa.list_(pa.int64()))}

    return map_slices(documents, ["doc_id"], "text", work, "shingles array<long>", lower=True)


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, POSITIONS)


def bucket_keys(vertices: DataFrame, plan: ChunkPlan) -> DataFrame:
    """``vertices(id, signature)`` to ``(key, id)``, a row for each key of the plan."""
    reads = np.array(plan.keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = _ODD[: reads.shape[1]]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                picked = _symbols(part.column(1)).astype(np.uint64)[:, reads]
                keys = mix((picked * odd).sum(axis=2, dtype=np.uint64) + (np.arange(len(reads), dtype=np.uint64) << np.uint64(17)) * _ODD[9])
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), len(reads)))], ["key", "id"])

    return vertices.select(F.col("id").cast("long"), "signature").mapInArrow(run, "key long, id long")


def _near(pairs: DataFrame, vertices: DataFrame, radius: int) -> DataFrame:
    """Of ``pairs(a, b)``, those whose signatures differ in at most ``radius`` symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                close = (_symbols(part.column(2)) != _symbols(part.column(3))).sum(axis=1) <= radius
                yield part.select([0, 1]).filter(pa.array(close))

    a, b = vertices.select(F.col("id").alias("a"), F.col("signature").alias("sa")), vertices.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs(a, b)``, those whose full sets have 100 * intersection >= percent * union."""
    a, b = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("xa")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("xb"))
    both = F.size(F.array_intersect("xa", "xb"))
    return pairs.join(b, "b").join(a, "a").where(100 * both >= percent * (F.size("xa") + F.size("xb") - both)).select("a", "b")


def _sharable(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """``(id, n, common)`` for ``ids(id)``: the set's size, and how many of its shingles another of the ids has too."""
    each = sets.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.explode_outer("shingles").alias("s"))
    alone = each.groupBy("s").agg(F.count(F.lit(1)).alias("__c"), F.min("id").alias("id")).where("__c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("__p"))
    size = sets.select(F.col("doc_id").alias("id"), F.size("shingles").cast("long").alias("n"))
    return ids.join(size, "id").join(alone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("__p", F.lit(0))).alias("common"))


def _cross_links(families: DataFrame, vertices: DataFrame, sets: DataFrame, radius: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between different components within a family, from blocks of ``BLOCK`` documents against blocks.

    ``families(family, id, component, n, common)``. A task holds the signatures and sets of two blocks; pairs
    that could be linked by the bound and by their signatures are confirmed on the whole sets there, so that only links leave it.
    """
    counted = families.groupBy("family").agg(F.count(F.lit(1)).alias("__n"))
    placed = families.join(counted, "family").withColumn("__nb", F.ceil(F.col("__n") / BLOCK).cast("int")).withColumn("__mine", F.pmod(F.xxhash64("id"), F.col("__nb")).cast("int"))
    spread = placed.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__nb") - 1))).select(
        "family", F.least("__mine", "__other").alias("lo"), F.greatest("__mine", "__other").alias("hi"), "__mine", "id", "component", "n", "common"
    )
    spread = spread.join(vertices.select("id", "signature"), "id").join(sets.select(F.col("doc_id").alias("id"), "shingles"), "id")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", ignore_index=True)
        lo, hi = frame.lo.iloc[0], frame.hi.iloc[0]
        left, right = np.flatnonzero(frame["__mine"] == lo), np.flatnonzero(frame["__mine"] == hi)
        marks = np.frombuffer(b"".join(frame.signature), np.uint16).reshape(-1, POSITIONS)
        ids, comps, sizes, commons = (frame[c].to_numpy() for c in ("id", "component", "n", "common"))
        place = np.unique(np.concatenate(frame.shingles.to_list()), return_inverse=True)[1]
        start = np.concatenate([[0], np.cumsum(sizes)])
        held = np.zeros(int(place.max()) + 1, bool)
        out = []
        for i in left.tolist():
            most = np.minimum(commons[right], commons[i])
            able = right[(comps[right] != comps[i]) & (100 * most >= percent * (sizes[right] + sizes[i] - most)) & ((ids[right] > ids[i]) | (lo != hi))]
            near = able[(marks[able] != marks[i]).sum(axis=1) <= radius]
            if len(near):
                mine = place[start[i] : start[i + 1]]
                held[mine] = True
                both = np.array([np.count_nonzero(held[place[start[j] : start[j + 1]]]) for j in near.tolist()])
                held[mine] = False
                near = near[100 * both >= percent * (sizes[near] + sizes[i] - both)]
                out += [(min(ids[i], j), max(ids[i], j)) for j in ids[near].tolist()]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return spread.groupBy("family", "lo", "hi").applyInPandas(run, "a long, b long").distinct()


def _still_open(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component."""
    mixed = members.groupBy("key").agg(F.min("component").alias("__a"), F.max("component").alias("__b")).where("__a != __b").select("key")
    return members.join(mixed, "key", "left_semi")


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links), kept (doc_id = component_id).

    Documents are linked when their sets of lower-cased ``shingle``-word shingles have a similarity of
    ``percent`` per cent or more; a text with fewer words is one shingle; null, empty or wordless texts
    have no set and no links, and are kept. Rows that repeat a doc_id are one document with the union of
    their links (the least set stands for it); rows with a null doc_id are left out. Other columns are
    ignored; an empty table gives no rows.
    """
    plan = chunk_plan(percent)
    whole = with_text_hash(documents.where(F.col("doc_id").isNotNull()))
    profile = store(signatures(whole, shingle, TEXT_HASH), "neardup-profile")
    sets_of = ["set_low", "set_high", "n_shingles"]
    filled = profile.where("n_shingles > 0")
    # A vertex is a set, named by its hash: an id may have several. One row of it stands for its text.
    row = ["doc_id", *TEXT_HASH]
    vertices = filled.groupBy(*sets_of).agg(F.min(F.struct(*row)).alias("row"), F.first("signature").alias("signature"))
    vertices = store(vertices.select(F.xxhash64(*sets_of).alias("id"), *sets_of, "row.*", "signature"), "neardup-vertices")

    keys = bucket_keys(vertices, plan)
    shared = keys.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("__last"), F.count(F.lit(1)).alias("n")).where("leader != __last").drop("__last")
    members = store(keys.join(shared, "key"), "neardup-members")
    first = _near(members.where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), vertices, plan.radius)
    first = store(first, "neardup-pairs")

    busy = vertices.join(members.select("id").distinct(), "id", "left_semi").select("id", *row)
    texts = whole.select(*row, "text").join(busy, row).dropDuplicates(row)
    sets = store(shingle_sets(texts.select(F.col("id").alias("doc_id"), "text"), shingle), "neardup-sets")
    links = store(_confirm(first, sets, percent), "neardup-links")
    label = components(links)

    open_keys = _still_open(members.where("n > 2").join(label, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")))
    open_keys = store(open_keys, "neardup-open")
    sharable = store(_sharable(open_keys.select("id").distinct(), sets), "neardup-sharable")
    able = _still_open(open_keys.join(sharable.where(100 * F.col("common") >= percent * F.col("n")), "id"))
    able = store(able, "neardup-able")
    # Documents that share a bucket, over any number of steps, are a family: each belongs to one.
    least = able.groupBy("key").agg(F.min("id").alias("a"))
    family = components(able.select("key", F.col("id").alias("b")).join(least, "key").select("a", "b"))
    grouped = able.drop("key").distinct().join(family.withColumnRenamed("component", "family"), "id")
    links = links.union(store(_cross_links(grouped, vertices, sets, plan.radius, percent), "neardup-links"))

    # From sets to documents: each set stands at its least id.
    copies = filled.select("doc_id", *sets_of).join(vertices.select(*sets_of, F.col("doc_id").alias("a")), sets_of).where("doc_id != a").select("a", F.col("doc_id").alias("b"))
    for end in ("a", "b"):
        links = links.join(vertices.select(F.col("id").alias(end), F.col("doc_id").alias(f"__{end}")), end).drop(end)
    label = components(links.select(F.col("__a").alias("a"), F.col("__b").alias("b")).union(copies))
    one = profile.groupBy("doc_id").agg(F.min("n_shingles").alias("n_shingles"))
    return (
        one.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def drop_near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``documents`` without those of a component's other members; the row of the least id stays. Null ids stay."""
    gone = near_duplicates(documents, shingle, percent).where(~F.col("kept")).select("doc_id")
    return documents.join(gone, "doc_id", "left_anti").select(documents.columns)
