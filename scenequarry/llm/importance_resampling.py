"""Importance resampling towards a target text: documents are drawn as if by how much likelier the target makes them.

Every run of one to three words is a feature, hashed by CRC-32 to one of ``BUCKETS``. Counts over all documents and all target
texts give each bucket a gain, an array of whole numbers; a document's weight is the sum of its features' gains. Weight plus a
Gumbel variate is its score, and the highest scores are a draw without replacement. Ranks come from a distributed LSD radix sort
(``radix_ranks``): no task sees more than a block of rows or of one digit's counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenequarry.llm.shared import PLAIN_BREAKS, Slice, map_slices, remove_stored, slices, store

BUCKETS, LONGEST_RUN = 10_000, 3
#: Bits of a digit; rows of a block, within which a pass counts.
DIGIT_BITS, BLOCK = 11, 1 << 16
#: Bytes of a word whose checksum is read from tables; longer words are rare and go through zlib.
TABLED = 47


def _checksum_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 is linear: what a byte adds by its distance from the end, what a length adds, and how a checksum changes when bytes follow it."""
    zeros = np.array([zlib.crc32(bytes(n)) for n in range(TABLED + 2)], np.uint32)
    adds = np.array([[zlib.crc32(bytes([b]) + bytes(n)) ^ int(zeros[n + 1]) for b in range(256)] for n in range(TABLED + 1)], np.uint32)
    one = np.array([[zlib.crc32(b"\0", b << (8 * k)) ^ int(zeros[1]) for b in range(256)] for k in range(4)], np.uint32)
    moves = np.empty((TABLED + 2, 4, 256), np.uint32)
    moves[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(1, TABLED + 2):
        c = moves[n - 1]
        moves[n] = one[0][c & 255] ^ one[1][(c >> 8) & 255] ^ one[2][(c >> 16) & 255] ^ one[3][c >> 24]
    return zeros, adds, moves


_ZEROS, _ADDS, _MOVES = _checksum_tables()
_SPACE = ord(" ")


def _word_checksums(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of each word, of each word after a space, and which words are too long for the tables."""
    length = s.ends - s.starts
    long = length > TABLED
    at = np.flatnonzero(~s.space)
    word = np.repeat(np.arange(len(length)), length)
    back = np.minimum(s.ends[word] - 1 - at, TABLED)
    crc = np.bitwise_xor.reduceat(_ADDS[back, s.data[at]], np.searchsorted(at, s.starts))
    tabled = np.minimum(length, TABLED)
    spaced = crc ^ _ADDS[tabled, _SPACE] ^ _ZEROS[tabled + 1]
    crc = crc ^ _ZEROS[tabled]
    for i in np.flatnonzero(long):
        raw = s.data[s.starts[i] : s.ends[i]].tobytes()
        crc[i], spaced[i] = zlib.crc32(raw), zlib.crc32(b" " + raw)
    return crc, spaced, long


def feature_buckets(s: Slice, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and text of every feature: first of the words, then of the runs of two, then of three."""
    n = len(s.starts)
    if not n:
        return
    crc, spaced, long = _word_checksums(s)
    size = np.minimum(s.ends - s.starts, TABLED) + 1
    run = crc
    yield (run % np.uint32(buckets)).astype(np.int64), s.doc
    for k in range(1, LONGEST_RUN):
        if n <= k:
            return
        # The run that begins at each word, followed by a space and the k-th word after it.
        head, by = run[: n - k], size[k:]
        run = _MOVES[by, 0, head & 255] ^ _MOVES[by, 1, (head >> 8) & 255] ^ _MOVES[by, 2, (head >> 16) & 255] ^ _MOVES[by, 3, head >> 24] ^ spaced[k:]
        for i in np.flatnonzero(long[k:]):
            run[i] = zlib.crc32(b" " + s.data[s.starts[i + k] : s.ends[i + k]].tobytes(), int(head[i]))
        whole = s.doc[k:] == s.doc[: n - k]
        yield (run[whole] % np.uint32(buckets)).astype(np.int64), s.doc[k:][whole]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all of ``texts(text)``; each partition hands on one sum a bucket, and only these sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, s in slices(batch.column(0), True, PLAIN_BREAKS):
                for bucket, _ in feature_buckets(s, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    counted = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(buckets, np.int64)
    for row in counted.collect():
        found[row["bucket"]] = row["n"]
    return found


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket: a thousand times the log of the ratio of add-one smoothed shares, rounded down."""
    some, most = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log(((t + 1.0) * some) / ((s + 1.0) * most))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _ordered_bits(key: Column, low: int, high: int, down: bool) -> tuple[Column, int]:
    """A key as an unsigned number that grows in sort order, and its bits."""
    if high - low < 1 << 63:
        return (F.lit(high) - key if down else key - F.lit(low)), (high - low).bit_length()
    turned = key.bitwiseXOR(F.lit(-(1 << 63)))
    return (F.bitwise_not(turned) if down else turned), 64


def radix_ranks(rows: DataFrame, keys: Sequence[tuple[str, bool]], rank: str = "rank", bits: int = DIGIT_BITS, block: int = BLOCK) -> DataFrame:
    """``rows`` with their place (from 1) in the order of ``keys``, pairs of a whole-number column and whether it falls; nulls come last.

    LSD radix sort: the keys' digits, from the last key's lowest up, are sorted by stable counting passes. A pass counts each digit in
    each block of ``block`` rows; sums over digits and blocks in that order give where each block's share of a digit begins; a row's
    place is that plus its turn in its block. Digits that all rows share are passed over. Rows move once a pass, and no task needs more
    than a block's rows of a digit, so that a key shared by all rows is as good as any. Rows equal in all keys get different places. Without
    rows there are none to rank.
    """
    state = store(rows.withColumn("__place", F.monotonically_increasing_id()), "radix-rows")
    ends = state.agg(*[f(F.col(f"`{k}`").cast("long")).alias(f"{name}{i}") for i, (k, _) in enumerate(keys) for name, f in (("lo", F.min), ("hi", F.max))], *[F.count_if(F.col(f"`{k}`").isNull()).alias(f"no{i}") for i, (k, _) in enumerate(keys)], F.count(F.lit(1)).alias("n")).first()
    passes: list[Column] = []
    for i, (k, down) in reversed(list(enumerate(keys))):
        key = F.col(f"`{k}`").cast("long")
        if ends[f"lo{i}"] is not None:
            number, width = _ordered_bits(key, ends[f"lo{i}"], ends[f"hi{i}"], down)
            passes += [F.coalesce(F.shiftrightunsigned(number, at).bitwiseAND(F.lit((1 << min(bits, width - at)) - 1)), F.lit(0)) for at in range(0, width, bits)]
            if ends[f"no{i}"]:
                passes.append(key.isNull().cast("long"))
    sorted_once = False
    for digit in passes:
        counts = _digit_counts(state, digit, block)
        totals = {r["__digit"]: r["__n"] for r in counts.groupBy("__digit").agg(F.sum("__n").alias("__n")).collect()}
        if len(totals) > 1:
            state, sorted_once = _counting_pass(state, digit, counts, totals, block), True
    if not sorted_once:
        # One pass over a digit that all share makes the places dense.
        counts = _digit_counts(state, F.lit(0), block)
        state = _counting_pass(state, F.lit(0), counts, {0: ends["n"]}, block)
    return state.withColumn(rank, F.col("__place") + 1).drop("__place")


def _marked(state: DataFrame, digit: Column, block: int) -> DataFrame:
    return state.withColumns({"__digit": digit.cast("int"), "__block": F.floor(F.col("__place") / block)})


def _digit_counts(state: DataFrame, digit: Column, block: int) -> DataFrame:
    return store(_marked(state, digit, block).groupBy("__block", "__digit").agg(F.count(F.lit(1)).alias("__n")), "radix-counts")


def _counting_pass(state: DataFrame, digit: Column, counts: DataFrame, totals: dict[int, int], block: int) -> DataFrame:
    """Rows at the places where a stable sort by the digit puts them; the tables of the pass before are deleted."""
    spark, before, base = state.sparkSession, 0, {}
    for d in sorted(totals):
        base[d], before = before, before + totals[d]
    start = spark.createDataFrame(list(base.items()), "__digit int, __base long")
    earlier = F.coalesce(F.sum("__n").over(Window.partitionBy("__digit").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("__earlier", earlier).join(F.broadcast(start), "__digit").select("__block", "__digit", (F.col("__base") + F.col("__earlier")).alias("__from"))
    # The only move of the rows: dealt by block and digit, to be numbered and to meet their offset.
    turn = F.row_number().over(Window.partitionBy("__block", "__digit").orderBy("__place")) - 1
    numbered = _marked(state, digit, block).withColumn("__turn", turn)
    moved = numbered.join(offsets, ["__block", "__digit"]).withColumn("__place", F.col("__from") + F.col("__turn"))
    done = store(moved.drop("__block", "__digit", "__from", "__turn"), "radix-rows")
    remove_stored(spark, state)
    remove_stored(spark, counts)
    return done


def importance_weights(documents: DataFrame, gains: np.ndarray, columns: list[str]) -> DataFrame:
    """``columns`` of each row, with ``n_words, n_features, weight``."""

    def score(_: pa.RecordBatch, s: Slice) -> dict:
        n, weight = np.zeros(s.n, np.int64), np.zeros(s.n, np.int64)
        for bucket, doc in feature_buckets(s, len(gains)):
            begins = np.flatnonzero(np.diff(doc, prepend=-1))
            if len(begins):
                n += np.bincount(doc, minlength=s.n)
                weight[doc[begins]] += np.add.reduceat(gains[bucket], begins)
        return {"n_words": s.per_doc(), "n_features": n, "weight": weight}

    return map_slices(documents, columns, "text", score, "n_words long, n_features long, weight long", True, PLAIN_BREAKS)


def resample_towards(documents: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of ``documents(doc_id, text)``; rank is null unless the row is drawn.

    Drawn are the ``percent`` per cent (rounded down) of the rows with ``least_words`` or more that score highest. A null or empty text
    has no features and weight 0; texts of any length are read whole. Ties go to the smaller doc_id, rows that share an id too to fewer
    features; rows alike in all of these get places next to each other. A null doc_id is written as ``null`` in the hash and comes last among ties.
    Repeated rows are rows of their own. An empty table gives no rows; with an empty target all buckets are judged against an even share. Extra columns are ignored. All
    chance comes from the id's hash: reruns agree.
    """
    gains = bucket_gains(bucket_counts(documents, buckets), bucket_counts(target, buckets))
    chance = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((chance + 0.5) / 4294967296.0)))
    scored = importance_weights(documents, gains, ["doc_id"]).withColumn("score", F.col("weight") + gumbel.cast("long"))
    scored = store(scored, "resample-scores")
    able = F.col("n_words") >= least_words
    enough = scored.where(able)
    drawn = enough.count() * percent // 100
    # Rows of one id and score have one weight; only where ids repeat can they differ in features.
    repeated = not enough.groupBy("doc_id").count().where("count > 1").isEmpty()
    plain = scored.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    # Ids that are no whole numbers are ordered by a hash of their text.
    keyed = enough if plain else enough.withColumn("__id", F.xxhash64(F.col("doc_id").cast("string")))
    ranked = radix_ranks(keyed, [("score", True), ("doc_id" if plain else "__id", False), *([("n_features", False)] if repeated else [])])
    columns = ["doc_id", "n_features", "weight", "score"]
    placed = ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return placed.unionByName(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
