"""Benchmark decontamination with built-in functions only.

Benchmark texts become windows of ``WINDOW`` normalised words, and these a hash set. Each window of a document's
words is hashed (from the hashes of its words, so that a word is hashed once) and looked up; a hit is verified by comparing the whole
window, and what it covers is marked. The set is broadcast behind a count of its rows and bytes; beyond that, position and hash
of the documents' windows are shuffled, and only documents with hits meet their text again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenequarry.llm.shared import TEXT_HASH, store, with_text_hash

WINDOW = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of the benchmark that may be broadcast, and their bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 64 << 20


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else; texts of ASCII only take the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def count_words(text: Column) -> Column:
    """Words of a text in either case; null counts as none."""
    pieces = F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.array_remove(pieces, ""))).cast("long")


def normalised_words(text: Column) -> Column:
    """Words of the text, A-Z lower-cased: runs of a-z, 0-9 and whatever isn't ASCII. Null: none."""
    clean = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def _window_hash(words: str, first: Column | int, width: int) -> Column:
    """Hash of ``width`` word hashes of an array from ``first`` (from 0) on."""
    return F.xxhash64(*[F.get(words, F.lit(j) + first) for j in range(width)])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """hash, width, gram, gram_id, item_id: a row for each window and each item that has it. Items without an id are one, with a null id."""
    words = benchmark.select("item_id", normalised_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(window))
    begun = words.select("item_id", "w", width.alias("width"), F.explode(F.sequence(F.lit(1), F.size("w") - width + 1)).alias("i"))
    grams = begun.select("item_id", "width", F.slice("w", F.col("i"), F.col("width")).alias("g"))
    # Hashing passes over nulls, so that shorter windows hash as their own words only.
    hashed = grams.withColumn("h", F.transform("g", lambda x: F.xxhash64(x)))
    made = hashed.select("item_id", "width", F.array_join("g", " ").alias("gram"), _window_hash("h", 0, window).alias("hash"))
    return made.distinct().withColumn("gram_id", F.xxhash64("gram", "width"))


def window_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, keys: Sequence[str] = ("doc_id",), most_rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``keys``, begin (its first piece, from 0), width, gram_id, item_id: every occurrence of a benchmark window, for each item that has it.

    ``keys`` name a text: rows that share them have one text.
    """
    listed = store(benchmark_windows(benchmark, window), "decontamination-windows")
    items = listed.select("gram_id", "item_id")
    grams = store(listed.select("hash", "width", "gram", "gram_id").distinct(), "decontamination-set")
    widths = sorted(r["width"] for r in grams.select("width").distinct().collect())
    size = grams.limit(most_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("gram") + 64), F.lit(0))).first()
    broadcast = size[0] <= most_rows and size[1] <= most_bytes
    # Pieces may have an empty string at either end, which no window holds. The outer form keeps the optimizer
    # from filtering on the size of the array, which would split every text twice.
    pieces = F.split(ascii_lower(F.col("text")), NOT_WORD)
    split = documents.select(*keys, pieces.alias("w")).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))

    def run(k: int) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size("h") - k), lambda i: _window_hash("h", i, k))
        return F.struct(F.lit(k).alias("width"), F.when(F.size("h") >= k, hashes).alias("hashes"))

    runs = [run(k) for k in widths or [window]]
    # The text's words go along only where they are at hand for the comparison.
    carried = [*keys, "w"] if broadcast else [*keys]
    each = split.select(*carried, F.explode(F.array(*runs)).alias("r")) if len(runs) > 1 else split.select(*carried, runs[0].alias("r"))
    scanned = each.select(*carried, F.col("r.width").alias("width"), F.posexplode_outer("r.hashes").alias("begin", "hash"))
    same = F.array_join(F.slice("w", F.col("begin") + 1, F.col("width")), " ") == F.col("gram")
    if broadcast:
        found = scanned.join(F.broadcast(grams), ["hash", "width"]).where(same)
    else:
        # A hash that a hot text repeats is one row of the set: the set's side is unique, and the other side is dealt by row, not by hash alone.
        likely = store(scanned.join(grams, ["hash", "width"]).select(*keys, "begin", "width", "gram", "gram_id"), "decontamination-likely")
        named = likely.select(*[F.col(k).alias(f"__{k}") for k in keys], "begin", "width", "gram", "gram_id")
        equal = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        having = named.select(*[f"__{k}" for k in keys]).distinct()
        texts = split.select(*keys, "w").join(having, equal, "left_semi").groupBy(*keys).agg(F.first("w").alias("w"))
        found = texts.join(named, equal).where(same)
    found = found.select(*keys, "begin", "width", "gram_id")
    return found.join(items, "gram_id")


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``documents``.

    n_hit counts words inside any occurrence of a window; an item of fewer words is one window. Null
    or wordless texts have no words and no hits, and such items no windows. Each row is judged by its own text, also where ids repeat or are null.
    All items without an id are one, which has no name in the hash. Empty tables give no rows, or no hits; other columns are ignored.
    """
    keys = ["doc_id", *TEXT_HASH]
    marked = with_text_hash(documents.select("doc_id", F.col("text").cast("string").alias("text")))
    hits = store(window_hits(marked, benchmark, window, keys).distinct(), "decontamination-hits")
    # Words covered: each window adds what lies beyond all windows that begin before it.
    before = Window.partitionBy(*keys).orderBy("begin", "width").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("begin") + F.col("width")).over(before), F.lit(0))
    end = F.col("begin") + F.col("width")
    places = hits.select(*keys, "begin", "width").distinct()
    covered = places.withColumn("__new", F.greatest(F.lit(0), end - F.greatest(reach, F.col("begin")))).groupBy(*keys).agg(F.sum("__new").alias("n_hit"))
    items = F.sort_array(F.collect_set(F.col("item_id").cast("string")))
    named = hits.groupBy(*keys).agg(items.alias("__items"), F.max(F.col("item_id").isNull()).cast("int").alias("__unnamed"))
    both = lambda a, b: [F.col(a(k)).eqNullSafe(F.col(b(k))) for k in keys]
    named = named.select(*[F.col(k).alias(f"__n{k}") for k in keys], "__items", "__unnamed")
    found = covered.join(named, both(str, lambda k: f"__n{k}")).select(*[F.col(k).alias(f"__f{k}") for k in keys], "n_hit", "__items", "__unnamed")
    listed = F.coalesce("__items", F.array().cast("array<string>"))
    return (
        marked.select(*keys, count_words(F.col("text")).alias("n_words"))
        .join(found, both(str, lambda k: f"__f{k}"), "left")
        .select(
            "doc_id", "n_words", F.coalesce(F.col("n_hit"), F.lit(0)).cast("long").alias("n_hit"), (F.size(listed) + F.coalesce("__unnamed", F.lit(0))).cast("long").alias("n_items"),
            F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce(F.col("n_hit"), F.lit(0)) > 0).alias("contaminated"),
        )
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``documents`` without a benchmark window, all columns as they are.

    Each row is judged on its own, also where ids repeat or are null; items count whatever their id. Null texts stay; an empty table gives no rows.
    """
    keys = ["doc_id", *TEXT_HASH]
    marked = with_text_hash(documents)
    hit = window_hits(marked, benchmark, window, keys).select(*[F.col(c).alias(f"__hit{i}") for i, c in enumerate(keys)]).distinct()
    return marked.join(hit, [marked[c].eqNullSafe(F.col(f"__hit{i}")) for i, c in enumerate(keys)], "left_anti").drop(*TEXT_HASH)
