"""URL filters as a sort-merge range join.

A host's canonical key is its labels reversed, each followed by a dot: ``com.example.``. A rule's host
covers the interval of keys that begin with its own, so intervals are nested or apart. URLs are dealt by
key ranges (the path and id end the key, so that one hot host spreads over many tasks); a rule goes to
each range that its interval meets. Each task sweeps its range in order with a stack of the rule hosts
whose interval is open, and asks them for the longest rule whose path the url's path starts with.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys looked at for each range, to place the bounds of ranges, and in all, about; any bounds give the same rows.
SAMPLE_PER_RANGE, SAMPLE_MOST = 50, 200_000
_HIGH = "\U0010ffff"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without it."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """``www.example.com`` to ``com.example.www.``; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _sweep(frames: Iterator[pd.DataFrame], default: str) -> Iterator[pd.DataFrame]:
    """Rows by (range, key, kind): rules (kind 0) open intervals, urls (kind 1) are judged."""
    stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []  # key prefix, path -> (rule, verdict), path lengths
    at = None
    for frame in frames:
        out = []
        for part, key, kind, path, ident, host, verdict in frame[["part", "key", "kind", "path", "page_id", "host", "verdict"]].itertuples(index=False, name=None):
            if part != at:
                stack, at = [], part
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                paths = stack[-1][1]
                old = paths.get(path)
                # A rule given twice blocks if either of them does.
                paths[path] = (host + path, "block" if old and old[1] == "block" else verdict)
                if len(path) not in stack[-1][2]:
                    stack[-1][2].append(len(path))
                continue
            best, size = None, -1
            for prefix, paths, lengths in stack:  # outer to inner, so of equally long rules the inner host wins
                for n in lengths:
                    rule = paths.get(path[:n]) if n <= len(path) else None
                    if rule and len(rule[0]) >= size:
                        best, size = rule, len(rule[0])
            out.append((ident, host, path, best[0] if best else None, best[1] if best else default))
        yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"])


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule (host and path of the longest rule that fits, else null), verdict.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains if the url's path starts with
    its path. The longest rule wins, and of equally long ones that of the longer host. Null or
    malformed urls have an empty host and path, fit no rule and get ``default``. Rules with a null or empty host are
    ignored. Repeated rows are judged each; an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col("url").cast("string")
    parsed = pages.select(F.col("page_id").cast("long"), url_host(url).alias("host"), url_path(url).alias("path")).withColumn("hkey", host_key(F.col("host")))
    order = F.concat("hkey", F.lit("\x01"), "path", F.lit("\x01"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    keyed = parsed.select("page_id", "host", "path", F.col("hkey").alias("key"), order.alias("__order"))
    # A bounded look at the keys: one of so many hashes picks rows, so each task sends its share only.
    one_of = max(1, pages.count() // min(n * SAMPLE_PER_RANGE, SAMPLE_MOST))
    looked = keyed.where(F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(one_of)) == 0).select("__order")
    sample = sorted(r[0] for r in looked.limit(2 * SAMPLE_MOST).collect())
    bounds = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []
    place = F.pandas_udf(lambda s: pd.Series([bisect_right(bounds, x) for x in s]), "int")
    urls = keyed.withColumn("part", place("__order")).select("part", "key", F.lit(1).alias("kind"), "path", "page_id", "host", F.lit(None).cast("string").alias("verdict"))
    named = rules.where(F.col("host").isNotNull() & (F.col("host") != "")).select(
        F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    opened = named.withColumn("key", host_key(F.col("host")))
    met = opened.withColumn("part", F.explode(F.sequence(place("key"), place(F.concat("key", F.lit(_HIGH))))))
    events = urls.unionByName(met.select("part", "key", F.lit(0).alias("kind"), "path", F.lit(None).cast("long").alias("page_id"), "host", "verdict"))
    dealt = events.repartition(n, "part").sortWithinPartitions("part", "key", "kind", "path", "page_id")
    return dealt.mapInPandas(lambda it: _sweep(it, default), "page_id long, host string, path string, rule string, verdict string")
