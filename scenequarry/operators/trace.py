"""Trace spans and model-call cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenequarry.functions.labels import COST_KEYS, IN_KEYS, OUT_KEYS, attribute, first_numbers, span_family
from scenequarry.operators.camera import small

TERMINAL_TOP, TERMINAL_STAGE = ("ready", "failed"), ("complete", "failed")


def columns_to_rows(documents: DataFrame, schema: str, column: str = "body") -> DataFrame:
    """Rows of column-major JSON ``{columns: [{name, values}]}``; ``schema`` names and types the columns wanted. Missing columns are null."""
    got = F.from_json(column, "struct<columns:array<struct<name:string,values:array<string>>>>")["columns"]
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    named = documents.withColumn("__m", F.transform(got, lambda c: F.struct(c["name"], c["values"])))
    values = {n: F.try_element_at(F.map_from_entries("__m"), F.lit(n)) for n, _ in fields}
    zipped = named.withColumns({f"__v_{n}": v for n, v in values.items()}).select(*[c for c in documents.columns if c != column], F.inline(F.arrays_zip(*[F.col(f"__v_{n}").alias(n) for n, _ in fields])))
    return zipped.withColumns({n: F.col(n).try_cast(t) for n, t in fields})


def spans_of_scene(spans: DataFrame, scene_id: str | Column) -> DataFrame:
    """All spans of every trace that has a span of the scene, by start."""
    touching = spans.where(attribute(F.col("attributes"), "scene_id") == scene_id).select("trace_id").distinct()
    return spans.join(touching, "trace_id", "left_semi").orderBy("start_timestamp", "span_id")


def scene_spans(spans: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``(scene_id, span…)`` for all scenes at once: a span counts for every scene that its trace touches.

    ``rows`` are the spans to hand on (all by default): what is read from their attributes is read before they multiply.
    """
    touching = spans.select(attribute(F.col("attributes"), "scene_id").alias("scene_id"), "trace_id").where(F.col("scene_id").isNotNull()).distinct()
    return touching.join(spans if rows is None else rows, "trace_id")


def span_usage(spans: DataFrame) -> DataFrame:
    """Spans with usd, tokens_in and tokens_out from their attributes, without those that have none."""
    used = spans.withColumns(first_numbers(F.col("attributes"), {"usd": COST_KEYS, "tokens_in": IN_KEYS, "tokens_out": OUT_KEYS}))
    return used.where("usd != 0 OR tokens_in != 0 OR tokens_out != 0")


def cost_by_span(usage: DataFrame) -> DataFrame:
    """Calls, cost (6 places) and tokens by scene and span name, and by scene (span_name null, is_total)."""
    sums = [F.count(F.lit(1)).alias("call_count"), F.round(F.sum("usd"), 6).alias("usd"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")]
    grouped = usage.groupingSets([["scene_id", "span_name"], ["scene_id"]], "scene_id", "span_name").agg(*sums, (F.grouping("span_name") == 1).alias("is_total"))
    return grouped.select("scene_id", "span_name", "is_total", "call_count", "usd", "tokens_in", "tokens_out")


def fold_chat_usage(by_span: DataFrame, chat: DataFrame, name: str = "agent.chat") -> DataFrame:
    """Cost rows with the chat's ``(scene_id, call_count, usd, tokens_in, tokens_out)`` as one more span, totals included."""
    parts = by_span.where(~F.col("is_total")).drop("is_total").unionByName(chat.select("scene_id", F.lit(name).alias("span_name"), "call_count", "usd", "tokens_in", "tokens_out"))
    sums = [F.sum("call_count").alias("call_count"), F.round(F.sum("usd"), 6).alias("usd"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")]
    return parts.groupingSets([["scene_id", "span_name"], ["scene_id"]], "scene_id", "span_name").agg(*sums, (F.grouping("span_name") == 1).alias("is_total"))


def price_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """``calls(call_id, model, tokens_in, tokens_out, usd)`` with price and cost.

    The price is the first of ``prices(ordinal, prefix, input_per_m, output_per_m)`` whose prefix the model begins
    with, or that of the least ordinal. A cost that is given stays.
    """
    default = prices.orderBy("ordinal").limit(1).select(F.struct("input_per_m", "output_per_m").alias("__default"))
    models = calls.select("model").distinct()
    best = models.join(small(prices), F.startswith(F.col("model"), F.col("prefix"))).groupBy("model").agg(F.min_by(F.struct("input_per_m", "output_per_m"), "ordinal").alias("__p"))
    priced = calls.join(best, "model", "left").join(F.broadcast(default)).withColumn("__p", F.coalesce("__p", "__default")).drop("__default")
    cost = F.col("tokens_in") / 1e6 * F.col("__p.input_per_m") + F.col("tokens_out") / 1e6 * F.col("__p.output_per_m")
    return priced.withColumn("cost", F.coalesce("usd", cost)).select(*calls.columns, "__p.*", "cost")


def calls_by_scene(priced: DataFrame) -> DataFrame:
    return priced.groupBy("scene_id").agg(F.count(F.lit(1)).alias("call_count"), F.sum("cost").alias("total_usd"), F.sum("tokens_in").alias("total_tokens_in"), F.sum("tokens_out").alias("total_tokens_out"))


def live_else_snapshot(live: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Live rows, and the snapshot's for scenes without live rows."""
    rest = snapshot.join(live.select("scene_id").distinct(), "scene_id", "left_anti")
    return live.withColumn("source", F.lit("live")).unionByName(rest.withColumn("source", F.lit("snapshot")))


def waterfall(spans: DataFrame, key: str = "trace_id", least: float = 0.3) -> DataFrame:
    """Left edge and width of each span, per cent of its trace's time; family by name."""
    w = Window.partitionBy(key)
    start, end = F.unix_micros("start_timestamp"), F.unix_micros(F.coalesce("end_timestamp", "start_timestamp"))
    timed = spans.withColumn("__s", start).withColumn("__e", end).withColumn("__lo", F.min("__s").over(w)).withColumn("__len", F.greatest(F.max("__e").over(w) - F.col("__lo"), F.lit(1)))
    return timed.select(*spans.columns, ((F.col("__s") - F.col("__lo")) / F.col("__len") * 100).alias("left_pct"), F.greatest(F.lit(least), (F.col("__e") - F.col("__s")) / F.col("__len") * 100).alias("width_pct"), span_family(F.col("span_name")).alias("family"))


def span_evidence(spans: DataFrame) -> DataFrame:
    """Proposals, labels and annotations that span attributes carry, a row each: kind, label, confidence, duplicate, rejected."""
    a = F.col("attributes")
    proposals = F.from_json(attribute(a, "proposals"), "array<struct<phrase:string,confidence:double>>")
    labels = F.from_json(attribute(a, "labels"), "map<string,struct<label:string,confidence:double,alternatives:array<string>>>")
    annotations = F.from_json(attribute(a, "annotations"), "array<struct<id:string,label:string,confidence:double>>")
    kind = "array<struct<kind:string,id:string,label:string,confidence:double,duplicate:boolean,rejected:boolean>>"
    item = lambda k, i, lab, c, d, r: F.struct(F.lit(k).alias("kind"), i.alias("id"), lab.alias("label"), c.alias("confidence"), d.alias("duplicate"), r.alias("rejected"))
    no = F.lit(False)
    every = F.concat(
        F.coalesce(F.transform(proposals, lambda p: item("proposal", F.lit(None).cast("string"), p["phrase"], p["confidence"], no, no)), F.array().cast(kind)),
        F.coalesce(F.transform(F.map_entries(labels), lambda e: item("label", e["key"], e["value"]["label"], e["value"]["confidence"], F.coalesce(F.exists(e["value"]["alternatives"], lambda x: F.startswith(x, F.lit("duplicate_of:"))), no), F.coalesce(F.lower(F.trim(e["value"]["label"])) == "none", no))), F.array().cast(kind)),
        F.coalesce(F.transform(annotations, lambda x: item("annotation", x["id"], x["label"], x["confidence"], no, no)), F.array().cast(kind)),
    )
    rows = spans.select("span_id", F.inline(every))
    return rows.withColumn("percent", F.floor(F.col("confidence") * 100 + 0.5).cast("int"))


def terminal_scenes(manifests: DataFrame) -> DataFrame:
    """Scenes that won't change: top status and segmentation both ended."""
    return manifests.where(F.col("status").isin(*TERMINAL_TOP) & F.col("segmentation").isin(*TERMINAL_STAGE))
