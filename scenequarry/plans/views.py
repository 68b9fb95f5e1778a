"""Logical inputs derived from the driver's tables, in SQL that Spark and DuckDB both read.

``{table}`` stands for a given table, ``[view]`` for another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from scenequarry.operators.stored import unbroadcast

VIEWS = {
    # A cloud of three scenes; ordinals keep the order of four columns that are unique together.
    "points": """
        SELECT l_returnflag AS scene_id, (l_orderkey * 10 + l_linenumber) * 10000000000 + l_partkey * 100000 + l_suppkey AS point_idx,
          l_quantity / 10 AS x, l_discount * 20 AS y, l_extendedprice / 20000 AS z, l_tax AS conf, l_discount * 40 - 1 AS opacity FROM {lineitem}""",
    # The same in scenes of about a thousand points, as many more as the table grows.
    "points_k": """
        SELECT 's' || CAST(CAST(floor(l_orderkey / 250) AS BIGINT) AS STRING) AS scene_id, (l_orderkey * 10 + l_linenumber) * 10000000000 + l_partkey * 100000 + l_suppkey AS id,
          l_quantity / 10 AS x, l_discount * 20 AS y, l_extendedprice / 20000 AS z FROM {lineitem}""",
    "cameras": """
        SELECT s.scene_id, CAST(n_nationkey AS BIGINT) AS frame_ord, 'f' || lpad(CAST(n_nationkey AS STRING), 4, '0') || '.jpg' AS frame_name,
          1.0D AS e00, 0.0D AS e01, 0.0D AS e02, -2.5D + n_nationkey * 0.1D AS e03, 0.0D AS e10, 1.0D AS e11, 0.0D AS e12, -1.0D AS e13, 0.0D AS e20, 0.0D AS e21, 1.0D AS e22, 0.5D + (n_nationkey % 4) * 0.25D AS e23,
          100.0D AS fx, 100.0D AS fy, 50.0D AS cx, 50.0D AS cy, 100 AS width, 100 AS height
        FROM {nation} CROSS JOIN (SELECT 'A' AS scene_id UNION ALL SELECT 'N' UNION ALL SELECT 'R') s""",
    "masks": """
        SELECT CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS scene_id, s_suppkey AS mask_ord, CAST(s_nationkey AS BIGINT) AS frame_ord,
          'f' || lpad(CAST(s_nationkey AS STRING), 4, '0') || '.jpg' AS frame_name, CAST((s_suppkey * 7) % 60 AS INT) AS "left", CAST((s_suppkey * 11) % 60 AS INT) AS "top",
          CAST(20 + s_suppkey % 20 AS INT) AS wide, CAST(20 + s_suppkey % 15 AS INT) AS high, CAST((20 + s_suppkey % 20) * (20 + s_suppkey % 15) AS BIGINT) AS area,
          (s_suppkey % 97) / 97.0D AS confidence, CASE s_suppkey % 2 WHEN 0 THEN 'sam' ELSE 'vlm' END AS source, s_name AS phrase FROM {supplier}""",
    "pixels": """
        SELECT 'p' || CAST(CAST(floor(o_orderkey / 5760) AS BIGINT) AS STRING) AS scene_id, CAST(floor(o_orderkey / 576) AS BIGINT) % 10 AS frame_ord,
          CAST(o_orderkey % 24 AS INT) AS u, CAST(floor((o_orderkey % 576) / 24) AS INT) AS v,
          CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE 2 + (o_orderkey % 24) * 0.02D + floor((o_orderkey % 576) / 24) * 0.01D + CASE WHEN o_orderkey % 89 = 0 THEN 3 ELSE 0 END END AS depth,
          (o_custkey % 100) / 100.0D AS conf, (o_custkey % 7) / 7.0D AS r, (o_custkey % 11) / 11.0D AS g, (o_custkey % 13) / 13.0D AS b FROM {orders}""",
    "pixel_cameras": """
        SELECT DISTINCT 'p' || CAST(CAST(floor(o_orderkey / 5760) AS BIGINT) AS STRING) AS scene_id, CAST(floor(o_orderkey / 576) AS BIGINT) % 10 AS frame_ord,
          'f' || CAST(CAST(floor(o_orderkey / 576) AS BIGINT) % 10 AS STRING) AS frame_name,
          0.0D AS e00, 1.0D AS e01, 0.0D AS e02, 0.25D AS e03, -1.0D AS e10, 0.0D AS e11, 0.0D AS e12, -0.5D AS e13, 0.0D AS e20, 0.0D AS e21, 1.0D AS e22, CAST(floor(o_orderkey / 576) AS BIGINT) % 10 * 0.5D AS e23,
          20.0D AS fx, 22.0D AS fy, 12.0D AS cx, 12.0D AS cy, 24 AS width, 24 AS height FROM {orders}""",
    "frames": """
        SELECT o_orderpriority || '/' || o_orderstatus AS scene_id, o_orderkey AS frame_ord, o_totalprice AS sharpness, CAST(o_orderdate AS TIMESTAMP) AS ts FROM {orders}""",
    "annotations": """
        SELECT CAST(CAST(floor(p_partkey / 200) AS BIGINT) AS STRING) AS scene_id, p_partkey % 200 AS ordinal, 'obj_' || CAST(p_partkey AS STRING) AS id, p_name AS label,
          (p_partkey * 37 % 100) / 20.0D AS x, (p_partkey * 53 % 60) / 20.0D AS y, (p_partkey * 71 % 100) / 20.0D AS z,
          (p_partkey * 37 % 100) / 20.0D - p_size / 100.0D AS lo_x, (p_partkey * 53 % 60) / 20.0D - p_size / 100.0D AS lo_y, (p_partkey * 71 % 100) / 20.0D - p_size / 100.0D AS lo_z,
          (p_partkey * 37 % 100) / 20.0D + p_size / 100.0D AS hi_x, (p_partkey * 53 % 60) / 20.0D + p_size / 100.0D AS hi_y, (p_partkey * 71 % 100) / 20.0D + p_size / 100.0D AS hi_z,
          (p_partkey * 29 % 100) / 100.0D AS confidence, p_brand AS brand, p_type AS type, CAST(p_size AS BIGINT) AS size FROM {part}""",
    # Questions: a customer asks one scene for an id, a label, a part of one, or for nothing there is.
    "requests": """
        SELECT c_custkey AS request_id, CAST(c_custkey % 7 AS STRING) AS scene_id,
          CASE c_custkey % 5 WHEN 0 THEN 'OBJ_' || CAST(c_custkey % 7 * 200 + c_custkey % 200 AS STRING) WHEN 1 THEN ' Red widget ' WHEN 2 THEN 'gizmo' WHEN 3 THEN 'unicorn' ELSE ' ' END AS needle,
          CASE c_custkey % 3 WHEN 0 THEN 'bolt' WHEN 1 THEN 'ring' ELSE 'blue gear' END AS needle_b FROM {customer}""",
    "spans": """
        SELECT CAST(floor(event_id / 100) AS BIGINT) AS trace_id, event_id AS span_id,
          CASE WHEN event_id % 100 = 0 THEN NULL WHEN event_id % 100 = 5 THEN -1 ELSE CAST(floor(event_id / 100) AS BIGINT) * 100 + CAST(floor(event_id % 100 / 4) AS BIGINT) END AS parent_span_id,
          CASE event_type WHEN 'view' THEN 'inference.poses' WHEN 'click' THEN 'segmentation.vlm_label' WHEN 'purchase' THEN 'segmentation.lift' WHEN 'signup' THEN 'capture.extract' ELSE 'modal.run' END AS span_name,
          CAST(ts AS TIMESTAMP) AS start_timestamp, CAST(event_id % 50 AS DOUBLE) * 20 AS duration_ms, value, user_id,
          CASE WHEN event_id % 10 = 0 THEN 's' || CAST(user_id % 20 AS STRING) END AS scene_attr, CASE WHEN event_id % 3 = 0 THEN value / 10000 END AS usd_attr, CASE WHEN event_id % 4 = 1 THEN 'n/a' WHEN event_id % 4 = 2 THEN CAST(user_id * 3 AS STRING) END AS in_attr FROM {events}""",
    "stage_events": """
        SELECT CAST(user_id AS STRING) AS scene_id, event_id AS seq, CAST(ts AS TIMESTAMP) AS ts, CASE event_id % 4 WHEN 0 THEN 'capture' WHEN 1 THEN 'poses' WHEN 2 THEN 'splat' ELSE 'segmentation' END AS stage,
          CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'complete' END AS status, CASE event_type WHEN 'error' THEN 'code ' || CAST(event_id % 9 AS STRING) END AS message, CAST(event_id % 1000 AS DOUBLE) / 8 AS duration_s FROM {events}""",
    "model_calls": """
        SELECT conv_id * 100 + turn AS call_id, 'c' || CAST(conv_id AS STRING) AS scene_id, CASE turn % 4 WHEN 0 THEN 'small-2-2025' WHEN 1 THEN 'medium-1' WHEN 2 THEN 'large-3x' ELSE 'other' END AS model,
          CAST(length(text) AS BIGINT) AS tokens_in, CAST(length(text) * 2 % 999 AS BIGINT) AS tokens_out, CASE WHEN conv_id % 9 = 0 THEN 0.5D END AS usd FROM {conversations}""",
    "uploads": """
        SELECT doc_id AS upload_id, 'scene-' || CAST(doc_id AS STRING) AS scene_id, text FROM {documents}""",
}


#: Views whose rows multiply in the operators (points by cameras, neighbours or boxes) or are dear to read (attributes of spans).
SPREAD = frozenset({"points", "points_k", "pixels", "spans"})
#: Rows of such a view that a task takes, at most.
TASK_ROWS = 250_000


def view(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """A view as a DataFrame. One that is only counted or dealt by a key is not ``spread``: that would shuffle all of it once more, in every pass."""
    sql = re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", VIEWS[name]).replace('"left"', "`left`").replace('"top"', "`top`")
    df = spark.sql(sql)
    cores = spark.sparkContext.defaultParallelism
    # The table that the view has most rows of stands first. Rows are counted from its footers.
    rows = spark.read.parquet(f"{sf_dir}/{re.search(r'\{(\w+)\}', VIEWS[name])[1]}.parquet").count()
    # A table of fewer files than cores may be one row group, which would be one task's work; a task's share does not grow with the table.
    dealt = df.repartition(max(cores, -(-rows // TASK_ROWS))) if spread and name in SPREAD and len(df.inputFiles()) < cores else df
    return unbroadcast(dealt, rows)


def stream_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over one table, as a stream of that table's files."""
    table = re.search(r"\{(\w+)\}", VIEWS[name])[1]
    path = f"{sf_dir}/{table}.parquet"
    given = spark.read.parquet(path)
    source = f"stream_of_{table}"
    reader = spark.readStream.schema(given.schema)
    # A table is a file, which a stream finds by its name in the folder, or a folder of parts.
    one = all(f.endswith(f"/{table}.parquet") for f in given.inputFiles())
    (reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir) if one else reader.parquet(path)).createOrReplaceTempView(source)
    return spark.sql(VIEWS[name].replace(f"{{{table}}}", source))


def with_views(sql: str) -> str:
    """DuckDB text: ``sql`` with the views that it names in front."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    body = {n: re.sub(r"\{(\w+)\}", r"\1", VIEWS[n]) for n in used}
    ctes = ", ".join(f"{n} AS ({re.sub(r'(\d)D\b', r'\1::DOUBLE', body[n])})" for n in used)
    sql = sql.strip()
    if not ctes:
        return sql
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql.upper().startswith(head):
            return f"{head}{ctes}, {sql[len(head):]}"
    return f"WITH {ctes} {sql}"
