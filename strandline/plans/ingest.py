"""Registered queries: sources, sinks and table shapes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline.operators.clean import load_pairs
from strandline.operators.clean import slice_rows
from strandline.plans.jobs import export_variants, write_run
from strandline.plans.registry import query
from strandline.plans.stand_ins import EVENTS_SQL, LINE_KEY, frame_seq, frames, lines, near, near_sql, table
from strandline.session import shared_dir
from strandline.sources import files


def fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("a1_read_measurements", "SELECT event_id, user_id, event_type, value FROM events")
def read_measurements(spark, sf_dir):
    path = files.write(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), fresh(spark, "a1"), fmt="csv")
    schema = "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE"
    return files.read_measurements(spark, path, schema).drop("experiment")


def channel_arrays(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id"), F.lit("vec").alias("name"),
        F.transform("embedding", lambda v: F.array(v.cast("double"), -v.cast("double"))).alias("values"),
    )


CHANNELS_SQL = """
WITH e AS (SELECT vec_id, UNNEST(embedding)::DOUBLE AS v, UNNEST(range(len(embedding))) AS pos FROM embeddings)
"""


@query(
    "a2_flatten_channels",
    CHANNELS_SQL + """SELECT vec_id, 'vec/0' AS "column", pos::BIGINT AS pos, v AS value FROM e
    UNION ALL SELECT vec_id, 'vec/1', pos::BIGINT, -v FROM e""",
)
def flatten_channels(spark, sf_dir):
    return files.flatten_channels(channel_arrays(spark, sf_dir), "vec_id", "name", "values")


@query("a2_widen_channels", CHANNELS_SQL + "SELECT vec_id, pos::BIGINT AS pos, v AS c0, -v AS c1 FROM e")
def widen_channels(spark, sf_dir):
    wide = files.widen_channels(flatten_channels(spark, sf_dir), "vec_id", ["vec/0", "vec/1"])
    return wide.select("vec_id", "pos", F.col("`vec/0`").alias("c0"), F.col("`vec/1`").alias("c1"))


def detections(spark, sf_dir):
    rows = lines(spark, sf_dir, "l_returnflag")
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    point = F.when(F.col("l_tax") > 0, F.struct(q.alias("x"), p.alias("y")))
    other = F.struct((q + 1).alias("x"), F.when(F.col("l_discount") > 0, p + 1).alias("y"))
    blob = F.struct(q.cast("int").alias("x"), F.lit(1).alias("y"), p.alias("area"), F.col("l_tax").alias("diameter_px"))
    blobs = F.when(F.col("l_returnflag") == "A", F.array(blob, blob)).when(F.col("l_returnflag") == "N", F.array(blob)).otherwise(
        F.array().cast(files.BLOB)
    )
    return rows.select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", point.alias("tip"),
        F.when(F.col("l_returnflag") == "A", F.array(point, other)).otherwise(F.array(other)).alias("tool"),
        blobs.alias("droplets"),
    )


@query(
    "a3_flatten_detections",
    f"""SELECT {LINE_KEY},
      CASE WHEN l_tax > 0 THEN l_quantity END AS tip_x, CASE WHEN l_tax > 0 THEN l_extendedprice END AS tip_y,
      CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_tax > 0 THEN l_quantity END
           WHEN l_discount > 0 THEN l_quantity + 1 END AS tool_x1,
      CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_tax > 0 THEN l_extendedprice END
           WHEN l_discount > 0 THEN l_extendedprice + 1 END AS tool_y1,
      CASE WHEN l_returnflag = 'A' AND l_discount > 0 THEN l_quantity + 1 END AS tool_x2,
      CASE WHEN l_returnflag = 'A' AND l_discount > 0 THEN l_extendedprice + 1 END AS tool_y2,
      CASE WHEN l_returnflag IN ('A', 'N') THEN l_quantity::INTEGER END AS droplet_1_x,
      CASE WHEN l_returnflag IN ('A', 'N') THEN 1 END AS droplet_1_y,
      CASE WHEN l_returnflag IN ('A', 'N') THEN l_extendedprice END AS droplet_1_area,
      CASE WHEN l_returnflag IN ('A', 'N') THEN l_tax END AS droplet_1_diameter_px,
      CASE WHEN l_returnflag = 'A' THEN l_quantity::INTEGER END AS droplet_2_x,
      CASE WHEN l_returnflag = 'A' THEN 1 END AS droplet_2_y,
      CASE WHEN l_returnflag = 'A' THEN l_extendedprice END AS droplet_2_area,
      CASE WHEN l_returnflag = 'A' THEN l_tax END AS droplet_2_diameter_px
    FROM lineitem""",
)
def flatten_detections(spark, sf_dir):
    flat = files.flatten_detections(
        detections(spark, sf_dir), {"tip": ("tip_x", "tip_y")}, ("tool", ("tool_x1", "tool_y1", "tool_x2", "tool_y2"))
    )
    return files.widen_blobs(flat, "droplets", "droplet", 2)


@query(
    "a4_union_ragged",
    """SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier
    UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer""",
)
def union_ragged(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS balance")
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment AS segment")
    return files.union_ragged(s, c)


@query("a5_append_export", "SELECT * FROM supplier UNION ALL SELECT * FROM supplier")
def append_export(spark, sf_dir):
    s, path = table(spark, sf_dir, "supplier"), fresh(spark, "a5")
    files.write(s, path)
    files.write(s, path, mode="append")
    return spark.read.parquet(path)


@query("a6_write_by_experiment", "SELECT event_id, user_id, value, event_type FROM events")
def write_by_experiment(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    path = files.write_by_experiment(rows, fresh(spark, "a6"), "event_type")
    return spark.read.parquet(path)


@query(
    "a7_export_variants",
    f"""WITH r AS (SELECT l_returnflag, {LINE_KEY}, l_quantity - 10 AS a, l_discount - 0.05 AS b FROM lineitem),
    c AS (SELECT * REPLACE (GREATEST(a, 0) AS a, GREATEST(b, 0) AS b) FROM r),
    m AS (SELECT MAX(a) AS ma, MAX(b) AS mb FROM c)
    SELECT 'raw' AS variant, l_returnflag, {LINE_KEY}, a, {near_sql('b')} AS b FROM r
    UNION ALL SELECT 'clipped', l_returnflag, {LINE_KEY}, a, {near_sql('b')} FROM c
    UNION ALL SELECT 'normalized', l_returnflag, {LINE_KEY}, a / ma, {near_sql('b / mb')} FROM c, m""",
)
def variants(spark, sf_dir):
    rows = lines(spark, sf_dir, "l_returnflag").selectExpr(
        "l_returnflag", *LINE_KEY.split(", "), "l_quantity - 10 AS a", "l_discount - 0.05D AS b"
    )
    paths = export_variants(rows, ["a", "b"], fresh(spark, "a7"), "l_returnflag")
    parts = [spark.read.schema(rows.schema).parquet(p).withColumn("variant", F.lit(v)) for v, p in paths.items()]
    return files.union_all(*parts).withColumn("b", near("b"))


def _run_sql() -> str:
    from strandline.plans.splits import roles_sql

    return roles_sql(50) + """, m AS (SELECT l_suppkey, chunk_index, role FROM roles JOIN won USING (l_suppkey, t)), n AS (SELECT COUNT(*) AS rows FROM c)
    SELECT 'predictions' AS name, rows FROM n UNION ALL SELECT 'grid', 12 UNION ALL SELECT 'metrics', 6 UNION ALL SELECT 'config', 7
    UNION ALL SELECT 'manifest ' || role, COUNT(*) FROM m GROUP BY role UNION ALL SELECT 'terms without coefficient', 0"""


@query("a8_write_run", _run_sql())
def run_export(spark, sf_dir):
    """Every table of a run, read back: its rows, the chunks of each role, and whether the coefficients fit the written orders."""
    from strandline.plans.models import arx_run

    path = write_run(arx_run(spark, sf_dir), fresh(spark, "a8"))
    read = {n: spark.read.parquet(f"{path}/{n}") for n in ("predictions", "grid", "metrics", "manifest", "coefficients")}
    config = spark.read.json(f"{path}/config")
    counted = [read[n].agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n in ("predictions", "grid", "metrics")]
    counted.append(config.agg(F.lit("config").alias("name"), F.count("*").alias("rows")))
    counted.append(read["manifest"].groupBy(F.concat(F.lit("manifest "), "split_role").alias("name")).agg(F.count("*").alias("rows")))
    orders = F.sum(F.when(F.col("name") == "na", F.col("value").cast("long")).when(F.col("name") == "nb", 2 * F.col("value").cast("long")))
    missing = config.agg(orders.alias("wanted")).select("wanted", F.lit(read["coefficients"].count()).alias("there"))
    counted.append(missing.select(F.lit("terms without coefficient").alias("name"), (F.col("wanted") - F.col("there")).alias("rows")))
    return files.union_all(*counted)


@query(
    "a9_discover_frames",
    """SELECT concat('c_nationkey_', c_nationkey) AS source_name, CASE WHEN c_custkey % 2 = 0 THEN 'backlit' ELSE 'laserlit' END AS mode, 1::BIGINT AS images
    FROM customer GROUP BY ALL""",
)
def discover_frames(spark, sf_dir):
    """A tree of folders written from the table, with other files beside the images, scanned for its sources."""
    root = fresh(spark, "a9")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    for folder, rest in (("Backlit", 0), ("other", 1)):
        rows = customer.filter(F.col("c_custkey") % 2 == rest).repartition("c_nationkey")  # one file a folder
        for extension in ("jpg", "txt"):
            rows.write.partitionBy("c_nationkey").option("extension", extension).mode("append").csv(f"{root}/{folder}")
    return files.discover_frames(spark, root).groupBy("source_name", "mode").agg(F.count("*").alias("images"))


PATH_SQL = """concat('/data/', CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Backlit' ELSE 'other' END, '/',
 replace(c_name, '#', ' no '), '/frame_', c_custkey, '.jpg')"""


@query(
    "a9_tag_sources",
    f"""WITH p AS (SELECT c_custkey, c_name, c_mktsegment, {PATH_SQL} AS path FROM customer)
    SELECT path, string_split(path, '/')[-1] AS image_name,
      array_to_string(string_split(path, '/')[:-2], '/') AS source_folder,
      regexp_replace(string_split(path, '/')[-2], '[^A-Za-z0-9_-]', '_', 'g') AS source_name,
      CASE WHEN c_mktsegment = 'MACHINERY' THEN 'backlit' ELSE 'laserlit' END AS mode FROM p""",
)
def tag_sources(spark, sf_dir):
    return files.tag_sources(table(spark, sf_dir, "customer").selectExpr(f"{PATH_SQL} AS path"), "path")


@query(
    "a10_frame_range",
    f"""WITH {EVENTS_SQL} SELECT user_id, frame_number FROM (
      SELECT user_id, event_id AS frame_number, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS pos
      FROM ev WHERE event_type = 'view') WHERE pos >= 2 AND pos < 10""",
)
def frame_range(spark, sf_dir):
    return slice_rows(frames(spark, sf_dir), frame_seq(spark, sf_dir), 2, 10).select("user_id", "frame_number")


@query("a11_count_lines", "SELECT COUNT(*) AS n_lines FROM orders")
def count_lines(spark, sf_dir):
    path = fresh(spark, "a11")
    table(spark, sf_dir, "orders").selectExpr("concat(o_orderkey, ';', o_orderpriority) AS value").write.text(path)
    return files.count_lines(spark, path).agg(F.sum("n_lines").alias("n_lines"))


MIXED_SQL = "CASE WHEN l_returnflag = 'A' THEN 'n/a' WHEN l_returnflag = 'N' AND l_tax = 0 THEN 'nan' ELSE CAST(l_quantity AS {text}) END"


@query(
    "a12_load_pairs",
    f"""WITH m AS (SELECT TRY_CAST({MIXED_SQL.format(text='VARCHAR')} AS DOUBLE) AS y_true, l_discount AS y_pred FROM lineitem)
    SELECT y_true, y_pred FROM m WHERE isfinite(y_true)""",
)
def pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(f"{MIXED_SQL.format(text='STRING')} AS truth", "l_discount AS guess")
    return load_pairs(rows, "truth", "guess")


@query(
    "a13_read_tracks",
    """SELECT concat('frame_', l_orderkey, '.jpg') AS image_name, l_orderkey::INTEGER AS frame_idx, 'droplet' AS feature_type,
    l_suppkey::INTEGER AS track_id, l_quantity::INTEGER AS x, l_linenumber AS y,
    CASE WHEN l_tax > 0 THEN l_extendedprice END AS area, l_discount AS diameter_px FROM lineitem""",
)
def read_tracks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "concat('frame_', l_orderkey, '.jpg') AS image_name", "CAST(l_orderkey AS DOUBLE) AS frame_idx", "'droplet' AS feature_type",
        "CAST(l_suppkey AS DOUBLE) AS track_id", "l_quantity AS x", "CAST(l_linenumber AS DOUBLE) AS y",
        "CASE WHEN l_tax > 0 THEN l_extendedprice END AS area", "l_discount AS diameter_px",
    )
    return files.read_tracks(spark, files.write(rows, fresh(spark, "a13"), fmt="csv"))


@query("a14_read_tagged", "SELECT s_suppkey, s_acctbal, TRUE AS tagged FROM supplier")
def read_tagged(spark, sf_dir):
    path = files.write(table(spark, sf_dir, "supplier"), fresh(spark, "a14"), fmt="csv")
    schema = "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE"
    rows = files.read_tagged(spark, path, ["s_suppkey", "s_acctbal"], schema)
    return rows.select("s_suppkey", "s_acctbal", F.col("source_file").endswith(".csv").alias("tagged"))


@query(
    "a15_quarantine",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'open' WHEN o_totalprice < 50000 THEN 'cheap' ELSE 'good' END AS verdict
    FROM orders""",
)
def quarantine(spark, sf_dir):
    rules = {"open": F.col("o_orderstatus") == "P", "cheap": F.col("o_totalprice") < 50000}
    good, rejected = files.quarantine(table(spark, sf_dir, "orders"), rules)
    return good.select("o_orderkey", F.lit("good").alias("verdict")).unionByName(
        rejected.select("o_orderkey", F.col("reason").alias("verdict"))
    )
