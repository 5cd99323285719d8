"""Registered queries: projections, scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import names, scalars
from strandline.operators import clean, metrics
from strandline.operators.features import target_value
from strandline.operators.split import sequence_settings
from strandline.plans.ingest import MIXED_SQL, detections
from strandline.plans.registry import query
from strandline.plans.stand_ins import (
    EVENTS_SQL, LINE_KEY, W_LINE, event_seq, events, line_seq, lines, near, near_sql, table,
)

KEY = LINE_KEY.split(", ")

STEM_SQL = """concat(
 CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Detections_' WHEN c_mktsegment = 'BUILDING' THEN 'anomaly_frames_' ELSE '' END,
 CASE WHEN c_acctbal < 1000 THEN 'backlit_' WHEN c_acctbal > 5000 THEN 'LaserLit_' ELSE '' END,
 CASE WHEN c_nationkey < 12 THEN 'fr' WHEN c_nationkey < 22 THEN 'WE' ELSE '7x' END, '_', c_nationkey,
 CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'cm_' ELSE 'm_' END, c_custkey, 'mm',
 CASE WHEN c_acctbal > 2000 THEN concat('--', c_nationkey) ELSE '' END,
 CASE WHEN c_acctbal > 4000 THEN '_cam12' ELSE '' END)"""
NORM_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(stem),
 '^detections_', ''), '^anomaly_frames_', ''), '^(backlit|laserlit)_', ''), '_cam\d+$', ''), '[_\-]+', '_', 'g'), '^_+|_+$', '', 'g')"""
STEMS = f"WITH s AS (SELECT c_custkey, {STEM_SQL} AS stem FROM customer), n AS (SELECT *, {NORM_SQL} AS norm FROM s)"


def stems(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{STEM_SQL} AS stem")


@query("b1_pick_column", f"SELECT {LINE_KEY}, l_extendedprice AS current FROM lineitem")
def pick_column(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return rows.select(*KEY, F.col(clean.pick_column(rows, ["current_2", "l_extendedprice", "l_tax"])).alias("current"))


@query(
    "b2_to_double",
    f"""WITH m AS (SELECT {LINE_KEY}, TRY_CAST({MIXED_SQL.format(text='VARCHAR')} AS DOUBLE) AS v FROM lineitem)
    SELECT {LINE_KEY}, CASE WHEN NOT isnan(v) THEN v END AS v FROM m""",
)
def to_double(spark, sf_dir):
    rows = lines(spark, sf_dir, "l_returnflag").withColumn("v", F.expr(MIXED_SQL.format(text="STRING")))
    return rows.select(*KEY, scalars.to_double("v").alias("v"))


BOOL_SQL = """CASE WHEN l_returnflag = 'A' THEN ' TRUE ' WHEN l_linenumber = 1 THEN '1' WHEN l_linenumber = 2 THEN '1.0'
 WHEN l_linenumber = 3 THEN 'Yes' WHEN l_linenumber = 4 THEN 'no' END"""


@query("b3_to_bool", f"SELECT {LINE_KEY}, COALESCE(lower(trim({BOOL_SQL})) IN ('true', '1', 'yes', 'y', 't'), FALSE) AS b FROM lineitem")
def to_bool(spark, sf_dir):
    return lines(spark, sf_dir, "l_returnflag").withColumn("b", F.expr(BOOL_SQL)).select(*KEY, scalars.to_bool("b").alias("b"))


@query("b4_normalize_stem", STEMS + "SELECT c_custkey, stem, norm FROM n")
def normalize_stem(spark, sf_dir):
    return stems(spark, sf_dir).withColumn("norm", names.normalize_stem("stem"))


@query(
    "b5_parse_settings",
    STEMS + r"""SELECT c_custkey,
    TRY_CAST(NULLIF(regexp_extract(norm, '\b[^_]+_(\d+)m_(\d+)mm(?:_\d+)?\b', 1), '') AS INTEGER) AS feed,
    TRY_CAST(NULLIF(regexp_extract(norm, '\b[^_]+_(\d+)m_(\d+)mm(?:_\d+)?\b', 2), '') AS INTEGER) AS distance FROM n""",
)
def parse_settings(spark, sf_dir):
    return stems(spark, sf_dir).select(
        "c_custkey", names.feed_setting("stem").alias("feed"), names.distance_setting("stem").alias("distance")
    )


@query(
    "b6_machine_group",
    STEMS + "SELECT c_custkey, COALESCE(NULLIF(lower(regexp_extract(norm, '^([A-Za-z]+)_', 1)), ''), 'unknown') AS machine FROM n",
)
def machine_group(spark, sf_dir):
    return stems(spark, sf_dir).select("c_custkey", names.machine_group(names.normalize_stem("stem")).alias("machine"))


IMAGE_SQL = """CASE WHEN o_orderpriority = '1-URGENT' THEN concat('frame_', o_orderkey, '_x7.jpg')
 WHEN o_orderpriority = '5-LOW' THEN 'no digits' ELSE concat(o_orderpriority, '_', o_orderkey, '.png') END"""


@query(
    "b7_frame_number",
    rf"""WITH i AS (SELECT o_orderkey, {IMAGE_SQL} AS image FROM orders)
    SELECT o_orderkey, CAST(COALESCE(NULLIF(regexp_extract(image, 'frame_(\d+)', 1), ''), NULLIF(regexp_extract(image, '(\d+)', 1), ''), '0')
    AS BIGINT) AS frame_number FROM i""",
)
def frame_number(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{IMAGE_SQL} AS image").select(
        "o_orderkey", names.frame_number("image").alias("frame_number")
    )


@query(
    "b8_safe_token",
    """WITH s AS (SELECT p_partkey, concat('_', p_name, '#', p_type, '.jpg') AS name FROM part)
    SELECT p_partkey, regexp_replace(regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g'), '^_+|_+$', '', 'g') AS token,
    concat('_', p_name, '#', p_type, '_src', '.jpg') AS suffixed FROM s JOIN part USING (p_partkey)""",
)
def safe_token(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat('_', p_name, '#', p_type, '.jpg') AS name")
    return rows.select("p_partkey", names.safe_token("name").alias("token"), names.suffix_name("name", F.lit("src")).alias("suffixed"))


@query(
    "b9_natural_key",
    r"""WITH n AS (SELECT c_custkey, c_custkey * 7919 % 100003 AS scrambled FROM customer),
    f AS (SELECT c_custkey, concat('run', scrambled, '_cam', c_custkey % 3) AS name, scrambled, c_custkey % 3 AS cam FROM n)
    SELECT name, ROW_NUMBER() OVER (ORDER BY scrambled, cam, c_custkey) AS place FROM f""",
)
def natural_key(spark, sf_dir):
    from strandline.sequence import Sequence, with_position

    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "concat('run', c_custkey * 7919 % 100003, '_cam', c_custkey % 3) AS name"
    )
    keyed = rows.withColumn("natural", names.natural_key("name"))
    # Numbered through buckets of the key's first number, so no single task ranks all names.
    seq = Sequence((), ("natural", "c_custkey"), "cast(regexp_extract(name, '([0-9]+)', 1) as bigint) div 1000")
    return with_position(keyed, seq, "place").select("name", (F.col("place") + 1).alias("place"))


@query(
    "b10_rebase",
    f"WITH {EVENTS_SQL} SELECT user_id, event_id, event_id - MIN(event_id) OVER (PARTITION BY user_id) + 1 AS frame FROM ev WHERE event_type = 'view'",
)
def rebase(spark, sf_dir):
    views = events(spark, sf_dir).filter("event_type = 'view'").select("user_id", "event_id", F.col("event_id").alias("frame"))
    return clean.rebase(views, ["user_id"], "frame")


@query(
    "b11_derive_distances",
    f"""SELECT {LINE_KEY}, {near_sql('abs(l_quantity - l_linenumber)')} AS tip, {near_sql('abs((l_tax + l_discount) / 2 - l_quantity)')} AS tool,
    CASE WHEN l_returnflag = 'A' THEN {near_sql('abs(l_discount - l_quantity)')} END AS arc FROM lineitem""",
)
def derive_distances(spark, sf_dir):
    q = F.col("l_quantity")
    out = clean.derive_distances(
        lines(spark, sf_dir, "l_returnflag"),
        {"tip": (q, F.col("l_linenumber")), "tool": ((F.col("l_tax") + F.col("l_discount")) / 2, q), "arc": (F.col("l_discount"), q)},
        {"arc": F.col("l_returnflag") == "A"},
    )
    return out.select(*KEY, *[near(c).alias(c) for c in ("tip", "tool", "arc")])


@query(
    "b12_mask_where",
    f"""SELECT {LINE_KEY}, CASE WHEN l_linenumber <> 1 THEN l_quantity END AS l_quantity, CASE WHEN l_linenumber <> 1 THEN l_tax END AS l_tax
    FROM lineitem""",
)
def mask_where(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("flag", (F.col("l_linenumber") == 1).cast("int"))
    return clean.mask_where(rows, "flag", ["l_quantity", "l_tax", "absent"]).select(*KEY, "l_quantity", "l_tax")


@query("b13_scale_cols", f"SELECT {LINE_KEY}, {near_sql('l_quantity * l_discount')} AS mm FROM lineitem")
def scale_cols(spark, sf_dir):
    out = clean.scale_cols(lines(spark, sf_dir), ["l_quantity"], "l_discount", {"l_quantity": "mm"})
    return out.select(*KEY, near("mm").alias("mm"))


@query(
    "b14_clip_low",
    f"SELECT {LINE_KEY}, CASE WHEN l_tax > 0 THEN GREATEST(l_quantity - 25, 0) END AS v FROM lineitem",
)
def clip_low(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("v", F.expr("CASE WHEN l_tax > 0 THEN l_quantity - 25 END"))
    return rows.select(*KEY, scalars.clip_low("v").alias("v"))


@query(
    "b15_normalize_by_max",
    f"""WITH r AS (SELECT {LINE_KEY}, CASE WHEN l_tax > 0 THEN l_quantity - 25 END AS a, -l_tax AS b, NULL::DOUBLE AS c FROM lineitem),
    m AS (SELECT MAX(GREATEST(a, 0)) FILTER (a IS NOT NULL) AS ma FROM r)
    SELECT {LINE_KEY}, {near_sql('CASE WHEN a IS NOT NULL THEN LEAST(GREATEST(a, 0) / ma, 1) END')} AS a, 0.0::DOUBLE AS b, c FROM r, m""",
)
def normalize_by_max(spark, sf_dir):
    rows = lines(spark, sf_dir).selectExpr(*KEY, "CASE WHEN l_tax > 0 THEN l_quantity - 25 END AS a", "-l_tax AS b", "CAST(NULL AS DOUBLE) AS c")
    out = clean.normalize_by_max(rows, clean.column_maxima(rows, ["a", "b", "c"]), ["a", "b", "c"])
    return out.withColumn("a", near("a"))


@query(
    "b16_safe_div",
    f"SELECT {LINE_KEY}, {near_sql('CASE WHEN abs(l_discount) > 0.02 THEN l_quantity / l_discount ELSE 0 END')} AS q FROM lineitem",
)
def safe_div(spark, sf_dir):
    return lines(spark, sf_dir).select(*KEY, near(scalars.safe_div("l_quantity", "l_discount", 0.02)).alias("q"))


@query(
    "b17_physics_features",
    f"""WITH f AS (SELECT *, l_quantity * l_discount AS p FROM lineitem)
    SELECT {LINE_KEY}, CASE WHEN l_quantity > 5 OR l_discount > 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS active, {near_sql('p')} AS product,
    {near_sql('CASE WHEN l_discount > 1e-6 THEN l_quantity / l_discount ELSE 0 END')} AS current_to_voltage,
    {near_sql('l_discount / l_quantity')} AS voltage_to_current,
    {near_sql('CASE WHEN l_tax > 1e-6 THEN l_quantity / l_tax ELSE 0 END')} AS current_per_feed,
    {near_sql('CASE WHEN l_tax > 1e-6 THEN l_discount / l_tax ELSE 0 END')} AS voltage_per_feed,
    {near_sql('CASE WHEN l_tax > 1e-6 THEN p / l_tax ELSE 0 END')} AS product_per_feed,
    {near_sql('l_tax / l_quantity')} AS feed_to_current,
    {near_sql('abs(l_quantity - LAG(l_quantity) OVER w)')} AS current_abs_delta,
    {near_sql('abs(l_discount - LAG(l_discount) OVER w)')} AS voltage_abs_delta,
    {near_sql('abs(p - LAG(p) OVER w)')} AS product_abs_delta
    FROM f WINDOW w AS ({W_LINE})""",
)
def physics_features(spark, sf_dir):
    rows = lines(spark, sf_dir)
    out = clean.physics_features(rows, line_seq(spark, sf_dir), "l_quantity", "l_discount", "l_tax")
    made = [c for c in out.columns if c not in rows.columns]
    return out.select(*KEY, *[near(c).alias(c) for c in made])


@query(
    "b18_static_context",
    f"""SELECT {LINE_KEY}, CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END::DOUBLE AS l_returnflag_is_A,
    CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS l_returnflag_is_R FROM lineitem""",
)
def static_context(spark, sf_dir):
    return clean.static_context(lines(spark, sf_dir, "l_returnflag"), "l_returnflag", ("A", "R")).select(
        *KEY, "l_returnflag_is_A", "l_returnflag_is_R"
    )


@query(
    "b19_transform_target",
    f"""WITH r AS (SELECT {LINE_KEY}, l_quantity - 10 AS y FROM lineitem)
    SELECT {LINE_KEY}, {near_sql('ln(1 + GREATEST(y, 0))')} AS y_log, {near_sql('GREATEST(y, 0)')} AS y_back FROM r""",
)
def transform_target(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("y_log", scalars.transform_target(F.col("l_quantity") - 10, "log1p"))
    return rows.select(*KEY, near("y_log").alias("y_log"), near(scalars.inverse_transform_target("y_log", "log1p")).alias("y_back"))


@query(
    "b20_target_reconstruct",
    f"""WITH r AS (SELECT {LINE_KEY}, l_quantity - LAG(l_quantity) OVER w AS target, LAG(l_quantity) OVER w AS prev, l_discount
      FROM lineitem WINDOW w AS ({W_LINE}))
    SELECT {LINE_KEY}, target, {near_sql('LEAST(GREATEST(prev + target + l_discount, 5), 45)')} AS rebuilt FROM r WHERE target IS NOT NULL""",
)
def target_reconstruct(spark, sf_dir):
    rows = target_value(lines(spark, sf_dir), line_seq(spark, sf_dir), "l_quantity", "delta")
    made = rows.filter(F.col("target").isNotNull()).withColumn("prev", F.col("l_quantity") - F.col("target"))
    value = scalars.reconstruct(F.col("target") + F.col("l_discount"), "prev", "delta", 5.0, 45.0)
    return made.select(*KEY, "target", near(value).alias("rebuilt"))


@query(
    "b21_expand_powers",
    f"""SELECT {LINE_KEY}, {near_sql('pow(l_discount, 2)')} AS d2, {near_sql('pow(l_discount, 3)')} AS d3, {near_sql('pow(l_tax, 2)')} AS t2,
    {near_sql('pow(l_tax, 3)')} AS t3 FROM lineitem""",
)
def expand_powers(spark, sf_dir):
    out = clean.expand_powers(lines(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"], 3, 1)
    named = {"l_discount^2": "d2", "l_discount^3": "d3", "l_tax^2": "t2", "l_tax^3": "t3"}
    return out.select(*KEY, *[near(F.col(f"`{c}`")).alias(n) for c, n in named.items()])


@query(
    "b22_standardize",
    f"""WITH m AS (SELECT AVG(l_quantity) AS mq, stddev_pop(l_quantity) AS sq FROM lineitem)
    SELECT {LINE_KEY}, {near_sql('(l_quantity - mq) / sq')} AS z, 0.0::DOUBLE AS constant FROM lineitem, m""",
)
def standardize(spark, sf_dir):
    rows = lines(spark, sf_dir).select(*KEY, F.col("l_quantity").alias("z"), F.lit(3.0).alias("constant"))
    return clean.standardize(rows, ["z", "constant"]).withColumn("z", near("z"))


@query(
    "b23_minmax",
    f"""WITH m AS (SELECT MIN(l_quantity) AS lq, MAX(l_quantity) AS hq, MIN(l_tax) AS lt, MAX(l_tax) AS ht FROM lineitem)
    SELECT {LINE_KEY}, {near_sql('(l_quantity - lq) / (hq - lq)')} AS q, {near_sql('(l_tax - lt) / (ht - lt)')} AS t,
    {near_sql('(l_quantity - LEAST(lq, lt)) / (GREATEST(hq, ht) - LEAST(lq, lt))')} AS q_joint,
    {near_sql('(l_tax - LEAST(lq, lt)) / (GREATEST(hq, ht) - LEAST(lq, lt))')} AS t_joint FROM lineitem, m""",
)
def minmax(spark, sf_dir):
    rows = lines(spark, sf_dir).select(
        *KEY, F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"), F.col("l_quantity").alias("q_joint"), F.col("l_tax").alias("t_joint")
    )
    out = clean.minmax(clean.minmax(rows, ["q", "t"]), ["q_joint", "t_joint"], joint=True)
    return out.select(*KEY, *[near(c).alias(c) for c in ("q", "t", "q_joint", "t_joint")])


@query(
    "b24_elapsed",
    f"WITH {EVENTS_SQL} SELECT event_id, {near_sql('t - FIRST_VALUE(t) OVER (PARTITION BY user_id ORDER BY t, event_id)', 5)} AS elapsed FROM ev",
)
def elapsed(spark, sf_dir):
    out = clean.elapsed(events(spark, sf_dir), event_seq(spark, sf_dir), ["meas_time", "t", "event_id"])
    return out.select("event_id", near("elapsed", 5).alias("elapsed"))


@query(
    "b25_condition_label",
    f"""SELECT {LINE_KEY}, concat('wfs=', printf('%.3f', l_quantity), '|ctdw=', CASE WHEN l_tax > 0 THEN printf('%.3f', l_tax) ELSE 'missing' END)
    AS label FROM lineitem""",
)
def condition_label(spark, sf_dir):
    label = names.condition_label([("wfs", F.col("l_quantity")), ("ctdw", F.when(F.col("l_tax") > 0, F.col("l_tax")))])
    return lines(spark, sf_dir).select(*KEY, label.alias("label"))


FEATURE_SQL = """CASE WHEN l_linenumber = 1 THEN 'voltage_to_current_ratio' WHEN l_linenumber = 2 THEN 'voltage_lag_5' WHEN l_linenumber = 3
 THEN 'current_roll_5_mean' WHEN l_linenumber = 4 THEN 'wfs_setpoint' WHEN l_linenumber = 5 THEN 'ctdw' WHEN l_linenumber = 6 THEN 'power_per_wfs'
 ELSE l_returnflag END"""


# The groups under which importances of features are reported, by what their names hold.
FEATURE_GROUPS = (
    ("voltage.*current|current.*voltage", "voltage_current_interaction"), ("^voltage", "voltage"), ("^current", "current"), ("^wfs", "wfs"), ("^ctdw", "ctdw"),
    ("wfs", "wfs_interaction"),
)


@query(
    "b26_feature_group",
    f"""WITH f AS (SELECT {LINE_KEY}, {FEATURE_SQL} AS f FROM lineitem)
    SELECT {LINE_KEY}, CASE WHEN contains(f, 'voltage') AND contains(f, 'current') THEN 'voltage_current_interaction'
    WHEN starts_with(f, 'voltage') THEN 'voltage' WHEN starts_with(f, 'current') THEN 'current' WHEN starts_with(f, 'wfs') THEN 'wfs'
    WHEN starts_with(f, 'ctdw') THEN 'ctdw' WHEN contains(f, 'wfs') THEN 'wfs_interaction' ELSE 'other' END AS grp FROM f""",
)
def feature_group(spark, sf_dir):
    return lines(spark, sf_dir, "l_returnflag").select(*KEY, names.labelled(F.expr(FEATURE_SQL), FEATURE_GROUPS, "other").alias("grp"))


@query("b27_conform", f"SELECT l_quantity AS meas_time, l_linenumber::INTEGER AS frame_number, NULL::DOUBLE AS current FROM lineitem")
def conform(spark, sf_dir):
    schema = T.StructType(
        [T.StructField("meas_time", T.DoubleType()), T.StructField("frame_number", T.IntegerType()), T.StructField("current", T.DoubleType())]
    )
    rows = lines(spark, sf_dir).withColumnsRenamed({"l_quantity": "meas_time", "l_linenumber": "frame_number"})
    return clean.conform(rows, schema)


@query(
    "b28_json_safe",
    f"""SELECT {LINE_KEY}, concat('{{"q":', l_quantity, ',"bad":null}}') AS body FROM lineitem""",
)
def json_safe(spark, sf_dir):
    body = scalars.json_safe([("q", F.col("l_quantity")), ("bad", F.lit(float("nan")))])
    return lines(spark, sf_dir).select(*KEY, body.alias("body"))


@query(
    "b30_xy",
    f"""SELECT {LINE_KEY}, CASE WHEN l_tax > 0 THEN l_quantity END AS x, CASE WHEN l_tax > 0 THEN l_extendedprice END AS y FROM lineitem""",
)
def xy(spark, sf_dir):
    return detections(spark, sf_dir).select(*KEY, scalars.point_x("tip").alias("x"), scalars.point_y("tip").alias("y"))


@query(
    "b31_blob_presence",
    f"""SELECT {LINE_KEY}, l_returnflag IN ('A', 'N') AS present, CASE WHEN l_returnflag IN ('A', 'N') THEN l_tax END AS diameter FROM lineitem""",
)
def blob_presence(spark, sf_dir):
    return detections(spark, sf_dir).select(
        *KEY, scalars.blob_present("droplets").alias("present"), scalars.blob_max_diameter("droplets").alias("diameter")
    )


@query(
    "b32_classify_blobs",
    f"""WITH b AS (SELECT {LINE_KEY}, l_quantity::INTEGER AS x, (l_discount * 1000)::INTEGER AS y, floor(l_tax * 400) AS r FROM lineitem),
    k AS (SELECT *, pi() * r * r AS area,
      CASE WHEN x BETWEEN 15 AND 35 AND y BETWEEN 10 AND 80 THEN CASE WHEN pi() * r * r >= 500 THEN 'droplet' ELSE 'spatter' END
           WHEN x <= 10 OR x >= 40 THEN 'spatter' END AS feature_type FROM b WHERE y BETWEEN 10 AND 90)
    SELECT {LINE_KEY}, x, y, {near_sql('area', 4)} AS area, (2 * floor(sqrt(area / pi())))::DOUBLE AS diameter_px, feature_type
    FROM k WHERE feature_type IS NOT NULL""",
)
def classify_blobs(spark, sf_dir):
    from strandline.operators.track import classify_blobs as classify

    rows = lines(spark, sf_dir).selectExpr(
        *KEY, "CAST(l_quantity AS INT) AS x", "CAST(round(l_discount * 1000) AS INT) AS y", "floor(l_tax * 400) AS r"
    )
    box = {k: F.lit(v) for k, v in {"x_min": 10, "x_max": 40, "y_min": 10, "y_max": 90, "center_y_max": 80}.items()}
    return classify(rows, "x", "y", "r", box, 10).withColumn("area", near("area", 4)).drop("r")


@query(
    "c1_require_key",
    f"SELECT {LINE_KEY}, l_quantity::BIGINT AS frame FROM lineitem WHERE NOT (l_returnflag = 'A' OR (l_returnflag = 'N' AND l_tax = 0))",
)
def require_key(spark, sf_dir):
    rows = lines(spark, sf_dir, "l_returnflag").withColumn("frame", F.expr(MIXED_SQL.format(text="STRING")))
    return clean.require_key(rows, "frame").select(*KEY, "frame")


@query("c2_frame_events", f"SELECT {LINE_KEY} FROM lineitem WHERE l_extendedprice % 1 = 0")
def frame_events(spark, sf_dir):
    return clean.frame_events(lines(spark, sf_dir), "l_extendedprice", "l_quantity").select(*KEY)


@query(
    "c3_measurement_rows",
    f"""SELECT {LINE_KEY}, CASE WHEN l_tax > 0 THEN l_quantity ELSE l_extendedprice END AS meas_time FROM lineitem
    WHERE l_tax > 0 OR l_discount > 0""",
)
def measurement_rows(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumns(
        {"t1": F.expr("CASE WHEN l_tax > 0 THEN l_quantity END"), "t2": F.expr("CASE WHEN l_discount > 0 THEN l_extendedprice END")}
    )
    return clean.measurement_rows(rows, "t1", "t2").select(*KEY, "meas_time")


@query(
    "c5_require_values",
    f"""SELECT {LINE_KEY}, CASE WHEN l_discount > 0 THEN l_discount END AS target FROM lineitem WHERE l_tax > 0""",
)
def require_values(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumns(
        {"input": F.expr("CASE WHEN l_tax > 0 THEN l_tax END"), "target": F.expr("CASE WHEN l_discount > 0 THEN l_discount END")}
    )
    return clean.require_values(rows, ["input"], "target", allow_missing_target=True).select(*KEY, "target")


@query(
    "c6_filter_condition",
    f"""WITH s AS (SELECT l_suppkey, MEDIAN(l_linenumber::DOUBLE) AS feed FROM lineitem GROUP BY l_suppkey),
    m AS (SELECT s_suppkey, CASE WHEN s_nationkey < 12 THEN 'we' ELSE 'fr' END AS machine FROM supplier)
    SELECT {LINE_KEY} FROM lineitem JOIN s USING (l_suppkey) JOIN m ON s_suppkey = l_suppkey WHERE machine = 'we' AND abs(feed - 4) <= 1e-9""",
)
def filter_condition(spark, sf_dir):
    rows = lines(spark, sf_dir)
    medians = sequence_settings(rows, ["l_suppkey"], ["l_linenumber"]).withColumnRenamed("l_linenumber", "feed")
    machines = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS l_suppkey", "CASE WHEN s_nationkey < 12 THEN 'we' ELSE 'fr' END AS machine_group"
    )
    return clean.filter_condition(rows, medians.join(machines, "l_suppkey"), ["l_suppkey"], "WE", feed=4.0).select(*KEY)


@query(
    "c7_finite_rows",
    f"SELECT {LINE_KEY} FROM lineitem WHERE NOT (l_returnflag = 'A' OR (l_returnflag = 'N' AND l_tax = 0)) AND l_discount > 0",
)
def finite_rows(spark, sf_dir):
    rows = lines(spark, sf_dir, "l_returnflag").withColumns(
        {"a": F.expr(MIXED_SQL.format(text="STRING")).try_cast("double"), "b": F.expr("CASE WHEN l_discount > 0 THEN l_discount ELSE double('inf') END")}
    )
    return clean.finite_rows(rows, ["a", "b"]).select(*KEY)


@query(
    "c8_min_length",
    f"""WITH {EVENTS_SQL}, n AS (SELECT user_id FROM ev GROUP BY user_id HAVING COUNT(*) > 70)
    SELECT event_id, user_id FROM ev JOIN n USING (user_id)""",
)
def min_length(spark, sf_dir):
    return clean.min_length(events(spark, sf_dir), ["user_id"], 70).select("event_id", "user_id")


@query("c9_where_eq", f"SELECT {LINE_KEY} FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 2")
def where_eq(spark, sf_dir):
    return clean.where_eq(lines(spark, sf_dir, "l_returnflag"), {"l_returnflag": "A", "l_linenumber": 2}).select(*KEY)


@query(
    "c13_slice_rows",
    f"SELECT {LINE_KEY} FROM (SELECT *, ROW_NUMBER() OVER ({W_LINE}) - 1 AS pos FROM lineitem) WHERE pos >= 100 AND pos < 250",
)
def slice_rows(spark, sf_dir):
    return clean.slice_rows(lines(spark, sf_dir), line_seq(spark, sf_dir), 100, 250).select(*KEY)


@query("g7_head", f"SELECT {LINE_KEY} FROM lineitem ORDER BY l_extendedprice DESC, {LINE_KEY} LIMIT 50")
def head(spark, sf_dir):
    return metrics.head(lines(spark, sf_dir), [F.col("l_extendedprice").desc(), *KEY], 50).select(*KEY)


@query(
    "g1_order_columns",
    f"WITH {EVENTS_SQL} SELECT event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS pos FROM ev",
)
def order_columns(spark, sf_dir):
    from strandline.sequence import Sequence, with_position

    rows = events(spark, sf_dir)
    order = clean.order_columns(rows, ["meas_time", "t", "frame_number"], tie_break="event_id")
    return with_position(rows, Sequence(("user_id",), order, event_seq(spark, sf_dir).bucket), "pos").select("event_id", "pos")


@query("n1_transform_columns", f"SELECT {LINE_KEY}, l_quantity * 2 AS l_quantity, l_tax * 2 AS l_tax FROM lineitem")
def transform_columns(spark, sf_dir):
    return clean.transform_columns(lines(spark, sf_dir), ["l_quantity", "l_tax", "absent"], lambda c: c * 2).select(*KEY, "l_quantity", "l_tax")


@query("n2_table_transform", f"SELECT {LINE_KEY}, GREATEST(l_quantity - 30, 0) AS v FROM lineitem")
def table_transform(spark, sf_dir):
    rows = lines(spark, sf_dir).select(*KEY, (F.col("l_quantity") - 30).alias("v"))
    return rows.transform(lambda df: clean.transform_columns(df, ["v"], scalars.clip_low))
