"""Registered queries: tracking, segments, trees and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import segments, track
from strandline.plans.ingest import fresh
from strandline.plans.jobs import ImageSpec, analyse_sources
from strandline.plans.registry import query
from strandline.plans.stand_ins import EVENT_SEQ, LINE_KEY, W_LINE, events, line_seq, lines, near, near_sql, table
from strandline.plans.windows import SCORE_SQL
from strandline.sequence import with_position
from strandline.session import cut_lineage
from strandline.streaming import ordered

KEY = LINE_KEY.split(", ")
RULES = track.TrackRules(radius=12.0, max_missed=3, min_hits=2, min_displacement=3.0, min_vertical=1.0)
DAYS = "datediff(l_shipdate, DATE'1995-01-01')"


def observations(spark, sf_dir):
    """Per supplier and return flag: ship days as frames, quantity and discount as coordinates."""
    rows = lines(spark, sf_dir, "l_returnflag").withColumn("day", F.expr(DAYS).cast("bigint"))
    placed = with_position(rows, line_seq(spark, sf_dir), "detection")
    return placed.select(
        "l_suppkey", "l_returnflag", "day", "detection", F.col("l_quantity").cast("int").alias("x"),
        F.round(F.col("l_discount") * 200).cast("int").alias("y"), *KEY[1:],
    )


def day_seq(spark, sf_dir, *keys):
    return line_seq(spark, sf_dir).along("day", ("day", "detection"), keys)


@query("j1_d8_track_objects")
def track_objects(spark, sf_dir):
    """Frames are consecutive: the dense rank of ship days, so tracks can live long."""
    seen = observations(spark, sf_dir)
    days = seen.select("l_suppkey", "day").distinct()
    seq = line_seq(spark, sf_dir)
    ranks = with_position(days, seq.along("day", ("day",)), "frame")
    rows = seen.join(ranks, ["l_suppkey", "day"])
    tracked = track.track_objects(
        rows, ("l_suppkey",), "frame", "x", "y", "detection", RULES, seq.along("frame", ("frame",)).bucket
    )
    # Numbering reads the tracks twice; the ordered pass must not run twice.
    return track.compact_ids(cut_lineage(tracked), ("l_suppkey",), "track_key", ["frame"]).select("l_suppkey", "frame", "detection", "x", "y", "track_id")


@query(
    "j1_episodes",
    f"""WITH o AS (SELECT l_suppkey, l_returnflag, date_diff('day', DATE '1995-01-01', l_shipdate) AS day, ROW_NUMBER() OVER ({W_LINE}) - 1 AS detection FROM lineitem),
    g AS (SELECT *, CASE WHEN day - LAG(day) OVER w > 4 THEN 1 ELSE 0 END AS cut FROM o
      WINDOW w AS (PARTITION BY l_suppkey, l_returnflag ORDER BY day, detection))
    SELECT l_suppkey, l_returnflag, detection, SUM(cut) OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY day, detection)::BIGINT AS episode FROM g""",
)
def episodes(spark, sf_dir):
    seq = day_seq(spark, sf_dir, "l_suppkey", "l_returnflag")
    return track.episodes(observations(spark, sf_dir), seq, "day", 3).select("l_suppkey", "l_returnflag", "detection", "episode")


@query(
    "f15_track_speed",
    f"""WITH o AS (SELECT l_suppkey, l_linenumber, date_diff('day', DATE '1995-01-01', l_shipdate) AS day, ROW_NUMBER() OVER ({W_LINE}) - 1 AS detection,
      l_quantity AS x, round(l_discount * 200) AS y FROM lineitem),
    g AS (SELECT *, day - LAG(day) OVER w AS d, x - LAG(x) OVER w AS dx, y - LAG(y) OVER w AS dy FROM o
      WINDOW w AS (PARTITION BY l_suppkey, l_linenumber ORDER BY day, detection))
    SELECT l_suppkey, detection, {near_sql('sqrt(dx * dx + dy * dy) / d')} AS speed FROM g WHERE d > 0""",
)
def track_speed(spark, sf_dir):
    seq = day_seq(spark, sf_dir, "l_suppkey", "l_linenumber")
    out = track.track_speed(observations(spark, sf_dir), seq, "day", "x", "y")
    return out.select("l_suppkey", "detection", near("speed").alias("speed"))


@query(
    "f16_compact_ids",
    """WITH f AS (SELECT l_returnflag, l_partkey, MIN(l_orderkey) AS first FROM lineitem GROUP BY l_returnflag, l_partkey)
    SELECT l_returnflag, l_partkey, (ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY first, l_partkey) - 1)::INTEGER AS track_id FROM f""",
)
def compact_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_orderkey")
    return track.compact_ids(rows, ("l_returnflag",), "l_partkey", ["l_orderkey"]).select("l_returnflag", "l_partkey", "track_id").distinct()


@query(
    "e16_displacement",
    f"""WITH o AS (SELECT l_suppkey, l_linenumber, ROW_NUMBER() OVER ({W_LINE}) AS rn, l_quantity AS x, round(l_discount * 200) AS y FROM lineitem),
    e AS (SELECT l_suppkey, l_linenumber, COUNT(*) AS n_points, arg_max(x, rn) - arg_min(x, rn) AS dx, arg_max(y, rn) - arg_min(y, rn) AS dy
      FROM o GROUP BY l_suppkey, l_linenumber)
    SELECT l_suppkey, l_linenumber, n_points, {near_sql('sqrt(dx * dx + dy * dy)')} AS total_displacement, dy AS vertical_displacement FROM e""",
)
def displacement(spark, sf_dir):
    out = track.displacement(observations(spark, sf_dir), ("l_suppkey", "l_linenumber"), "detection", "x", "y")
    return out.withColumn("total_displacement", near("total_displacement"))


# --- segments ---------------------------------------------------------------------------------

SEGMENT_SQL = f"""
WITH r AS (SELECT *, ROW_NUMBER() OVER ({W_LINE}) - 1 AS segment FROM lineitem),
i AS (SELECT l_suppkey, segment, (l_quantity * 8)::INTEGER AS a, (l_linenumber * 20)::INTEGER AS b,
        (l_quantity * 8 + round(l_discount * 1000) - 40)::INTEGER AS c, (l_linenumber * 20 + round(l_tax * 5000) - 150)::INTEGER AS d FROM r),
o AS (SELECT l_suppkey, segment, CASE WHEN f THEN c ELSE a END AS x1, CASE WHEN f THEN d ELSE b END AS y1, CASE WHEN f THEN a ELSE c END AS x2,
        CASE WHEN f THEN b ELSE d END AS y2 FROM (SELECT *, d < b OR (d = b AND c < a) AS f FROM i)),
s AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS length, CASE WHEN atan2(y2 - y1, x2 - x1) < 0 THEN atan2(y2 - y1, x2 - x1) + pi()
        ELSE atan2(y2 - y1, x2 - x1) END AS angle, (x1 + x2) * 0.5::DOUBLE AS mean_x, LEAST(y1, y2) AS y_min, GREATEST(y1, y2) AS y_max FROM o)
"""


def raw_segments(spark, sf_dir):
    placed = with_position(lines(spark, sf_dir), line_seq(spark, sf_dir), "segment")
    return placed.selectExpr(
        "l_suppkey", "segment", "l_quantity * 8 AS x1", "l_linenumber * 20 AS y1", "l_quantity * 8 + round(l_discount * 1000) - 40 AS x2",
        "l_linenumber * 20 + round(l_tax * 5000) - 150 AS y2",
    )


@query(
    "b33_describe_segments",
    SEGMENT_SQL + f"SELECT l_suppkey, segment, x1, y1, x2, y2, {near_sql('length')} AS length, {near_sql('angle')} AS angle, mean_x, y_min, y_max FROM s",
)
def describe_segments(spark, sf_dir):
    return segments.describe_segments(raw_segments(spark, sf_dir)).withColumns({"length": near("length"), "angle": near("angle")})


@query(
    "c12_filter_candidates",
    SEGMENT_SQL + """SELECT l_suppkey, segment FROM s WHERE length >= 60 AND LEAST(y_max - y_min, x1) BETWEEN 2 AND 200
    AND GREATEST(y_max - y_min, x1) >= LEAST(y_max - y_min, x1) * 1.5 AND LEAST(abs(90 - degrees(angle)), abs(-90 - degrees(angle))) <= 30""",
)
def filter_candidates(spark, sf_dir):
    rows = segments.describe_segments(raw_segments(spark, sf_dir)).withColumns(
        {"height": F.col("y_max") - F.col("y_min"), "degrees": F.degrees("angle")}
    )
    return segments.filter_candidates(
        rows, "length", "x1", "height", "degrees", min_length=60, max_width=200, min_aspect=1.5
    ).select("l_suppkey", "segment")


@query(
    "g2_top_candidates",
    SEGMENT_SQL + f""", k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey, x1 ORDER BY length DESC, segment) AS rank,
      MAX(length) OVER (PARTITION BY l_suppkey, x1) AS longest FROM s)
    SELECT l_suppkey, segment, rank::INTEGER AS rank FROM k WHERE rank = 1 OR (rank = 2 AND longest < 150)""",
)
def top_candidates(spark, sf_dir):
    rows = segments.describe_segments(raw_segments(spark, sf_dir))
    return segments.top_candidates(rows, ["l_suppkey", "x1"], "length", "segment", 150.0).select("l_suppkey", "segment", "rank")


@query(
    "d10_best_pair",
    SEGMENT_SQL + f""", k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY length DESC, segment) AS rk FROM s),
    p AS (SELECT a.l_suppkey, a.length + b.length AS score, a.rk AS ra, b.rk AS rb, a.segment AS sa, b.segment AS sb, a.mean_x AS ma, b.mean_x AS mb
      FROM k a JOIN k b ON a.l_suppkey = b.l_suppkey AND a.rk < b.rk AND abs(a.angle - b.angle) <= 0.05 AND a.y_max >= b.y_min AND b.y_max >= a.y_min
      AND abs(a.mean_x - b.mean_x) BETWEEN 30 AND 100),
    t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY score DESC, rb, ra) AS k FROM p)
    SELECT l_suppkey, {near_sql('score')} AS score, CASE WHEN ma <= mb THEN sa ELSE sb END AS left_segment, CASE WHEN ma <= mb THEN sb ELSE sa END AS right_segment
    FROM t WHERE k = 1""",
)
def best_pair(spark, sf_dir):
    rows = segments.describe_segments(raw_segments(spark, sf_dir))
    out = segments.best_pair(rows, ["l_suppkey"], "segment", angle_tolerance=0.05, min_x=30, max_x=100)
    return out.withColumn("score", near("score"))


def _axis_sql(n: str) -> str:
    """Direction and centre of the line through points with the sums sx, sy, sxx, syy, sxy."""
    theta = f"0.5 * atan2(2.0 * (sxy - sx * sy / {n}), (sxx - sx * sx / {n}) - (syy - sy * sy / {n}))"
    return f"cos({theta}) AS vx, sin({theta}) AS vy, sx / {n} AS x0, sy / {n} AS y0"


def _sums_sql(points: list[tuple[str, str]]) -> str:
    total = lambda f: " + ".join(f"({f(x, y)})::DOUBLE" for x, y in points)
    parts = {"sx": lambda x, y: x, "sy": lambda x, y: y, "sxx": lambda x, y: f"{x} * {x}", "syy": lambda x, y: f"{y} * {y}", "sxy": lambda x, y: f"{x} * {y}"}
    return ", ".join(f"{total(f)} AS {n}" for n, f in parts.items())


ENDS_SQL = [("ax1", "ay1"), ("ax2", "ay2"), ("bx1", "by1"), ("bx2", "by2")]
MERGE_SQL = SEGMENT_SQL.replace("WITH r AS", "WITH RECURSIVE r AS") + f""",
u AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (ORDER BY l_suppkey, x1, y1, x2, y2) AS id
  FROM (SELECT l_suppkey, x1, y1, x2, y2, any_value(angle) AS angle, COUNT(*) AS w FROM s GROUP BY l_suppkey, x1, y1, x2, y2)),
q AS (SELECT a.id AS ia, b.id AS ib, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
  FROM u a JOIN u b ON a.l_suppkey = b.l_suppkey AND a.id < b.id AND abs(a.angle - b.angle) <= 0.05
  AND a.x1 - 80 <= GREATEST(b.x1, b.x2) + 80 AND LEAST(b.x1, b.x2) - 80 <= GREATEST(a.x1, a.x2) + 80),
f AS (SELECT *, {_axis_sql('4')} FROM (SELECT *, {_sums_sql(ENDS_SQL)} FROM q)),
g AS (SELECT ia, ib, {", ".join(f"abs(({y} - y0) * vx - ({x} - x0) * vy) AS o{i}, ({x} - x0) * vx + ({y} - y0) * vy AS t{i}" for i, (x, y) in enumerate(ENDS_SQL))} FROM f),
e AS MATERIALIZED (SELECT ia, ib FROM g WHERE GREATEST(o0, o1, o2, o3) <= 2 AND GREATEST(LEAST(t2, t3) - GREATEST(t0, t1), LEAST(t0, t1) - GREATEST(t2, t3), 0) <= 5),
e2 AS MATERIALIZED (SELECT ia, ib FROM e UNION ALL SELECT ib, ia FROM e),
reach AS (SELECT id AS a, id AS b FROM u UNION SELECT reach.a, e2.ib FROM reach JOIN e2 ON e2.ia = reach.b),
member AS (SELECT u.*, c.comp FROM u JOIN (SELECT a, MIN(b) AS comp FROM reach GROUP BY a) c ON c.a = u.id),
pt AS MATERIALIZED (SELECT l_suppkey, comp, w, UNNEST([x1, x2])::DOUBLE AS x, UNNEST([y1, y2])::DOUBLE AS y FROM member),
ln AS MATERIALIZED (SELECT l_suppkey, comp, n / 2 AS support, {_axis_sql('n')}
  FROM (SELECT l_suppkey, comp, SUM(w)::DOUBLE AS n, SUM(w * x) AS sx, SUM(w * y) AS sy, SUM(w * x * x) AS sxx, SUM(w * y * y) AS syy, SUM(w * x * y) AS sxy FROM pt GROUP BY l_suppkey, comp)),
sp AS (SELECT ln.*, t0, t1 FROM ln JOIN (SELECT comp, MIN((x - x0) * vx + (y - y0) * vy) AS t0, MAX((x - x0) * vx + (y - y0) * vy) AS t1 FROM pt JOIN ln USING (l_suppkey, comp) GROUP BY comp) USING (comp)),
en AS (SELECT l_suppkey, support, round_even(x0 + t0 * vx, 0)::INTEGER AS a, round_even(y0 + t0 * vy, 0)::INTEGER AS b, round_even(x0 + t1 * vx, 0)::INTEGER AS c,
  round_even(y0 + t1 * vy, 0)::INTEGER AS d FROM sp),
od AS (SELECT l_suppkey, support, CASE WHEN k THEN c ELSE a END AS x1, CASE WHEN k THEN d ELSE b END AS y1, CASE WHEN k THEN a ELSE c END AS x2, CASE WHEN k THEN b ELSE d END AS y2
  FROM (SELECT *, d < b OR (d = b AND c < a) AS k FROM en))
SELECT l_suppkey, support::BIGINT AS support_count, x1, y1, x2, y2, {near_sql('sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)')} AS length FROM od WHERE sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) >= 30
"""


@query("j5_merge_segments", MERGE_SQL)
def merge_segments(spark, sf_dir):
    out = segments.merge_segments(
        raw_segments(spark, sf_dir), ["l_suppkey"], angle_tolerance=0.05, max_gap=5.0, max_distance=2.0, min_length=30.0
    )
    return out.select("l_suppkey", "support_count", "x1", "y1", "x2", "y2", near("length").alias("length"))


# --- streams ----------------------------------------------------------------------------------


HALF_DAY = 43_200


def stream_rows(events):
    """Per user, half days as frames; the frame's start is the event time of all its rows."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    half = F.floor(seconds / HALF_DAY)
    return events.select(
        F.col("user_id").cast("string").alias("key"), F.timestamp_seconds(half * HALF_DAY).alias("event_time"),
        half.alias("frame"), F.col("event_id").alias("item"), F.col("value").alias("a"),
        F.get_json_object("props", "$.k").try_cast("double").alias("b"),
    )


STREAM_RULES = track.TrackRules(radius=40.0, max_missed=3, min_hits=2, min_displacement=1.0, min_vertical=0.0)


DELAY = "1 day"


def replay(spark, sf_dir, kind, build, shape=stream_rows):
    """Replay the events table as a stream to its end and return what it emitted, written to the shared folder."""
    source = table(spark, sf_dir, "events")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.STATE_STORE)
    feed = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out, checkpoint, ended = fresh(spark, kind), fresh(spark, f"{kind}-state"), fresh(spark, f"{kind}-end")
    marker = ordered.end_marker(shape(source), DELAY)
    marker.write.parquet(ended)
    rows = shape(feed).unionByName(spark.readStream.schema(marker.schema).parquet(ended))
    running = (
        build(rows).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start(out)
    )
    running.awaitTermination()
    return spark.read.parquet(out)


def single_track_sql(rows: str, rules: track.TrackRules, order: str) -> str:
    """Tracks of objects (key, frame, item, x, y) that are seen alone in their frames: one filter, step by step.

    ``rules`` must have a radius that no step exceeds. Over n frames without a match the covariance has a closed form.
    """
    q, r, s0 = rules.process_noise, rules.measurement_noise, rules.initial_variance
    return f"""WITH RECURSIVE seen AS ({rows}),
    s AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY {order}) AS rn FROM seen),
    t AS (SELECT key, rn, frame, item, x, y, x::DOUBLE AS px, y::DOUBLE AS py, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, {s0!r}::DOUBLE AS pp, 0.0::DOUBLE AS pv, {s0!r}::DOUBLE AS vv,
        x AS fx, y AS fy, 1 AS hits, FALSE AS confirmed, 0 AS id FROM s WHERE rn = 1
      UNION ALL SELECT key, rn, frame, item, x, y, CASE WHEN live THEN qx + gp * (x - qx) ELSE x END, CASE WHEN live THEN qy + gp * (y - qy) ELSE y END,
        CASE WHEN live THEN vx + gv * (x - qx) ELSE 0 END, CASE WHEN live THEN vy + gv * (y - qy) ELSE 0 END,
        CASE WHEN live THEN a * (1 - gp) ELSE {s0!r} END, CASE WHEN live THEN b * (1 - gp) ELSE 0 END, CASE WHEN live THEN c - gv * b ELSE {s0!r} END,
        CASE WHEN live THEN fx ELSE x END, CASE WHEN live THEN fy ELSE y END, CASE WHEN live THEN hits + 1 ELSE 1 END,
        live AND (confirmed OR (hits + 1 >= {rules.min_hits} AND sqrt((x - fx) ** 2 + (y - fy) ** 2) >= {rules.min_displacement} AND y - fy >= {rules.min_vertical})),
        CASE WHEN live THEN id ELSE id + 1 END
      FROM (SELECT *, a / (a + {r!r}) AS gp, b / (a + {r!r}) AS gv FROM (
        SELECT n.key, n.rn, n.frame, n.item, n.x, n.y, t.vx, t.vy, t.fx, t.fy, t.hits, t.confirmed, t.id, n.frame - t.frame - 1 <= {rules.max_missed} AS live,
          t.px + (n.frame - t.frame) * t.vx AS qx, t.py + (n.frame - t.frame) * t.vy AS qy,
          t.pp + 2 * (m * t.pv + t.vv * m * (m - 1) / 2 + {q!r} * m * (m - 1) * (m - 2) / 6) + m * t.vv + {q!r} * m * (m - 1) / 2 + m * {q!r} AS a,
          t.pv + m * t.vv + {q!r} * m * (m - 1) / 2 AS b, t.vv + m * {q!r} AS c
        FROM t JOIN s n ON n.key = t.key AND n.rn = t.rn + 1, LATERAL (SELECT (n.frame - t.frame)::DOUBLE AS m))))
    """


ALONE_RULES = track.TrackRules(radius=1e6, max_missed=3, min_hits=2, min_displacement=8.0, min_vertical=2.0, initial_variance=0.25)


@query(
    "j1_track_alone",
    single_track_sql(
        f"""SELECT l_suppkey AS key, date_diff('day', DATE '1995-01-01', l_shipdate) AS frame, detection AS item, l_quantity::INTEGER AS x, round(l_discount * 200)::INTEGER AS y
        FROM (SELECT *, ROW_NUMBER() OVER ({W_LINE}) - 1 AS detection, ROW_NUMBER() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey) AS k
          FROM lineitem) WHERE k = 1""", ALONE_RULES, "frame",
    ) + "SELECT key AS l_suppkey, frame, item AS detection, x, y, (DENSE_RANK() OVER (PARTITION BY key ORDER BY id) - 1)::INTEGER AS track_id FROM t WHERE confirmed",
)
def track_alone(spark, sf_dir):
    """The first detection of every ship day: one object at a time, over days without any."""
    seen = observations(spark, sf_dir).drop("l_returnflag")
    first = seen.groupBy("l_suppkey", "day").agg(F.min(F.struct("detection", "x", "y")).alias("d")).select("l_suppkey", F.col("day").alias("frame"), "d.*")
    tracked = track.track_objects(first, ("l_suppkey",), "frame", "x", "y", "detection", ALONE_RULES, line_seq(spark, sf_dir).along("frame", ("frame",)).bucket)
    return track.compact_ids(cut_lineage(tracked), ("l_suppkey",), "track_key", ["frame"]).select("l_suppkey", "frame", "detection", "x", "y", "track_id")


def image_run(spark, sf_dir):
    """Users as sources, their events as images in order of time: each but a view shows one blob."""
    numbered = with_position(events(spark, sf_dir), EVENT_SEQ, "frame").withColumn("source_name", F.format_string("user_%d", "user_id"))
    folder = F.when(F.col("user_id") % 2 == 0, "Backlit").otherwise("other")
    images = numbered.select(F.format_string("/data/%s/%s/frame_%06d.png", folder, "source_name", "frame").alias("path"))
    blob = F.struct(F.col("value").alias("x"), F.col("k").alias("y"))
    found = numbered.select(
        "source_name", "frame", F.when(F.col("event_type") != "error", F.col("value")).alias("a"), "k",
        F.when(F.col("event_type") != "view", F.array(blob)).otherwise(F.array().cast("array<struct<x:double,y:double>>")).alias("blobs"),
    )
    return analyse_sources(images, found, ImageSpec(("a", "k"), "blobs", tracks=ALONE_RULES), fresh(spark, "images"))


IMAGE_TRACK_SQL = single_track_sql(
    """SELECT user_id AS key, frame, event_id AS item, trunc(value)::INTEGER AS x, trunc(k)::INTEGER AS y FROM (SELECT event_id, user_id, event_type, value,
    TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events)
    WHERE event_type <> 'view' AND value IS NOT NULL AND k IS NOT NULL""", ALONE_RULES, "frame",
)


@query(
    "image_job_sources",
    f"""SELECT concat('user_', e.user_id) AS source_name, CASE WHEN e.user_id % 2 = 0 THEN 'backlit' ELSE 'laserlit' END AS mode, e.flagged, e.total,
    {near_sql('e.flagged / e.total')} AS ratio, e.flagged / e.total > 0.10 AS recheck, COALESCE(m.points, 0) AS points, COALESCE(m.tracks, 0) AS tracks
    FROM ({SCORE_SQL} SELECT user_id, SUM(anomaly)::BIGINT AS flagged, COUNT(*) AS total FROM s GROUP BY user_id) e
    LEFT JOIN ({IMAGE_TRACK_SQL} SELECT key, COUNT(*) AS points, COUNT(DISTINCT id) AS tracks FROM t WHERE confirmed GROUP BY key) m ON m.key = e.user_id""",
)
def image_job_sources(spark, sf_dir):
    """The summary that the job writes last, from every table before it."""
    return image_run(spark, sf_dir).tables["sources"].withColumn("ratio", near("ratio"))


@query(
    "image_job_tracks",
    IMAGE_TRACK_SQL + """SELECT concat('user_', key) AS source_name, frame, 0 AS blob, x, y, (DENSE_RANK() OVER (PARTITION BY key ORDER BY id) - 1)::INTEGER AS track_id
    FROM t WHERE confirmed""",
)
def image_job_tracks(spark, sf_dir):
    return image_run(spark, sf_dir).tables["tracks"]


LANES = 16


def lane_rows(events):
    """Events dealt to lanes in turn: each is alone in its frame; views are left out, so frames are missing."""
    return events.filter("event_type <> 'view'").select(
        (F.col("event_id") % LANES).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("event_time"), F.expr(f"event_id div {LANES}").alias("frame"),
        F.col("event_id").alias("item"), F.col("value").alias("a"), F.get_json_object("props", "$.k").try_cast("double").alias("b"),
    )


@query(
    "m1_track_stream_alone",
    single_track_sql(
        f"""SELECT (event_id % {LANES})::VARCHAR AS key, event_id // {LANES} AS frame, event_id AS item, trunc(value)::INTEGER AS x,
        trunc(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE))::INTEGER AS y FROM events WHERE event_type <> 'view'""", ALONE_RULES, "frame",
    ) + """SELECT t.key, t.frame, t.item, e.value AS a, TRY_CAST(json_extract_string(e.props, '$.k') AS DOUBLE) AS b, t.id::DOUBLE AS result
    FROM t JOIN events e ON e.event_id = t.item WHERE t.confirmed""",
)
def track_stream_alone(spark, sf_dir):
    return replay(spark, sf_dir, "m1-alone", lambda rows: ordered.track_stream(rows, DELAY, ALONE_RULES), lane_rows)


@query("m1_track_stream")
def track_stream(spark, sf_dir):
    return replay(spark, sf_dir, "m1", lambda rows: ordered.track_stream(rows, DELAY, STREAM_RULES))


@query(
    "m2_jump_stream",
    """WITH r AS (SELECT user_id::VARCHAR AS key, floor(epoch(ts) / 43200)::BIGINT AS frame, event_id::BIGINT AS item, value AS a,
      TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS b FROM events),
    w AS (SELECT *, AVG(a) OVER p AS mean, COUNT(a) OVER p AS n FROM r WINDOW p AS (PARTITION BY key ORDER BY frame, item ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
    SELECT key, frame, item, a, b, (CASE WHEN n >= 5 AND abs(a - mean) / (abs(mean) + 1e-9) > 0.2 THEN 1 ELSE 0 END)::DOUBLE AS result FROM w""",
)
def jump_stream(spark, sf_dir):
    return replay(spark, sf_dir, "m2", lambda rows: ordered.jump_stream(rows, DELAY))
