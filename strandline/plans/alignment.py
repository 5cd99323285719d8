"""Registered queries: joins and aggregates that align samples with frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import align, clean
from strandline.operators.anomaly import frames_covered
from strandline.plans.jobs import AlignSpec, align_experiments
from strandline.plans.registry import query
from strandline.plans.scalars import NORM_SQL, STEM_SQL
from strandline.plans.stand_ins import (
    EVENTS_SQL, LINE_ORDER, event_seq, frame_seq, frames, lines, near, near_sql, samples, table,
)
from strandline.sources.files import union_all as union

# Detection-file names for the same customers, cut or altered so that every match class occurs.
RIGHT_SQL = """concat('detections_', CASE WHEN c_nationkey < 12 THEN 'fr' ELSE 'we' END, '_', c_nationkey,
 CASE WHEN c_acctbal < 3000 THEN concat('m_', c_custkey, 'mm') WHEN c_acctbal < 6000 THEN 'm' ELSE concat('m_', c_custkey, 'mm_', c_nationkey, '_x') END)"""

NEAREST_SQL = f"""
WITH {EVENTS_SQL},
fr AS (SELECT user_id, event_id AS frame_number, t AS ft FROM ev WHERE event_type = 'view'),
iv AS (SELECT user_id, frame_number, ft,
              COALESCE((LAG(ft) OVER w + ft) / 2, '-infinity'::DOUBLE) AS lower,
              COALESCE((ft + LEAD(ft) OVER w) / 2, 'infinity'::DOUBLE) AS upper
       FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY ft, frame_number)),
asg AS (SELECT e.user_id, i.frame_number, e.event_id, e.t, e.value, e.k
        FROM ev e JOIN iv i ON e.user_id = i.user_id AND e.t >= i.lower AND e.t < i.upper
        WHERE e.event_type <> 'view')
"""


def nearest(spark, sf_dir):
    return align.assign_nearest(
        samples(spark, sf_dir), frames(spark, sf_dir), ("user_id",), "t", "frame_time", "frame_number",
        event_seq(spark, sf_dir).bucket, "event_id",
    )


@query(
    "d5_e1_nearest_frame_mean",
    NEAREST_SQL + f"""
SELECT user_id, frame_number, {near_sql('AVG(value)')} AS mean_value, {near_sql('AVG(t)', 4)} AS mean_t, COUNT(*) AS n_samples
FROM asg GROUP BY user_id, frame_number
""",
)
def nearest_frame_mean(spark, sf_dir):
    return nearest(spark, sf_dir).groupBy("user_id", "frame_number").agg(
        near(F.avg("value")).alias("mean_value"), near(F.avg("t"), 4).alias("mean_t"), F.count("*").alias("n_samples")
    )


INTERVALS_SQL = f"""
WITH {EVENTS_SQL},
fr AS (SELECT user_id, event_id AS frame_number, t AS frame_time, value, k FROM ev WHERE event_type = 'view')
"""


@query(
    "d5_frame_intervals",
    INTERVALS_SQL + f"""SELECT user_id, frame_number, {near_sql('(LAG(frame_time) OVER w + frame_time) / 2', 4)} AS lower,
    {near_sql('(frame_time + LEAD(frame_time) OVER w) / 2', 4)} AS upper
    FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY frame_time, frame_number)""",
)
def intervals(spark, sf_dir):
    out = align.frame_intervals(frames(spark, sf_dir), frame_seq(spark, sf_dir), "frame_time")
    inf = float("inf")
    ends = {c: F.when(F.abs(F.col(c)) < inf, near(c, 4)) for c in ("lower", "upper")}
    return out.select("user_id", "frame_number", *[v.alias(c) for c, v in ends.items()])


@query("d5_assign_nearest", NEAREST_SQL + "SELECT user_id, event_id, frame_number FROM asg")
def assigned(spark, sf_dir):
    return nearest(spark, sf_dir).select("user_id", "event_id", "frame_number")


@query(
    "d1_attach_detections",
    INTERVALS_SQL + """, det AS (SELECT user_id, frame_number - 1 AS frame_number, value AS width, 0 AS src FROM fr
      UNION ALL SELECT user_id, frame_number + 3, value, 1 FROM fr
      UNION ALL SELECT user_id, frame_number, k, 2 FROM fr WHERE k > 30),
    one AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, frame_number ORDER BY src) AS rn FROM det) WHERE rn = 1)
    SELECT f.user_id, f.frame_number, width FROM fr f LEFT JOIN one ON one.user_id = f.user_id AND one.frame_number = f.frame_number""",
)
def attach_detections(spark, sf_dir):
    f = frames(spark, sf_dir)
    det = (
        f.select("user_id", (F.col("frame_number") - 1).alias("frame_number"), F.col("value").alias("width"), F.lit(0).alias("src"))
        .unionByName(f.select("user_id", (F.col("frame_number") + 3).alias("frame_number"), F.col("value").alias("width"), F.lit(1).alias("src")))
        .unionByName(f.filter("k > 30").select("user_id", "frame_number", F.col("k").alias("width"), F.lit(2).alias("src")))
    )
    return align.attach_detections(f, det, ["user_id", "frame_number"], ["src"]).select("user_id", "frame_number", "width")


@query(
    "d2_attach_flags",
    INTERVALS_SQL + "SELECT user_id, frame_number, CASE WHEN value > 50 THEN 1 ELSE 0 END AS anomaly FROM fr",
)
def attach_flags(spark, sf_dir):
    f = frames(spark, sf_dir)
    flags = f.filter("value > 50").select("user_id", "frame_number", F.lit(1).alias("anomaly"))
    return align.attach_flags(f, flags, ["user_id", "frame_number"], "anomaly").select("user_id", "frame_number", "anomaly")


@query(
    "d3_downsample",
    NEAREST_SQL + f""", m AS (SELECT user_id, frame_number, AVG(t) AS t, AVG(value) AS value FROM asg GROUP BY user_id, frame_number)
    SELECT fr.user_id, fr.frame_number, {near_sql('COALESCE(m.t, fr.ft)', 4)} AS t, {near_sql('m.value')} AS value
    FROM fr LEFT JOIN m ON m.user_id = fr.user_id AND m.frame_number = fr.frame_number""",
)
def downsample(spark, sf_dir):
    key = ["user_id", "frame_number"]
    means = align.frame_means(nearest(spark, sf_dir), key, ["t", "value"])
    out = align.downsample(frames(spark, sf_dir).drop("value", "k"), means, key, "t", "frame_time")
    return out.select(*key, near("t", 4).alias("t"), near("value").alias("value"))


@query(
    "d4_upsample",
    NEAREST_SQL + """SELECT a.user_id, a.event_id, a.frame_number, e.value AS frame_value FROM asg a
    JOIN ev e ON e.event_id = a.frame_number AND e.user_id = a.user_id""",
)
def upsample(spark, sf_dir):
    level = frames(spark, sf_dir).select("user_id", "frame_number", F.col("value").alias("frame_value"))
    out = align.upsample(nearest(spark, sf_dir), level, ["user_id", "frame_number"])
    return out.select("user_id", "event_id", "frame_number", "frame_value")


@query(
    "d6_interpolate",
    f"""WITH {EVENTS_SQL},
    src AS (SELECT user_id, t, value AS v FROM ev WHERE event_type = 'view'),
    tgt AS (SELECT user_id, event_id, t FROM ev WHERE event_type <> 'view'),
    lo AS (SELECT g.*, s.t AS t0, s.v AS v0 FROM tgt g ASOF LEFT JOIN src s ON g.user_id = s.user_id AND g.t >= s.t),
    both_sides AS (SELECT l.*, s.t AS t1, s.v AS v1 FROM lo l ASOF LEFT JOIN src s ON l.user_id = s.user_id AND l.t <= s.t)
    SELECT user_id, event_id, {near_sql('CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) / (t1 - t0) * (t - t0) END')}
    AS value FROM both_sides""",
)
def interpolate(spark, sf_dir):
    source = frames(spark, sf_dir).withColumnRenamed("frame_time", "t")
    out = align.interpolate_to(
        source, samples(spark, sf_dir).select("user_id", "event_id", "t"), ("user_id",), "t", ["value"],
        event_seq(spark, sf_dir).bucket, ["frame_number"], "event_id",
    )
    return out.select("user_id", "event_id", near("value").alias("value"))


def match_sql(left: str, right: str) -> str:
    """The best of all pairs; ``left`` and ``right`` select the distinct stems."""
    return f"""WITH l0 AS ({left}),
    l AS (SELECT stem AS name, {NORM_SQL} AS norm FROM l0),
    r0 AS ({right}),
    r AS (SELECT norm, MAX(name) AS name FROM (SELECT stem AS name, {NORM_SQL} AS norm FROM r0) GROUP BY norm),
    u AS (SELECT DISTINCT norm FROM l),
    p AS (SELECT u.norm, r.name, r.norm AS other,
      list_unique(string_split(u.norm, '_')) AS nl, list_unique(string_split(r.norm, '_')) AS nr,
      len(list_intersect(list_distinct(string_split(u.norm, '_')), list_distinct(string_split(r.norm, '_')))) AS ov FROM u, r),
    k AS (SELECT *, CASE WHEN norm = other THEN 3 WHEN contains(other, norm) OR contains(norm, other) THEN 2 WHEN ov > 0 THEN 1 ELSE 0 END AS cls FROM p),
    b AS (SELECT *, CASE WHEN cls = 3 THEN len(norm) ELSE ov END AS s1,
      CASE WHEN cls = 3 THEN len(other) WHEN cls = 2 THEN -abs(len(norm) - len(other)) ELSE -abs(nl::BIGINT - nr::BIGINT) END AS s2 FROM k WHERE cls > 0),
    w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY norm ORDER BY cls DESC, s1 DESC, s2 DESC, name DESC) AS rn FROM b)
    SELECT l.name, w.name AS match, COALESCE(w.cls, 0)::INTEGER AS score_class FROM l LEFT JOIN w ON w.norm = l.norm AND w.rn = 1"""


@query("d7_match_sources", match_sql(f"SELECT DISTINCT {STEM_SQL} AS stem FROM customer", f"SELECT DISTINCT {RIGHT_SQL} AS stem FROM customer"))
def match_sources(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    left = customer.selectExpr(f"{STEM_SQL} AS name").distinct()
    right = customer.selectExpr(f"{RIGHT_SQL} AS name").distinct()
    return align.match_sources(left, right, "name")


# Names of thirty tokens, some of them parts of longer ones.
LONG_TOKENS = 30


def _long_sql(multiplier: int, more: int) -> str:
    return f"""SELECT DISTINCT array_to_string(list_transform(range({LONG_TOKENS} + (c_custkey % {more})::INTEGER),
      lambda i: concat('t', (c_custkey * {multiplier} * (i + 3) + c_nationkey) % 997)), '_') AS stem FROM customer WHERE c_custkey % 3 < 2"""


def long_names(spark, sf_dir, multiplier: int, more: int):
    made = f"""array_join(transform(sequence(0, {LONG_TOKENS} - 1 + CAST(c_custkey % {more} AS INT)),
      i -> concat('t', (c_custkey * {multiplier} * (i + 3) + c_nationkey) % 997)), '_') AS name"""
    return table(spark, sf_dir, "customer").filter("c_custkey % 3 < 2").selectExpr(made).distinct()


@query("d7_match_long_names", match_sql(_long_sql(1, 1), _long_sql(1, 4)))
def match_long_names(spark, sf_dir):
    return align.match_sources(long_names(spark, sf_dir, 1, 1), long_names(spark, sf_dir, 1, 4), "name")


@query(
    "e2_column_maxima",
    "SELECT MAX(GREATEST(l_quantity - 25, 0)) AS max_a, MAX(GREATEST(-l_tax, 0)) + 0.0 AS max_b, NULL::DOUBLE AS max_c FROM lineitem",
)
def column_maxima(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_quantity - 25 AS a", "-l_tax AS b", "CAST(NULL AS DOUBLE) AS c")
    return clean.column_maxima(rows, ["a", "b", "c"])


@query(
    "e1_frame_means",
    NEAREST_SQL + f"SELECT user_id, frame_number, {near_sql('AVG(value)')} AS value, {near_sql('AVG(k)')} AS k FROM asg GROUP BY user_id, frame_number",
)
def frame_means(spark, sf_dir):
    out = align.frame_means(nearest(spark, sf_dir), ["user_id", "frame_number"], ["value", "k"])
    return out.withColumns({"value": near("value"), "k": near("k")})


@query(
    "e7_frames_covered",
    NEAREST_SQL + "SELECT user_id, COUNT(DISTINCT frame_number) AS frames_covered FROM asg GROUP BY user_id",
)
def covered(spark, sf_dir):
    return frames_covered(nearest(spark, sf_dir), ("user_id",), "frame_number")


@query(
    "e15_first_per_key",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_shipdate FROM (SELECT *, ROW_NUMBER() OVER
    (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1""",
)
def first_per_key(spark, sf_dir):
    return align.first_per_key(lines(spark, sf_dir), ["l_suppkey"], list(LINE_ORDER)).select("l_suppkey", *LINE_ORDER)


@query("h1_union_all", "SELECT l_quantity AS v FROM lineitem UNION ALL SELECT value FROM events")
def union_all(spark, sf_dir):
    return union(
        table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("v")), table(spark, sf_dir, "events").select(F.col("value").alias("v"))
    )


@query(
    "align_downsample_job",
    NEAREST_SQL + f""", det AS (SELECT user_id, frame_number, ft, value AS width, CASE WHEN k > 60 THEN 1 ELSE 0 END AS anomaly
      FROM fr JOIN (SELECT event_id, value, k FROM ev) e ON e.event_id = fr.frame_number),
    p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ft, frame_number) AS rn,
      ROW_NUMBER() OVER (PARTITION BY user_id, anomaly ORDER BY ft, frame_number) AS rf FROM det),
    q AS (SELECT *, CASE WHEN anomaly = 1 THEN COUNT(*) OVER (PARTITION BY user_id, anomaly, rn - rf) END AS len,
      CASE WHEN anomaly = 1 THEN MIN(rn) OVER (PARTITION BY user_id, anomaly, rn - rf) END AS a FROM p),
    e AS (SELECT q.*, l.width AS w0, h.width AS w1 FROM q LEFT JOIN p l ON l.user_id = q.user_id AND l.rn = q.a - 1
      LEFT JOIN p h ON h.user_id = q.user_id AND h.rn = q.a + q.len),
    z AS (SELECT user_id, frame_number, ft, CASE WHEN len <= 3 THEN w0 + (w1 - w0) / (len + 1) * (rn - a + 1) ELSE width END AS width,
      CASE WHEN len <= 3 AND w0 IS NOT NULL AND w1 IS NOT NULL THEN 0 ELSE anomaly END AS anomaly FROM e),
    m AS (SELECT user_id, frame_number, AVG(t) AS t, AVG(k) AS k FROM asg GROUP BY user_id, frame_number)
    SELECT z.user_id, z.frame_number, {near_sql('COALESCE(m.t, z.ft)', 4)} AS t, {near_sql('m.k')} AS k,
    CASE WHEN z.anomaly = 0 THEN {near_sql('z.width')} END AS width, z.anomaly::INTEGER AS anomaly
    FROM z LEFT JOIN m ON m.user_id = z.user_id AND m.frame_number = z.frame_number""",
)
def align_downsample(spark, sf_dir):
    f = frames(spark, sf_dir)
    detections = f.select("user_id", "frame_number", F.col("value").alias("width"), F.col("frame_number").alias("event_id"))
    flags = f.filter("k > 60").select("user_id", "frame_number", F.lit(1).alias("anomaly"))
    spec = AlignSpec(
        event_seq(spark, sf_dir), "t", "frame_number", "frame_time", ("k",), ("width",), (), "event_id", max_run=3
    )
    out = align_experiments(
        samples(spark, sf_dir).select("user_id", "event_id", "t", "k"), f.select("user_id", "frame_number", "frame_time"),
        detections, flags, spec, [("width", F.when(F.col("anomaly") != 1, F.col("width")))],
    )
    return out.select("user_id", "frame_number", near("t", 4).alias("t"), near("k").alias("k"), near("width").alias("width"), "anomaly")


@query(
    "align_upsample_job",
    NEAREST_SQL + f""", src AS (SELECT user_id, t, value AS v FROM ev WHERE event_type = 'view'),
    lo AS (SELECT g.*, s.t AS t0, s.v AS v0 FROM asg g ASOF LEFT JOIN src s ON g.user_id = s.user_id AND g.t >= s.t),
    both_sides AS (SELECT l.*, s.t AS t1, s.v AS v1 FROM lo l ASOF LEFT JOIN src s ON l.user_id = s.user_id AND l.t <= s.t)
    SELECT user_id, event_id, frame_number, k, 0::INTEGER AS anomaly,
    {near_sql('CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) / (t1 - t0) * (t - t0) END')} AS width FROM both_sides""",
)
def align_upsample(spark, sf_dir):
    """Frame values carried to the samples: interpolated between frames, with the flags of the nearest one."""
    f = frames(spark, sf_dir)
    detections = f.select("user_id", "frame_number", F.col("value").alias("width"), F.col("frame_number").alias("event_id"))
    spec = AlignSpec(event_seq(spark, sf_dir), "t", "frame_number", "frame_time", ("k",), ("width",), (), "event_id", mode="upsample")
    out = align_experiments(
        samples(spark, sf_dir).select("user_id", "event_id", "t", "k"), f.select("user_id", "frame_number", "frame_time"), detections, None, spec
    )
    return out.select("user_id", "event_id", "frame_number", "k", "anomaly", near("width").alias("width"))
