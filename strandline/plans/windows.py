"""Registered queries: repair, anomaly rules and window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import anomaly, features, metrics, repair
from strandline.plans.registry import query
from strandline.plans.stand_ins import (
    EVENTS_SQL, LINE_KEY, W_LINE, W_USER, event_seq, events, line_seq, lines, near, near_sql, table,
)


KEY = LINE_KEY.split(", ")


def flagged(spark, sf_dir):
    return events(spark, sf_dir).withColumn("flag", (F.col("event_type") == "error").cast("int"))


RUNS_SQL = f"""
WITH {EVENTS_SQL},
f AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS flag FROM ev),
p AS (SELECT *, ROW_NUMBER() OVER ({W_USER}) AS rn,
        ROW_NUMBER() OVER (PARTITION BY user_id, flag ORDER BY t, event_id) AS rf FROM f),
q AS (SELECT *, CASE WHEN flag = 1 THEN COUNT(*) OVER (PARTITION BY user_id, flag, rn - rf) END AS len,
        CASE WHEN flag = 1 THEN MIN(rn) OVER (PARTITION BY user_id, flag, rn - rf) END AS a FROM p)
"""


@query(
    "f8_repair_runs",
    RUNS_SQL + f""", e AS (SELECT q.*, l.value AS w0, h.value AS w1, l.k AS k0, h.k AS k1 FROM q
      LEFT JOIN p l ON l.user_id = q.user_id AND l.rn = q.a - 1 LEFT JOIN p h ON h.user_id = q.user_id AND h.rn = q.a + q.len)
    SELECT event_id, {near_sql('CASE WHEN len <= 2 THEN w0 + (w1 - w0) / (len + 1) * (rn - a + 1) ELSE value END')} AS value,
    {near_sql('CASE WHEN len <= 2 THEN k0 + (k1 - k0) / (len + 1) * (rn - a + 1) ELSE k END')} AS k,
    CASE WHEN len <= 2 AND w0 IS NOT NULL AND w1 IS NOT NULL THEN 0 ELSE flag END::INTEGER AS flag FROM e""",
)
def repair_runs(spark, sf_dir):
    out = repair.repair_runs(flagged(spark, sf_dir), event_seq(spark, sf_dir), "flag", ["value", "k"], 2)
    return out.select("event_id", near("value").alias("value"), near("k").alias("k"), "flag")


@query(
    "f9_repair_gaps",
    RUNS_SQL + f""", e AS (SELECT q.*, l.value AS w0, h.value AS w1 FROM q
      LEFT JOIN p l ON l.user_id = q.user_id AND l.rn = q.a - 1 LEFT JOIN p h ON h.user_id = q.user_id AND h.rn = q.a + q.len)
    SELECT event_id, {near_sql('CASE WHEN flag = 0 THEN value WHEN len <= 2 THEN w0 + (w1 - w0) / (len + 1) * (rn - a + 1) END')} AS value FROM e""",
)
def repair_gaps(spark, sf_dir):
    gappy = events(spark, sf_dir).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    out = repair.repair_gaps(gappy, event_seq(spark, sf_dir), ["value"], 2)
    return out.select("event_id", near("value").alias("value"))


JUMP_SQL = """COALESCE(abs({c} - m) / (abs(m) + 1e-9) > 0.2, FALSE)"""


def prior(c: str, w: str = W_USER) -> str:
    frame = f"OVER ({w} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN COUNT({c}) {frame} >= 5 THEN AVG({c}) {frame} END"


@query(
    "f6_jump_flags",
    f"""WITH {EVENTS_SQL}, b AS (SELECT event_id, value, {prior('value')} AS m FROM ev)
    SELECT event_id, {JUMP_SQL.format(c='value')} AS jump FROM b""",
)
def jump_flags(spark, sf_dir):
    return anomaly.jump_flags(events(spark, sf_dir), event_seq(spark, sf_dir), "value").select("event_id", "jump")


@query(
    "f7_transient_flags",
    RUNS_SQL + """, r AS (SELECT user_id, a, ANY_VALUE(len) AS len FROM q WHERE flag = 1 GROUP BY user_id, a),
    lone AS (SELECT r.* FROM r WHERE len <= 2 AND NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = r.user_id AND flag = 1 AND
      ((p.rn >= r.a - 4 AND p.rn < r.a) OR (p.rn >= r.a + r.len AND p.rn < r.a + r.len + 4))))
    SELECT q.event_id, lone.a IS NOT NULL AS transient FROM q LEFT JOIN lone ON lone.user_id = q.user_id AND lone.a = q.a""",
)
def transient_flags(spark, sf_dir):
    rows = events(spark, sf_dir)
    out = anomaly.transient_flags(rows, event_seq(spark, sf_dir), F.col("event_type") == "error", window=4, max_len=2)
    return out.select("event_id", "transient")


SCORE_SQL = f"""
WITH {EVENTS_SQL},
g AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS a FROM ev),
b AS (SELECT event_id, user_id, a, k, COUNT(a) OVER (PARTITION BY user_id) = 0 AS va, {prior('a')} AS ma, {prior('k')} AS mk FROM g),
h AS (SELECT *, (NOT va AND a IS NULL)::INTEGER AS h1, (NOT va AND COALESCE(abs(a - ma) / (abs(ma) + 1e-9) > 0.2, FALSE))::INTEGER AS h2,
        COALESCE(abs(k - mk) / (abs(mk) + 1e-9) > 0.2, FALSE)::INTEGER AS h3 FROM b),
s AS (SELECT event_id, user_id, (h1 + h2 + h3)::DOUBLE AS anomaly_score, (h1 + h2 + h3 >= 1)::INTEGER AS anomaly,
        concat_ws(';', CASE WHEN h2 = 1 THEN 'jump:a' END, CASE WHEN h3 = 1 THEN 'jump:k' END, CASE WHEN h1 = 1 THEN 'missing:a' END)
        AS anomaly_reason FROM h)
"""


def scored(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("a", F.when(F.col("event_type") != "error", F.col("value")))
    return anomaly.anomaly_score(rows, event_seq(spark, sf_dir), ["a", "k"])


@query("f18_anomaly_score", SCORE_SQL + "SELECT event_id, anomaly_score, anomaly, anomaly_reason FROM s")
def anomaly_score(spark, sf_dir):
    reason = F.array_join("anomaly_reasons", ";").alias("anomaly_reason")
    return scored(spark, sf_dir).select("event_id", "anomaly_score", "anomaly", reason)


@query(
    "e6_anomaly_summary",
    SCORE_SQL + f"""SELECT user_id, SUM(anomaly)::BIGINT AS flagged, COUNT(*) AS total, {near_sql('SUM(anomaly) / COUNT(*)')} AS ratio,
    SUM(anomaly) / COUNT(*) > 0.10 AS recheck FROM s GROUP BY user_id""",
)
def anomaly_summary(spark, sf_dir):
    return anomaly.anomaly_summary(scored(spark, sf_dir), ("user_id",)).withColumn("ratio", near("ratio"))


@query(
    "e5_presence_features",
    f"""SELECT {LINE_KEY}, CASE WHEN l_extendedprice <= 0 THEN 0 WHEN l_returnflag = 'A' THEN 2 WHEN l_returnflag = 'N' THEN 1 ELSE 0 END
    AS active_droplet_count, CASE WHEN l_returnflag = 'A' THEN 2 * l_extendedprice WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END
    AS active_droplet_total_area FROM lineitem""",
)
def presence_features(spark, sf_dir):
    from strandline.plans.ingest import detections

    return anomaly.presence_features(detections(spark, sf_dir), {"droplet": "droplets"}).select(
        *KEY, "active_droplet_count", "active_droplet_total_area"
    )


@query("e14_all_null_columns", "SELECT FALSE AS l_quantity, TRUE AS empty, FALSE AS rare FROM lineitem LIMIT 1")
def all_null_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_quantity", "CASE WHEN l_quantity < 0 THEN 1 END AS empty", "CASE WHEN l_linenumber = 1 THEN l_tax END AS rare"
    )
    return anomaly.all_null_columns(rows, ["l_quantity", "empty", "rare"])


@query(
    "f1_add_lags",
    f"""SELECT {LINE_KEY}, LAG(l_quantity, 1) OVER w AS l_quantity_lag_1, LAG(l_quantity, 5) OVER w AS l_quantity_lag_5,
    LAG(l_tax, 1) OVER w AS l_tax_lag_1, LAG(l_tax, 5) OVER w AS l_tax_lag_5 FROM lineitem WINDOW w AS ({W_LINE})""",
)
def add_lags(spark, sf_dir):
    out = features.add_lags(lines(spark, sf_dir), line_seq(spark, sf_dir), ["l_quantity", "l_tax"], [1, 5])
    return out.select(*KEY, *[f"{c}_lag_{k}" for c in ("l_quantity", "l_tax") for k in (1, 5)])


GAPPY_SQL = f"g AS (SELECT *, CASE WHEN l_tax > 0.01 THEN l_quantity END AS q FROM lineitem)"


def gappy(spark, sf_dir):
    return lines(spark, sf_dir).withColumn("q", F.when(F.col("l_tax") > 0.01, F.col("l_quantity")))


def full_sql(c: str, n: int, value: str) -> str:
    return near_sql(f"CASE WHEN COUNT({c}) OVER w{n} = {n} THEN {value} END")


@query(
    "f2_rolling_summary",
    f"""WITH {GAPPY_SQL} SELECT {LINE_KEY},
    {', '.join(f"{full_sql('q', n, f'{fn}(q) OVER w{n}')} AS q_roll_{n}_{s}"
               for n in (5, 10) for s, fn in (('mean', 'AVG'), ('std', 'stddev_pop'), ('min', 'MIN'), ('max', 'MAX')))},
    {', '.join(f"q - LAG(q, {n - 1}) OVER w AS q_roll_{n}_delta, {near_sql(f'(q - LAG(q, {n - 1}) OVER w) / {n - 1}')} AS q_roll_{n}_slope"
               for n in (5, 10))}
    FROM g WINDOW w AS ({W_LINE}), {', '.join(f'w{n} AS ({W_LINE} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)' for n in (5, 10))}""",
)
def rolling_summary(spark, sf_dir):
    out = features.rolling_summary(gappy(spark, sf_dir), line_seq(spark, sf_dir), ["q"], [5, 10])
    return out.select(*KEY, *[near(c).alias(c) for c in out.columns if c.startswith("q_roll")])


@query(
    "f3_rolling_pair",
    f"""WITH c AS (SELECT {LINE_KEY}, COUNT(*) OVER w = 5 AS whole,
      AVG(l_quantity * l_discount) OVER w - AVG(l_quantity) OVER w * AVG(l_discount) OVER w AS cov,
      stddev_pop(l_quantity) OVER w * stddev_pop(l_discount) OVER w AS sd
      FROM lineitem WINDOW w AS ({W_LINE} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT {LINE_KEY}, {near_sql('CASE WHEN whole THEN cov END', 5)} AS cov, {near_sql('CASE WHEN whole THEN -cov END', 5)} AS negcov,
    {near_sql('CASE WHEN whole AND sd > 1e-6 THEN cov / sd ELSE 0 END', 5)} AS corr FROM c""",
)
def rolling_pair(spark, sf_dir):
    out = features.rolling_pair(lines(spark, sf_dir), line_seq(spark, sf_dir), "l_quantity", "l_discount", [5])
    return out.select(*KEY, *[near(f"l_quantity_l_discount_roll_5_{s}", 5).alias(s) for s in ("cov", "negcov", "corr")])


@query(
    "f4_window_stats",
    f"""WITH r AS (SELECT *, ROW_NUMBER() OVER ({W_LINE}) AS rn FROM lineitem)
    SELECT {LINE_KEY}, {full_sql('l_quantity', 5, 'AVG(l_quantity) OVER w5')} AS mean, {full_sql('l_quantity', 5, 'stddev_pop(l_quantity) OVER w5')} AS std,
    {full_sql('l_quantity', 5, 'regr_slope(l_quantity, rn) OVER w5')} AS slope,
    {full_sql('l_quantity', 5, 'AVG(l_quantity * l_discount) OVER w5')} AS pmean,
    {full_sql('l_quantity', 5, 'stddev_pop(l_quantity * l_discount) OVER w5')} AS pstd
    FROM r WINDOW w5 AS ({W_LINE} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def window_stats(spark, sf_dir):
    out = features.window_stats(lines(spark, sf_dir), line_seq(spark, sf_dir), ["l_quantity"], 5, ("l_quantity", "l_discount"))
    names = {"l_quantity_mean": "mean", "l_quantity_std": "std", "l_quantity_slope": "slope", "product_mean": "pmean", "product_std": "pstd"}
    return out.select(*KEY, *[near(c).alias(n) for c, n in names.items()])


@query(
    "f5_first_difference",
    f"""SELECT {LINE_KEY}, COALESCE(l_quantity - LAG(l_quantity) OVER w, 0) AS delta_l_quantity,
    abs(l_quantity - LAG(l_quantity) OVER w) AS abs_delta_l_quantity FROM lineitem WINDOW w AS ({W_LINE})""",
)
def first_difference(spark, sf_dir):
    seq = line_seq(spark, sf_dir)
    out = features.first_difference(lines(spark, sf_dir), seq, ["l_quantity"])
    out = features.first_difference(out, seq, ["l_quantity"], fill=None, absolute=True)
    return out.select(*KEY, "delta_l_quantity", "abs_delta_l_quantity")


@query(
    "f10_lag_matrix",
    f"""SELECT {LINE_KEY}, rn > 3 AS has_full_history, CASE WHEN rn > 3 THEN {near_sql('y1 + 10 * y2 + 100 * u1 + 1000 * u2 + 10000 * u3')} END AS checksum
    FROM (SELECT *, ROW_NUMBER() OVER w AS rn, LAG(l_quantity, 1) OVER w AS y1, LAG(l_quantity, 2) OVER w AS y2, LAG(l_discount, 1) OVER w AS u1,
      LAG(l_discount, 2) OVER w AS u2, LAG(l_discount, 3) OVER w AS u3 FROM lineitem WINDOW w AS ({W_LINE}))""",
)
def lag_matrix(spark, sf_dir):
    out = features.lag_matrix(lines(spark, sf_dir), line_seq(spark, sf_dir), "l_quantity", ["l_discount"], 2, 3, 1)
    phi = F.col("phi")
    total = phi[0] + 10 * phi[1] + 100 * phi[2] + 1000 * phi[3] + 10000 * phi[4]
    return out.select(*KEY, "has_full_history", F.when(F.col("has_full_history"), near(total)).alias("checksum"))


@query("f11_warmup", f"SELECT {LINE_KEY}, ROW_NUMBER() OVER ({W_LINE}) > 7 AS has_full_history FROM lineitem")
def warmup(spark, sf_dir):
    start = features.warmup(na=3, nb=5, nk=3)
    out = features.sample_index(lines(spark, sf_dir), line_seq(spark, sf_dir))
    return out.select(*KEY, (F.col("sample_index") >= start).alias("has_full_history"))


@query("f12_sample_index", f"SELECT {LINE_KEY}, ROW_NUMBER() OVER ({W_LINE}) - 1 AS sample_index FROM lineitem")
def sample_index(spark, sf_dir):
    return features.sample_index(lines(spark, sf_dir), line_seq(spark, sf_dir)).select(*KEY, "sample_index")


STEPS = [f"{c}_{k}" for k in range(4) for c in ("quantity", "tax")]  # oldest first, as they stand in a window
STATS_SQL = {
    **{f"{c}_{s}": f"{f}(l_{c}{x}) OVER f" for c in ("quantity", "tax")
       for s, f, x in (("mean", "AVG", ""), ("std", "stddev_pop", ""), ("min", "MIN", ""), ("max", "MAX", ""), ("slope", "regr_slope", ", p"))},
    "product_mean": "AVG(l_quantity * l_tax) OVER f", "product_std": "stddev_pop(l_quantity * l_tax) OVER f",
}


@query(
    "f13_sliding_windows",
    f"""WITH r AS (SELECT *, ROW_NUMBER() OVER ({W_LINE}) - 1 AS src FROM lineitem),
    g AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY src) AS p FROM r WHERE l_tax > 0),
    w AS (SELECT l_suppkey, src, l_discount, COUNT(*) OVER f AS n, {', '.join(f'LAG(l_{c}, {3 - int(k)}) OVER o AS {c}_{k}' for c, k in (s.split('_') for s in STEPS))},
      {', '.join(f'{v} AS {name}' for name, v in STATS_SQL.items())}
      FROM g WINDOW o AS (PARTITION BY l_suppkey ORDER BY src), f AS (PARTITION BY l_suppkey ORDER BY src ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
    SELECT l_suppkey, src AS window_end, l_discount, 4 * (2 + 12)::INTEGER AS width, {', '.join(STEPS)}, {', '.join(f'{near_sql(name)} AS {name}' for name in STATS_SQL)}
    FROM w WHERE n = 4""",
)
def sliding_windows(spark, sf_dir):
    """Whole windows: every step of both inputs, and all statistics, which every step repeats, from the last one."""
    rows = lines(spark, sf_dir).withColumn("u", F.when(F.col("l_tax") > 0, F.col("l_tax")))
    out = features.sliding_windows(
        rows, line_seq(spark, sf_dir), ["l_quantity", "u"], ["l_discount"], 4, stats=("l_quantity", "u")
    )
    at = lambda step, k: F.col("window")[step * 14 + k]
    steps = [at(i // 2, i % 2).alias(name) for i, name in enumerate(STEPS)]
    stats = [near(at(3, 2 + i)).alias(name) for i, name in enumerate(STATS_SQL)]
    return out.select("l_suppkey", "window_end", "l_discount", F.size("window").alias("width"), *steps, *stats)


@query(
    "f14_best_window",
    f"""WITH e AS (SELECT l_suppkey, l_quantity::DOUBLE AS y, 25.0::DOUBLE + 100 * l_discount AS p, ROW_NUMBER() OVER ({W_LINE}) - 1 AS rn FROM lineitem),
    w AS (SELECT l_suppkey, rn - 19 AS start_index, sqrt(AVG((y - p) * (y - p)) OVER f) AS s, AVG(abs(y - p)) OVER f AS mae, corr(y, p) OVER f AS c, COUNT(*) OVER f AS n FROM e
      WINDOW f AS (PARTITION BY l_suppkey ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY round(s, 9), start_index) AS k FROM w WHERE n = 20)
    SELECT l_suppkey, start_index, start_index + 20 AS end_index, {near_sql('s')} AS metric_value, {near_sql('s')} AS rmse, {near_sql('mae')} AS mae, {near_sql('c')} AS correlation
    FROM r WHERE k = 1""",
)
def best_window(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("guess", F.lit(25.0) + 100 * F.col("l_discount"))
    out = features.best_window(rows, line_seq(spark, sf_dir), "l_quantity", "guess", 20, "rmse")
    return out.select("l_suppkey", "start_index", "end_index", *[near(c).alias(c) for c in ("metric_value", "rmse", "mae", "correlation")])


@query(
    "k11_tree_features",
    f"""WITH r AS (SELECT *, l_quantity * l_discount AS p FROM lineitem),
    f AS (SELECT {LINE_KEY}, l_extendedprice, LAG(l_quantity, 5) OVER w AS a, LAG(l_discount, 5) OVER w AS b, COUNT(*) OVER f5 AS n, AVG(l_quantity) OVER f5 AS m,
      stddev_pop(l_discount) OVER f5 AS s, (l_quantity - LAG(l_quantity, 4) OVER w) / 4 AS slope, l_tax * AVG(l_quantity) OVER f5 AS cross_mean
      FROM r WINDOW w AS ({W_LINE}), f5 AS ({W_LINE} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT {LINE_KEY}, a, b, {near_sql('m')} AS m, {near_sql('s')} AS s, {near_sql('slope')} AS slope, {near_sql('cross_mean')} AS cross_mean
    FROM f WHERE n = 5 AND a IS NOT NULL""",
)
def tree_features(spark, sf_dir):
    out, _ = features.tree_features(
        lines(spark, sf_dir), line_seq(spark, sf_dir), ["l_quantity", "l_discount"], ["l_tax"], "l_quantity", "l_discount", "l_extendedprice",
        "full", 5, [0, 5, 10], [5, 25], feed="l_tax",
    )
    return out.select(
        *KEY, F.col("l_quantity_lag_5").alias("a"), F.col("l_discount_lag_5").alias("b"), near("l_quantity_roll_5_mean").alias("m"),
        near("l_discount_roll_5_std").alias("s"), near("l_quantity_roll_5_slope").alias("slope"),
        near("feed_l_quantity_roll_5_mean").alias("cross_mean"),
    )


@query(
    "k11_tree_features_online",
    f"""WITH r AS (SELECT *, l_quantity * l_discount AS p FROM lineitem),
    d AS (SELECT *, l_quantity - LAG(l_quantity) OVER ({W_LINE}) AS dq, p - LAG(p) OVER ({W_LINE}) AS dp FROM r),
    f AS (SELECT {LINE_KEY}, LAG(dq, 5) OVER w AS a, COUNT(dp) OVER f5 AS n, AVG(dp) OVER f5 AS m, stddev_pop(p) OVER f5 AS s
      FROM d WINDOW w AS ({W_LINE}), f5 AS ({W_LINE} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT {LINE_KEY}, a, {near_sql('m')} AS m, {near_sql('s')} AS s FROM f WHERE n = 5 AND a IS NOT NULL""",
)
def tree_features_online(spark, sf_dir):
    out, _ = features.tree_features(
        lines(spark, sf_dir), line_seq(spark, sf_dir), ["l_quantity", "l_discount"], ["l_tax"], "l_quantity", "l_discount", "l_extendedprice",
        "online_dynamics", 5, [0, 5], [5],
    )
    return out.select(
        *KEY, F.col("current_diff_dyn_lag_5").alias("a"), near("product_diff_dyn_roll_5_mean").alias("m"), near("product_dyn_roll_5_std").alias("s")
    )


@query(
    "k12_dynamic_features",
    f"""WITH r AS (SELECT *, l_quantity * l_discount AS p FROM lineitem)
    SELECT {LINE_KEY}, {near_sql('p')} AS power, {near_sql('CASE WHEN l_tax > 1e-6 THEN p / l_tax ELSE 0 END')} AS specific_power,
    {near_sql('COALESCE(p - LAG(p) OVER w, 0)')} AS power_diff, {near_sql('CASE WHEN COUNT(*) OVER f5 = 5 THEN AVG(p) OVER f5 ELSE 0 END')} AS power_mean,
    {near_sql('CASE WHEN COUNT(*) OVER f5 = 5 THEN stddev_pop(l_quantity) OVER f5 ELSE 0 END')} AS current_std,
    {near_sql('COALESCE((l_quantity - LAG(l_quantity, 4) OVER w) / 4, 0)')} AS current_slope
    FROM r WINDOW w AS ({W_LINE}), f5 AS ({W_LINE} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def dynamic_features(spark, sf_dir):
    out, _ = features.dynamic_features(lines(spark, sf_dir), line_seq(spark, sf_dir), "l_quantity", "l_discount", [5], "l_tax", extended=True)
    picked = {
        "power": "power", "specific_power": "specific_power", "power_diff": "power_diff", "power_roll_5_mean": "power_mean",
        "l_quantity_roll_5_std": "current_std", "l_quantity_roll_5_slope": "current_slope",
    }
    return out.select(*KEY, *[near(c).alias(n) for c, n in picked.items()])


@query(
    "e8_pearson",
    f"""SELECT l_suppkey, {near_sql('corr(l_extendedprice, l_quantity)')} AS r, COUNT(*) AS n_pairs FROM lineitem WHERE l_tax > 0 GROUP BY l_suppkey""",
)
def pearson(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("price", F.when(F.col("l_tax") > 0, F.col("l_extendedprice")))
    return metrics.pearson(rows, "price", "l_quantity", ("l_suppkey",)).withColumn("r", near("r"))


LAGS = 10


@query(
    "e9_lag_correlations",
    f"""WITH w AS (SELECT l_extendedprice AS y, {', '.join(f'LAG({c}, {k}) OVER w AS {n}{k}' for c, n in (('l_quantity', 'q'), ('l_tax', 't')) for k in range(LAGS + 1))}
      FROM lineitem WINDOW w AS ({W_LINE}))
    """ + " UNION ALL ".join(
        f"SELECT '{c}' AS input, {k} AS lag, {near_sql(f'corr(y, {n}{k})')} AS r, COUNT({n}{k}) AS n_pairs FROM w"
        for c, n in (("l_quantity", "q"), ("l_tax", "t")) for k in range(LAGS + 1)
    ),
)
def lag_correlations(spark, sf_dir):
    out = metrics.lag_correlations(lines(spark, sf_dir), line_seq(spark, sf_dir), "l_extendedprice", ["l_quantity", "l_tax"], LAGS)
    return out.withColumn("r", near("r"))
