"""Registered queries: linear models, simulation and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import features, grid, linear, metrics, split
from strandline.plans.jobs import Run
from strandline.plans.registry import query
from strandline.plans.splits import CHUNK_SQL, LENGTH, GAP, MIN_ROWS, chunks, with_roles
from strandline.plans.stand_ins import LINE_SEQ, lines, near, near_sql, table
from strandline.session import cut_lineage


CHUNK_SEQ = split.chunk_sequence(LINE_SEQ)
Y, X = "l_quantity", "l_discount"
C_KEY = "l_suppkey, chunk_index, sample_index"

PAIRS_SQL = CHUNK_SQL + f""",
m AS (SELECT {C_KEY}, sample_index - source_row_start AS p, {Y} AS y, LAG({Y}) OVER w AS y1, LAG({X}) OVER w AS u1
      FROM c WINDOW w AS (PARTITION BY l_suppkey, chunk_index ORDER BY sample_index)),
s AS (SELECT SUM(y1 * y1) AS a, SUM(y1 * u1) AS b, SUM(u1 * u1) AS d, SUM(y1 * y) AS e, SUM(u1 * y) AS f, COUNT(*) AS n FROM m WHERE y1 IS NOT NULL),
th AS (SELECT (e * d - b * f) / (a * d - b * b) AS t1, (a * f - b * e) / (a * d - b * b) AS t2, n FROM s)
"""


def fitted(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    return rows, linear.fit_arx(rows, CHUNK_SEQ, Y, [X], 1, 1, 1)


@query(
    "e10_gram",
    PAIRS_SQL + f"""SELECT UNNEST([0, 0, 0, 1, 1, 2, -1])::INTEGER AS i, UNNEST([0, 1, 2, 1, 2, 2, -1])::INTEGER AS j,
    UNNEST([{near_sql('a', 3)}, {near_sql('b', 3)}, {near_sql('e', 3)}, {near_sql('d', 3)}, {near_sql('f', 3)}, {near_sql('yy', 3)}, {near_sql('n', 3)}]) AS s
    FROM s, (SELECT SUM(y * y) AS yy FROM m WHERE y1 IS NOT NULL)""",
)
def gram(spark, sf_dir):
    rows = features.lag_matrix(chunks(spark, sf_dir), CHUNK_SEQ, Y, [X], 1, 1, 1).filter(features.usable("phi", Y))
    return linear.gram(rows, "phi", Y, 2).select("i", "j", near("s", 3).alias("s"))


@query(
    "e10_gram_sql",
    f"""SELECT COUNT(*) AS n, {near_sql('SUM(l_quantity * l_quantity)', 3)} AS qq, {near_sql('SUM(l_quantity * l_tax)', 3)} AS qt,
    {near_sql('SUM(l_tax * l_tax)', 3)} AS tt FROM lineitem""",
)
def gram_sql(spark, sf_dir):
    out = linear.gram_sql(lines(spark, sf_dir), ["l_quantity"], "l_tax")
    return out.select(
        "n", near("l_quantity__l_quantity", 3).alias("qq"), near("l_quantity__l_tax", 3).alias("qt"), near("l_tax__l_tax", 3).alias("tt")
    )


@query(
    "k1_fit_arx",
    PAIRS_SQL + f"""SELECT 'a1' AS name, {near_sql('t1')} AS value, n AS n_samples FROM th
    UNION ALL SELECT 'b_l_discount_delay1', {near_sql('t2')}, n FROM th""",
)
def fit_arx(spark, sf_dir):
    _, model = fitted(spark, sf_dir)
    rows = spark.createDataFrame([(n, v, model.n_samples) for n, v in zip(model.names, model.theta)], "name string, value double, n_samples bigint")
    return rows.withColumn("value", near("value"))


@query(
    "k10_predict_one_step",
    PAIRS_SQL + f"""SELECT {C_KEY.replace('chunk_index', 'chunk_index::BIGINT AS chunk_index')}, p >= 1 AS has_full_history,
    {near_sql('t1 * y1 + t2 * u1', 5)} AS y_pred FROM m, th""",
)
def predict_one_step(spark, sf_dir):
    rows, model = fitted(spark, sf_dir)
    out = linear.predict_one_step(rows, CHUNK_SEQ, model)
    return out.select("l_suppkey", "chunk_index", "sample_index", "has_full_history", near("y_pred_osa", 5).alias("y_pred"))


@query(
    "j2_simulate_linear",
    PAIRS_SQL.replace("WITH r AS", "WITH RECURSIVE r AS") + f""",
    sim AS (SELECT l_suppkey, chunk_index, sample_index, p, y AS v FROM m WHERE p = 0
      UNION ALL SELECT m.l_suppkey, m.chunk_index, m.sample_index, m.p, t1 * sim.v + t2 * m.u1
      FROM sim JOIN m ON m.l_suppkey = sim.l_suppkey AND m.chunk_index = sim.chunk_index AND m.p = sim.p + 1 CROSS JOIN th)
    SELECT l_suppkey, chunk_index::BIGINT AS chunk_index, sample_index, CASE WHEN p > 0 THEN {near_sql('v', 5)} END AS y_pred FROM sim""",
)
def simulate_linear(spark, sf_dir):
    rows, model = fitted(spark, sf_dir)
    out = linear.simulate_linear(rows, CHUNK_SEQ, model)
    return out.select("l_suppkey", "chunk_index", "sample_index", near("y_pred_freerun", 5).alias("y_pred"))


@query(
    "j4_simulate_delta",
    PAIRS_SQL.replace("WITH r AS", "WITH RECURSIVE r AS") + f""",
    sim AS (SELECT l_suppkey, chunk_index, sample_index, p, y AS v FROM m WHERE p = 0
      UNION ALL SELECT m.l_suppkey, m.chunk_index, m.sample_index, m.p, LEAST(GREATEST(sim.v - 0.5 * sim.v + 150 * m.u1, 10), 30)
      FROM sim JOIN m ON m.l_suppkey = sim.l_suppkey AND m.chunk_index = sim.chunk_index AND m.p = sim.p + 1)
    SELECT l_suppkey, chunk_index::BIGINT AS chunk_index, sample_index, CASE WHEN p > 0 THEN {near_sql('v', 5)} END AS y_pred FROM sim""",
)
def simulate_delta(spark, sf_dir):
    model = linear.LinearModel(Y, (X,), 1, 1, 1, (-0.5, 150.0), 0)
    out = linear.simulate_linear(
        chunks(spark, sf_dir), CHUNK_SEQ, model, mode="delta", bounds=(10.0, 30.0), seed_missing=float("nan")
    )
    return out.select("l_suppkey", "chunk_index", "sample_index", near("y_pred_freerun", 5).alias("y_pred"))


POWER = linear.PowerModel(
    linear.LinearModel(Y, (X,), 1, 1, 1, (), 0), (25.0, 0.05), (14.0, 0.03), linear.additive_terms(2, 2, 1), 0.1, (0.0, 60.0), False,
    (25.0, 6.0, 3.0, -2.0),
)
POWER_STEP = "25.0 + 6.0 * ({prev} - 25.0) / 14.0 + 3.0 * (m.u1 - 0.05) / 0.03 - 2.0 * pow((m.u1 - 0.05) / 0.03, 2)"


@query(
    "j3_simulate_powers",
    PAIRS_SQL.replace("WITH r AS", "WITH RECURSIVE r AS") + f""",
    sim AS (SELECT l_suppkey, chunk_index, sample_index, p, y AS v FROM m WHERE p = 0
      UNION ALL SELECT m.l_suppkey, m.chunk_index, m.sample_index, m.p, {POWER_STEP.format(prev='sim.v')}
      FROM sim JOIN m ON m.l_suppkey = sim.l_suppkey AND m.chunk_index = sim.chunk_index AND m.p = sim.p + 1)
    SELECT l_suppkey, chunk_index::BIGINT AS chunk_index, sample_index, CASE WHEN p > 0 THEN {near_sql('v', 5)} END AS y_pred FROM sim""",
)
def simulate_powers(spark, sf_dir):
    out = linear.simulate_powers(chunks(spark, sf_dir), CHUNK_SEQ, POWER)
    return out.select("l_suppkey", "chunk_index", "sample_index", near("y_pred_freerun", 5).alias("y_pred"))


@query(
    "k10_predict_one_step_powers",
    PAIRS_SQL + f"""SELECT l_suppkey, chunk_index::BIGINT AS chunk_index, sample_index,
    {near_sql(POWER_STEP.format(prev='m.y1'), 5)} AS y_pred FROM m""",
)
def one_step_powers(spark, sf_dir):
    out = linear.predict_one_step_powers(chunks(spark, sf_dir), CHUNK_SEQ, POWER)
    return out.select("l_suppkey", "chunk_index", "sample_index", near("y_pred_osa", 5).alias("y_pred"))


@query("k2_fit_power_ridge")
def fit_power_ridge(spark, sf_dir):
    model = linear.fit_power_ridge(chunks(spark, sf_dir), CHUNK_SEQ, Y, [X, "l_tax"], 2, 2, 0, 3, 1.0)
    rows = spark.createDataFrame(list(zip(model.names, model.theta)), "name string, value double")
    return rows.withColumn("value", near("value"))


def split_rows(spark, sf_dir):
    """Chunk rows with their roles, computed once: a fit and a score read them several times."""
    rows = chunks(spark, sf_dir).select("l_suppkey", "chunk_index", "sample_index", Y, X, "l_tax")
    roles = with_roles(spark, sf_dir, trials=50).select("l_suppkey", "chunk_index", "split_role")
    return cut_lineage(rows.join(roles, ["l_suppkey", "chunk_index"]))


def shown_scores(scores):
    """Scores of a search, rounded for a comparison."""
    digits = {"rmse": 5, "mae": 5, "r2": 5, "aic": 2, "bic": 2}
    return scores.select("na", "nb", "nk", "n_params", "n_train", "n_samples", "status", *[near(c, d).alias(c) for c, d in digits.items()])


@query("k3_grid_search")
def grid_search(spark, sf_dir):
    rows = split_rows(spark, sf_dir)
    train, validation = (rows.filter(F.col("split_role") == r) for r in ("train", "validation"))
    scores, _ = grid.grid_search(train, validation, CHUNK_SEQ, Y, [X, "l_tax"], [0, 1, 3], [0, 1, 3], [0, 1])
    return shown_scores(metrics.ranked(scores, "selection_score", "na", "nb", "nk"))


@query("k3_grid_search_free_run")
def grid_search_free_run(spark, sf_dir):
    rows = split_rows(spark, sf_dir)
    train, validation = (rows.filter(F.col("split_role") == r) for r in ("train", "validation"))
    scores, _ = grid.grid_search(train, validation, CHUNK_SEQ, Y, [X], [0, 1, 2], [1], [0, 1], mode="free_run", metric="bic")
    return shown_scores(scores)


@query("k3_live_inputs")
def engineered_fit(spark, sf_dir):
    """ARX over the engineered input family: rolling, ratio and pair features of the live signals."""
    rows, names = features.live_inputs(
        chunks(spark, sf_dir), CHUNK_SEQ, "engineered", 5, "l_quantity", "l_tax", ["l_quantity", "l_tax"], "l_discount"
    )
    model = linear.fit_arx(rows, CHUNK_SEQ, "l_extendedprice", names, 1, 1, 0, reach=features.input_reach("engineered", 5)["reach"])
    return spark.createDataFrame(list(zip(model.names, model.theta)), "name string, value double")


@query("k3_specified_inputs")
def specified_fit(spark, sf_dir):
    rows, names = features.live_inputs(
        chunks(spark, sf_dir), CHUNK_SEQ, "specified", 3, "l_quantity", "l_tax", ["l_quantity", "l_tax"], "l_discount"
    )
    model = linear.fit_arx(rows, CHUNK_SEQ, "l_extendedprice", names, 1, 3, 1, **features.input_reach("specified", 3))
    return spark.createDataFrame(list(zip(model.names, model.theta)), "name string, value double")


def specified_model(spark, sf_dir):
    """Chunks with the specified inputs of two rows, and a model of given weights over them."""
    rows, names = features.live_inputs(chunks(spark, sf_dir), CHUNK_SEQ, "specified", 2, "l_tax", X, [], X)
    theta = (0.5, *[0.25 * (k + 1) for k in range(len(names))])
    return rows, linear.LinearModel(Y, tuple(names), 1, 2, 1, theta, 0, **features.input_reach("specified", 2))


SPECIFIED_SQL = CHUNK_SQL + f""",
f AS (SELECT {C_KEY}, sample_index - source_row_start AS p, {Y} AS y, LAG({Y}) OVER w AS y1, l_tax AS i0, LAG(l_tax) OVER w AS i1, l_discount AS u0,
      LAG(l_discount) OVER w AS u1 FROM c WINDOW w AS (PARTITION BY l_suppkey, chunk_index ORDER BY sample_index)),
d AS (SELECT *, 0.25 * (i0 + 2 * i1 + 3 * u0 + 4 * u1 + 5 * i0 * u0 + 6 * i1 * u1 + 7 * (i0 + i1) / 2 + 8 * (u0 + u1) / 2 + 9 * abs(i0 - i1) / 2
      + 10 * abs(u0 - u1) / 2 + 11 * (i0 - i1) + 12 * (u0 - u1) + 13 * LEAST(i0, i1) + 14 * LEAST(u0, u1) + 15 * GREATEST(i0, i1) + 16 * GREATEST(u0, u1)
      + 17 * u0) AS drive FROM f),
m AS (SELECT *, LAG(drive) OVER (PARTITION BY l_suppkey, chunk_index ORDER BY sample_index) AS drive1 FROM d)
"""


@query(
    "j2_simulate_specified",
    SPECIFIED_SQL.replace("WITH r AS", "WITH RECURSIVE r AS") + f""",
    sim AS (SELECT l_suppkey, chunk_index, p, y AS v FROM m WHERE p = 1
      UNION ALL SELECT m.l_suppkey, m.chunk_index, m.p, 0.5 * sim.v + m.drive1
      FROM sim JOIN m ON m.l_suppkey = sim.l_suppkey AND m.chunk_index = sim.chunk_index AND m.p = sim.p + 1)
    SELECT m.l_suppkey, m.chunk_index::BIGINT AS chunk_index, m.sample_index, CASE WHEN m.p > 1 THEN {near_sql('0.5 * m.y1 + m.drive1', 5)} END AS one_step,
    CASE WHEN m.p > 1 THEN {near_sql('sim.v', 5)} END AS y_pred FROM m LEFT JOIN sim ON m.l_suppkey = sim.l_suppkey AND m.chunk_index = sim.chunk_index AND m.p = sim.p""",
)
def simulate_specified(spark, sf_dir):
    """Rolling inputs: predictions start at the first row whose delayed inputs are all there."""
    rows, model = specified_model(spark, sf_dir)
    out = linear.predict_aligned(rows, CHUNK_SEQ, model)
    return out.select("l_suppkey", "chunk_index", "sample_index", near("y_pred_osa", 5).alias("one_step"), near("y_pred_freerun", 5).alias("y_pred"))


@query("j2_simulate_engineered")
def simulate_engineered(spark, sf_dir):
    """Fitted over the engineered inputs, then run freely."""
    rows, names = features.live_inputs(
        chunks(spark, sf_dir), CHUNK_SEQ, "engineered", 5, "l_quantity", "l_tax", ["l_quantity", "l_tax"], X
    )
    model = linear.fit_arx(rows, CHUNK_SEQ, "l_extendedprice", names, 1, 1, 0, reach=features.input_reach("engineered", 5)["reach"])
    out = linear.simulate_linear(rows, CHUNK_SEQ, model)
    return out.select("l_suppkey", "chunk_index", "sample_index", "has_full_history", "y_pred_freerun")


def arx_run(spark, sf_dir) -> Run:
    """Fit on train chunks, predict and score the others, and gather every result table."""
    rows = split_rows(spark, sf_dir)
    train, validation = (rows.filter(F.col("split_role") == r) for r in ("train", "validation"))
    scores, best = grid.grid_search(train, validation, CHUNK_SEQ, Y, [X, "l_tax"], [0, 1, 2], [1, 2], [0, 1])
    predicted = linear.predict_aligned(rows, CHUNK_SEQ, best)
    scored = metrics.metrics_by(
        predicted.filter("has_full_history"), Y, {"one_step_ahead": "y_pred_osa", "free_run": "y_pred_freerun"}, ("split_role",)
    )
    coefficients = spark.createDataFrame(list(zip(best.names, best.theta)), "name string, value double")
    manifest = rows.groupBy("l_suppkey", "chunk_index", "split_role").agg(
        F.count("*").alias("n_rows"), F.min("sample_index").alias("start_sample_index"), F.max("sample_index").alias("end_sample_index")
    )
    tables = {"coefficients": coefficients, "grid": scores, "predictions": predicted, "metrics": scored, "manifest": manifest}
    return Run(tables, {"target": Y, "na": best.na, "nb": best.nb, "nk": best.nk, "length": LENGTH, "gap": GAP, "min_rows": MIN_ROWS})


@query("arx_job")
def arx_job(spark, sf_dir):
    return arx_run(spark, sf_dir).tables["metrics"]


@query(
    "e12_target_bounds",
    f"""SELECT {near_sql('MIN(l_quantity) - 0.25 * (MAX(l_quantity) - MIN(l_quantity))')} AS low,
    {near_sql('MAX(l_quantity) + 0.25 * (MAX(l_quantity) - MIN(l_quantity))')} AS high FROM lineitem""",
)
def target_bounds(spark, sf_dir):
    out = metrics.target_bounds(lines(spark, sf_dir), "l_quantity", margin=0.25, relative=True)
    return out.select(near("low").alias("low"), near("high").alias("high"))


def guesses(spark, sf_dir):
    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = lines(spark, sf_dir, "l_returnflag").join(nation, "l_suppkey")
    return rows.withColumns(
        {
            "y": F.col("l_extendedprice") / 1000,
            "p": F.when(F.col("l_tax") > 0.01, 20 + F.col("l_quantity")),
            "p2": F.col("l_quantity") * 1.5,
            "region": F.when(F.col("s_nationkey") > 3, F.col("s_nationkey")),
        }
    )


GUESS_SQL = """
WITH g AS (SELECT *, l_extendedprice / 1000 AS y, CASE WHEN l_tax > 0.01 THEN 20 + l_quantity END AS p, l_quantity * 1.5 AS p2,
  CASE WHEN s_nationkey > 3 THEN s_nationkey END AS region FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
"""


def errors_sql(y: str, p: str) -> dict[str, str]:
    e = f"({p} - {y})"
    return {
        "n_samples": "COUNT(*)",
        "rmse": near_sql(f"sqrt(AVG({e} * {e}))"),
        "mae": near_sql(f"AVG(abs({e}))"),
        "bias": near_sql(f"AVG({e})"),
        "r2": near_sql(f"1 - SUM({e} * {e}) / (COUNT(*) * var_pop({y}))"),
        "rrse": near_sql(f"sqrt(SUM({e} * {e}) / (COUNT(*) * var_pop({y})))"),
        "fit_pct": near_sql(f"100 * (1 - sqrt(SUM({e} * {e})) / sqrt(COUNT(*) * var_pop({y})))", 5),
        "nrmse": near_sql(f"sqrt(AVG({e} * {e})) / (MAX({y}) - MIN({y}))"),
        "mape": near_sql(f"100 * AVG(CASE WHEN abs({y}) > 1e-8 THEN abs({e} / {y}) END)", 4),
    }


DIGITS = {"fit_pct": 5, "mape": 4, "aic": 3, "bic": 3}


def rounded(df):
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    base = lambda c: c.removeprefix("high_")
    return df.withColumns({c: near(c, DIGITS.get(base(c), 6)) for c in doubles})


def select_sql(parts: dict[str, str], prefix: str = "") -> str:
    return ", ".join(f"{v} AS {prefix}{k}" for k, v in parts.items())


@query(
    "l1_l2_l3_metrics",
    GUESS_SQL + f"SELECT s_nationkey, {select_sql(errors_sql('y', 'p'))} FROM g WHERE p IS NOT NULL GROUP BY s_nationkey",
)
def error_metrics(spark, sf_dir):
    return rounded(metrics.metrics(guesses(spark, sf_dir), "y", "p", ("s_nationkey",)))


@query(
    "l4_information_criteria",
    GUESS_SQL + f"""SELECT s_nationkey, COUNT(*) AS n_samples,
    {near_sql('COUNT(*) * (ln(2 * pi() * SUM((p - y) ** 2) / COUNT(*)) + 1) + 2 * 4', 3)} AS aic,
    {near_sql('COUNT(*) * (ln(2 * pi() * SUM((p - y) ** 2) / COUNT(*)) + 1) + 4 * ln(COUNT(*))', 3)} AS bic
    FROM g WHERE p IS NOT NULL GROUP BY s_nationkey""",
)
def criteria(spark, sf_dir):
    out = metrics.metrics(guesses(spark, sf_dir), "y", "p", ("s_nationkey",), n_params=3)
    return rounded(out).select("s_nationkey", "n_samples", "aic", "bic")


@query(
    "l5_zero_class",
    GUESS_SQL + f""", z AS (SELECT s_nationkey, y <= 30 AS t, p <= 40 - 10 AS q FROM g WHERE p IS NOT NULL),
    k AS (SELECT s_nationkey, COUNT(*) AS n, COUNT(*) FILTER (t) AS nt, COUNT(*) FILTER (q) AS nq, COUNT(*) FILTER (t = q) AS same,
      COUNT(*) FILTER (t AND q) AS tp FROM z GROUP BY s_nationkey),
    r AS (SELECT *, CASE WHEN nq > 0 THEN tp / nq END AS pr, CASE WHEN nt > 0 THEN tp / nt END AS rc FROM k)
    SELECT s_nationkey, {near_sql('nt / n')} AS zero_true_rate, {near_sql('nq / n')} AS zero_pred_rate, {near_sql('same / n')} AS zero_accuracy,
    {near_sql('pr')} AS zero_precision, {near_sql('rc')} AS zero_recall, {near_sql('CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) END')} AS zero_f1 FROM r""",
)
def zero_class(spark, sf_dir):
    out = rounded(metrics.metrics(guesses(spark, sf_dir), "y", "p", ("s_nationkey",), zero_threshold=30.0))
    return out.select("s_nationkey", *[c for c in out.columns if c.startswith("zero_")])


@query(
    "l6_c11_high_values",
    GUESS_SQL + f"SELECT s_nationkey, {select_sql(errors_sql('y', 'p'), 'high_')} FROM g WHERE p IS NOT NULL AND y >= 30 GROUP BY s_nationkey",
)
def high_values(spark, sf_dir):
    out = rounded(metrics.metrics(guesses(spark, sf_dir), "y", "p", ("s_nationkey",), high_threshold=30.0))
    return out.select("s_nationkey", *[c for c in out.columns if c.startswith("high_")])


@query(
    "l7_strict_scores",
    GUESS_SQL + f"""SELECT l_returnflag, l_linenumber, COUNT(*) FILTER (p IS NULL) > 0 AS worst,
    CASE WHEN COUNT(*) FILTER (p IS NULL) = 0 THEN {near_sql('sqrt(AVG((p - y) * (p - y)))')} END AS rmse FROM g GROUP BY l_returnflag, l_linenumber""",
)
def strict_scores(spark, sf_dir):
    out = metrics.metrics(guesses(spark, sf_dir), "y", "p", ("l_returnflag", "l_linenumber"), strict=True)
    worst = F.col("rmse") == float("inf")
    return out.select("l_returnflag", "l_linenumber", worst.alias("worst"), F.when(~worst, near("rmse")).alias("rmse"))


@query(
    "e11_metrics_by",
    GUESS_SQL + f""", l AS (SELECT 'one' AS mode, region, l_returnflag, y, p FROM g UNION ALL SELECT 'two', region, l_returnflag, y, p2 FROM g)
    SELECT mode, region, l_returnflag, COUNT(p) AS n_samples, {near_sql('sqrt(AVG((p - y) * (p - y)))')} AS rmse,
    {near_sql('AVG(y)')} AS truth_mean, {near_sql('AVG(p)')} AS prediction_mean, COUNT(*) AS n_rows FROM l GROUP BY mode, region, l_returnflag""",
)
def metrics_by(spark, sf_dir):
    out = rounded(metrics.metrics_by(guesses(spark, sf_dir), "y", {"one": "p", "two": "p2"}, ("region", "l_returnflag")))
    return out.select("mode", "region", "l_returnflag", "n_samples", "rmse", "truth_mean", "prediction_mean", "n_rows")


@query(
    "g3_select_best",
    GUESS_SQL + f""", k AS (SELECT s_nationkey, {near_sql('sqrt(AVG((p - y) * (p - y)))')} AS rmse FROM g WHERE p IS NOT NULL GROUP BY s_nationkey)
    SELECT s_nationkey, rmse FROM k ORDER BY rmse, s_nationkey LIMIT 1""",
)
def select_best(spark, sf_dir):
    return metrics.select_best(error_metrics(spark, sf_dir).select("s_nationkey", "rmse"), "rmse", "s_nationkey")


@query(
    "g4_ranked",
    GUESS_SQL + f"""SELECT s_nationkey, {near_sql('sqrt(AVG((p - y) * (p - y)))')} AS rmse FROM g WHERE p IS NOT NULL GROUP BY s_nationkey
    ORDER BY 2 NULLS LAST, 1""",
)
def ranked(spark, sf_dir):
    return metrics.ranked(error_metrics(spark, sf_dir).select("s_nationkey", "rmse"), "rmse", "s_nationkey")
