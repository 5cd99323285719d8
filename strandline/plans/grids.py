"""Registered queries: searches over orders, families, degrees and penalties, with SQL that solves the same normal equations."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import functions as F

from strandline.operators import grid, linear
from strandline.plans.models import CHUNK_SEQ, X, Y
from strandline.plans.registry import ORACLES, query
from strandline.plans.splits import CHUNK_SQL, chunks, roles_sql
from strandline.plans.stand_ins import near, near_sql
from strandline.session import cut_lineage

ORDERS = ([0, 1, 3, 5, 10, 25, 50], [0, 1, 3, 5, 10, 25, 50], [0, 1, 2, 3, 4, 5])  # fixed values: the published 294 combinations


def lag_rows_sql(head: str, role: str, source: str = "c") -> str:
    """CTEs up to ``m``: chunk rows with their role and the lags that the candidates use."""
    return head + f""",
m AS MATERIALIZED (SELECT l_suppkey, chunk_index, sample_index - source_row_start AS p, {Y} AS y, {role} AS role,
  {", ".join(f"LAG({Y}, {k}) OVER w AS y{k}" for k in (1, 2, 3))},
  {", ".join(f"LAG({c}, {k}) OVER w AS {n}{k}" for c, n in ((X, "u"), ("l_tax", "v")) for k in range(4))}
  FROM {source} WINDOW w AS (PARTITION BY l_suppkey, chunk_index ORDER BY sample_index))
"""


STRIPED_SQL = lag_rows_sql(CHUNK_SQL, "CASE WHEN (l_suppkey + chunk_index) % 5 < 3 THEN 'train' WHEN (l_suppkey + chunk_index) % 5 = 3 THEN 'validation' ELSE 'test' END")
SHUFFLED_SQL = lag_rows_sql(
    roles_sql(50) + ", placed AS (SELECT l_suppkey, chunk_index, role AS placed_role FROM roles JOIN won USING (l_suppkey, t))",
    "placed_role", "c JOIN placed USING (l_suppkey, chunk_index)",
)


@dataclass(frozen=True)
class SqlModel:
    """A candidate as SQL expressions over ``m``: base terms, the first usable row, powers of standardised terms and a penalty."""

    base: tuple[str, ...]
    start: int
    powers: tuple[tuple[int, int], ...] | None = None
    alpha: float = 0.0


def _terms(x: SqlModel) -> list[str]:
    if x.powers is None:
        return [f"b{i}" for i in range(len(x.base))]
    return ["1.0::DOUBLE" if p == 0 else f"pow(b{k}, {p})" for k, p in x.powers]


def solved_sql(models: list[SqlModel]) -> str:
    """CTEs: d<k> rows of model k, theta (m, i, v) of all models by Gauss-Jordan elimination on the training rows."""
    out, sums, deepest = [], [], 0
    for k, x in enumerate(models):
        base = [f"({b})::DOUBLE" for b in x.base]
        if x.powers is not None:
            scale = ", ".join(f"AVG({b}) AS a{i}, stddev_pop({b}) AS s{i}" for i, b in enumerate(base))
            out.append(f"k{k} AS (SELECT {scale} FROM m WHERE role = 'train' AND p >= {x.start})")
            base = [f"({b} - a{i}) / s{i}" for i, b in enumerate(base)]
        columns = "".join(f", {b} AS b{i}" for i, b in enumerate(base))
        source = "m" if x.powers is None else f"m, k{k}"
        out.append(f"d{k} AS MATERIALIZED (SELECT role, l_suppkey, chunk_index, p, y{columns} FROM {source} WHERE p >= {x.start})")
        terms = _terms(x)
        deepest = max(deepest, len(terms))
        cells = [(i, j) for i in range(len(terms)) for j in range(len(terms))]
        penalty = lambda i, j: f" + {x.alpha!r}" if i == j and i > 0 and x.powers is not None else ""  # noqa: B023, E731
        values = [f"SUM({terms[i]} * {terms[j]}){penalty(i, j)}" for i, j in cells] + [f"SUM({t} * y)" for t in terms]
        if not terms:
            out[-1] = f"d{k} AS MATERIALIZED (SELECT role, l_suppkey, chunk_index, p, y FROM m WHERE p >= {x.start})"
            continue
        rows, columns = [i for i, _ in cells] + list(range(len(terms))), [j for _, j in cells] + [-1] * len(terms)
        sums.append(f"SELECT {k} AS m, UNNEST({rows}) AS i, UNNEST({columns}) AS j, UNNEST([{', '.join(values)}]) AS v FROM d{k} WHERE role = 'train'")
    out.append(f"g0 AS MATERIALIZED ({' UNION ALL '.join(sums)})")
    for c in range(deepest):
        out.append(f"""g{c + 1} AS MATERIALIZED (SELECT a.m, a.i, a.j, CASE WHEN o.v IS NULL THEN a.v WHEN a.i = {c} THEN a.v / o.v ELSE a.v - f.v * r.v / o.v END AS v
        FROM g{c} a LEFT JOIN g{c} o ON o.m = a.m AND o.i = {c} AND o.j = {c} LEFT JOIN g{c} f ON f.m = a.m AND f.i = a.i AND f.j = {c}
        LEFT JOIN g{c} r ON r.m = a.m AND r.i = {c} AND r.j = a.j)""")
    out.append(f"theta AS MATERIALIZED (SELECT m, i, v FROM g{deepest} WHERE j = -1)")
    return ",\n" + ",\n".join(out)


def errors_sql(e: str, y: str, n_params: int) -> str:
    """Further errors of a model, with its information criteria."""
    deviance = f"COUNT({e}) * (ln(2 * pi() * SUM(pow({e}, 2)) / COUNT({e})) + 1)"
    return f"""{near_sql(f"AVG(abs({e}))", 5)} AS mae, {near_sql(f"1 - SUM(pow({e}, 2)) / (COUNT({e}) * var_pop(CASE WHEN {e} IS NOT NULL THEN {y} END))", 5)} AS r2,
    {near_sql(f"{deviance} + 2 * {n_params + 1}", 2)} AS aic, {near_sql(f"{deviance} + {n_params + 1} * ln(COUNT({e}))", 2)} AS bic"""


def scored_sql(models: list[SqlModel], labels: list[str], head: str = STRIPED_SQL, more: bool = False) -> str:
    """One row per model: its label columns, training rows and validation error, one step ahead."""
    parts = []
    for k, (x, label) in enumerate(zip(models, labels)):
        predicted = " + ".join(f"w[{i + 1}] * {t}" for i, t in enumerate(_terms(x))) or "0"
        extra = f", {errors_sql(f'(y - ({predicted}))', 'y', len(_terms(x)))}" if more else ""
        parts.append(f"""SELECT {label}, {len(_terms(x))} AS n_params, (SELECT COUNT(*) FROM d{k} WHERE role = 'train') AS n_train, COUNT(*) AS n_samples,
        {near_sql(f'sqrt(AVG(pow(y - ({predicted}), 2)))', 5)} AS rmse, 'ok' AS status{extra}
        FROM d{k}, (SELECT list(v ORDER BY i) AS w FROM theta WHERE m = {k}) WHERE role = 'validation'""")
    return head + solved_sql(models) + " UNION ALL ".join(parts)


def striped(spark, sf_dir):
    """Train and validation chunk rows; a chunk's role follows from its place."""
    at = F.pmod(F.col("l_suppkey") + F.col("chunk_index"), F.lit(5))
    rows = cut_lineage(chunks(spark, sf_dir).select("l_suppkey", "chunk_index", "sample_index", Y, X, "l_tax").withColumn("at", at))
    return rows.filter("at < 3"), rows.filter("at = 3")


def _shown(spark, rows: Iterable, *columns: str):
    table = spark.createDataFrame([tuple(r) for r in rows], grid.RESULT)
    return table.select(*columns, "n_params", "n_train", "n_samples", near("rmse", 5).alias("rmse"), "status")


def lagged(na: int, nb: int, nk: int, columns: str) -> tuple[str, ...]:
    return (*[f"y{k}" for k in range(1, na + 1)], *[f"{c}{nk + k}" for c in columns for k in range(nb)])


SMALL_ORDERS = [(na, nb, nk) for na in (0, 1, 2) for nb in (1, 2) for nk in (0, 1)]


@query(
    "k3_grid_orders",
    scored_sql(
        [SqlModel(lagged(*o, "uv"), max(o[0], o[2] + o[1] - 1)) for o in SMALL_ORDERS], [f"{na} AS na, {nb} AS nb, {nk} AS nk" for na, nb, nk in SMALL_ORDERS]
    ),
)
def grid_orders(spark, sf_dir):
    train, validation = striped(spark, sf_dir)
    rows, _ = grid.search(train, validation, CHUNK_SEQ, grid.arx_grid(Y, [X, "l_tax"], [0, 1, 2], [1, 2], [0, 1]))
    return _shown(spark, rows, "na", "nb", "nk")


FREE_ORDERS = [(na, 1, nk) for na in (0, 1, 2) for nk in (0, 1)]


def free_run_sql(head: str = STRIPED_SQL, more: bool = False) -> str:
    models = [SqlModel(lagged(*o, "u"), max(o[0], o[2])) for o in FREE_ORDERS]
    runs, scores = [], []
    for k, ((na, nb, nk), x) in enumerate(zip(FREE_ORDERS, models)):
        step = " + ".join([*[f"w[{i + 1}] * s.v{i + 1}" for i in range(na)], f"w[{na + 1}] * m.u{nk}"])
        runs.append(f"""f{k} AS (SELECT role, l_suppkey, chunk_index, p, y, NULL::DOUBLE AS out, y AS v1, 0.0::DOUBLE AS v2 FROM m WHERE p = 0 AND {x.start} > 0
          UNION ALL SELECT role, l_suppkey, chunk_index, -1, NULL, NULL, 0.0, 0.0 FROM m WHERE p = 0 AND {x.start} = 0
          UNION ALL SELECT m.role, m.l_suppkey, m.chunk_index, m.p, m.y, CASE WHEN m.p >= {x.start} THEN {step} END, CASE WHEN m.p >= {x.start} THEN {step} ELSE m.y END, s.v1
          FROM f{k} s JOIN m ON m.l_suppkey = s.l_suppkey AND m.chunk_index = s.chunk_index AND m.p = s.p + 1, (SELECT list(v ORDER BY i) AS w FROM theta WHERE m = {k}))""")
        extra = f", {errors_sql('(y - out)', 'y', na + 1)}" if more else ""
        scores.append(f"""SELECT {na} AS na, {nb} AS nb, {nk} AS nk, {na + 1} AS n_params, (SELECT COUNT(*) FROM d{k} WHERE role = 'train') AS n_train,
        COUNT(out) AS n_samples, {near_sql('sqrt(AVG(pow(y - out, 2)))', 5)} AS rmse, 'ok' AS status{extra} FROM f{k} WHERE role = 'validation'""")
    head = head.replace("WITH r AS", "WITH RECURSIVE r AS")
    return head + solved_sql(models) + ",\n" + ",\n".join(runs) + " UNION ALL ".join(scores)


@query("k3_grid_orders_free_run", free_run_sql())
def grid_orders_free_run(spark, sf_dir):
    train, validation = striped(spark, sf_dir)
    rows, _ = grid.search(train, validation, CHUNK_SEQ, grid.arx_grid(Y, [X], [0, 1, 2], [1], [0, 1]), mode="free_run")
    return _shown(spark, rows, "na", "nb", "nk")


DEGREES, ALPHAS = (1, 2, 3), (0.0, 10.0)
POWER_ORDERS = [(na, 1, nk, d, a) for na in (0, 1) for nk in (0, 1) for d in DEGREES for a in ALPHAS]


@query(
    "k3_grid_powers",
    scored_sql(
        [SqlModel(lagged(na, nb, nk, "uv"), max(na, nk), linear.additive_terms(na + 2 * nb, d, na), a) for na, nb, nk, d, a in POWER_ORDERS],
        [f"{na} AS na, {nb} AS nb, {nk} AS nk, {d} AS degree, {a!r}::DOUBLE AS alpha" for na, nb, nk, d, a in POWER_ORDERS],
    ),
)
def grid_powers(spark, sf_dir):
    """Orders, degrees and penalties in one search."""
    train, validation = striped(spark, sf_dir)
    candidates = grid.power_grid(Y, [X, "l_tax"], [0, 1], [1], [0, 1], list(DEGREES), list(ALPHAS))
    rows, _ = grid.search(train, validation, CHUNK_SEQ, candidates)
    return _shown(spark, rows, "na", "nb", "nk", "degree", "alpha")


# Rolling inputs over two rows lie in the span of both rows, their products and the size of their difference.
SPAN = ("v0", "v1", "u0", "u1", "v0 * u0", "v1 * u1", "abs(v0 - v1)", "abs(u0 - u1)")
FAMILY_MODELS = [
    *[("raw", na, nb, 0, SqlModel(lagged(na, nb, 0, "uv"), max(na, nb - 1)), na + 2 * nb) for na in (0, 1) for nb in (1, 2)],
    *[("specified", na, 2, 0, SqlModel((*lagged(na, 0, 0, ""), *SPAN), max(na, 1)), na + 17) for na in (0, 1)],
]


def _family_oracle() -> str:
    labels = [f"'{f}' AS family, {na} AS na, {nb} AS nb, {nk} AS nk, {size} AS n_terms" for f, na, nb, nk, _, size in FAMILY_MODELS]
    found = scored_sql([x for *_, x, _ in FAMILY_MODELS], labels)
    head, tail = found.rsplit("theta AS MATERIALIZED", 1)
    definition, select = tail.split(")", 1)
    return f"{head}theta AS MATERIALIZED{definition}) SELECT family, na, nb, nk, n_terms, n_train, n_samples, FLOOR(rmse * 1e3 + 0.5137) / 1e3 AS rmse, status FROM ({select})"


@query("k3_grid_families", _family_oracle())
def grid_families(spark, sf_dir):
    """Input families, each with its own inputs, delays and reach for every nb."""
    train, validation = striped(spark, sf_dir)
    out = None
    for family, nbs in (("raw", [1, 2]), ("specified", [2])):
        made, candidates = grid.family_grid(train, CHUNK_SEQ, family, Y, [0, 1], nbs, [0], "l_tax", X, [], X)
        held, _ = grid.family_grid(validation, CHUNK_SEQ, family, Y, [0, 1], nbs, [0], "l_tax", X, [], X)
        rows, _ = grid.search(made, held, CHUNK_SEQ, candidates)
        shown = _shown(spark, rows, "na", "nb", "nk").withColumn("family", F.lit(family)).withColumnRenamed("n_params", "n_terms")
        out = shown if out is None else out.unionByName(shown)
    return out.withColumn("rmse", near("rmse", 3))


@query("k3_grid_published")
def grid_published(spark, sf_dir):
    """All 294 published combinations."""
    train, validation = striped(spark, sf_dir)
    rows, _ = grid.search(train, validation, CHUNK_SEQ, grid.arx_grid(Y, [X, "l_tax"], *ORDERS))
    return grid.scores_table(train, rows)


def _ridge_oracle() -> str:
    x = SqlModel(lagged(2, 2, 0, "uv"), 2, linear.additive_terms(6, 3, 2), 1.0)
    base = linear.LinearModel(Y, (X, "l_tax"), 2, 2, 0, (), 0)
    names = linear.PowerModel(base, (), (), x.powers, 1.0, (0.0, 0.0)).names
    every_row = lag_rows_sql(CHUNK_SQL, "'train'")
    listed = ", ".join(f"'{n}'" for n in names)
    return every_row + solved_sql([x]) + f"SELECT ([{listed}])[i + 1] AS name, {near_sql('v')} AS value FROM theta"


ORACLES["k2_fit_power_ridge"] = _ridge_oracle()


SEARCHED = [(na, nb, nk) for na in (0, 1, 3) for nb in (0, 1, 3) for nk in (0, 1)]
ORACLES["k3_grid_search"] = scored_sql(
    [SqlModel(lagged(*o, "uv"), max(o[0], o[2] + o[1] - 1 if o[1] else 0)) for o in SEARCHED], [f"{na} AS na, {nb} AS nb, {nk} AS nk" for na, nb, nk in SEARCHED], SHUFFLED_SQL, True
)
ORACLES["k3_grid_search_free_run"] = free_run_sql(SHUFFLED_SQL, True)
