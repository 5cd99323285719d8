"""Registered queries: chunks, roles, manifests and conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import split
from strandline.plans.registry import query
from strandline.plans.stand_ins import LINE_KEY, W_LINE, line_seq, lines, near, near_sql, table

KEY = LINE_KEY.split(", ")
LENGTH, GAP, MIN_ROWS = 100, 5, 40

CHUNK_SQL = f"""
WITH r AS (SELECT *, ROW_NUMBER() OVER ({W_LINE}) - 1 AS sample_index, COUNT(*) OVER (PARTITION BY l_suppkey) AS len FROM lineitem),
c0 AS (SELECT *, sample_index // {LENGTH + GAP} AS chunk_index FROM r),
c AS (SELECT *, chunk_index * {LENGTH + GAP} AS source_row_start, LEAST({LENGTH}, len - chunk_index * {LENGTH + GAP}) AS size FROM c0
      WHERE sample_index % {LENGTH + GAP} < {LENGTH} AND LEAST({LENGTH}, len - chunk_index * {LENGTH + GAP}) >= {MIN_ROWS})
"""


def chunks(spark, sf_dir, *extra):
    return split.chunk(lines(spark, sf_dir, *extra), line_seq(spark, sf_dir), LENGTH, GAP, MIN_ROWS)


def chunk_meta(spark, sf_dir):
    return split.chunk_metadata(chunks(spark, sf_dir), ("l_suppkey",), "l_quantity", ["l_linenumber"])


def with_roles(spark, sf_dir, trials=200):
    return split.assign_roles(chunk_meta(spark, sf_dir), ("l_suppkey",), trials=trials)


@query(
    "i1_chunk",
    CHUNK_SQL + f"""SELECT {LINE_KEY}, sample_index, chunk_index::BIGINT AS chunk_index, source_row_start::BIGINT AS source_row_start,
    (source_row_start + size - 1)::BIGINT AS source_row_end, (sample_index - source_row_start)::BIGINT AS subsequence_row_pos,
    printf('%d::subseq_%04d', l_suppkey, chunk_index) AS subsequence_id FROM c""",
)
def chunk(spark, sf_dir):
    return chunks(spark, sf_dir).select(
        *KEY, "sample_index", "chunk_index", "source_row_start", "source_row_end", "subsequence_row_pos", "subsequence_id"
    )


@query(
    "i3_role_counts",
    """WITH n AS (SELECT c_custkey, (c_custkey % 97)::INTEGER AS n FROM customer),
    a AS (SELECT *, GREATEST(1, round_even(n * 0.6, 0)::INTEGER) AS t0, GREATEST(1, round_even(n * 0.2, 0)::INTEGER) AS v0 FROM n),
    b AS (SELECT *, CASE WHEN t0 + v0 >= n THEN GREATEST(1, n - t0 - 1) ELSE v0 END AS v1 FROM a),
    d AS (SELECT *, CASE WHEN t0 + v1 >= n THEN GREATEST(1, n - v1 - 1) ELSE t0 END AS t1 FROM b),
    e AS (SELECT c_custkey, n, CASE WHEN n >= 3 THEN t1 WHEN n >= 1 THEN 1 ELSE 0 END AS train,
      CASE WHEN n >= 3 THEN v1 WHEN n = 2 THEN 1 ELSE 0 END AS validation FROM d)
    SELECT c_custkey, train::INTEGER AS train, validation::INTEGER AS validation, (n - train - validation)::INTEGER AS test FROM e""",
)
def role_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CAST(c_custkey % 97 AS INT) AS n")
    return rows.select("c_custkey", split.role_counts("n").alias("r")).select("c_custkey", "r.*")


PRIME = split.PRIME
ROLES_SQL = f"""
meta AS (SELECT l_suppkey, chunk_index, COUNT(*)::DOUBLE AS n_rows, AVG(l_quantity) AS mean,
  ('0x' || substr(md5(concat_ws(':', '42', l_suppkey, chunk_index)), 1, 12))::BIGINT % {PRIME} AS u FROM c GROUP BY l_suppkey, chunk_index),
whole AS (SELECT l_suppkey, COUNT(*) AS n, SUM(n_rows) AS total, SUM(mean * n_rows) / SUM(n_rows) AS overall,
  GREATEST(CASE WHEN stddev_pop(mean) > 0 THEN stddev_pop(mean) ELSE 1 END, 1e-9) AS spread FROM meta GROUP BY l_suppkey),
cuts AS (SELECT *, CASE WHEN n >= 3 THEN GREATEST(1, round_even(n * 0.6, 0)) ELSE 1 END AS tr,
  CASE WHEN n >= 3 THEN GREATEST(1, round_even(n * 0.2, 0)) WHEN n = 2 THEN 1 ELSE 0 END AS va FROM whole),
trials AS (SELECT t, ('0x' || substr(md5('42:trial:' || t), 1, 12))::BIGINT % {PRIME - 1} + 1 AS m, ('0x' || substr(md5('42:trial:' || t), 13, 12))::BIGINT % {PRIME} AS a
  FROM range(__TRIALS__) x(t)),
ordered AS (SELECT meta.*, cuts.* EXCLUDE (l_suppkey), t, ROW_NUMBER() OVER (PARTITION BY meta.l_suppkey, t ORDER BY (u * m + a) % {PRIME}, u, chunk_index) AS place
  FROM meta JOIN cuts USING (l_suppkey), trials),
roles AS (SELECT *, CASE WHEN place <= tr THEN 'train' WHEN place <= tr + va THEN 'validation' ELSE 'test' END AS role FROM ordered),
sums AS (SELECT l_suppkey, t, role, any_value(n) AS n, any_value(total) AS total, any_value(overall) AS overall, any_value(spread) AS spread, COUNT(*) AS k,
  SUM(n_rows) AS r, SUM(n_rows * mean) AS w FROM roles GROUP BY l_suppkey, t, role),
scores AS (SELECT l_suppkey, t, SUM(2.0 * abs(r / total - k::DOUBLE / n) + 1.5 * abs(w / r - overall) / spread) AS score FROM sums GROUP BY l_suppkey, t),
won AS (SELECT l_suppkey, t, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY round(score, 12), t) AS k FROM scores) WHERE k = 1)
"""


def roles_sql(trials: int) -> str:
    """CHUNK_SQL and the table ``roles`` of all trials with the winners in ``won``."""
    return CHUNK_SQL + "," + ROLES_SQL.replace("__TRIALS__", str(trials))


@query(
    "i4_assign_roles",
    roles_sql(2000) + f"SELECT l_suppkey, chunk_index::BIGINT AS chunk_index, role AS split_role, {near_sql('score')} AS score FROM roles JOIN won USING (l_suppkey, t)",
)
def assign_roles(spark, sf_dir):
    return with_roles(spark, sf_dir, trials=2000).select("l_suppkey", "chunk_index", "split_role", near("score").alias("score"))


@query(
    "i4_role_totals",
    CHUNK_SQL + """, n AS (SELECT l_suppkey, COUNT(DISTINCT chunk_index) AS n FROM c GROUP BY l_suppkey),
    e AS (SELECT l_suppkey, n, CASE WHEN n >= 3 THEN GREATEST(1, round_even(n * 0.6, 0)) ELSE 1 END AS t,
      CASE WHEN n >= 3 THEN GREATEST(1, round_even(n * 0.2, 0)) WHEN n = 2 THEN 1 ELSE 0 END AS v FROM n)
    SELECT l_suppkey, t::BIGINT AS train, v::BIGINT AS validation, (n - t - v)::BIGINT AS test FROM e""",
)
def role_totals(spark, sf_dir):
    return with_roles(spark, sf_dir).groupBy("l_suppkey").agg(
        *[F.count_if(F.col("split_role") == r).alias(r) for r in split.ROLES]
    )


@query(
    "i5_split_manifest",
    CHUNK_SQL + f"""SELECT l_suppkey, chunk_index::BIGINT AS chunk_index, COUNT(*) AS n_rows, {near_sql('AVG(l_quantity)')} AS target_mean,
    {near_sql('stddev_pop(l_quantity)')} AS target_std, MIN(sample_index) AS start_sample_index, MAX(sample_index) AS end_sample_index,
    concat('l_linenumber=', printf('%.3f', MEDIAN(l_linenumber::DOUBLE))) AS condition_group FROM c GROUP BY l_suppkey, chunk_index""",
)
def split_manifest(spark, sf_dir):
    out = split.split_manifest(chunk_meta(spark, sf_dir), ("l_suppkey",), ["l_linenumber"])
    return out.select(
        "l_suppkey", "chunk_index", "n_rows", near("target_mean").alias("target_mean"), near("target_std").alias("target_std"),
        "start_sample_index", "end_sample_index", "condition_group",
    )


@query(
    "i6_apply_manifest",
    roles_sql(200) + f"""SELECT {LINE_KEY}, c.chunk_index::BIGINT AS chunk_index, sample_index, role AS split_role
    FROM c JOIN (SELECT l_suppkey, chunk_index, role FROM roles JOIN won USING (l_suppkey, t)) w USING (l_suppkey, chunk_index)""",
)
def apply_manifest(spark, sf_dir):
    from strandline.operators.features import sample_index

    rows = sample_index(lines(spark, sf_dir), line_seq(spark, sf_dir))
    out = split.apply_manifest(rows, with_roles(spark, sf_dir), ("l_suppkey",), LENGTH, GAP, "sample_index")
    return out.select(*KEY, "chunk_index", "sample_index", "split_role")


@query("c10_trim_start", CHUNK_SQL + f"SELECT {LINE_KEY} FROM c WHERE sample_index - source_row_start >= 10")
def trim_start(spark, sf_dir):
    return split.trim_start(chunks(spark, sf_dir), 10).select(*KEY)


CONDITION_SQL = """
WITH s AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS feed,
  CASE WHEN o_orderkey < 1000 THEN 'train' WHEN o_totalprice > 200000 THEN 'validation' ELSE 'test' END AS split_role FROM orders)
"""


def conditions(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_orderstatus", "CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS feed",
        "CASE WHEN o_totalprice < 2000 THEN 'train' WHEN o_totalprice > 200000 THEN 'validation' ELSE 'test' END AS split_role",
    )


CONDITION_SQL = CONDITION_SQL.replace("o_orderkey < 1000", "o_totalprice < 2000")


@query(
    "d9_condition_coverage",
    CONDITION_SQL + """, t AS (SELECT DISTINCT o_orderstatus, feed FROM s WHERE split_role = 'train')
    SELECT o_orderkey, t.o_orderstatus IS NOT NULL AS condition_seen_in_train, split_role <> 'train' AND t.o_orderstatus IS NULL AS is_extrapolation_condition
    FROM s LEFT JOIN t ON t.o_orderstatus = s.o_orderstatus AND t.feed IS NOT DISTINCT FROM s.feed""",
)
def condition_coverage(spark, sf_dir):
    out = split.condition_coverage(conditions(spark, sf_dir), ["o_orderstatus", "feed"])
    return out.select("o_orderkey", "condition_seen_in_train", "is_extrapolation_condition")


@query(
    "d9_unseen_conditions",
    CONDITION_SQL + """, t AS (SELECT DISTINCT o_orderstatus, feed FROM s WHERE split_role = 'train')
    SELECT s.o_orderstatus, s.feed, COUNT(*) AS n_rows FROM s WHERE split_role <> 'train'
      AND NOT EXISTS (SELECT 1 FROM t WHERE t.o_orderstatus = s.o_orderstatus AND t.feed IS NOT DISTINCT FROM s.feed) GROUP BY ALL""",
)
def unseen_conditions(spark, sf_dir):
    return split.unseen_conditions(conditions(spark, sf_dir), ["o_orderstatus", "feed"])


@query(
    "e3_sequence_settings",
    f"SELECT l_suppkey, {near_sql('MEDIAN(l_linenumber::DOUBLE)')} AS l_linenumber, {near_sql('MEDIAN(l_tax)')} AS l_tax FROM lineitem GROUP BY l_suppkey",
)
def sequence_settings(spark, sf_dir):
    out = split.sequence_settings(lines(spark, sf_dir), ["l_suppkey"], ["l_linenumber", "l_tax"])
    return out.select("l_suppkey", near("l_linenumber").alias("l_linenumber"), near("l_tax").alias("l_tax"))


@query(
    "e4_sequence_metadata",
    f"""SELECT l_suppkey, COUNT(*) AS n_rows, {near_sql('AVG(l_quantity)')} AS target_mean, {near_sql('stddev_pop(l_quantity)')} AS target_std,
    MIN(l_orderkey) AS first_order, MAX(l_orderkey) AS last_order FROM lineitem GROUP BY l_suppkey""",
)
def sequence_metadata(spark, sf_dir):
    out = split.sequence_metadata(lines(spark, sf_dir), ["l_suppkey"], "l_quantity", ["l_orderkey"])
    return out.withColumns({"target_mean": near("target_mean"), "target_std": near("target_std")})


@query("h2_distinct_conditions", "SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem ORDER BY 1, 2")
def distinct_conditions(spark, sf_dir):
    return split.distinct_conditions(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"])


SEEDED_SQL = f"('0x' || substr(md5(concat_ws(':', '42', {LINE_KEY})), 1, 15))::BIGINT"


@query("g5_sample_n", f"SELECT {LINE_KEY}, l_quantity FROM lineitem ORDER BY {SEEDED_SQL}, {LINE_KEY} LIMIT 1000")
def sample_n(spark, sf_dir):
    return split.sample_n(lines(spark, sf_dir), KEY, 1000, 42).select(*KEY, "l_quantity")


@query("g6_shuffle_order", f"SELECT {LINE_KEY}, {SEEDED_SQL} AS shuffle_rank FROM lineitem ORDER BY shuffle_rank, {LINE_KEY}")
def shuffle_order(spark, sf_dir):
    return split.shuffle_order(lines(spark, sf_dir).select(*KEY), KEY, 42)


@query(
    "k6_balanced_weights",
    CHUNK_SQL + f""", g AS (SELECT *, COUNT(*) OVER (PARTITION BY l_suppkey, chunk_index) AS size FROM c)
    SELECT {LINE_KEY}, {near_sql('(1.0 / size) / (SELECT AVG(1.0 / size) FROM g)')} AS weight FROM g""",
)
def balanced_weights(spark, sf_dir):
    out = split.balanced_weights(chunks(spark, sf_dir), ["l_suppkey", "chunk_index"])
    return out.select(*KEY, near("weight").alias("weight"))
