"""Proportional stratified interleaving: every shard gets every source in proportion, and the counts differ by one at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import source_key, written

BUCKETS = 4096  # hash prefixes per source, and slices of the fractional rank: what one window task orders


def interleave(df: DataFrame, shards: int, key: str = "doc_id", source: str = "source", seed: str = "shards") -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0 inside the shard).

    Rows are shuffled within their source by a seeded hash of the key, ranked, and given the fractional rank
    ``(2 rank - 1) / (2 rows of the source)``; the order by fractional rank is cut into equal slices.

    No source and no slice is ordered by one task: the hash prefix splits a source, the fractional rank splits the whole,
    and counts per bucket, added up, turn a rank inside a bucket into the rank inside the whole.

    A null source is a source of its own, a null key is a key like any other. Rows that share a key are ordered by the hash
    of their other columns; equal rows are interchangeable. Columns named ``shard`` or ``slot`` are replaced. An empty table
    gives an empty table.
    """
    rest = [c for c in df.columns if c not in ("shard", "slot")]
    body = F.struct(*[F.col(f"`{c}`") for c in rest])
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    rows = df.select(body.alias("_row"), source_key(source).alias("_s"), digest.alias("_h"))
    rows = rows.withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))

    counts = rows.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_m"))
    earlier = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_s", "_b", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_off"), F.sum("_m").over(Window.partitionBy("_s")).alias("_n")
    )
    within = Window.partitionBy("_s", "_b").orderBy("_h", F.xxhash64("_row"))
    odd = 2 * (F.col("_off") + F.col("_r")) - 1
    ranked = (
        rows.withColumn("_r", F.row_number().over(within))
        .join(offsets, ["_s", "_b"])
        .select("_row", "_s", "_h", (odd / (2 * F.col("_n"))).alias("_f"))
        .withColumn("_g", F.least(F.floor(F.col("_f") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    )
    ranked = written(ranked, "interleave")

    total = ranked.count()
    slices = ranked.groupBy("_g").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows at most
    slices = slices.select("_g", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_off"))
    order = Window.partitionBy("_g").orderBy("_f", "_s", "_h", F.xxhash64("_row"))
    place = ranked.withColumn("_r", F.row_number().over(order)).join(slices, "_g").withColumn("_p", F.col("_off") + F.col("_r") - 1)
    shard = F.expr(f"_p * {shards} div {max(total, 1)}")
    start = F.expr(f"(_shard * {total} + {shards - 1}) div {shards}")
    return place.withColumn("_shard", shard).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in rest],
        F.col("_shard").cast("int").alias("shard"), (F.col("_p") - start).cast("long").alias("slot"),
    )
