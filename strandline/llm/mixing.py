"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import SPACE, source_key, unit, written

SLICES = 4096  # of the sampling order of a source; only the slice that holds the cut is put in order
ADDED = ("size", "source_size", "target", "copies", "taken")


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """(_s, source_size, docs, target): the total shared by weight, no target above ``most`` times its source's size.

    Sources sorted by capacity per unit of weight fill up in that order; the level is what the unfilled ones get per unit of
    weight, and it is largest exactly when the right ones are full.
    """
    order = Window.orderBy("_s")
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("_w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * most)
    filled = Window.orderBy(F.col("_cap") / F.col("_w"), "_s").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(filled), F.lit(0))
    open_weight = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(filled), F.lit(0))
    level = F.max("_level").over(whole)
    return (
        ranked.withColumn("_level", left.cast("double") / open_weight)
        .withColumn("target", F.least(F.col("_cap").cast("double"), level * F.col("_w")))
        .select("_s", "source_size", "docs", "target")
    )


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = "mix", key: str = "doc_id",
        source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` (of the source), ``copies`` and ``taken`` (words, repeats counted).

    A source wants ``target / source_size`` copies of each document: the whole part is certain, and the fraction is the base
    inclusion chance of one copy more. Inclusion odds grow with the square root of a document's size, so the choice is of
    unequal chances. Documents are ordered by random odds over inclusion odds; the sample is the longest prefix of that order
    whose words do not pass what is left of the target, and one closing document, the one nearest in size to the words still
    missing, if it brings the source nearer.

    A source is never ordered by one task: sums over ``SLICES`` slices of the order find the slice of the cut, and only that
    slice is ordered. The decision on a document needs its own row and one row for its source.

    The random number is a hash of seed and key, so reruns agree, and repeated rows share their fate. A null text has size 0, a
    null source is a source of its own, a null key a key like any other. Columns named like the new ones are replaced. Empty
    tables, and tables without words, take nothing.
    """
    docs = docs.drop(*ADDED)
    marks = [F.coalesce(F.regexp_count(F.col(text), F.lit(SPACE)), F.lit(0)).cast("long").alias("size"), source_key(source).alias("_s"), unit(F.lit(seed), F.col(key)).alias("_u")]
    slim = written(docs.select(F.col(key).cast("string").alias("_k"), *marks), "mix")
    sizes = slim.groupBy("_s").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    targets = written(source_targets(sizes, weights, most), "mix-targets")

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.withColumn("_ratio", ratio).withColumn("_whole", F.floor("_ratio")).withColumn("_part", F.col("_ratio") - F.col("_whole"))
    plan = plan.withColumn("_want", F.col("target") - F.col("_whole") * F.col("source_size")).withColumn("_mean", F.col("source_size") / F.col("docs"))
    odds = F.col("_part") / (1 - F.col("_part")) * F.sqrt(F.col("size") / F.col("_mean"))
    place = F.when(F.col("_part") > 0, F.col("_u") / (F.col("_u") + (1 - F.col("_u")) * odds)).otherwise(F.lit(1.0))
    placed = slim.join(plan, "_s").withColumn("_v", F.when(F.col("size") > 0, place).otherwise(F.lit(1.0)))
    placed = placed.withColumn("_slice", F.least(F.floor(F.col("_v") * SLICES), F.lit(SLICES - 1)).cast("int"))

    def running(by):
        return Window.partitionBy("_s").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)

    sums = placed.groupBy("_s", "_slice", "_want").agg(F.sum("size").alias("_words")).withColumn("_to", F.sum("_words").over(running("_slice")))
    at = sums.filter(F.col("_to") > F.col("_want")).groupBy("_s").agg(F.min_by(F.struct("_slice", (F.col("_to") - F.col("_words")).alias("_base")), "_slice").alias("_at"))
    at = at.select("_s", "_at._slice", "_at._base")
    inside = placed.join(at, ["_s", "_slice"]).groupBy("_s", "_v", "_want", "_base").agg(F.sum("size").alias("_words"))
    inside = inside.withColumn("_to", F.col("_base") + F.sum("_words").over(running("_v"))).filter(F.col("_to") <= F.col("_want"))
    inside = inside.groupBy("_s").agg(F.max("_v").alias("_last"), F.max("_to").alias("_got"))
    # no document of the slice fits: the cut lies before it; no slice passes the target: everything fits
    edge = at.select("_s", (F.col("_slice") / F.lit(float(SLICES))).alias("_edge"), "_base")
    cut = (
        plan.join(edge, "_s", "left").join(inside, "_s", "left")
        .withColumn("_fits", F.when(F.col("_part") <= 0, F.lit("none")).when(F.col("_edge").isNull(), F.lit("all")).when(F.col("_last").isNull(), F.lit("before")).otherwise(F.lit("upto")))
        .withColumn("_got", F.when(F.col("_fits") == "none", F.lit(0)).when(F.col("_fits") == "all", F.col("source_size")).otherwise(F.coalesce("_got", "_base")))
        .withColumn("_miss", F.when(F.col("_part") > 0, F.col("_want") - F.col("_got")).otherwise(F.lit(0.0)))
        .select("_s", "_fits", "_edge", "_last", "_miss")
    )
    cut = written(cut, "mix-cut")
    chosen = F.when(F.col("_fits") == "all", F.lit(True)).when(F.col("_fits") == "none", F.lit(False)).when(F.col("_fits") == "before", F.col("_v") < F.col("_edge")).otherwise(F.col("_v") <= F.col("_last"))
    gap = F.abs(F.col("size") - F.col("_miss"))
    closing = (
        placed.join(cut, "_s").filter(~chosen & (gap < F.col("_miss")))
        .groupBy("_s").agg(F.min(F.struct(gap.alias("gap"), F.col("_v").alias("v"), F.col("size").alias("size"), F.col("_k").alias("k"))).alias("_end"))
    )
    known = written(plan.join(cut, "_s").join(closing, "_s", "left"), "mix-plan")

    rest = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), F.col(key).cast("string").alias("_k"), *marks).join(known, "_s")
    rows = rows.withColumn("_v", F.when(F.col("size") > 0, place).otherwise(F.lit(1.0)))
    last = F.coalesce((F.col("_v") == F.col("_end.v")) & (F.col("size") == F.col("_end.size")) & F.col("_k").eqNullSafe(F.col("_end.k")), F.lit(False))
    rows = rows.withColumn("copies", (F.col("_whole") + F.when(chosen | last, 1).otherwise(0)).cast("int"))
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in rest], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
