"""Aligning samples with frame timelines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.names import normalize_stem
from strandline.sequence import Sequence, carry
from strandline.session import cut_lineage


def first_per_key(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """First row per key in the given order.

    A top-1 ``row_number`` filter: Spark trims each key to one row on the map side, so a key with a
    third of all rows shuffles one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def attach_detections(frames: DataFrame, detections: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Frame timeline with each frame's first detection row; undetected frames stay."""
    return frames.join(first_per_key(detections, keys, order_by), keys, "left")


def attach_flags(df: DataFrame, flags: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Add a 0/1 flag per frame; frames without one get 0."""
    return df.join(flags.select(*keys, flag), keys, "left").withColumn(flag, F.coalesce(F.col(flag).cast("int"), F.lit(0)))


def frame_intervals(frames: DataFrame, seq: Sequence, ft: str) -> DataFrame:
    """Half-open validity ``[lower, upper)`` per frame: midpoints of neighbours, open at both ends."""
    t = F.col(ft)
    out = carry(frames, seq, {"__prev": t}, exclusive=True)
    out = carry(out, seq, {"__next": t}, backward=True, exclusive=True)
    inf = F.lit(float("inf"))
    return out.withColumns(
        {
            "lower": F.coalesce((F.col("__prev") + t) / 2, -inf),
            "upper": F.coalesce((t + F.col("__next")) / 2, inf),
        }
    ).drop("__prev", "__next")


def assign_nearest(
    samples: DataFrame,
    frames: DataFrame,
    keys: tuple[str, ...],
    t: str,
    ft: str,
    frame: str,
    bucket: str | None,
    pos: str,
) -> DataFrame:
    """Give each sample the frame whose midpoint interval contains it; samples without one are dropped.

    Interval starts and samples are merged into one timeline and the last start is carried forward:
    linear in the rows, where an interval join would compare every pair within a key. ``bucket`` is
    an expression over the time column ``t``. ``pos`` orders samples at equal times.
    """
    timeline = frames.select(*keys, F.col(ft).cast("double").alias(t), F.col(frame).alias("__frame"))
    starts = carry(
        timeline, Sequence(keys, (t, "__frame"), bucket), {"__before": F.col(t)}, exclusive=True
    ).select(*keys, ((F.col("__before") + F.col(t)) / 2).alias(t), "__frame", F.lit(0).alias("__kind"))
    rows = samples.filter(F.col(t).isNotNull()).withColumn("__kind", F.lit(1))
    merged = rows.unionByName(starts, allowMissingColumns=True)
    seq = Sequence(keys, (t, "__kind", "__frame", pos), bucket)
    return (
        carry(merged, seq, {frame: F.col("__frame")})
        .filter((F.col("__kind") == 1) & F.col(frame).isNotNull())
        .drop("__kind", "__frame")
    )


def frame_means(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per-frame means of sample columns (partial aggregation runs before the shuffle)."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def downsample(frames: DataFrame, means: DataFrame, keys: list[str], t: str, ft: str) -> DataFrame:
    """Frames with their sample means; a frame without samples takes its own time."""
    return frames.join(means, keys, "left").withColumn(t, F.coalesce(t, ft))


def upsample(samples: DataFrame, frame_level: DataFrame, keys: list[str]) -> DataFrame:
    """Samples with the frame-level columns of their frame."""
    return samples.join(frame_level, keys, "left")


def interpolate_to(
    source: DataFrame,
    targets: DataFrame,
    keys: tuple[str, ...],
    t: str,
    columns: list[str],
    bucket: str | None,
    source_order: list[str],
    pos: str,
) -> DataFrame:
    """Linearly interpolate source columns onto target times.

    Outside the source range the edge value holds; one valid point is constant; none gives missing.
    Of repeated source times the first valid value counts. Each column skips its own missing values.
    """
    order = F.struct(*source_order)
    points = (
        source.filter(F.col(t).isNotNull())
        .groupBy(*keys, t)
        .agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"__v_{c}") for c in columns])
    )
    base = [c for c in targets.columns if c not in columns]
    rows = targets.select(*base).withColumn("__kind", F.lit(1))
    merged = rows.unionByName(points.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    seq = Sequence(keys, (t, "__kind", pos), bucket)
    valued = {
        c: F.when(F.col(f"__v_{c}").isNotNull(), F.struct(F.col(t).alias("t"), F.col(f"__v_{c}").alias("v")))
        for c in columns
    }
    both = carry(merged, seq, {f"__p_{c}": v for c, v in valued.items()})
    both = carry(both, seq, {f"__n_{c}": v for c, v in valued.items()}, backward=True)

    def value(c: str) -> Column:
        p, n = F.col(f"__p_{c}"), F.col(f"__n_{c}")
        slope = (n["v"] - p["v"]) / (n["t"] - p["t"])
        return (
            F.when(p.isNull(), n["v"])
            .when(n.isNull() | (p["t"] == F.col(t)), p["v"])
            .otherwise(p["v"] + slope * (F.col(t) - p["t"]))
        )

    return both.filter(F.col("__kind") == 1).select(*base, *[value(c).alias(c) for c in columns])


GRAMS = (3, 6, 12)  # characters of the keys by which a name finds the names it lies in: the longest that the name has
LEFT_SETS, RIGHT_SETS = 4_000, 40_000  # sets of frequent tokens that one task compares


def _tokens(c: str) -> Column:
    return F.array_distinct(F.split(F.col(c), "_"))


def _grams(c: str, n: int) -> Column:
    """The distinct substrings of ``n`` characters; none of a shorter text."""
    last = F.length(c) - (n - 1)
    every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(n)))
    return F.array_distinct(F.when(last > 0, every).otherwise(F.array().cast("array<string>")))


def _contained(subs: DataFrame, wholes: DataFrame) -> DataFrame:
    """(sub, whole): every name of ``subs`` that lies in a different name of ``wholes``; both have ``stem``, distinct.

    A name is looked up by the one of its longest grams that fewest wholes have, so each whole gives a few rows of 16 bytes for
    each of its characters and a candidate shares a rare text with it. Names shorter than all grams, of which there are few, are
    looked up by themselves. No side is broadcast: a small file can hold many names.
    """
    short = F.array_union(F.array(F.lit("")), F.array_union(_grams("whole", 1), _grams("whole", 2)))
    named = wholes.select(F.col("stem").alias("whole"))
    brief = subs.filter(F.length("stem") < GRAMS[0]).select(F.col("stem").alias("sub"))
    tiny = named.select("whole", F.explode(short).alias("sub")).join(brief.hint("merge"), "sub")
    hashed = lambda c, n: F.transform(_grams(c, n), lambda g: F.xxhash64(g))  # noqa: E731  (a clash only adds a candidate)
    sizes = F.concat(*[hashed("whole", n) for n in GRAMS])
    held = named.select(F.xxhash64("whole").alias("id"), F.explode(sizes).alias("gram"))
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    longest = hashed("stem", GRAMS[0])
    for n in GRAMS[1:]:
        longest = F.when(F.length("stem") >= n, hashed("stem", n)).otherwise(longest)
    mine = subs.filter(F.length("stem") >= GRAMS[0]).select(F.col("stem").alias("sub"), F.explode(longest).alias("gram"))
    # a gram that no whole has rules the name out: its count is then 0
    keyed = mine.join(often.hint("merge"), "gram", "left").groupBy("sub").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("k"))
    keyed = keyed.filter("k.n > 0").select("sub", F.col("k.gram").alias("gram"))
    met = held.join(keyed.hint("merge"), "gram").select("id", "sub")
    found = met.join(named.withColumn("id", F.xxhash64("whole")).hint("merge"), "id").filter(F.contains("whole", "sub")).select("sub", "whole")
    return tiny.select("sub", "whole").unionByName(found).filter("sub <> whole")


def meet_sets(mine: pa.Table, theirs: pa.Table) -> pa.Table:
    """For each set of ``mine`` the set of ``theirs`` with most common tokens, then closest size ``n``, then greatest ``best``; none without a common token."""
    theirs = theirs.sort_by([("best", "descending")])
    tokens = theirs.column("set").combine_chunks()
    kinds = tokens.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy(zero_copy_only=False))
    code = kinds.indices.to_numpy(zero_copy_only=False)
    posted = owner[np.argsort(code, kind="stable")]
    at = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(kinds.dictionary)))])
    sizes, own_sizes = theirs.column("n").to_numpy().astype(np.int64), mine.column("n").to_numpy().astype(np.int64)
    wanted = mine.column("set").combine_chunks()
    codes = pc.fill_null(pc.index_in(wanted.flatten(), value_set=kinds.dictionary), -1).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(wanted.value_lengths().to_numpy(zero_copy_only=False))])
    weight = int(max(sizes.max(initial=0), own_sizes.max(initial=0))) + 1
    rows, others, shared = [], [], []
    for i, n in enumerate(own_sizes.tolist()):
        known = [c for c in codes[ends[i] : ends[i + 1]].tolist() if c >= 0]
        if known:
            common = np.bincount(np.concatenate([posted[at[c] : at[c + 1]] for c in known]), minlength=len(sizes))
            j = int(np.argmax(common * weight - np.abs(sizes - n)))
            rows.append(i)
            others.append(j)
            shared.append(int(common[j]))
    kept = mine.take(pa.array(rows, pa.int64()))
    apart = -np.abs(sizes[others] - own_sizes[rows]) if rows else np.empty(0)
    return pa.table({"set_l": kept.column("set").cast(pa.list_(pa.string())), "n_l": kept.column("n"), "a": pa.array(shared, pa.int32()), "b": pa.array(apart.astype(np.int32)),
                     "best": theirs.column("best").take(pa.array(others, pa.int64()))})


def _best_sets(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """``meet_sets`` of all sets: blocks of both sides meet in one task each, and the best of a set's blocks counts."""
    mine, theirs = cut_lineage(mine), cut_lineage(theirs)
    across, down = -(-theirs.count() // RIGHT_SETS) or 1, -(-mine.count() // LEFT_SETS) or 1
    dealt = lambda n: F.pmod(F.xxhash64("set", "n"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = mine.select("set", "n", dealt(down).alias("__l"), every(across).alias("__r")).groupBy("__l", "__r")
    other = theirs.select("set", "n", "best", dealt(across).alias("__r"), every(down).alias("__l")).groupBy("__l", "__r")
    return one.cogroup(other).applyInArrow(meet_sets, "set_l array<string>, n_l int, a int, b int, best string")


def match_sources(left: DataFrame, right: DataFrame, name: str, frequent: int = 1000) -> DataFrame:
    """Best partner in ``right`` for every name in ``left`` (columns: name, match, score_class).

    Classes: 3 equal normalised stems, 2 one contains the other, 1 a shared token. Within class 2:
    more shared tokens, then closer lengths; within 1: more shared tokens, then closer token counts;
    ties go to the greater name. No class, no match (NULL). Names may have any number of tokens.

    ``right`` is first reduced to its best name per stem. A token of at most ``frequent`` right stems leads to all of them. Stems
    that share only more frequent tokens need not be compared one by one: they are compared as sets of frequent tokens, each set
    standing for all right stems of equal size that have it. So no list of pairs grows with the square of a common token.
    """
    stems_l = left.select(F.col(name), normalize_stem(name).alias("stem")).distinct()
    stems_r = right.select(normalize_stem(name).alias("stem"), F.col(name)).groupBy("stem").agg(F.max(name).alias("best"))
    # the names are read once, and dealt over all tasks before each gives many rows
    width = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    uniq_l, stems_r = cut_lineage(stems_l.select("stem").distinct().repartition(width, "stem")), cut_lineage(stems_r.repartition(width, "stem"))
    rank = lambda k, a, b, c: F.struct(F.lit(k).alias("k"), a.alias("a"), b.alias("b"), F.col(c).alias("name"))
    overlap = lambda a, b: F.size(F.array_intersect(_tokens(a), _tokens(b)))

    equal = uniq_l.join(stems_r.hint("merge"), "stem").select("stem", rank(3, F.length("stem"), F.length("stem"), "best").alias("r"))
    inner = rank(2, overlap("sub", "whole"), -(F.length("whole") - F.length("sub")), "best").alias("r")
    left_inside = _contained(uniq_l, stems_r).join(stems_r.withColumnRenamed("stem", "whole").hint("merge"), "whole").select(F.col("sub").alias("stem"), inner)
    right_inside = _contained(stems_r, uniq_l).join(stems_r.withColumnRenamed("stem", "sub").hint("merge"), "sub").select(F.col("whole").alias("stem"), inner)

    has_r = stems_r.select("best", F.col("stem").alias("other"), _tokens("stem").alias("theirs"), F.explode(_tokens("stem")).alias("token"))
    has_l = uniq_l.select("stem", _tokens("stem").alias("mine"), F.explode(_tokens("stem")).alias("token"))
    spread = has_r.groupBy("token").agg(F.count("*").alias("n"))
    rare, common = spread.filter(F.col("n") <= frequent).select("token"), spread.filter(F.col("n") > frequent).select("token")  # common: at most a thousandth of all tokens
    closeness = -F.abs(F.size("mine") - F.size("theirs"))
    by_rare = has_l.join(has_r.join(rare.hint("merge"), "token").hint("merge"), "token").select(
        "stem", rank(1, F.size(F.array_intersect("mine", "theirs")), closeness, "best").alias("r")
    )

    def classes(has: DataFrame, own: str, tokens: str) -> DataFrame:
        """Stems by their set of frequent tokens and how many tokens they have."""
        return has.join(F.broadcast(common), "token").groupBy(own).agg(F.sort_array(F.collect_set("token")).alias("set"), F.first(F.size(tokens)).alias("n"))

    sets_l = classes(has_l, "stem", "mine")
    sets_r = classes(has_r, "best", "theirs").groupBy("set", "n").agg(F.max("best").alias("best"))
    kinds = _best_sets(sets_l.select("set", "n").distinct(), sets_r).groupBy("set_l", "n_l").agg(F.max(rank(1, F.col("a"), F.col("b"), "best")).alias("r"))
    by_common = sets_l.join(kinds.hint("merge"), (F.col("set") == F.col("set_l")) & (F.col("n") == F.col("n_l"))).select("stem", "r")

    best = equal.union(left_inside).union(right_inside).union(by_rare).union(by_common).groupBy("stem").agg(F.max("r").alias("r"))
    return stems_l.join(best.hint("merge"), "stem", "left").select(
        F.col(name), F.col("r.name").alias("match"), F.coalesce(F.col("r.k"), F.lit(0)).alias("score_class")
    )
