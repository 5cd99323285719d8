"""Cutting sequences into chunks and assigning chunks to train, validation and test."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandline.functions.names import condition_label
from strandline.sequence import Sequence, with_position
from strandline.session import cut_lineage

ROLES = ("train", "validation", "test")


def sequence_settings(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Exact per-sequence medians of setting columns.

    Settings take few distinct values, so rows are counted per value first and the exact median is
    taken from those counts: a hot sequence never gathers its rows in one task.
    """
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s"))
    counts = long.filter(F.col("s.v").isNotNull()).groupBy(*keys, "s.c", "s.v").agg(F.count("*").alias("n"))
    medians = counts.groupBy(*keys).pivot("c", columns).agg(F.percentile("v", F.lit(0.5), F.col("n")))
    return df.select(*keys).distinct().join(medians, keys, "left")


def chunk(df: DataFrame, seq: Sequence, length: int, gap: int, min_rows: int) -> DataFrame:
    """Cut each sequence into runs of ``length`` rows with ``gap`` rows discarded in between.

    A tail is kept only with at least ``min_rows`` rows. After row positions, everything is local to
    a chunk, and later windows over chunks reuse the same partitioning.
    """
    step = length + gap
    k = F.floor(F.col("sample_index") / step).cast("bigint")
    rows = with_position(df, seq, "sample_index").withColumn("chunk_index", k)
    start, size = F.col("chunk_index") * step, F.col("__size")
    kept = (
        rows.filter(F.col("sample_index") - start < length)
        .withColumn("__size", F.count("*").over(Window.partitionBy(*seq.keys, "chunk_index")))
        .filter(size >= min_rows)
    )
    return kept.withColumns(
        {
            "source_row_start": start,
            "source_row_end": start + size - 1,
            "subsequence_row_pos": F.col("sample_index") - start,
            "subsequence_id": F.concat_ws(
                "::", *[F.col(c).cast("string") for c in seq.keys], F.format_string("subseq_%04d", F.col("chunk_index"))
            ),
        }
    ).drop("__size")


def chunk_sequence(seq: Sequence) -> Sequence:
    """Sequence spec of chunked rows: chunk lengths are bounded, so plain windows serve."""
    return Sequence((*seq.keys, "chunk_index"), ("sample_index",), None)


def role_counts(n: Column | str, train: float = 0.6, validation: float = 0.2) -> Column:
    """struct(train, validation, test) counts for ``n`` chunks; halves round to even, no role empty from 3 up."""
    if not (0 < train < 1 and 0 < validation < 1 and train + validation < 1):
        raise ValueError("fractions must be positive and leave room for a test part")
    n = F.col(n) if isinstance(n, str) else n
    t0 = F.greatest(F.lit(1), F.bround(n * F.lit(train), 0).cast("int"))
    v0 = F.greatest(F.lit(1), F.bround(n * F.lit(validation), 0).cast("int"))
    v1 = F.when(t0 + v0 >= n, F.greatest(F.lit(1), n - t0 - 1)).otherwise(v0)
    t1 = F.when(t0 + v1 >= n, F.greatest(F.lit(1), n - v1 - 1)).otherwise(t0)
    t = F.when(n >= 3, t1).when(n >= 1, F.lit(1)).otherwise(F.lit(0))
    v = F.when(n >= 3, v1).when(n == 2, F.lit(1)).otherwise(F.lit(0))
    return F.struct(
        t.cast("int").alias("train"), v.cast("int").alias("validation"), (n - t - v).cast("int").alias("test")
    )


def chunk_metadata(chunks: DataFrame, keys: tuple[str, ...], target: str, context: list[str] = ()) -> DataFrame:
    """One row per chunk: size, target mean and population std, source range, context medians."""
    group = [*keys, "chunk_index"]
    aggs = [
        F.first("subsequence_id").alias("subsequence_id"),
        F.count("*").alias("n_rows"),
        F.avg(target).alias("target_mean"),
        F.stddev_pop(target).alias("target_std"),
        F.min("sample_index").alias("start_sample_index"),
        F.max("sample_index").alias("end_sample_index"),
        *[F.median(c).alias(c) for c in context],
    ]
    return chunks.groupBy(*group).agg(*aggs)


def sequence_metadata(df: DataFrame, keys: list[str], target: str, order: list[str]) -> DataFrame:
    """Rows, target mean and population std, first and last order value per sequence."""
    o = order[0]
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.avg(target).alias("target_mean"),
        F.stddev_pop(target).alias("target_std"),
        F.min(o).alias("first_order"),
        F.max(o).alias("last_order"),
    )


# Shuffles are orders that any engine can repeat: a chunk has a number u below the prime PRIME by the md5 of seed and key, and trial t
# sorts by (u * m + a) modulo PRIME, then by u, then by chunk, with m and a taken from the md5 of seed and t.
PRIME = (1 << 31) - 1
HELD_CHUNKS = 4_000_000  # chunks of a sequence that one task holds, 24 bytes each; longer ones are ranked over many tasks
TRIAL_BLOCK = 1 << 22  # numbers of a block of trials that are sorted together


def trial_numbers(seed: int, trial: int) -> tuple[int, int]:
    digest = hashlib.md5(f"{seed}:trial:{trial}".encode()).hexdigest()
    return int(digest[:12], 16) % (PRIME - 1) + 1, int(digest[12:24], 16) % PRIME


def seeded_number(seed: int, keys: Iterable[str], digits: int = 15) -> Column:
    """The first hexadecimal digits of the md5 of seed and keys, joined by colons (null as such), as a long."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, digits), 16, 10).cast("long")


def _scores(rows: np.ndarray, means: np.ndarray, orders: np.ndarray, cuts: tuple[int, int]) -> np.ndarray:
    """Score of each order (a row of ``orders``): how far the roles' row shares and means are from the sequence's."""
    n, weights = len(rows), rows * means
    total, spread = rows.sum(), means.std()
    spread = max(spread if spread > 0 else 1.0, 1e-9)
    upto_r = np.cumsum(rows[orders], axis=1)
    upto_m = np.cumsum(weights[orders], axis=1)
    edges = [0, cuts[0], cuts[0] + cuts[1], n]
    score = np.zeros(len(orders))
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            r = upto_r[:, b - 1] - (upto_r[:, a - 1] if a else 0)
            m = upto_m[:, b - 1] - (upto_m[:, a - 1] if a else 0)
            score += 2.0 * np.abs(r / total - (b - a) / n) + 1.5 * np.abs(m / r - weights.sum() / total) / spread
    return score


def _best_order(u: np.ndarray, chunk: np.ndarray, rows: np.ndarray, means: np.ndarray, cuts: tuple[int, int], numbers: np.ndarray) -> tuple[np.ndarray, float]:
    """The order of the best trial, and its score; the first of those equal to 12 digits wins."""
    first = np.lexsort((chunk, u))
    u, rows, means = u[first], rows[first], means[first]
    block, best = max(1, TRIAL_BLOCK // max(1, len(u))), (np.inf, 0, 0.0)
    for t in range(0, len(numbers), block):
        m, a = numbers[t : t + block, :1], numbers[t : t + block, 1:]
        score = _scores(rows, means, np.argsort((u * m + a) % PRIME, axis=1, kind="stable"), cuts)
        rounded = np.round(score, 12)
        at = int(np.argmin(rounded))
        if rounded[at] < best[0]:
            best = (float(rounded[at]), t + at, float(score[at]))
    m, a = numbers[best[1]]
    return first[np.argsort((u * m + a) % PRIME, kind="stable")], best[2]


def assign_roles(
    meta: DataFrame, keys: tuple[str, ...], trials: int = 2000, seed: int = 42, train: float = 0.6, validation: float = 0.2
) -> DataFrame:
    """Give every chunk a role: of ``trials`` seeded shuffles per sequence, the best balanced one.

    The score weighs each role's row fraction (2.0) and target mean (1.5 per population std of the
    chunk means) against the sequence's; settings are constant within a sequence and cannot change
    the winner. A missing target mean counts as the mean of the sequence's others.

    The chunks of a sequence meet once, as numbers, in one task, which scores all trials in place: nothing grows with the trials. A
    sequence of more than HELD_CHUNKS chunks is ranked trial by trial over many tasks instead, with the same result.
    """
    group, meta = list(keys), cut_lineage(meta)  # one row per chunk, read several times below: the chunks are made once
    numbers = np.array([trial_numbers(seed, t) for t in range(max(1, trials))], np.int64)
    sizes = meta.groupBy(*group).agg(F.count("*").alias("__n")).withColumn("__counts", role_counts(F.col("__n"), train, validation))
    slim = meta.select(*group, F.col("chunk_index").cast("long").alias("chunk_index"), F.col("n_rows").cast("double").alias("__rows"), F.col("target_mean").cast("double").alias("__mean"),
                       (seeded_number(seed, [*keys, "chunk_index"], 12) % PRIME).alias("__u"))
    ready = _same(slim, sizes, group)
    roles = _held_roles(ready.filter(F.col("__n") <= HELD_CHUNKS), group, numbers)
    if (sizes.agg(F.max("__n")).first()[0] or 0) > HELD_CHUNKS:
        roles = roles.unionByName(_spread_roles(ready.filter(F.col("__n") > HELD_CHUNKS), group, numbers))
    return _same(meta, roles, [*group, "chunk_index"])


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which a NULL key meets a NULL key."""
    named = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(named[f"__right_{k}"])
    return left.join(named, on).drop(*[f"__right_{k}" for k in keys])


def _held_roles(ready: DataFrame, group: list[str], numbers: np.ndarray) -> DataFrame:
    """(keys, chunk_index, split_role, score), one sequence after another."""
    kinds = [ready.schema[k] for k in group]
    schema = T.StructType([*kinds, T.StructField("chunk_index", T.LongType()), T.StructField("split_role", T.StringType()), T.StructField("score", T.DoubleType())])
    names = np.array(ROLES)

    def solved(key: pa.RecordBatch, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        get = lambda c: np.concatenate([p.column(p.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for p in parts])
        chunk, rows, means, u = get("chunk_index"), get("__rows"), get("__mean").astype(float), get("__u")
        known = means[~np.isnan(means)]
        means = np.where(np.isnan(means), known.mean() if len(known) else 0.0, means)
        cuts = tuple(int(parts[0].column(parts[0].schema.get_field_index(c))[0].as_py()) for c in ("__t", "__v"))
        order, score = _best_order(u, chunk, rows, means, cuts, numbers)
        role = np.full(len(order), 2)
        role[order[: cuts[0] + cuts[1]]] = 1
        role[order[: cuts[0]]] = 0
        same = [pa.concat_arrays([p.column(i) for p in parts]) for i in range(len(group))]
        return pa.RecordBatch.from_arrays([*same, pa.array(chunk), pa.array(names[role]), pa.array(np.full(len(chunk), score))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        for batch in batches:
            begins = np.flatnonzero(batch.column(batch.schema.get_field_index("__first")).to_numpy(zero_copy_only=False))
            edges = [0, *[b for b in begins.tolist() if b], batch.num_rows]
            for i, (s, e) in enumerate(zip(edges[:-1], edges[1:])):
                if s == e:
                    continue
                if parts and s in begins:
                    yield solved(parts[0], parts)
                    parts = []
                parts.append(batch.slice(s, e - s))
        if parts:
            yield solved(parts[0], parts)

    first = F.row_number().over(Window.partitionBy(*group).orderBy("chunk_index")) == 1
    width = int(ready.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the chunks are few bytes and much work: all tasks share them
    arranged = ready.repartition(width, *group).select(*group, "chunk_index", "__rows", "__mean", "__u", F.col("__counts.train").alias("__t"), F.col("__counts.validation").alias("__v"), first.alias("__first"))
    return arranged.mapInArrow(run, schema)


def _spread_roles(ready: DataFrame, group: list[str], numbers: np.ndarray) -> DataFrame:
    """The same for sequences too long for one task: every trial is a sequence of its own, ranked in buckets of the order."""
    fills = ready.groupBy(*group).agg(F.coalesce(F.avg("__mean"), F.lit(0.0)).alias("__fill"), F.sum("__rows").alias("__total"))
    filled = _same(ready, fills, group).withColumn("__mean", F.coalesce("__mean", "__fill"))
    scale = filled.groupBy(*group).agg((F.sum(F.col("__mean") * F.col("__rows")) / F.sum("__rows")).alias("__global"), F.stddev_pop("__mean").alias("__sd"))
    filled = _same(filled, scale, group)
    table = ready.sparkSession.createDataFrame([(t, int(m), int(a)) for t, (m, a) in enumerate(numbers)], "__t int, __m long, __a long")

    def ranked(rows: DataFrame) -> DataFrame:
        placed = rows.join(F.broadcast(table), "__t").withColumn("__o", (F.col("__u") * F.col("__m") + F.col("__a")) % PRIME)  # as many rows as trials
        at = with_position(placed, Sequence((*group, "__t"), ("__o", "__u", "chunk_index"), "shiftright(__o, 21)"), "__at")
        t, v = F.col("__counts.train"), F.col("__counts.validation")
        return at.withColumn("split_role", F.when(F.col("__at") < t, ROLES[0]).when(F.col("__at") < t + v, ROLES[1]).otherwise(ROLES[2]))

    tried = ranked(filled.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(len(numbers) - 1)))))
    score, sums = F.lit(0.0), []
    spread = F.greatest(F.when(F.col("__sd") > 0, F.col("__sd")).otherwise(F.lit(1.0)), F.lit(1e-9))
    for r in ROLES:
        here = F.col("split_role") == r
        sums += [
            F.count_if(here).alias(f"__k_{r}"), F.sum(F.when(here, F.col("__rows")).otherwise(0.0)).alias(f"__r_{r}"),
            F.sum(F.when(here, F.col("__rows") * F.col("__mean")).otherwise(0.0)).alias(f"__m_{r}"),
        ]
        share = F.abs(F.col(f"__r_{r}") / F.col("__total") - F.col(f"__k_{r}") / F.col("__n"))
        shift = F.abs(F.col(f"__m_{r}") / F.col(f"__r_{r}") - F.col("__global"))
        score = score + F.when(F.col(f"__k_{r}") > 0, 2.0 * share + 1.5 * shift / spread).otherwise(F.lit(0.0))
    scored = tried.groupBy(*group, "__t", "__total", "__n", "__global", "__sd").agg(*sums).withColumn("score", score)
    best = scored.groupBy(*group).agg(F.min_by(F.struct("__t", "score"), F.struct(F.round("score", 12), F.col("__t"))).alias("__b"))
    won = _same(filled, best.select(*group, F.col("__b.__t").alias("__t"), F.col("__b.score").alias("score")), group)
    return ranked(won).select(*group, "chunk_index", "split_role", "score")


def split_manifest(
    meta: DataFrame, keys: tuple[str, ...], context: list[str] = (), check: bool = False
) -> DataFrame:
    """Ranges, sizes, target statistics, role and condition label per chunk.

    ``check`` runs one small job and fails if any role is empty overall.
    """
    label = condition_label([(c, F.col(c)) for c in context])
    out = meta.withColumn("condition_group", label)
    if check:
        seen = {r[0] for r in out.select("split_role").distinct().collect()}
        missing = [r for r in ROLES if r not in seen]
        if missing:
            raise ValueError(f"no chunk has role {missing}")
    return out


def apply_manifest(df: DataFrame, manifest: DataFrame, keys: tuple[str, ...], length: int, gap: int, position: str) -> DataFrame:
    """Give rows the role a stored manifest assigns to their position range.

    Chunks lie on a fixed grid, so the range lookup is an equi-join on (source, chunk index) followed
    by an exact range check; no range join.
    """
    rows = df.withColumn("chunk_index", F.floor(F.col(position) / (length + gap)).cast("bigint"))
    ranges = manifest.select(
        *keys, "chunk_index", "split_role", F.col("start_sample_index").alias("__a"), F.col("end_sample_index").alias("__b")
    )
    return (
        rows.join(ranges, [*keys, "chunk_index"])
        .filter(F.col(position).between(F.col("__a"), F.col("__b")))
        .drop("__a", "__b")
    )


def trim_start(df: DataFrame, n: int, position: str = "subsequence_row_pos") -> DataFrame:
    """Drop the first ``n`` rows of every chunk."""
    return df.filter(F.col(position) >= n)


def condition_coverage(df: DataFrame, condition: list[str], role: str = "split_role") -> DataFrame:
    """Was each row's condition seen in training, and is it an extrapolation? NULLs match NULLs."""
    trained = df.filter(F.col(role) == "train").select(*[F.col(c).alias(f"__{c}") for c in condition]).distinct()
    on = None
    for c in condition:
        same = F.col(c).eqNullSafe(F.col(f"__{c}"))
        on = same if on is None else on & same
    # Distinct conditions are few; a hot one is split by the adaptive skew join.
    seen = df.join(trained.withColumn("__hit", F.lit(True)), on, "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    return seen.withColumns(
        {"condition_seen_in_train": hit, "is_extrapolation_condition": (F.col(role) != "train") & ~hit}
    ).drop("__hit", *[f"__{c}" for c in condition])


def unseen_conditions(df: DataFrame, condition: list[str], role: str = "split_role") -> DataFrame:
    """The conditions outside training that training does not have, with their rows: what a warning lists. NULLs match NULLs."""
    trained = df.filter(F.col(role) == "train").select(*[F.col(c).alias(f"__{c}") for c in condition]).distinct()
    others = df.filter(F.col(role) != "train").groupBy(*condition).agg(F.count("*").alias("n_rows"))  # few rows before the join
    on = F.lit(True)
    for c in condition:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return others.join(trained, on, "left_anti")


def distinct_conditions(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)


def shuffle_order(df: DataFrame, key: list[str], seed: int, out: str = "shuffle_rank") -> DataFrame:
    """Seeded order of rows: a range-partitioned global sort by the md5 of seed and key."""
    return df.withColumn(out, seeded_number(seed, key)).orderBy(out, *key)


SAMPLE_BITS = 16  # leading bits of a seeded number that name its bucket: 65 536 counts at most


def sample_n(df: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), the same on every cluster: those of the n smallest seeded numbers of their key.

    ``key`` tells rows apart. Rows are counted per bucket of the number; buckets that lie wholly below the cut pass as they are, and
    only in the one that holds the cut, a 65 536th of all rows, are rows ranked. All of it is one plan without a look at the data.
    """
    bucket = F.shiftright("__h", 60 - SAMPLE_BITS)
    hashed = df.withColumn("__h", seeded_number(seed, key)).withColumn("__bucket", bucket)
    counts = hashed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # of the counts only
    placed = counts.withColumn("__upto", before).filter(F.col("__upto") - F.col("__n") < n)
    inside = hashed.join(F.broadcast(placed), "__bucket")
    whole = inside.filter(F.col("__upto") <= n)
    cut = inside.filter(F.col("__upto") > n)
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy("__h", *key))
    last = cut.withColumn("__rank", rank).filter(F.col("__rank") <= n - (F.col("__upto") - F.col("__n"))).drop("__rank")
    return whole.unionByName(last).select(*df.columns)


def balanced_weights(df: DataFrame, group: list[str], out: str = "weight", bounded: bool = False) -> DataFrame:
    """Weight 1 / group size, scaled to mean 1 over all rows.

    Where groups are ``bounded``, as chunks are, a window counts them and the rows are kept: what makes ``df`` runs once.
    """
    if bounded:
        sized = cut_lineage(df.withColumn("__size", F.count(F.lit(1)).over(Window.partitionBy(*group))))
        groups, rows = sized.agg(F.round(F.sum(1.0 / F.col("__size"))), F.count("*")).first()
        return sized.withColumn(out, 1.0 / F.col("__size") / F.lit((groups or 0.0) / max(rows, 1))).drop("__size")
    sizes = df.groupBy(*group).agg(F.count("*").alias("__size"))
    mean = sizes.agg((F.count("*") / F.sum("__size")).alias("m")).scalar()
    return df.join(sizes, group, "left").withColumn(out, 1.0 / F.col("__size") / mean).drop("__size")
