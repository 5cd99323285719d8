"""What the operators of this package share: written intermediate tables, keys and Arrow maps."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import shared_dir

SPACE = r"[^\x20\x09-\x0D]+"  # words, as every size in words counts them
NULL_ID = -(1 << 63)  # a null id sorts before all others


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[list[str]] = []  # per open ``settled``, the folders written on its way


def written(df: DataFrame, tag: str) -> DataFrame:
    """The table written once into the shared folder and read back: computed once, and safe from lost executors.

    Shuffle files of the write go when it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    if _written:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settled(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """``written(make(), tag)``; the tables written on the way, which only it reads, are removed."""
    _written.append([])
    try:
        df = make()
    finally:
        passed = _written.pop()
    out = written(df, tag)
    _remove(df.sparkSession, passed)
    return out


def discard(df: DataFrame) -> None:
    """Removes a written table that nothing reads any more."""
    _remove(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def source_key(column: str = "source") -> Column:
    """A non-null string that keeps the order of sources by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(column)), F.lit("1"))


def unit(*parts: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the parts alone: 48 bits of their md5."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def trim() -> None:
    """Gives memory that is free inside this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a worker that other stages use after it: what it needed at its peak does not stay with the worker."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return tidy


def arrow_map(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One batch in, at most one out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)
