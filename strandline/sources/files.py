"""Folder scans and exports. Parquet between stages; CSV and text at the edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.names import acquisition_mode, file_stem, safe_token
from strandline.functions.scalars import nan_to_null, point_x, point_y

IMAGE_GLOB = "*.{jpg,jpeg,png,JPG,JPEG,PNG}"
VIDEO_GLOB = "*.{avi,AVI}"

BLOB = T.ArrayType(
    T.StructType(
        [
            T.StructField("x", T.IntegerType()),
            T.StructField("y", T.IntegerType()),
            T.StructField("area", T.DoubleType()),
            T.StructField("diameter_px", T.DoubleType()),
        ]
    )
)

TRACK_SCHEMA = T.StructType(
    [
        T.StructField("image_name", T.StringType()),
        T.StructField("frame_idx", T.DoubleType()),
        T.StructField("feature_type", T.StringType()),
        T.StructField("track_id", T.DoubleType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("area", T.DoubleType()),
        T.StructField("diameter_px", T.DoubleType()),
    ]
)


def _clean(df: DataFrame) -> DataFrame:
    """NaN becomes NULL at every ingestion edge."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(c) for c in doubles}) if doubles else df


def read_measurements(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv") -> DataFrame:
    """Every measurement file under ``path``, tagged with its stem as ``experiment``."""
    reader = spark.read.schema(schema)
    raw = reader.csv(path, header=True, enforceSchema=False) if fmt == "csv" else reader.format(fmt).load(path)
    stem = file_stem(F.col("_metadata.file_name"))
    return _clean(raw.select("*", stem.alias("experiment")))


def read_tagged(spark: SparkSession, path: str, columns: list[str], schema: T.StructType | str, fmt: str = "csv") -> DataFrame:
    """Selected columns of every file, with the file name as ``source_file``."""
    reader = spark.read.schema(schema)
    raw = reader.csv(path, header=True, enforceSchema=False) if fmt == "csv" else reader.format(fmt).load(path)
    return _clean(raw.select(*columns, F.col("_metadata.file_name").alias("source_file")))


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Tracked rows written earlier: blanks and ``nan`` are missing, ids and coordinates whole numbers."""
    raw = spark.read.csv(path, header=True, schema=TRACK_SCHEMA, nullValue="", nanValue="nan", enforceSchema=False)
    out = _clean(raw)
    return out.withColumns({c: F.col(c).cast("int") for c in ("frame_idx", "track_id", "x", "y")})


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines per text file, named by its whole path; a last line without a terminator counts."""
    return spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n_lines"))


def discover_frames(spark: SparkSession, root: str, pattern: str = IMAGE_GLOB) -> DataFrame:
    """Image (or, with ``VIDEO_GLOB``, video) files below ``root`` with source name and acquisition mode.

    Only paths are selected, so file contents are never read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path")
    )
    return tag_sources(files, "path")


def tag_sources(df: DataFrame, path: str) -> DataFrame:
    """Source folder, source token and acquisition mode of each path."""
    parts = F.split(F.col(path), "/")
    return df.withColumns(
        {
            "source_folder": F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"),
            "source_name": safe_token(F.element_at(parts, -2)),
            "image_name": F.element_at(parts, -1),
            "mode": acquisition_mode(path),
        }
    )


def flatten_channels(df: DataFrame, experiment: str, name: str, values: str) -> DataFrame:
    """1-D or 2-D channel arrays to long form: (experiment, column, pos, value).

    A 1-D channel becomes column ``name``; column k of a 2-D channel becomes ``name/k``.
    """
    element = df.schema[values].dataType.elementType
    rows = df.select(experiment, name, F.posexplode(values).alias("pos", "__v"))
    if isinstance(element, T.ArrayType):
        rows = rows.select(experiment, name, "pos", F.posexplode("__v").alias("__k", "value"))
        label = F.concat(F.col(name), F.lit("/"), F.col("__k").cast("string"))
    else:
        rows = rows.withColumnRenamed("__v", "value")
        label = F.col(name)
    return rows.select(experiment, label.alias("column"), F.col("pos").cast("bigint"), F.col("value").cast("double"))


def widen_channels(long: DataFrame, experiment: str, columns: list[str] | None = None) -> DataFrame:
    """One row per (experiment, pos), one column per channel; shorter channels are padded with NULL."""
    return long.groupBy(experiment, "pos").pivot("column", columns).agg(F.first("value"))


def flatten_detections(df: DataFrame, points: dict[str, tuple[str, str]], pair: tuple[str, tuple[str, str, str, str]] | None = None) -> DataFrame:
    """Split point columns into x and y columns; absent points give missing values.

    points: point column -> (x name, y name). pair: array-of-points column -> (x1, y1, x2, y2) names.
    Blob arrays stay arrays; ``widen_blobs`` numbers them for export.
    """
    out: dict[str, Column] = {}
    for c, (xn, yn) in points.items():
        out[xn], out[yn] = point_x(c), point_y(c)
    drop = list(points)
    if pair is not None:
        c, (x1, y1, x2, y2) = pair
        first, second = F.try_element_at(F.col(c), F.lit(1)), F.try_element_at(F.col(c), F.lit(2))
        out.update({x1: point_x(first), y1: point_y(first), x2: point_x(second), y2: point_y(second)})
        drop.append(c)
    return df.withColumns(out).drop(*drop)


def widen_blobs(df: DataFrame, blobs: str, prefix: str, size: int | None = None) -> DataFrame:
    """Numbered columns ``prefix_i_{x,y,area,diameter_px}``; by default as many as the longest list; a list longer than ``size`` fails."""
    if size is None:
        size = max(df.agg(F.max(F.size(blobs))).first()[0] or 0, 0)
    longer = F.raise_error(F.lit(f"{blobs} holds more than {size} blobs")).cast(df.schema[blobs].dataType)
    listed = F.when(F.size(blobs) > size, longer).otherwise(F.col(blobs))
    item = lambda i: F.try_element_at(listed, F.lit(i))
    out = {f"{prefix}_{i}_{f}": item(i)[f] for i in range(1, size + 1) for f in ("x", "y", "area", "diameter_px")}
    return df.withColumns(out).drop(blobs)


def union_ragged(*frames: DataFrame) -> DataFrame:
    """Union by name; columns missing on one side are filled with NULL, first-seen column order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def write(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> str:
    writer = df.write.mode(mode).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
    return path


def write_by_experiment(df: DataFrame, path: str, experiment: str = "experiment", mode: str = "overwrite") -> str:
    """One folder per experiment. A rebalance keeps a large experiment in several files and small ones in one."""
    df.hint("rebalance", experiment).write.mode(mode).partitionBy(experiment).parquet(path)
    return path


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split into (good, rejected with ``reason``); a rule is true where a row is bad, first match wins."""
    reason = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()])
    tagged = df.withColumn("reason", reason)
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(F.col("reason").isNotNull())
