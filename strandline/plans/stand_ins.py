"""The driver tables seen as sensor sequences.

``events``: per user, ``view`` rows are frames and all other rows samples of ``value``.
``lineitem``: per supplier, a multi-signal sequence in ship-date order.
The SQL texts define the same roles for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sequence import Sequence, measured


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Seconds since 2024-01-01, exact to the microsecond.
EPOCH_2024_US = 1_704_067_200_000_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").try_cast("double").alias("k"),
        ((micros - EPOCH_2024_US) / F.lit(1_000_000.0)).alias("t"),
    )


EVENTS_SQL = """
ev AS (SELECT event_id, user_id, event_type, value,
              TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
              (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE AS t
       FROM events)
"""

EVENT_SEQ = Sequence(("user_id",), ("t", "event_id"), axis="t")


def event_seq(spark: SparkSession, sf_dir: str) -> Sequence:
    return measured(events(spark, sf_dir), EVENT_SEQ)


def frame_seq(spark: SparkSession, sf_dir: str) -> Sequence:
    return event_seq(spark, sf_dir).along("frame_time", ("frame_time", "frame_number"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_type = 'view'").select(
        "user_id", F.col("event_id").alias("frame_number"), F.col("t").alias("frame_time"), "value", "k"
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_type <> 'view'").select("user_id", "event_id", "t", "value", "k", "event_type")


LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
LINE_SEQ = Sequence(("l_suppkey",), LINE_ORDER, axis="datediff(l_shipdate, DATE'1995-01-01')")


def line_seq(spark: SparkSession, sf_dir: str) -> Sequence:
    return measured(table(spark, sf_dir, "lineitem"), LINE_SEQ)


def lines(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    columns = ["l_suppkey", *LINE_ORDER, "l_quantity", "l_extendedprice", "l_discount", "l_tax", *extra]
    return table(spark, sf_dir, "lineitem").select(*dict.fromkeys(columns))


W_LINE = "PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey"
W_USER = "PARTITION BY user_id ORDER BY t, event_id"
LINE_KEY = "l_suppkey, l_orderkey, l_linenumber, l_partkey"


def near(c, digits: int = 6):
    """Round for comparison with an oracle. The odd offset keeps exact decimal ties off the boundary,
    where two engines that sum in different orders could fall on different sides."""
    scale = float(10**digits)
    return F.floor((F.col(c) if isinstance(c, str) else c) * scale + 0.5137) / scale


def near_sql(c: str, digits: int = 6) -> str:
    return f"FLOOR(({c}) * 1e{digits} + 0.5137) / 1e{digits}"
