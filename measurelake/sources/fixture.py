"""The measurement view over the star-schema test tables.

State = region, county = nation, site = supplier.  Every value is a multiple of
0.25, so sums do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Columns used, with their types: a given schema spares reading file footers
# for inference before a query even starts.
_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "lineitem": (
        "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "ts timestamp_ntz, event_type string, value double",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    def table(name: str) -> DataFrame:
        return _table(spark, sf_dir, name)

    # The large table leads, so each join sees the file size of its dimension:
    # nation and region are fixed and tiny, supplier is broadcast while small
    # and shuffled beyond that, where AQE splits skewed keys.  Joining the
    # dimensions first would hide their sizes behind a product estimate.
    quantity = F.col("l_quantity")
    pending = F.col("l_linestatus") == "O"
    return (
        table("lineitem")
        .join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("state_name"),
            F.col("n_name").alias("county_name"),
            F.col("l_shipdate").cast("date").alias("date_local"),
            F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("s_name")).alias("site_name"),
            (F.lit(25) + F.col("s_suppkey") % 25).cast("double").alias("latitude"),
            (F.lit(-125) + F.col("s_suppkey") % 60).cast("double").alias("longitude"),
            F.when(F.col("l_returnflag") == "R", "1 HOUR").otherwise("24 HOUR").alias("sample_duration"),
            F.when(~pending, "PM25 24-hour 2012").alias("pollutant_standard"),
            F.round(F.lit(100.0) - F.col("l_discount") * 1000.0).alias("observation_percent"),
            F.when(F.col("l_orderkey") % 997 == 0, F.lit(160.0) + quantity * 4.0)
            .otherwise(quantity * 0.75 - 3.0)
            .alias("pm25_raw"),
            F.when(pending, None)
            .when(F.col("l_orderkey") % 991 == 0, (F.lit(480.0) + quantity).cast("bigint"))
            .otherwise((quantity * 2.0).cast("bigint"))
            .alias("aqi_raw"),
        )
    )


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as readings: event type as state, value as concentration."""
    return _table(spark, sf_dir, "events").select(
        F.col("event_type").alias("state_name"),
        F.col("ts").cast("date").alias("date_local"),
        F.col("value").alias("pm25_cleaned"),
        F.lit(None).cast("double").alias("aqi_cleaned"),
    )
