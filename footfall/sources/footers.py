"""Counts and ranges that Parquet files state in their footers, without reading rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

# Of these types Spark takes the smallest and largest value from footers.
RANGED = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date")


def footer_session(spark: SparkSession) -> SparkSession:
    """A session in which Parquet scans push aggregates down; the caller's stays as it is."""
    own = spark.newSession()
    listed = spark.conf.get("spark.sql.sources.useV1SourceList")
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(s for s in listed.split(",") if s.strip() != "parquet"))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def footer_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """``table_name, row_count``: the rows of every Parquet path, as its footers state them."""
    own = footer_session(spark)
    counts = None
    for name, path in paths.items():
        one = own.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def footer_ranges(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """``column, rows, smallest, largest`` of each of ``columns``, as strings.

    Columns of other types than RANGED have no range in footers that Spark trusts: an error.
    """
    table = footer_session(spark).read.parquet(path)
    kinds = dict(table.dtypes)
    other = [c for c in columns if kinds[c] not in RANGED]
    if other:
        raise ValueError(f"footers give no range of {', '.join(other)}")
    found = table.agg(
        F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{f.__name__}_{i}") for i, c in enumerate(columns) for f in (F.min, F.max)]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col("rows"), F.col(f"min_{i}").cast("string").alias("smallest"), F.col(f"max_{i}").cast("string").alias("largest")
        )
        for i, c in enumerate(columns)
    ]
    return found.select(F.inline(F.array(*rows)))
