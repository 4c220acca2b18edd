"""Readers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F


def normalise(df: DataFrame, rename: Mapping[str, str] | None = None) -> DataFrame:
    """Lower-case column names and apply ``rename``, matching names without regard to case.

    Only names change: a filter on any column still reaches the scan.
    """
    rename = {old.lower(): new for old, new in (rename or {}).items()}
    return df.select(
        *[F.col(f"`{name}`").alias(rename.get(name.lower(), name.lower())) for name in df.columns]
    )


def read_files(
    spark: SparkSession,
    path: str,
    rename: Mapping[str, str] | None = None,
    file_format: str = "parquet",
    **options: str,
) -> DataFrame:
    return normalise(spark.read.format(file_format).options(**options).load(path), rename)


def read_table(spark: SparkSession, name: str, rename: Mapping[str, str] | None = None) -> DataFrame:
    """A catalog table by its one-, two- or three-part name."""
    return normalise(spark.table(name), rename)


def preview(df: DataFrame, rows: int = 5, order_by: str | None = None) -> DataFrame:
    """A first look at the data: some rows, or the first ones in an order."""
    return (df if order_by is None else df.orderBy(order_by)).limit(rows)
