"""Tables that are kept by a key, so that joins and groupings on it move nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.session import new_scratch_path

BUCKETS = 64


def write_bucketed(df: DataFrame, key: str, buckets: int = BUCKETS, name: str | None = None, path: str | None = None) -> str:
    """Stores ``df`` in ``buckets`` sorted by ``key`` and returns the table's name.

    Rows are shuffled once, here, by the hash that buckets have, so every bucket is one file.
    Tables that are joined need the same number of buckets.  ``path`` is by default in the
    shared scratch folder; the catalog only knows the table as long as it lives.
    """
    name = name or f"footfall_{uuid.uuid4().hex}"
    place = path or new_scratch_path(df.sparkSession, "bucketed")
    (
        df.repartition(buckets, F.col(key))
        .write.format("parquet")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", place)
        .saveAsTable(name)
    )
    return name


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
