"""Finding keys too large for one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from footfall.session import materialize

# A key with more rows than this is split; about 1 GB of sorted narrow rows.
HOT_ROWS = 5_000_000
# Hot keys are broadcast up to this many, and joined without a hint beyond.
BROADCAST_KEYS = 100_000


@dataclass(frozen=True)
class HotKeys:
    """Keys above a row limit.  ``frame`` holds one column, the key."""

    frame: DataFrame
    count: int

    @property
    def hinted(self) -> DataFrame:
        return F.broadcast(self.frame) if self.count <= BROADCAST_KEYS else self.frame


def find_hot_keys(df: DataFrame, key: str, limit: int = HOT_ROWS) -> HotKeys | None:
    """Keys with more than ``limit`` rows, or None.

    Reads the key column only; counts are combined before they are shuffled.  At most
    rows / limit keys can qualify, and no more than BROADCAST_KEYS + 1 reach the driver.
    """
    hot = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit).select(key)
    found = hot.limit(BROADCAST_KEYS + 1).collect()
    if not found:
        return None
    if len(found) <= BROADCAST_KEYS:
        hot = df.sparkSession.createDataFrame(found, hot.schema)
    else:
        hot = materialize(hot, "hot-keys")  # several joins read it
    return HotKeys(hot, len(found))
