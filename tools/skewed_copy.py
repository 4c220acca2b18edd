"""A larger, skewed copy of the shop tables: python tools/skewed_copy.py SOURCE TARGET [TIMES]

Repeats orders, lineitem and events TIMES times (30 by default) under new ids.  One user
gets a third of all events and orders, and one order a third of all lines.
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import Column, DataFrame, functions as F  # noqa: E402

from footfall.session import build_session  # noqa: E402
from footfall.sources.star_schema import TABLES  # noqa: E402

HOT_SHARE = 3
STRIDE = 10_000_000


def moved(column: str) -> Column:
    return F.col(column) + F.col("_copy") * STRIDE


def skewed(column: str, by: str) -> Column:
    """``column``, but 1 for a third of the rows."""
    return F.when(F.pmod(F.xxhash64(by, "_copy"), F.lit(HOT_SHARE)) == 0, F.lit(1)).otherwise(F.col(column)).cast("long")


def main() -> None:
    source, target = sys.argv[1:3]
    times = int(sys.argv[3]) if len(sys.argv) > 3 else 30
    spark = build_session("copy", "local[8]", **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{source}/{name}.parquet")

    def copies(name: str) -> DataFrame:
        return read(name).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).cast("long"))

    changes = {
        "orders": {"o_custkey": skewed("o_custkey", "o_orderkey"), "o_orderkey": moved("o_orderkey")},
        "lineitem": {"l_orderkey": F.when(F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "_copy"), F.lit(HOT_SHARE)) == 0, F.lit(1)).otherwise(moved("l_orderkey")).cast("long")},
        "events": {"user_id": skewed("user_id", "event_id"), "event_id": moved("event_id")},
    }
    for name in TABLES:
        table = copies(name).withColumns(changes[name]).drop("_copy") if name in changes else read(name)
        table.write.mode("errorifexists").parquet(f"{target}/{name}.parquet")
    spark.stop()


if __name__ == "__main__":
    main()
