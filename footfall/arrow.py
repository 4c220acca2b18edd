"""Arrow batches in tasks: columns of any name, and runs of equal keys in sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, types as T

# A batch takes several times its bytes: Spark's vectors grow by doubling, and rows that go
# out again are in memory twice.  Rows are dealt by number only, so texts need a limit.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def limit_batches(spark: SparkSession) -> None:
    """Batches of the session hold about BATCH_BYTES at most, or one row, unless it has a limit of its own.

    Spark reads the limit when a result is computed, so it stays set.
    """
    if spark.conf.get(_LIMIT, None) is None:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def map_batches(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``df.mapInArrow``, for columns of any name: Spark takes a dot for a field of a struct.  Batches are small."""
    names = df.columns
    limit_batches(df.sparkSession)

    def renamed(batches):
        return run(batch.rename_columns(names) for batch in batches)

    return df.toDF(*[f"_{i}" for i in range(len(names))]).mapInArrow(renamed, schema)


def run_starts(batch: pa.RecordBatch, keys: Sequence[str], last: list) -> np.ndarray:
    """Whether each row opens a run of equal ``keys``; NULLs are equal.

    ``last`` holds the keys of the row before the batch, empty at first, and is moved on.
    """
    opens = np.zeros(batch.num_rows, dtype=bool)
    values = [batch.column(k) for k in keys]
    for value in values:
        if len(value) > 1:
            missing = value.is_null().to_numpy(zero_copy_only=False)
            same = pc.fill_null(pc.equal(value[1:], value[:-1]), False).to_numpy(zero_copy_only=False)
            opens[1:] |= ~(same | (missing[1:] & missing[:-1]))
    if batch.num_rows:
        opens[0] = not last or any(v[0].as_py() != k for v, k in zip(values, last))
        last[:] = [v[-1].as_py() for v in values]
    return opens
