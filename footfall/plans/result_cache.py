"""Results kept in the shared folder and used again until they are too old.

A result is found by what it is made of: the canonical form of its plan, and the name, size and
time of every file that it reads.  A changed file or another plan is another result; what is
older than the age limit is computed anew.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

from footfall.session import scratch_folder

MAX_AGE = timedelta(hours=1)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _input_state(df: DataFrame) -> list[str]:
    """Name, size and time of the files that ``df`` reads; a folder is listed once."""
    spark = df.sparkSession
    wanted = set(df.inputFiles())
    folders = sorted({f.rsplit("/", 1)[0] for f in wanted})
    found = []
    for folder in folders:
        system, place = _file_system(spark, folder)
        for status in system.listStatus(place):
            found.append(f"{status.getPath().toString()}|{status.getLen()}|{status.getModificationTime()}")
    # The same file may be written in several ways (file:/a, file:///a); names within folders are not.
    names = {f.rsplit("/", 1)[1] for f in wanted}
    return sorted(f for f in found if f.split("|")[0].rsplit("/", 1)[1] in names)


def result_key(df: DataFrame) -> str:
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    parts = [plan, df.schema.json(), df.sparkSession.conf.get("spark.sql.session.timeZone"), *_input_state(df)]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def cached(df: DataFrame, max_age: timedelta = MAX_AGE, folder: str | None = None) -> DataFrame:
    """``df``, or what was stored of it no longer than ``max_age`` ago.

    The result is written to a folder of its own, and the entry that names it last, so that
    readers never see half a result, and two that compute it at once both succeed.  Entries lie
    in ``folder``, by default in the shared scratch folder; expire it as you would checkpoints.
    """
    spark = df.sparkSession
    place = f"{folder or scratch_folder(spark)}/footfall/results/{result_key(df)}"
    newest = _newest(spark, place)
    if newest is not None and time.time() - newest[0] <= max_age.total_seconds():
        return spark.read.schema(df.schema).parquet(newest[1])
    name = uuid.uuid4().hex
    began = time.time()
    df.write.parquet(f"{place}/{name}")
    system, entry = _file_system(spark, f"{place}/entries/{int(began * 1000):015d}-{name}")
    system.create(entry).close()
    return spark.read.schema(df.schema).parquet(f"{place}/{name}")


def _newest(spark: SparkSession, place: str) -> tuple[float, str] | None:
    """When the newest entry was computed, and where it is."""
    system, entries = _file_system(spark, f"{place}/entries")
    if not system.exists(entries):
        return None
    names = [s.getPath().getName() for s in system.listStatus(entries)]
    if not names:
        return None
    when, name = max(names).split("-")
    return int(when) / 1000, f"{place}/{name}"
