"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "footfall", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Call-site capture for error messages makes building a plan several times slower.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a session of one machine may fall back to a folder of its own: on a cluster a
    machine-local folder would be lost with the machine, and other machines cannot read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not is_one_machine(context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="footfall-"))
    return context.getCheckpointDir().rstrip("/")


def is_one_machine(master: str) -> bool:
    """``local`` and ``local[...]``, but not ``local-cluster[...]``, whose executors are processes of their own."""
    return master == "local" or master.startswith("local[")


def new_scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_folder(spark)}/footfall/{label}-{uuid.uuid4().hex}"
    for written in _scopes:
        written.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Cuts the lineage, so a lost executor costs a re-read and not a recompute, and
    pins values that depend on task placement, such as partition ids.  Unlike an
    RDD checkpoint the table is columnar and its size is known to the optimizer.
    """
    spark = df.sparkSession
    path = new_scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, when it ends, what was written to the scratch folder inside it.

    Results are lazy and may read such tables: write or collect them before the end.
    Without a scope tables stay; expire the folder as you would checkpoints.
    """
    written: list[str] = []
    _scopes.append(written)
    try:
        yield written
    finally:
        _scopes.remove(written)
        jvm, configuration = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in written:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(configuration).delete(place, True)
