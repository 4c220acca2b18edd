"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as
Parquet to the shared folder and hands the written rows to the next one.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.llm import decontaminate, exact_dedup, packing, quality, simhash
from footfall.llm.common import fresh_name, quoted, table
from footfall.llm.queries import vocabulary_file
from footfall.session import new_scratch_path, scratch_scope


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh_name(docs, "score")
    scored = quality.with_scores(docs, model, score=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(*[F.col(quoted(c)) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.one_per_class(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose SimHash fingerprints are linked, the one with the smallest id stays."""
    return simhash.one_per_component(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with any word window of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences."""
    return packing.pack_documents(docs, vocabulary_file())


STAGES = [
    ("quality", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Models, fingerprints and tokens have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep.

    What a stage wrote besides its result, and the result before it, are deleted on the way.
    """
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before, path = path, new_scratch_path(spark, name.replace(" ", "-"))
        with scratch_scope(spark) as written:
            stage(spark, docs, sf_dir).write.parquet(path)
            written += [before] if before else []
        docs = spark.read.parquet(path)
    return docs
