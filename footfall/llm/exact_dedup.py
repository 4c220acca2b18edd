"""Exact dedup: equal texts form a class, and the row with the largest id stays.

Copies are combined where they are read, then per digest and salt, then per digest; all
three compare whole texts.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.common import quoted, rows_that_stay, text_or_empty
from footfall.session import materialize

SALTS = 32
# A class is hot if it has more than this fraction of all rows, so at most as many are hot.
HOT_CLASSES = 10_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def copy_classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256,
    salts: int = SALTS,
) -> DataFrame:
    """``digest, content, keep_id, group_size``: one row per distinct text, NULL as empty.

    ``content`` is NULL where the digest names one text only, and the text itself where texts
    share a digest; so no class ever rests on the digest alone.  Grouping by the text makes
    Spark combine copies in the reading task, so each task sends one row per distinct text;
    salts then spread what many tasks send of the same text.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("content"))
    salted = (
        rows.select("doc_id", "content", digest(F.col("content")).alias("digest"))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        .groupBy("digest", "salt", "content")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    winners = (
        salted.repartition("digest")  # also serves the next grouping
        .groupBy("digest", "content")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    alone = materialize(
        winners.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")),
        "classes",
    )
    no_content = F.lit(None).cast("string").alias("content")
    single = alone.where(F.col("texts") == 1).select("digest", no_content, "keep_id", "group_size")
    shared = alone.where(F.col("texts") > 1).select("digest")
    if not shared.take(1):
        return single
    return single.unionByName(
        winners.join(shared, "digest", "left_semi").select("digest", "content", "keep_id", "group_size")
    )


def exact_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256,
    salts: int = SALTS,
    hot_classes: int = HOT_CLASSES,
) -> DataFrame:
    """``doc_id, digest, keep_id, group_size, kept`` for every row, dropped ones too.

    ``kept`` is true where the row's id is the largest of its class.  Rows that repeat an id
    with its text count towards ``group_size`` and are marked alike.  NULL ids rank below all
    others; a class of NULL ids only keeps them.

    Rows of classes with more than one ``hot_classes``-th of all rows meet their class where
    they are read, as at most ``hot_classes`` classes are broadcast; no text has its rows
    gathered in one task.  All others are shuffled by digest.
    """
    classes = copy_classes(docs, doc_id, text, digest, salts)
    shared = classes.where(F.col("content").isNotNull())
    single = classes.where(F.col("content").isNull()).drop("content")
    content = text_or_empty(text)
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), digest(content).alias("digest")), "digests")
    n_rows = single.agg(F.sum("group_size")).first()[0] or 0
    is_hot = F.col("group_size") * hot_classes > n_rows
    hot = single.where(is_hot)
    cold_rows = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    found = rows.join(F.broadcast(hot), "digest").unionByName(cold_rows.join(single.where(~is_hot), "digest"))
    found = found.select("doc_id", "digest", "keep_id", "group_size")
    if shared.take(1):
        whole = docs.select(F.col(doc_id).alias("doc_id"), digest(content).alias("digest"), content.alias("content"))
        found = found.unionByName(
            whole.join(shared, ["digest", "content"]).select("doc_id", "digest", "keep_id", "group_size")
        )
    return found.select(
        F.col("doc_id").alias(doc_id), "digest", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
    )


def one_per_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The one row of each class that stays; columns stay as they are.  Of rows that repeat
    the largest id with its text, or have NULL ids only, one stays too."""
    marked = materialize(
        exact_duplicates(docs, doc_id, text)
        .where("group_size > 1")
        .groupBy(F.col(quoted(doc_id)).alias("_id"), F.col("digest").alias("_digest"), "kept")
        .agg(F.count(F.lit(1)).alias("_rows")),
        "copies",
    )
    repeated = marked.where(F.col("kept") & (F.col("_rows") > 1))
    return rows_that_stay(docs, marked.where(~F.col("kept")).select("_id", "_digest"), repeated.select("_id", "_digest"), doc_id, text)
