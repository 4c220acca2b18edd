"""Sharding by jump consistent hashing: a key and the number of shards decide, no table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.common import fresh_name, quoted, text_or_empty, with_group_ranks
from footfall.session import materialize

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every 64-bit key.

    Each key jumps from one shard count at which it moves to the next; its shard is the last
    before ``shards``.  So with one more shard a key stays or goes to the new one, and does
    the latter with probability 1 / (shards + 1).
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), dtype=np.int64)
    following = np.zeros(len(state), dtype=np.int64)
    moving = np.arange(len(state))
    while len(moving):
        shard[moving] = following[moving]
        state[moving] = state[moving] * _STEP + np.uint64(1)
        draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        following[moving] = np.floor((shard[moving] + 1.0) * (float(1 << 31) / draw)).astype(np.int64)
        moving = moving[following[moving] < shards]
    return shard.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """INT from 0 to ``shards`` - 1; ``key`` is a LONG, best a hash, and NULL counts as 0."""

    @F.pandas_udf("int")
    def compute(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.fillna(0).to_numpy(np.int64).view(np.uint64), shards))

    return compute(key)


def assign_shards(
    docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", grown: int | None = None
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` and, with ``grown`` shards, ``grown_shard``.

    ``size`` is the text's length in UTF-8 plus one; NULL is an empty text.  ``slot`` numbers
    the rows of a shard by id, from 0 without gaps.  Rows that repeat an id have the same
    shard and slots of their own; rows with a NULL id share a shard.
    """
    content = text_or_empty(text)
    key = F.xxhash64(F.col(doc_id).cast("string"))
    more = {} if grown is None else {"grown_shard": jump_shard(key, grown)}
    placed = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(content) + 1).cast("long").alias("size"),
            F.crc32(F.encode(content, "UTF-8")).alias("text_crc32"),
            jump_shard(key, shards).alias("shard"),
            *[column.alias(name) for name, column in more.items()],
        ),
        "shards",
    )
    ranked = with_group_ranks(placed, "shard", ["doc_id", "text_crc32", "size"], "slot", "slots")
    return ranked.select(F.col("doc_id").alias(doc_id), "size", "text_crc32", "shard", "slot", *more)


def write_shards(docs: DataFrame, path: str, shards: int, doc_id: str = "doc_id") -> str:
    """Writes ``docs`` with all its columns to ``path``/shard=0, 1, ... and returns the name of
    the new column: ``shard``, or a longer name if ``docs`` has that one.

    Tasks write what they hold of each shard, so no shard is ever in one task.
    """
    name = fresh_name(docs, "shard")
    key = F.xxhash64(F.col(quoted(doc_id)).cast("string"))
    docs.withColumn(name, jump_shard(key, shards)).write.partitionBy(name).parquet(path)
    return name
