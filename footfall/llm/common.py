"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from footfall.arrow import map_batches, run_starts
from footfall.session import materialize

# At most so many ids with digests are broadcast, about 50 bytes each.
BROADCAST_ROWS = 500_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    # lower() is several times faster, and the same where every character is one byte.
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_arrow_columns(
    df: DataFrame,
    columns: Sequence[T.StructField],
    compute: Callable[[pa.RecordBatch], Sequence[pa.Array]],
    keep: Sequence[str],
) -> DataFrame:
    """``keep`` of ``df`` and new ``columns``, computed from whole Arrow batches in the tasks."""
    schema = T.StructType([df.schema[c] for c in keep] + list(columns))
    names = schema.names

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + list(compute(batch)), names=names
            )

    return map_batches(df, run, schema)


def text_digest(text: Column) -> Column:
    """SHA-256 of a text, NULL as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def split_groups(rows: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Which of ``_id, _digest`` go, and which stay but more than once, if one row of each
    ``group`` is to stay: the first by ``_id`` (NULL last), then by ``_digest``.

    Both have ``_id, _digest``.  A pair that is the first of any group stays.
    """
    counted = materialize(rows.groupBy(group, "_id", "_digest").agg(F.count(F.lit(1)).alias("_rows")), "grouped")
    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_digest"))
    firsts = counted.groupBy(F.col(group).alias("_of")).agg(first.alias("_first"))
    marked = counted.join(firsts, F.col(group) == F.col("_of")).withColumn(
        "_stays", F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_digest") == F.col("_first._digest"))
    )
    return marked.where(~F.col("_stays")).select("_id", "_digest"), marked.where(F.col("_stays") & (F.col("_rows") > 1)).select("_id", "_digest")


def rows_that_stay(docs: DataFrame, goes: DataFrame, repeated: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` without the ids and texts that ``goes`` lists, and with one row of each that
    ``repeated`` lists: the first by its columns.  Columns stay as they are.

    What goes is the smaller part; it is written and counted, and broadcast if it is at most
    BROADCAST_ROWS, so that no text moves.  Beyond that both sides are shuffled.
    """
    identity, content = F.col(quoted(doc_id)), F.col(quoted(text))
    goes = materialize(goes.distinct(), "goes")
    repeated = materialize(repeated.distinct(), "repeated")
    gone, again = goes.count(), repeated.count()

    def without(frame: DataFrame, few: DataFrame, rows: int) -> DataFrame:
        few = few.select(F.col("_id").alias(fresh_name(docs, "_gone")), F.col("_digest").alias(fresh_name(docs, "_gone_digest")))
        same = frame[quoted(doc_id)].eqNullSafe(few[few.columns[0]]) & (text_digest(frame[quoted(text)]) == few[few.columns[1]])
        return frame.join(F.broadcast(few) if rows <= BROADCAST_ROWS else few, same, "left_anti")

    kept = without(docs, goes, gone) if gone else docs
    if not again:
        return kept
    # Columns of docs may have any name.
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    found = kept.select(identity.alias("i"), text_digest(content).alias("d"), row.alias("r")).join(
        repeated, F.col("i").eqNullSafe(F.col("_id")) & (F.col("d") == F.col("_digest"))
    )
    one = found.groupBy("i", "d").agg(F.min_by("r", F.to_json("r")).alias("r"))
    return without(kept, repeated, again).unionByName(one.select("r.*"))


def quoted(name: str) -> str:
    """A column's name as a reference to it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def with_group_ranks(df: DataFrame, group: str, order: Sequence[str], rank: str, label: str) -> DataFrame:
    """Adds ``rank``: 0, 1, 2, ... in every ``group``, by ``order``.

    No group is ever whole in one task: rows are range-partitioned by group *and* order, a
    task numbers the sorted rows that it has of each group, and a group that began in an
    earlier partition is moved on by what those hold of it.  Only the first group of a
    partition can be such a one, so what is broadcast has at most a row per partition.  The
    sorted rows are written out, because their partition ids must be the same when they are
    counted and when they are looked up.  Rows equal in group and order are ranked
    arbitrarily, but once.
    """
    keys = [F.col(quoted(k)) for k in (group, *order)]
    part, place = fresh_name(df, "_part"), fresh_name(df, "_place")
    columns = df.columns

    def number(batches):
        from pyspark import TaskContext

        here, last, carried = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            opens = np.flatnonzero(run_starts(batch, [group], last))
            at = np.arange(batch.num_rows)
            base = np.full(batch.num_rows, -carried)
            if len(opens):
                base[opens[0] :] = np.repeat(opens, np.diff([*opens, batch.num_rows]))
            places = at - base
            if batch.num_rows:
                carried = int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, here, np.int32)), pa.array(places.astype(np.int64))],
                names=[*columns, part, place],
            )

    schema = T.StructType([*df.schema, T.StructField(part, T.IntegerType()), T.StructField(place, T.LongType())])
    placed = materialize(map_batches(df.repartitionByRange(*keys).sortWithinPartitions(*keys), number, schema), label)
    earlier = Window.partitionBy("_group").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(F.col(quoted(group)).alias("_group"), F.col(part).alias("_in"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_group", "_in", F.sum("_rows").over(earlier).alias("_start"))
        .where(F.col("_start") > 0)
        .alias("_starts")
    )
    own = placed.alias("_placed")
    return own.join(
        F.broadcast(starts),
        F.col(f"_placed.{quoted(group)}").eqNullSafe(F.col("_starts._group")) & (F.col(f"_placed.{part}") == F.col("_starts._in")),
        "left",
    ).select(
        *[F.col(f"_placed.{quoted(c)}") for c in columns],
        (F.col(f"_placed.{place}") + F.coalesce(F.col("_starts._start"), F.lit(0))).alias(rank),
    )


def streamed_digests(rows: DataFrame, keys: Sequence[str], order: Sequence[str], piece: str, joiner: str, digest: str) -> DataFrame:
    """``keys`` and ``digest``: the SHA-256 of the pieces of each key in ``order``, with ``joiner`` between.

    A digest is one chain, so the pieces of a key pass through one task; they are sorted by
    Spark, which spills, and stream past a hash state.  No key is ever held whole.
    """
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField(digest, T.StringType())])
    between = joiner.encode()

    def run(batches):
        import hashlib

        last, state, whose = [], None, None
        for batch in batches:
            opens = run_starts(batch, keys, last)
            done = []
            for i, text in enumerate(batch.column(piece)):
                if opens[i]:
                    if state is not None:
                        done.append((*whose, state.hexdigest()))
                    state, whose = hashlib.sha256(), [batch.column(k)[i].as_py() for k in keys]
                else:
                    state.update(between)
                state.update(text.as_py().encode())
            if done:
                yield out(done, batch)
            empty = batch.slice(0, 0)
        if state is not None:
            yield out([(*whose, state.hexdigest())], empty)

    def out(done, like):
        types = [like.schema.field(k).type for k in keys] + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done), types)], names=schema.names)

    columns = [F.col(quoted(c)) for c in (*keys, *order)]
    sorted_rows = rows.repartition(*columns[: len(keys)]).sortWithinPartitions(*columns)
    return sorted_rows.select(*[F.col(quoted(c)) for c in dict.fromkeys([*keys, *order, piece])]).mapInArrow(run, schema)
