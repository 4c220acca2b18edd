"""Exact global ranks, quantile buckets and quantiles without a single-task sort.

A window without PARTITION BY, and an exact percentile, both bring every row (or every
distinct value) to one task.  Here the values are range-partitioned and sorted where they
are; a row's global rank is its position in its partition plus the sizes of the partitions
before it, and only the few rows at the wanted ranks travel further.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from footfall.functions.dates import micros
from footfall.session import materialize

# monotonically_increasing_id() holds the partition in the bits above the row position.
POSITION_BITS = 33


@dataclass(frozen=True)
class Ranking:
    """A column of numbers, dates or timestamps to rank, compared as what it is.

    NULLs come first ascending and last descending; NaN is larger than any number.
    """

    column: str
    descending: bool = False

    def kind(self, df: DataFrame) -> str:
        """The type values are compared in: whole numbers as LONG, DECIMAL as it is."""
        kind = df.schema[self.column].dataType
        if isinstance(kind, (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "bigint"
        if isinstance(kind, T.DecimalType):
            return kind.simpleString()
        if isinstance(kind, T.FractionalType):
            return "double"
        raise ValueError(f"{self.column} is {kind.simpleString()}, which cannot be ranked")

    def value(self, df: DataFrame) -> Column:
        kind = df.schema[self.column].dataType
        if isinstance(kind, T.DateType):
            return F.unix_date(self.column).cast("bigint")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return micros(F.col(self.column))
        return F.col(self.column).cast(self.kind(df))

    def key(self, df: DataFrame, tie: str) -> Column:
        """Orders rows as this ranking does when compared ascending.

        Reversing the value alone would put NULLs first in a descending ranking too, and
        NaN last.
        """
        value = self.value(df)
        is_null = value.isNull().cast("int")
        if not self.descending:
            return F.struct((-is_null).alias("nulls"), value.alias("value"), F.col(tie).alias("tie"))
        kind = self.kind(df)
        nulls = is_null - F.isnan(value).cast("int") if kind == "double" else is_null
        # The complement of a whole number, unlike its negative, always exists.
        reverse = F.bitwise_not(value) if kind == "bigint" else -value
        return F.struct(nulls.alias("nulls"), reverse.alias("value"), F.col(tie).alias("tie"))


def by_kind(df: DataFrame, rankings: Sequence[Ranking]) -> list[list[int]]:
    """Places in ``rankings``, those compared in the same type together."""
    groups: dict[str, list[int]] = {}
    for i, ranking in enumerate(rankings):
        groups.setdefault(ranking.kind(df), []).append(i)
    return list(groups.values())


def rank_columns(
    df: DataFrame, rankings: Sequence[Ranking], tie: str, skip_nulls: bool = False
) -> DataFrame:
    """``which, nulls, value, tie, rank, total``: the 0-based rank of every value.

    ``which`` is the position in ``rankings``, which must be compared in one type; all are
    ranked in one range shuffle of narrow rows.  ``tie`` must be unique; as part of the sort
    key it also lets a value shared by most rows spread over many partitions.  The sorted
    rows are written out because partition ids must be the same when sizes are counted and
    when ranks are looked up.
    """
    if len(by_kind(df, rankings)) > 1:
        raise ValueError("rank columns of one type at a time")
    entries = [F.struct(F.lit(i).alias("which"), r.key(df, tie).alias("key")) for i, r in enumerate(rankings)]
    narrow = df.select(F.explode(F.array(*entries)).alias("entry")).select("entry.which", "entry.key.*")
    if skip_nulls:
        narrow = narrow.where(F.col("value").isNotNull())
    order = ["which", "nulls", "value", "tie"]
    placed = materialize(
        narrow.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .select(
            *order,
            F.shiftright("_id", POSITION_BITS).alias("_part"),
            F.col("_id").bitwiseAND((1 << POSITION_BITS) - 1).alias("_position"),
        ),
        "ranked",
    )
    earlier_parts = Window.partitionBy("which").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per ranking and partition, whatever the size of the table.
    starts = (
        placed.groupBy("which", "_part")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_position").alias("_first"))
        .select(
            "which",
            "_part",
            (F.coalesce(F.sum("_rows").over(earlier_parts), F.lit(0)) - F.col("_first")).alias("_start"),
            F.sum("_rows").over(Window.partitionBy("which")).alias("total"),
        )
    )
    return placed.join(F.broadcast(starts), ["which", "_part"]).select(
        *order, (F.col("_position") + F.col("_start")).alias("rank"), "total"
    )


def with_ntiles(df: DataFrame, scores: Mapping[str, Ranking], buckets: int, tie: str) -> DataFrame:
    """Adds one column per entry of ``scores``: the row's bucket, 1 to ``buckets``.

    Equal to ``NTILE(buckets) OVER (ORDER BY column, tie)``.  Only the first rows of buckets
    2, 3, ... are looked up; each row then compares itself with those few keys, so ``df``
    itself is not shuffled.
    """
    if buckets == 1:
        return df.withColumns({name: F.lit(1).cast("long") for name in scores})
    rankings = list(scores.values())
    size = F.floor(F.col("total") / buckets)
    larger = F.col("total") % buckets
    opens = {i: F.col("rank") == size * i + F.least(larger, F.lit(i)) for i in range(1, buckets)}
    key = F.struct("nulls", "value", "tie")
    cuts = {}
    for places in by_kind(df, rankings):
        ranked = rank_columns(df, [rankings[p] for p in places], tie)
        first_rows = [
            F.max(F.when((F.col("which") == which) & opening, key)).alias(f"{place}_{i}")
            for which, place in enumerate(places)
            for i, opening in opens.items()
        ]
        found = ranked.where(reduce(or_, opens.values())).agg(F.struct(*first_rows).alias("cuts"))
        cuts |= {place: (f"_cuts_{places[0]}", found) for place in places}

    def bucket(place: int, ranking: Ranking) -> Column:
        own = F.col(cuts[place][0])
        passed = [F.when(ranking.key(df, tie) >= own[f"{place}_{i}"], 1).otherwise(0) for i in opens]
        return reduce(add, passed, F.lit(1).cast("long"))

    return (
        df.withColumns({name: found.scalar() for name, found in cuts.values()})
        .withColumns({name: bucket(place, scores[name]) for place, name in enumerate(scores)})
        .drop(*[name for name, _ in cuts.values()])
    )


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], quantiles: Mapping[str, float], tie: str
) -> DataFrame:
    """``column, <name of each quantile>``: interpolated quantiles of non-NULL values, as DOUBLE."""
    spots = {name: (F.col("total") - 1) * F.lit(q) for name, q in quantiles.items()}
    wanted = [F.col("rank").isin(F.floor(spot), F.ceil(spot)) for spot in spots.values()]
    at_spots = []
    for name, spot in spots.items():
        below = F.max(F.when(F.col("rank") == F.floor(spot), F.col("value"))).cast("double")
        above = F.max(F.when(F.col("rank") == F.ceil(spot), F.col("value"))).cast("double")
        part = F.max(spot - F.floor(spot))
        at_spots.append(((above - below) * part + below).alias(name))
    rankings = [Ranking(c) for c in columns]
    found = []
    for places in by_kind(df, rankings):
        ranked = rank_columns(df, [rankings[p] for p in places], tie, skip_nulls=True)
        names = F.array(*[F.lit(columns[p]) for p in places])
        found.append(
            ranked.where(reduce(or_, wanted))
            .groupBy("which")
            .agg(*at_spots)
            .withColumn("column", F.element_at(names, F.col("which") + 1))
            .drop("which")
        )
    return reduce(DataFrame.unionByName, found)
