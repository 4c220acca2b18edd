"""Line dedup: long lines that many documents share stay in one document only.

Hashes of lines are range-partitioned and sorted by document and position, and stream past;
what comes back per document is a bitmap of the lines that stay.  Text is not moved until a
bitmap is applied.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.llm.common import BROADCAST_ROWS, ascii_lower, let, quoted, text_or_empty
from footfall.session import materialize

WHITE = " \t\n\x0b\x0c\r"
MIN_LENGTH = 40
MIN_DOCS = 5
# At most so many lines are hot: those that make up more than that share of all lines.
MOST_HOT = 100_000
# Lines that occur less often than this are never hot.
LEAST_HOT = 1_000
WORD_BITS = 64


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _row_hash(text: str) -> Column:
    # Tells rows apart that share an id.
    return F.xxhash64(text_or_empty(text))


def keep_bitmaps(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_docs: int = MIN_DOCS,
    hot_lines: int | None = None,
) -> DataFrame:
    """``doc_id, row_hash, words`` for the documents that lose lines.

    ``words`` is the compressed bitmap: of every 64 lines one LONG with a bit for each line
    that stays, without the words in which all stay.  Keys of at least ``min_length`` code
    points found in at least ``min_docs`` documents keep their lines only where the id is the
    largest that holds them.  Documents are told apart by id, so rows repeated under one id
    count once and are treated alike; NULL ids count as one id below all others.

    Lines that occur over ``hot_lines`` times are counted by combining aggregates, never
    brought to one task.  By default that is a share of all lines, so that at most MOST_HOT
    hashes are broadcast however large the table is; no other hash has more rows in its
    window.
    """
    key = F.transform(lines_of(text_or_empty(text)), lambda line: line_key(line))
    lines = materialize(
        docs.select(F.col(doc_id).alias("doc_id"), _row_hash(text).alias("row_hash"), F.posexplode(key).alias("line", "key"))
        .where(F.length("key") >= min_length)
        .select("doc_id", "row_hash", "line", F.unhex(F.md5("key")).alias("hash")),
        "lines",
    )
    if hot_lines is None:
        hot_lines = max(LEAST_HOT, -(-lines.count() // MOST_HOT))
    counted = lines.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_lines)
    hot = materialize(counted.select("hash"), "hot-lines")
    some_hot = bool(hot.take(1))
    by_document = Window.partitionBy("hash").orderBy(F.col("doc_id").desc(), "line")
    whole = Window.partitionBy("hash")
    previous = F.lag("doc_id").over(by_document)
    cold = lines.join(F.broadcast(hot), "hash", "left_anti") if some_hot else lines
    dropped = (
        cold.repartitionByRange("hash")
        .withColumn("_opens", F.when((F.row_number().over(by_document) > 1) & previous.eqNullSafe(F.col("doc_id")), 0).otherwise(1))
        .withColumn("_docs", F.sum("_opens").over(whole))
        .withColumn("_keeper", F.max("doc_id").over(whole))
        .where((F.col("_docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("_keeper")))
        .select("doc_id", "row_hash", "line")
    )
    if some_hot:
        hot_rows = lines.join(F.broadcast(hot), "hash")
        # One row per hot line.
        keepers = (
            hot_rows.groupBy("hash", "doc_id").agg(F.lit(1).alias("one")).groupBy("hash")
            .agg(F.count(F.lit(1)).alias("_docs"), F.max("doc_id").alias("_keeper"))
            .where(F.col("_docs") >= min_docs)
        )
        dropped = dropped.unionByName(
            hot_rows.join(F.broadcast(keepers), "hash")
            .where(~F.col("doc_id").eqNullSafe(F.col("_keeper")))
            .select("doc_id", "row_hash", "line")
        )
    bit = F.expr(f"shiftleft(1L, line % {WORD_BITS})")
    return (
        dropped.repartition("doc_id", "row_hash")
        .groupBy("doc_id", "row_hash", F.expr(f"line div {WORD_BITS}").alias("word"))
        .agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
        .groupBy("doc_id", "row_hash")
        .agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))
    )


def _kept(lines: Column, words: Column) -> Column:
    dense = let(
        F.map_from_entries(words),
        lambda m: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / WORD_BITS).cast("int")),
            lambda w: F.coalesce(m[w.cast("long")], F.lit(-1).cast("long")),
        ),
    )
    return let(
        dense,
        lambda d: F.filter(
            lines,
            lambda line, i: F.getbit(d[F.floor(i / WORD_BITS).cast("int")], i % WORD_BITS) == 1,
        ),
    )


def drop_lines(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept``: texts after their bitmaps are applied.

    A NULL or empty text has one empty line.  A text that loses all lines becomes empty.

    Bitmaps are written and counted.  If at most BROADCAST_ROWS documents have one, their ids
    and hashes are broadcast, and only these documents are shuffled to meet them; the others
    stay where they are.  Beyond that all documents are.
    """
    rows = docs.select(
        F.col(quoted(doc_id)).alias("doc_id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text")
    ).withColumn("row_hash", F.xxhash64("text"))
    bitmaps = materialize(bitmaps, "bitmaps")
    few = bitmaps.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"))
    has = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash"))
    split = few.count() <= BROADCAST_ROWS
    losing = rows.join(F.broadcast(few), has, "left_semi") if split else rows
    marked = losing.alias("r").join(
        bitmaps.alias("b"),
        F.col("r.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("r.row_hash") == F.col("b.row_hash")),
        "left",
    )
    lines = lines_of(F.col("text"))

    def whole(ls: Column) -> Column:
        return F.struct(F.size(ls).alias("n"), F.lit(0).alias("gone"), F.col("text").alias("kept"))

    def cut(ls: Column) -> Column:
        return let(
            _kept(ls, F.col("words")),
            lambda k: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(k)).alias("gone"), F.array_join(k, "\n").alias("kept")),
        )

    found = marked.select(
        F.col("r.doc_id").alias("doc_id"), let(lines, lambda ls: F.when(F.col("words").isNull(), whole(ls)).otherwise(cut(ls))).alias("x")
    )
    if split:
        same = rows.join(F.broadcast(few), has, "left_anti")
        found = found.unionByName(same.select("doc_id", let(lines, whole).alias("x")))
    return found.select(
        F.col("doc_id").alias(doc_id), F.col("x.n").cast("long").alias("n_lines"), F.col("x.gone").cast("long").alias("n_dropped"), F.col("x.kept").alias("kept")
    )
