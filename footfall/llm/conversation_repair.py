"""Conversation structure repair by a persistent audit DP.

Spark orders the rows of every conversation, marks their faults and writes each run of up to
``piece_rows`` rows as a short string; tasks solve these strings (``audit_dp``); the edits
come back as rows and meet the texts again in a join.  A conversation of any length is solved
piece by piece: costs between the pieces' ends first, then every piece by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from footfall.llm import audit_dp
from footfall.llm.common import quoted, with_group_ranks
from footfall.session import materialize

WHITE = " \t\n\x0b\x0c\r"
PIECE_ROWS = 4096
# Edits before a row come before the row's own.
OWN = (1 << 31) - 1

EDITS = T.ArrayType(
    T.StructType(
        [
            T.StructField("pos", T.LongType()),
            T.StructField("nth", T.IntegerType()),
            T.StructField("edit", T.StringType()),
            T.StructField("initial", T.StringType()),
        ]
    )
)
ARROW_EDITS = pa.list_(pa.struct([("pos", pa.int64()), ("nth", pa.int32()), ("edit", pa.string()), ("initial", pa.string())]))


@dataclass(frozen=True)
class Repair:
    """What ``repair`` finds; the conversation column has the name it had."""

    summary: DataFrame  # conversation, gaps, blank, duplicate, truncated, illegal, cost, audit
    edits: DataFrame  # conversation, pos, nth, edit, initial
    repaired: DataFrame  # conversation, pos, nth, role, text


def _code(role: Column, doomed: Column, truncated: Column) -> Column:
    initial = F.left(role, F.lit(1))
    place = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    codes = F.when(doomed, audit_dp.DOOMED).when(truncated, audit_dp.TRUNCATED).otherwise(audit_dp.SOUND)
    return F.substr(codes, place, F.lit(1))


def ordered_rows(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """``_c, _turn, _role, _text, _digest, _pos``: rows numbered by turn (NULL first), then by
    role and the digest of role and text; NULL roles and texts are one space."""
    own = rows.select(
        F.col(quoted(conversation)).alias("_c"), F.col(quoted(turn)).alias("_turn"),
        F.coalesce(F.col(quoted(role)), F.lit(" ")).alias("_role"), F.coalesce(F.col(quoted(text)), F.lit(" ")).alias("_text"),
    )
    digest = F.unhex(F.sha2(F.concat(F.length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256))
    return with_group_ranks(own.withColumn("_digest", digest), "_c", ["_turn", "_role", "_digest"], "_pos", "turns")


def _pieces(placed: DataFrame, piece_rows: int) -> DataFrame:
    """``_c, _piece, rows, blank, duplicate, truncated``: a piece's rows as one string."""
    blank = F.length(F.btrim("_text", F.lit(WHITE))) == 0
    cut = ~F.right(F.rtrim("_text", F.lit(WHITE)), F.lit(1)).isin(".", "!", "?")
    facts = placed.select("_c", "_pos", "_digest", "_role", blank.alias("_blank"), cut.alias("_cut"))
    # Only what is repeated is joined back; both sides are narrow, and a frequent row is split at run time.
    first = (
        facts.groupBy(F.col("_c").alias("_fc"), F.col("_digest").alias("_fd"))
        .agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .drop("_n")
    )
    marked = facts.join(first, F.col("_c").eqNullSafe(F.col("_fc")) & (F.col("_digest") == F.col("_fd")), "left")
    again = ~F.col("_blank") & (F.col("_pos") > F.coalesce("_first", "_pos"))
    truncated = ~F.col("_blank") & ~F.col("_again") & F.col("_cut")
    return (
        marked.withColumn("_again", again)
        .withColumn("_truncated", truncated)
        .groupBy("_c", F.expr(f"_pos div {piece_rows}").alias("_piece"))
        .agg(
            F.array_sort(F.collect_list(F.struct("_pos", _code(F.col("_role"), F.col("_blank") | F.col("_again"), F.col("_truncated")).alias("code")))).alias("rows"),
            F.count_if("_blank").alias("blank"), F.count_if("_again").alias("duplicate"), F.count_if("_truncated").alias("truncated"),
        )
        .withColumn("rows", F.array_join(F.transform("rows", lambda r: r["code"]), ""))
    )


def _arrow(batch: pa.RecordBatch, keep: list[str], new: list[tuple[str, list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*[batch.column(k) for k in keep], *[pa.array(v, t) for _, v, t in new]], names=[*keep, *[n for n, _, _ in new]]
    )


def _solved(pieces: DataFrame, piece_rows: int) -> DataFrame:
    """``pieces`` (with ``start, to_go``; no ``to_go`` behind the last one) with their edits."""
    kept = ["_c", "_piece", "blank", "duplicate", "truncated"]
    schema = T.StructType(
        [pieces.schema[c] for c in kept]
        + [T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("edits", EDITS)]
        + [T.StructField("illegal", T.LongType()), T.StructField("first", T.StringType()), T.StructField("last", T.StringType())]
    )

    def solve(batches):
        for batch in batches:
            costs, audits, edits, illegal, firsts, lasts = [], [], [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("rows", "start", "to_go", "_piece")]
            for rows, start, to_go, piece in zip(*columns):
                cost, audit, _ = audit_dp.cheapest(rows, start, to_go)
                out, nth = [], 0
                for at, edit, initial in audit_dp.replay(rows, audit, start):
                    insert = edit == audit_dp.INSERT
                    out.append((piece * piece_rows + at, nth if insert else OWN, edit, initial))
                    nth = nth + 1 if insert else 0
                initials = "".join(audit_dp.INITIAL[r] for r in rows)
                costs.append(cost), audits.append(audit), illegal.append(audit_dp.illegal_neighbours(initials))
                edits.append([dict(zip(("pos", "nth", "edit", "initial"), e)) for e in out])
                firsts.append(initials[0]), lasts.append(initials[-1])
            yield _arrow(batch, kept, [
                ("cost", costs, pa.int64()), ("audit", audits, pa.string()), ("edits", edits, ARROW_EDITS),
                ("illegal", illegal, pa.int64()), ("first", firsts, pa.string()), ("last", lasts, pa.string()),
            ])

    return pieces.mapInArrow(solve, schema)


def _long_starts(pieces: DataFrame) -> DataFrame:
    """``_lc, _lpiece, start, to_go`` for the pieces of conversations that have several.

    Each piece gives its costs from every state to every state; a conversation's few numbers
    per piece are folded from behind, which says what each state is worth at every border;
    with that each piece says in which state it ends from every state, and a fold from the
    front says where each begins.
    """
    ints = T.ArrayType(T.LongType())

    def matrices(batches):
        for batch in batches:
            found = [[c for line in audit_dp.cost_matrix(r) for c in line] for r in batch.column("rows").to_pylist()]
            yield _arrow(batch, ["_c", "_piece", "rows"], [("matrix", found, pa.list_(pa.int64()))])

    def borders(batches):
        for batch in batches:
            out = []
            for flat in batch.column("matrices").to_pylist():
                found = audit_dp.costs_to_go([[m[i : i + 4] for i in (0, 4, 8, 12)] for m in flat])
                out.append([*found[:-1], None])
            yield _arrow(batch, ["_c"], [("to_go", out, pa.list_(pa.list_(pa.int64())))])

    def ends(batches):
        for batch in batches:
            out = []
            for rows, to_go in zip(batch.column("rows").to_pylist(), batch.column("to_go").to_pylist()):
                out.append([0] * 4 if to_go is None else [audit_dp.cheapest(rows, s, to_go)[2] for s in range(4)])
            yield _arrow(batch, ["_c", "_piece", "to_go"], [("next", out, pa.list_(pa.int64()))])

    def struct(like: DataFrame, names: list[str], **more: T.DataType) -> T.StructType:
        return T.StructType([*[like.schema[n] for n in names], *[T.StructField(n, t) for n, t in more.items()]])

    def in_order(column: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("_piece", column))), lambda p: p[column])

    costs = materialize(pieces.mapInArrow(matrices, struct(pieces, ["_c", "_piece", "rows"], matrix=ints)), "piece-costs")
    grouped = costs.groupBy("_c").agg(in_order("matrix").alias("matrices"))
    worth = grouped.mapInArrow(borders, struct(grouped, ["_c"], to_go=T.ArrayType(ints)))
    worth = worth.select(F.col("_c").alias("_wc"), F.posexplode("to_go").alias("_wp", "to_go"))
    valued = costs.join(worth, F.col("_c").eqNullSafe(F.col("_wc")) & (F.col("_piece") == F.col("_wp"))).select("_c", "_piece", "rows", "to_go")
    steps = materialize(valued.mapInArrow(ends, struct(valued, ["_c", "_piece", "to_go"], next=ints)), "piece-ends")
    begins = steps.groupBy("_c").agg(in_order("next").alias("next"), in_order("to_go").alias("to_go")).select(
        F.col("_c").alias("_lc"),
        F.posexplode(
            F.arrays_zip(
                F.aggregate(
                    F.slice("next", 1, F.size("next") - 1),
                    F.array(F.lit(audit_dp.START).cast("long")),
                    lambda starts, step: F.concat(starts, F.array(step[F.element_at(starts, -1).cast("int")])),
                ).alias("start"),
                F.col("to_go"),
            )
        ).alias("_lpiece", "x"),
    )
    return begins.select("_lc", "_lpiece", "x.start", "x.to_go")


def repair(
    rows: DataFrame, conversations: DataFrame | None = None, conversation: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text", piece_rows: int = PIECE_ROWS,
) -> Repair:
    """Cheapest edits that give every conversation the role order ``(s?(ua)+)?``.

    Rows are taken by turn, NULL first; ties by role, then by the digest of role and text.  A
    row's first fault counts: blank (only white space), duplicate (role and text were seen
    earlier in the conversation), truncated (does not end in ``.!?``).  Blank and duplicate
    rows have to go.  NULL roles and texts are one space, so such a text is blank and such a
    role is neither s, u nor a; NULL conversations are one conversation.  ``conversations``
    names further ones, which without rows have zeros and no edits; an empty table gives no
    rows.  Very long texts only pass through sorts; other columns are ignored.
    """
    placed = materialize(ordered_rows(rows, conversation, turn, role, text), "ordered-turns")
    pieces = materialize(_pieces(placed, piece_rows), "pieces")
    begins = pieces.withColumn("start", F.lit(audit_dp.START)).withColumn("to_go", F.lit(None).cast("array<bigint>"))
    long = pieces.where(F.col("_piece") > 0).select(F.col("_c").alias("_lc")).distinct()
    if long.take(1):
        several = pieces.join(long, F.col("_c").eqNullSafe(F.col("_lc")), "left_semi")
        found = _long_starts(several)
        begins = pieces.join(found, F.col("_c").eqNullSafe(F.col("_lc")) & (F.col("_piece") == F.col("_lpiece")), "left").select(
            *pieces.columns, F.coalesce("start", F.lit(audit_dp.START).cast("long")).cast("int").alias("start"), "to_go"
        )
    solved = materialize(_solved(begins, piece_rows), "solved")
    name = quoted(conversation)

    edits = solved.select("_c", F.inline("edits"))
    # Inserts have no row; every other edit has its own.
    own = edits.where((F.col("edit") != audit_dp.INSERT) & F.col("initial").isNotNull()).select(
        F.col("_c").alias("_ec"), F.col("pos").alias("_epos"), "edit", "initial"
    )
    due = F.when(F.col("initial") == "u", "user").otherwise("assistant")
    kept = placed.join(own, F.col("_c").eqNullSafe(F.col("_ec")) & (F.col("_pos") == F.col("_epos"))).select(
        F.col("_c").alias(conversation), F.col("_pos").alias("pos"), F.lit(OWN).alias("nth"),
        F.when(F.col("edit") == audit_dp.KEEP, F.col("_role")).otherwise(due).alias("role"), F.col("_text").alias("text"),
    )
    inserted = edits.where(F.col("edit") == audit_dp.INSERT).select(
        F.col("_c").alias(conversation), "pos", "nth", due.alias("role"), F.lit("").alias("text")
    )

    entry = F.struct("_piece", "audit", "first", "last")
    borders = F.aggregate(
        F.sequence(F.lit(2), F.size("_all")), F.lit(0).cast("long"),
        lambda n, i: n + F.when(F.concat(F.element_at("_all", i - 1)["last"], F.element_at("_all", i)["first"]).isin("su", "ua", "au"), 0).otherwise(1),
    )
    totals = ["blank", "duplicate", "truncated", "illegal", "cost"]
    faults = (
        solved.groupBy("_c")
        .agg(*[F.sum(t).alias(t) for t in totals], F.array_sort(F.collect_list(entry)).alias("_all"))
        .withColumn("illegal", F.col("illegal") + F.when(F.size("_all") > 1, borders).otherwise(0))
        .withColumn("audit", F.array_join(F.transform("_all", lambda p: p["audit"]), ""))
    )
    turns = (
        placed.groupBy("_c", "_turn").agg(F.lit(1).alias("one")).groupBy(F.col("_c").alias("_tc"))
        .agg(F.coalesce(F.max("_turn") - F.min("_turn") + 1 - F.count("_turn"), F.lit(0)).cast("long").alias("gaps"))
    )
    summary = faults.join(turns, F.col("_c").eqNullSafe(F.col("_tc"))).select(F.col("_c").alias("_sc"), "gaps", *totals, "audit")
    if conversations is None:
        summary = summary.withColumnRenamed("_sc", conversation)
    else:
        named = conversations.select(F.col(name).alias("_id")).distinct()
        summary = named.join(summary, F.col("_id").eqNullSafe(F.col("_sc")), "left").select(
            F.col("_id").alias(conversation), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", *totals)],
            F.coalesce("audit", F.lit("")).alias("audit"),
        )
    return Repair(summary, edits.withColumnRenamed("_c", conversation), kept.unionByName(inserted))
