"""Conversation repair and the prefix trie against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from footfall.llm import audit_dp, conversation_repair, prefix_trie
from footfall.llm.queries import damaged, op11_conversation_repair, op12_prefix_trie, rebuilt
from tests.llm import brute
from tests.llm.conftest import SMALL

REPAIR = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.fixture(scope="module")
def odd_conversations(spark):
    """NULLs, ties, gaps, repeats, long texts, roles of all kinds, and columns whose names clash."""
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, None, "user", "a."), (2, 5, "assistant", "b!"), (2, 9, "tool", "c?"),
        (3, 0, None, "x."), (3, 1, "user", None), (4, 0, "", ""), (5, 0, "system", "s."), (6, 0, "user", "u" * 20_000),
        (7, 0, "assistant", "a."), (7, 0, "user", "b."), (7, 0, "user", "b."), (7, 1, "User", " \t\x0c\n"), (7, 2, "assistant", "ok. \n"),
        (None, 0, "user", "n."), (None, None, "assistant", "m."), (8, 3, "sys", "."), (8, 4, "unknown", "q."), (8, 5, "also", "q."),
        (20, 0, "user", "a."), (20, 1, "assistant", "b."), (20, 2, "user", "c."), (21, 7, "user", "z."), (40, 0, "user", "a."), (41, 1, "assistant", "b."),
    ]
    rows += [(9, i, ("user", "assistant", "system")[i * i % 3], f"t{i % 11}{'.' * (i % 3)}") for i in range(60)]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, pos int, `a.b` string, _part int")
    return frame.repartition(3)


def plain(frame):
    return [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]


def random_rows(n, seed):
    return "".join(random.Random(seed + i).choice("suauauauaoSUAO1234") for i in range(n))


def test_edits_are_the_cheapest_and_then_the_smallest():
    for seed in range(600):
        rows = random_rows(seed % 9, seed * 100)
        roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
        faults = [(roles[audit_dp.INITIAL[r]], "t", "truncated" if r in audit_dp.TRUNCATED else "blank" if r in audit_dp.DOOMED else "") for r in rows]
        cost, letters, lines = brute.cheapest_edits(faults)
        assert audit_dp.cheapest(rows)[:2] == (cost, letters)
        # Hashes that collide nearly always change nothing.
        assert audit_dp.cheapest(rows, prefixes=audit_dp.Prefixes(base=1, prime=2))[:2] == (cost, letters)
        assert [i for _, _, i in audit_dp.replay(rows, letters) if i] == [l[0] for l in lines]


def test_prefixes_compare_like_their_letters():
    draw = random.Random(5)
    for base, prime in ((1_000_003, (1 << 61) - 1), (1, 2)):
        known, nodes = audit_dp.Prefixes(base, prime), [0]
        for _ in range(400):
            nodes.append(known.add(draw.choice(nodes[-30:]), draw.choice("DK")))
        for _ in range(2000):
            a, b = draw.choice(nodes), draw.choice(nodes)
            assert known.less(a, b) == (known.letters(a) < known.letters(b))


@pytest.mark.parametrize("piece", [1, 2, 5])
def test_pieces_give_what_the_whole_gives(piece):
    for seed in range(200):
        rows = random_rows(1 + seed % 14, seed * 50)
        cut = [rows[i : i + piece] for i in range(0, len(rows), piece)]
        to_go = [*audit_dp.costs_to_go([audit_dp.cost_matrix(p) for p in cut])[:-1], None]
        state, cost, letters = audit_dp.START, 0, ""
        for part, worth in zip(cut, to_go):
            more, edits, state = audit_dp.cheapest(part, state, worth)
            cost, letters = cost + more, letters + edits
        assert (cost, letters) == audit_dp.cheapest(rows)[:2]


@pytest.mark.parametrize("piece_rows", [1, 3, 4096])
def test_repair(spark, odd_conversations, piece_rows):
    rows = odd_conversations.where("conv_id is null or conv_id != 7")  # ties in turn are in the next test
    found = conversation_repair.repair(rows, piece_rows=piece_rows)
    shown = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in plain(rows)]
    wanted = brute.repair(shown, shown)
    assert {r["conv_id"]: tuple(r[c] for c in REPAIR[:-1]) for r in found.summary.collect()} == {c: w[:-1] for c, w in wanted.items()}
    lines = {c: [] for c in wanted}
    for r in found.repaired.orderBy("conv_id", "pos", "nth").collect():
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: brute.sha("\n".join(l)) for c, l in lines.items()} == {c: w[-1] for c, w in wanted.items()}
    audits = found.edits.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "nth", "edit"))), lambda e: e["edit"]), "").alias("a"))
    assert {r["conv_id"]: r["a"] for r in audits.collect()} == {c: w[-2] for c, w in wanted.items() if w[-2]}


def test_ties_and_nothing(spark, odd_conversations):
    tied = odd_conversations.where("conv_id = 7")
    row = conversation_repair.repair(tied).summary.first()
    # assistant a., user b., user b. again, User blank, assistant ok.
    assert (row["blank"], row["duplicate"], row["gaps"], row["audit"]) == (1, 1, 0, "DKDDK")
    empty = conversation_repair.repair(tied.limit(0))
    assert empty.summary.count() == empty.edits.count() == empty.repaired.count() == 0
    named = conversation_repair.repair(tied.limit(0), conversations=tied).summary.collect()
    assert [tuple(r) for r in named] == [(7, 0, 0, 0, 0, 0, 0, "")]


def test_repair_query(spark, tmp_path, odd_conversations):
    small = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = small.unionByName(odd_conversations.where("conv_id is null or conv_id != 7").withColumn("conv_id", F.col("conv_id") + 1_000_000).select(small.columns))
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    wanted = brute.repair(plain(rows), brute.damage(plain(rows)))
    found = op11_conversation_repair(spark, str(tmp_path)).collect()
    assert {r["conv_id"]: tuple(r[c] for c in REPAIR) for r in found} == wanted and len(found) == len(wanted)
    assert sorted(map(repr, plain(damaged(rows)))) == sorted(map(repr, brute.damage(plain(rows))))


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def in_order(rows):
    return sorted(map(repr, rows))


def trie_of(rows, block=prefix_trie.BLOCK):
    """The nodes and their ends, read back as the brute force gives them."""
    found = prefix_trie.prefix_trie(prefix_trie.as_tokens(rows), rows.select("conv_id"), block=block)
    ends = {}
    for r in found.ends.collect():
        ends.setdefault(bytes(r["end"]), []).append(r["conv_id"])
    out = []
    for r in found.nodes.collect():
        ids = sorted(i for i in ends.get(r["end"] and bytes(r["end"]), []) if i is not None)
        out.append((r["conv_id"], r["depth"], r["parent"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], brute.sha(",".join(map(str, ids)))))
    return out


def random_conversations(spark, seed):
    draw = random.Random(seed)
    rows = []
    for c in range(90):
        for turn in range(draw.choice([1, 1, 2, 3, 5, 7, 11])):
            rows.append((c, turn, "user", draw.choice(["a", "a", "a", "b b", "c c c"])))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)


@pytest.mark.parametrize("seed, block, parts", [(1, 16_384, 8), (2, 1, 3), (3, 2, 8), (4, 3, 1), (5, 16_384, 40)])
def test_trie(spark, seed, block, parts):
    rows = random_conversations(spark, seed)
    sequences = {}
    for c, _, role, text in sorted(plain(rows)):
        sequences.setdefault(c, []).append((role, text))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = trie_of(rows, block)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert in_order(found) == in_order(brute.prefix_trie(sequences))


@pytest.mark.parametrize("block", [2, 16_384])
def test_trie_of_odd_conversations(odd_conversations, block):
    rows = odd_conversations.where("conv_id is null or conv_id != 7")
    sequences = {}
    for c, _, role, text in sorted(plain(rows), key=lambda r: (r[1] is not None, r[1] or 0)):
        sequences.setdefault(c, []).append((role or "", text or ""))
    assert in_order(trie_of(rows, block)) == in_order(brute.prefix_trie(sequences))
    assert trie_of(rows.limit(0)) == []
    # A tie in turn has one order, whatever the rows came in.
    tied = odd_conversations.where("conv_id = 7")
    assert in_order(trie_of(tied)) == in_order(trie_of(tied.repartition(5)))


def test_trie_query(spark, tmp_path, odd_conversations):
    small = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = small.unionByName(odd_conversations.where("conv_id is null or conv_id != 7").withColumn("conv_id", F.col("conv_id") + 1000).select(small.columns))
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    sequences = brute.rebuilt(plain(rows))
    assert any(not s for s in sequences.values())
    tokens = rebuilt(prefix_trie.as_tokens(rows)).groupBy("conv_id").count()
    assert {r["conv_id"]: r["count"] for r in tokens.collect()} == {c: len(s) for c, s in sequences.items() if s}
    found = op12_prefix_trie(spark, str(tmp_path))
    assert in_order(tuple(r[c] for c in TRIE) for r in found.collect()) == in_order(brute.prefix_trie(sequences))
