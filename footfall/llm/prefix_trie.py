"""The prefix trie of conversations, by union-find over sorted neighbours.

A turn is a digest; a conversation is the sequence of its turns.  Equal sequences are combined,
the distinct ones are range-partitioned and sorted.  In every partition the edges between
sorted neighbours, weighted by the length of their longest common prefix (LCP), are taken in
descending depth: each merge of two components creates the branching node at that depth, or
joins it, and closes the unary nodes below.  Nodes that touch the first or the last sequence
of a partition may go on beyond it; they are contracted to one skeleton per partition, and the
skeletons are merged across the boundaries.

Sequences are taken in blocks of ``block`` turns, the deepest first: the nodes at a block's end
are the roots of the next block's forests, so no row holds more than a block.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from footfall.llm.common import quoted, with_group_ranks
from footfall.session import materialize

BLOCK = 16_384
# A run of white space would be no word; what is between counts.
WORD = r"[^\x20\x09-\x0D]+"

NODE, SKELETON, ROOT, OPENED = range(4)  # kinds of rows that tasks return
BOTH, LEFT, RIGHT = range(3)  # the sides of a partition that an open node touches


@dataclass(frozen=True)
class Trie:
    """``nodes``: conversation (the smallest member's), ``depth, parent`` (the parent's smallest
    member), ``n_convs, n_children, n_leaves, saved_tokens`` and ``end``, which names the
    conversations in ``ends`` whose last turn is the node (NULL: none).  ``ends``: one row per
    conversation, with its ``end``."""

    nodes: DataFrame
    ends: DataFrame


def as_tokens(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conversation, pos, token, words``: a turn's place (NULL turns first, ties by token),
    the digest of its role and text, and how many words the text has.  NULLs are empty."""
    roles, texts = (F.coalesce(F.col(quoted(c)), F.lit("")) for c in (role, text))
    own = rows.select(
        F.col(quoted(conversation)).alias("_c"), F.col(quoted(turn)).alias("_turn"),
        F.unhex(F.sha2(F.concat(F.length(roles).cast("string"), F.lit(":"), roles, texts), 256)).alias("token"),
        F.regexp_count(texts, F.lit(WORD)).cast("long").alias("words"),
    )
    ranked = with_group_ranks(own, "_c", ["_turn", "token"], "pos", "tokens")
    return ranked.select(F.col("_c").alias(conversation), "pos", "token", "words")


def _chained(before: Column, tokens: Column) -> Column:
    """The digest of a sequence, from that of the blocks before and the block's tokens."""
    return F.unhex(F.sha2(F.concat(F.hex(before), F.lit(":"), F.array_join(F.transform(tokens, F.hex), "")), 256))


def prefix_trie(tokens: DataFrame, conversations: DataFrame, conversation: str = "conv_id", block: int = BLOCK) -> Trie:
    """The trie of ``tokens`` (as ``as_tokens`` returns them, ``pos`` without gaps).

    ``conversations`` names all of them, also those without turns, which end at the root.
    Without any conversation there are no nodes.  A NULL conversation is one conversation,
    larger than all others.  Other columns are ignored.
    """
    name = F.col(quoted(conversation))
    entry = F.array_sort(F.collect_list(F.struct("pos", "token", "words")))
    blocks = materialize(
        tokens.groupBy(name.alias("_c"), F.expr(f"pos div {block}").alias("_block"))
        .agg(entry.alias("_entries"))
        .select(
            "_c", "_block", F.transform("_entries", lambda e: e["token"]).alias("tokens"),
            F.transform("_entries", lambda e: e["words"]).alias("words"),
        ),
        "token-blocks",
    )
    named = conversations.select(name.alias("_id")).distinct()
    levels = (blocks.agg(F.max("_block")).first()[0] or 0) + 1

    def same(left: str, right: str) -> Column:
        return F.col(left).eqNullSafe(F.col(right))

    none = F.array()
    rows = named.join(blocks.where("_block = 0"), same("_id", "_c"), "left").select(
        F.col("_id").alias("_c"), F.lit(b"").alias("_class"),
        F.coalesce("tokens", none.cast("array<binary>")).alias("tokens"), F.coalesce("words", none.cast("array<bigint>")).alias("words"),
    )
    sequences, ends = [], []
    for level in range(levels):
        rows = materialize(rows.withColumn("_seq", _chained(F.col("_class"), F.col("tokens"))), "sequences")
        combined = rows.groupBy("_class", "_seq", "tokens", "words").agg(F.min("_c").alias("_c"), F.count(F.lit(1)).alias("n"))
        if level:
            above = sequences[-1].select(F.col("_seq").alias("_above"), F.col("_c").alias("_root"))
            combined = combined.join(above, F.col("_class") == F.col("_above")).drop("_above")
        else:
            combined = combined.withColumn("_root", F.col("_c"))
        sequences.append(materialize(combined, "distinct-sequences"))
        last = rows.select("_c", "_seq")
        if level + 1 < levels:
            further = blocks.where(F.col("_block") == level + 1).select(F.col("_c").alias("_id"), "tokens", "words")
            ends.append(last.join(further.select("_id"), same("_c", "_id"), "left_anti"))
            rows = last.join(further, same("_c", "_id")).select("_c", F.col("_seq").alias("_class"), "tokens", "words")
        else:
            ends.append(last)

    found, below = [], None
    for level in reversed(range(levels)):
        rows = sequences[level]
        if below is None:
            rows = rows.withColumns({c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")})
        else:
            rows = rows.join(below, F.col("_seq") == F.col("_of"), "left").withColumns(
                {c: F.coalesce(c, F.lit(0)) for c in ("children", "leaves", "saved")}
            )
        nodes, below = _forest(rows, level * block, level == 0)
        found.append(nodes)
    whole = found[0]
    for nodes in found[1:]:
        whole = whole.unionByName(nodes)
    listed = ends[0]
    for more in ends[1:]:
        listed = listed.unionByName(more)
    return Trie(
        whole.withColumnRenamed("_c", conversation),
        listed.select(F.col("_c").alias(conversation), F.col("_seq").alias("end")),
    )


def _forest(rows: DataFrame, base: int, whole: bool) -> tuple[DataFrame, DataFrame]:
    """The nodes of one block of turns, and what its roots hand to the block above."""
    conv = rows.schema["_c"].dataType
    schema = T.StructType(
        [
            T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("_c", conv),
            T.StructField("depth", T.LongType()), T.StructField("parent", conv), T.StructField("side", T.IntegerType()),
            T.StructField("n_convs", T.LongType()), T.StructField("n_children", T.LongType()), T.StructField("n_leaves", T.LongType()),
            T.StructField("saved_tokens", T.LongType()), T.StructField("end", T.BinaryType()), T.StructField("skeleton", T.BinaryType()),
        ]
    )
    order = ["_class", "tokens"]

    def local(batches):
        from pyspark import TaskContext

        part, found, kind = TaskContext.get().partitionId(), [], None
        for batch in batches:
            kind = batch.schema.field("_c").type
            found += zip(*[batch.column(c).to_pylist() for c in _ROW])
        if found:
            yield from _batches(_Forest(found, part, whole).rows(), kind)

    def merge(batches):
        stack = _Boundaries(whole)
        kind = None
        for batch in batches:
            kind = batch.schema.field("_c").type
            for part, skeleton in zip(batch.column("part").to_pylist(), batch.column("skeleton").to_pylist()):
                yield from _batches(stack.add(part, pickle.loads(skeleton)), kind)
        if kind is not None:
            yield from _batches(stack.end(), kind)

    inner = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*_ROW).mapInArrow(local, schema), "forests")
    # One row per partition, with the nodes at its two ends.
    skeletons = inner.where(F.col("kind") == SKELETON).select("part", "_c", "skeleton")
    outer = materialize(skeletons.repartition(1).sortWithinPartitions("part").mapInArrow(merge, schema), "boundaries")
    opened = outer.where(F.col("kind") == OPENED).select(
        F.col("part").alias("_part"), F.col("depth").alias("_depth"), F.col("side").alias("_side"), F.col("_c").alias("_parent")
    )
    at = ["_c", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", "end"]
    nodes = inner.where(F.col("kind") == NODE)
    hanging = nodes.where(F.col("side").isNotNull()).drop("parent").join(
        opened, (F.col("part") == F.col("_part")) & (F.col("depth") == F.col("_depth") + 1) & (F.col("side") == F.col("_side"))
    ).withColumnRenamed("_parent", "parent")
    every = (
        nodes.where(F.col("side").isNull()).select(at)
        .unionByName(hanging.select(at))
        .unionByName(outer.where(F.col("kind") == NODE).select(at))
        .withColumn("depth", F.col("depth") + base)
    )
    roots = inner.unionByName(outer).where(F.col("kind") == ROOT)
    return every, roots.select(
        F.col("end").alias("_of"), F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")
    )


_ROW = ["_class", "tokens", "words", "n", "_c", "_seq", "_root", "children", "leaves", "saved"]
_CLASS, _TOKENS, _WORDS, _N, _CONV, _SEQ, _ROOT_CONV, _CHILDREN, _LEAVES, _SAVED = range(len(_ROW))
_COLUMNS = [
    ("kind", pa.int32()), ("part", pa.int32()), ("_c", None), ("depth", pa.int64()), ("parent", None), ("side", pa.int32()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("end", pa.binary()), ("skeleton", pa.binary()),
]


def _batches(rows: Iterator[tuple], conv: pa.DataType, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    names = [n for n, _ in _COLUMNS]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t or conv) for v, (_, t) in zip(zip(*found), _COLUMNS)], names=names)

    found = []
    for row in rows:
        found.append(row)
        if len(found) >= size:
            yield batch(found)
            found = []
    if found:
        yield batch(found)


def _lcp(a: tuple, b: tuple) -> int:
    """How many tokens two sequences share at their beginning; -1 if their roots differ."""
    if a[0] != b[0]:
        return -1
    n = 0
    for x, y in zip(a[1], b[1]):
        if x != y:
            break
        n += 1
    return n


def _smaller(a, b):
    return b if a is None else a if b is None else min(a, b)


@dataclass(slots=True)
class _Node:
    """A node, or as much of it as is known: what its closed subtrees hold, without itself."""

    depth: int
    n: int
    conv: object
    children: int
    leaves: int
    saved: int
    end: bytes | None
    kids: list  # closed children, until the smallest member is known
    left: int
    right: int


class _Forest:
    """The nodes of the sorted sequences of one partition."""

    def __init__(self, rows: list[tuple], part: int, whole: bool):
        self.all, self.part, self.whole = rows, part, whole
        self.last = len(rows) - 1
        self.out: list[tuple] = []
        self.open: dict[tuple[int, int], list] = {}

    def rows(self) -> Iterator[tuple]:
        rows, last = self.all, self.last
        top = [_Node(len(r[_TOKENS]), r[_N], r[_CONV], r[_CHILDREN], r[_LEAVES], r[_SAVED], r[_SEQ], [], i, i) for i, r in enumerate(rows)]
        lcp = [-1] + [_lcp(a, b) for a, b in zip(rows, rows[1:])]
        parent = list(range(len(rows)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in sorted(range(1, len(rows)), key=lcp.__getitem__, reverse=True):
            if lcp[i] < 0:
                break
            a, b = find(i - 1), find(i)
            one, two = self._raised(top[a], lcp[i]), self._raised(top[b], lcp[i])
            if one.right - one.left < two.right - two.left:  # the larger component keeps its name
                a, b = b, a
            one.n += two.n
            one.conv = _smaller(one.conv, two.conv)
            one.children += two.children
            one.leaves += two.leaves
            one.saved += two.saved
            one.end = one.end or two.end
            if len(one.kids) < len(two.kids):
                one.kids, two.kids = two.kids, one.kids
            one.kids += two.kids
            one.right = two.right
            parent[b], top[a] = a, one
            yield from self._flush()
        for i in range(len(rows)):
            if find(i) == i:
                self._root(self._raised(top[i], 0))
                yield from self._flush()
        first, final = rows[0], rows[last]
        sides = {side: [self.open[k] for k in sorted(self.open) if k[0] == side] for side in (BOTH, LEFT, RIGHT)}
        skeleton = pickle.dumps(
            ((first[_CLASS], first[_TOKENS], first[_ROOT_CONV]), (final[_CLASS], final[_TOKENS], final[_ROOT_CONV]), sides[BOTH], sides[LEFT], sides[RIGHT])
        )
        yield (SKELETON, self.part, None, None, None, None, None, None, None, None, None, skeleton)

    def _flush(self) -> Iterator[tuple]:
        out, self.out = self.out, []
        return iter(out)

    def _words(self, node: _Node) -> int:
        return self.all[node.left][_WORDS][node.depth - 1] if node.depth else 0

    def _side(self, node: _Node) -> int | None:
        if node.left == 0:
            return BOTH if node.right == self.last else LEFT
        return RIGHT if node.right == self.last else None

    def _leave_open(self, node: _Node, side: int) -> None:
        self.open[side, node.depth] = [node.n, node.conv, node.children, node.leaves, node.saved, self._words(node), node.end]
        self.out += [(NODE, self.part, *kid[:2], None, side, *kid[2:], None) for kid in node.kids]

    def _raised(self, node: _Node, depth: int) -> _Node:
        """The component's node at ``depth``; all deeper ones are complete, but for open ends."""
        while node.depth > depth:
            side = self._side(node)
            if side is not None:
                self._leave_open(node, side)
                node = _Node(node.depth - 1, node.n, node.conv, 0, 0, 0, None, [], node.left, node.right)
            else:
                kid = _closed(node.n, node.conv, node.depth, node.children, node.leaves, node.saved, self._words(node), node.end)
                self.out += [(NODE, self.part, *k[:2], node.conv, None, *k[2:], None) for k in node.kids]
                node = _Node(node.depth - 1, node.n, node.conv, 1, kid[4], kid[5], None, [kid], node.left, node.right)
        return node

    def _root(self, node: _Node) -> None:
        side = self._side(node)
        if side is not None:
            self._leave_open(node, side)
            return
        row = self.all[node.left]
        self.out += [(NODE, self.part, *k[:2], row[_ROOT_CONV], None, *k[2:], None) for k in node.kids]
        self.out.append(_root_row(row[_CLASS], node.children, node.leaves, node.saved))


def _closed(n: int, conv, depth: int, children: int, leaves: int, saved: int, words: int, end: bytes | None) -> tuple:
    """conversation, depth, n_convs, n_children, n_leaves, saved_tokens, end"""
    return (conv, depth, n, children, leaves if children else 1, saved + (n - 1) * words, end)


def _root_row(of: bytes, children: int, leaves: int, saved: int) -> tuple:
    return (ROOT, None, None, 0, None, None, None, children, leaves, saved, of, None)


class _Boundaries:
    """Merges the skeletons of partitions in their order: the open path is a stack by depth."""

    def __init__(self, whole: bool):
        self.whole = whole
        self.path: list[list] = []  # n, conv, children, leaves, saved, words, end, open ids, kids
        self.sequence: tuple | None = None

    def add(self, part: int, skeleton: tuple) -> Iterator[tuple]:
        first, last, both, left, right = skeleton
        if self.sequence is not None:
            shared = _lcp(self.sequence, first)
            yield from self._cut(shared)
        for depth, entry in enumerate([*both, *left]):
            self._put(part, depth, BOTH if depth < len(both) else LEFT, entry)
        self.sequence = first
        yield from self._cut(len(both) - 1)
        for depth, entry in enumerate(right, len(both)):
            self._put(part, depth, RIGHT, entry)
        self.sequence = last

    def end(self) -> Iterator[tuple]:
        yield from self._cut(-1)

    def _put(self, part: int, depth: int, side: int, entry: list) -> None:
        if depth == len(self.path):
            self.path.append([*entry, [(part, side)], []])
            return
        node = self.path[depth]
        for i in (0, 2, 3, 4):
            node[i] += entry[i]
        node[1] = _smaller(node[1], entry[1])
        node[6] = node[6] or entry[6]
        node[7].append((part, side))

    def _cut(self, depth: int) -> Iterator[tuple]:
        """Closes the nodes of the path below ``depth``."""
        while len(self.path) > depth + 1:
            n, conv, children, leaves, saved, words, end, opened, kids = self.path.pop()
            at = len(self.path)
            if not at and not self.whole:
                conv = self.sequence[2]
            for kid in kids:
                yield (NODE, None, *kid[:2], conv, None, *kid[2:], None)
            for part, side in opened:
                yield (OPENED, part, conv, at, None, side, None, None, None, None, None, None)
            if at:
                kid = _closed(n, conv, at, children, leaves, saved, words, end)
                above = self.path[-1]
                above[2] += 1
                above[3] += kid[4]
                above[4] += kid[5]
                above[8].append(kid)
            elif self.whole:
                root = _closed(n, conv, 0, children, leaves, saved, 0, end)
                yield (NODE, None, *root[:2], None, None, *root[2:], None)
            else:
                yield _root_row(self.sequence[0], children, leaves, saved)
