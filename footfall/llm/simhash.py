"""SimHash near-duplicates: 64-bit fingerprints, linked at two or fewer differing bits.

Fingerprints are cut into four blocks.  Two that differ in at most two bits agree in at
least two blocks, so a join on every pair of blocks finds all close pairs; the Hamming
distance is then checked.  Only distinct fingerprints take part, and links become classes,
not pairs of documents.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from footfall.llm.common import quoted, rows_that_stay, split_groups, text_digest, with_arrow_columns
from footfall.session import materialize

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
BLOCK_BITS = (16, 16, 16, 16)
# Buckets of more fingerprints are linked through shared one-bit neighbours, not pairwise.
MAX_BUCKET = 64
SLAB = 1 << 16
SALTS = 16


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """Bit i is set if it is set in more than half the hashes of the text's word shingles.

    Shingles are counted as often as they occur.  Fewer words than a shingle has are one
    shingle; a text without words has the fingerprint 0.
    """
    found = text.encode().lower().split()  # of bytes: A-Z only; space and \\t to \\r
    if not found:
        return 0
    if len(found) < words:
        shingles, n = iter([b" ".join(found)]), 1
    else:
        shingles, n = map(b" ".join, zip(*[found[i:] for i in range(words)])), len(found) - words + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, dtype=np.int64)
    for first in range(0, n, SLAB):
        slab = hashes[first : first + SLAB].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(slab, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, words: int = SHINGLE_WORDS
) -> DataFrame:
    """``keep`` (all columns by default) and ``fingerprint``, a LONG.  A NULL text has no words."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        values = [fingerprint(t.as_py() or "", words) for t in batch.column(text)]
        return [pa.array(np.array(values, dtype=np.uint64).view(np.int64))]

    return with_arrow_columns(
        docs, [T.StructField("fingerprint", T.LongType())], compute, docs.columns if keep is None else keep
    )


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _block_masks(max_bits: int) -> list[int]:
    edges = np.cumsum([0, *BLOCK_BITS]).tolist()
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(blocks, len(blocks) - max_bits)]


def links(prints: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """``a, b``: links between distinct fingerprints, enough to connect all close ones.

    ``prints`` has one LONG column, without repeats.  In a bucket of up to ``max_bucket``
    fingerprints every pair is compared.  In a larger one each fingerprint names itself and
    its one-bit neighbours outside the shared blocks: two of them name a common value exactly
    if they differ in two bits at most, and no value is named more than 33 times, so linking
    each to the smallest that names the same value keeps all connections without any pairs.
    """
    name = prints.columns[0]
    masks = _block_masks(MAX_BITS)
    keyed = prints.select(
        F.col(name).alias("a"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("mask"), F.col(name).bitwiseAND(_signed(m)).alias("key"))
                    for i, m in enumerate(masks)
                ]
            )
        ).alias("bucket"),
    ).select("a", "bucket.*")
    sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    crowded = materialize(keyed.join(sizes, ["mask", "key"]), "buckets")

    small = crowded.where(F.col("rows") <= max_bucket).select("mask", "key", "a")
    pairs = (
        small.join(small.withColumnRenamed("a", "b"), ["mask", "key"])
        .where((F.col("b") < F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
        .select("a", "b")
    )

    flips = F.array(
        *[
            F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1])
            for m in masks
        ]
    )
    named = crowded.where(F.col("rows") > max_bucket).select(
        "mask", "a", F.explode(F.transform(flips[F.col("mask")], lambda f: F.col("a").bitwiseXOR(f))).alias("value")
    )
    smallest = named.groupBy("mask", "value").agg(F.min("a").alias("b"))
    through_values = named.join(smallest, ["mask", "value"]).where(F.col("b") < F.col("a")).select("a", "b")
    return pairs.unionByName(through_values).distinct()


def _salted_join(many: DataFrame, few: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join on ``key``; rows of a frequent key go to SALTS tasks, by ``spread``."""
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_salt", salt).join(copies, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``: the smallest node reachable.

    Alternates two steps until nothing changes: every node passes its smallest neighbour to
    its larger ones, then to its smaller ones.  Both keep what is connected, and the number
    of rounds grows with the logarithm of the longest chain.  Each round is written out, so
    that lineage stays short and a lost executor costs a re-read.
    """
    links = materialize(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    state = None
    while True:
        summary = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(summary) == state or not summary[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = tuple(summary)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (
            _salted_join(both.where(F.col("b") > F.col("a")), lowest, "a", "b")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        large = materialize(large, "links")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.*")
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        links = materialize(small, "links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per row of ``docs``.

    ``component_id`` is the smallest id among documents reachable over links, the document
    itself included.  Documents without words share the fingerprint 0 and are linked like any
    others.  Repeated rows are linked by their equal fingerprints; NULL ids count as larger
    than all others, so a component of NULL ids only has a NULL id.
    """
    prints = materialize(
        with_fingerprints(docs, text, [doc_id], words).withColumnRenamed(doc_id, "doc_id"), "fingerprints"
    )
    found = _with_components(prints, "doc_id")
    return found.select(F.col("doc_id").alias(doc_id), "fingerprint", "component_id")


def _with_components(prints: DataFrame, doc_id: str) -> DataFrame:
    """Adds ``component_id``, and ``root``, which is one for each component whatever its ids are."""
    distinct = materialize(prints.groupBy("fingerprint").agg(F.min(doc_id).alias("first")), "distinct")
    roots = components(links(distinct.select("fingerprint")))
    # A fingerprint that no other is close to is a component of its own.
    placed = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    firsts = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = materialize(
        _salted_join(placed.select("root", "fingerprint"), firsts, "root", "fingerprint").select(
            "fingerprint", "component_id", "root"
        ),
        "labels",
    )
    # Both sides are plain shuffles, so a fingerprint of very many documents is split at run time.
    return prints.join(labels, "fingerprint")


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, one with its smallest id; columns stay as they are."""
    content = F.col(quoted(text))
    read = docs.select(F.col(quoted(doc_id)).alias("_id"), content.alias("_text"), text_digest(content).alias("_digest"))
    prints = materialize(with_fingerprints(read, "_text", ["_id", "_digest"]), "fingerprints")
    goes, repeated = split_groups(_with_components(prints, "_id"), "root")
    return rows_that_stay(docs, goes, repeated, doc_id, text)


def as_hex(fingerprint_column: str = "fingerprint"):
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(fingerprint_column)), 16, "0"))
