"""Packing tokenized documents into as few fixed-length sequences as possible.

Spark tokenizes, counts the lengths and ranks the pieces of each length; the configuration
program of ``config_lp`` works on the histogram alone; its bins are dealt out by rank.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from footfall.llm.common import with_arrow_columns, with_group_ranks
from footfall.llm.config_lp import Configuration, solve
from footfall.session import materialize

CAPACITY = 1024
END_ID = 2
# Words whose ids a task remembers, about 150 bytes each; further ones are encoded each time.
REMEMBERED_WORDS = 400_000

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
# Of these characters the pattern below cuts texts just as the tokenizer does.
_PLAIN = re.compile(rf"[^\x20-\x7e\t\n\r{_LETTERS}]|<\|")
_PIECES = re.compile(rf" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")

PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
)
ARROW_PIECES = pa.list_(
    pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
)


def _unicode_bytes() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one character: printable ones as
    themselves, the others as the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def is_plain_byte_level(spec: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE that the lookup of words reproduces: texts are
    taken as they are, cut by the usual pattern, and merged in the order of the ids."""
    model, cut = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    if any(spec.get(k) for k in ("normalizer", "truncation", "padding")):
        return False
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space", True) or not cut.get("use_regex", True):
        return False
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if model.get("type") != "BPE" or any(model.get(k) for k in odd):
        return False
    added = {t["content"] for t in spec.get("added_tokens", ())}
    byte_of, ids = _unicode_bytes(), model["vocab"]
    ordinary = [t for t in ids if t not in added]
    if any(not t.startswith("<|") for t in added) or any(c not in byte_of for t in ordinary for c in t):
        return False
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [ids.get(a + b, -1) for a, b in pairs]
    singles = {t for t in ordinary if len(t) == 1}
    in_order = all(a < b for a, b in zip(merged, merged[1:])) and (not merged or merged[0] > max(ids[t] for t in singles))
    return in_order and len(singles) == 256 and len(merged) + 256 == len(ordinary)


class ByteLevelEncoder:
    """Ids of a tokenizer file.

    If it is plain byte-level BPE, texts of Latin letters are cut into words, and words
    already met are looked up, as a corpus repeats most of them.  All other texts, and all
    texts of any other tokenizer, go to the tokenizer as they are.
    """

    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        spec = json.loads(vocabulary)
        self.known: dict[str, bytes] = {}
        self.words = None
        if not is_plain_byte_level(spec):
            return
        special = {t["content"] for t in spec.get("added_tokens", ())}
        byte_of = _unicode_bytes()
        ranks = {
            bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special
        }
        # A word is one piece already, so it needs no pattern.
        self.words = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def _word(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = array("I", self.words.encode_ordinary(word)).tobytes()
            if len(self.known) < REMEMBERED_WORDS:
                self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit numbers, little-endian."""
        if self.words is None or _PLAIN.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype="<u4").tobytes()
        words = _PIECES.findall(text)
        try:
            return b"".join([self.known[w] for w in words])
        except KeyError:
            return b"".join(map(self._word, words))


_encoders: dict[str, ByteLevelEncoder] = {}


def encoder_of(vocabulary: str) -> ByteLevelEncoder:
    """The encoder of this Python worker: further tasks know the words of earlier ones."""
    if vocabulary not in _encoders:
        _encoders.clear()  # one vocabulary at a time
        _encoders[vocabulary] = ByteLevelEncoder(vocabulary)
    return _encoders[vocabulary]


def cut(ids: bytes, capacity: int = CAPACITY) -> list[dict]:
    """Pieces of ``capacity`` ids; if the document is longer, the first may be shorter."""
    total = len(ids) // 4
    edges = [0, *range(total % capacity or capacity, total + 1, capacity)] if total else [0]
    return [
        {"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[4 * a : 4 * b])}
        for i, (a, b) in enumerate(zip(edges, edges[1:]))
    ]


def tokenized_pieces(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``.  ``tokenizer`` is a file on the driver.

    Every document ends with ``end_id``, so a NULL or empty text is one piece of length 1.
    """
    with open(tokenizer, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    end = np.array([end_id], dtype="<u4").tobytes()

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        encoder = encoder_of(vocabulary.value)
        return [pa.array([cut(encoder.encode(t.as_py() or "") + end, capacity) for t in batch.column(text)], ARROW_PIECES)]

    rows = with_arrow_columns(docs.select(F.col(doc_id), F.col(text)), [T.StructField("_pieces", PIECES)], compute, [doc_id])
    return rows.select(F.col(doc_id).alias("doc_id"), F.inline("_pieces"))


class Seats:
    """Which bin and offset the n-th piece of a length gets."""

    RANK_BITS = 48

    def __init__(self, plan: list[Configuration]):
        taken: dict[int, int] = {}
        rows = []
        first_bin = 0
        for configuration in plan:
            offset = 0
            for length, copies in configuration.copies.items():
                start = taken.get(length, 0)
                rows.append(((length << self.RANK_BITS) + start, first_bin, offset, copies))
                taken[length] = start + copies * configuration.bins
                offset += length * copies
            first_bin += configuration.bins
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
        self.start, self.bin, self.offset, self.copies = table.T.copy()

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value = (length << self.RANK_BITS) + rank
        row = np.searchsorted(self.start, value, side="right") - 1
        nth = value - self.start[row]
        return self.bin[row] + nth // self.copies[row], self.offset[row] + nth % self.copies[row] * length


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (``doc_id, piece, length`` and more) with ``sequence_id`` and ``offset``.

    Every sequence is filled from 0 without gaps up to at most ``capacity``.  What goes to
    the driver is the histogram, at most ``capacity`` rows; what comes back is the plan, at
    most a configuration per round of the program and length, whatever the corpus.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    seats = spark.sparkContext.broadcast(Seats(solve(histogram, capacity).configurations))
    ranked = with_group_ranks(pieces, "length", ["doc_id", "piece"], "_rank", "ranked-pieces")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
        return [pa.array(x) for x in seats.value.of(length, rank)]

    new = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return with_arrow_columns(ranked, new, compute, pieces.columns)


def pack_documents(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Rows that repeat an id are documents of their own, packed like any others.
    """
    packed = pack(tokenized_pieces(docs, tokenizer, doc_id, text, capacity, end_id), capacity)
    return packed.withColumnRenamed("doc_id", doc_id)
