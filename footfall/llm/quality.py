"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages and only the document has a label.  Every passage is encoded
into figures about its words and characters; gated attention learns which passages decide,
and the score is that of their weighted mean.  Passages are encoded in the tasks; training
sees the encoded passages of a bounded number of labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from footfall.llm.common import with_arrow_columns
from footfall.llm.decontaminate import chunks

PASSAGE_WORDS = 64
# At most so many labelled documents are trained on, those with the smallest hashes of ids.
TRAIN_DOCS = 6_000
FOLDS = 5
THRESHOLD = 0.3
EPOCHS, STEP, WEIGHT_DECAY = 120, 0.02, 1e-3
HIDDEN, GATE = 16, 8

# Character classes whose share of a passage is a feature.
CLASSES = [
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", bytes(range(128, 256)), b"!", b"|",
    b"%$#&*~^", b".", b",", b"?;:", b"\"'`", b"()[]{}", b"/\\", b"-_", b"@", b"=+", b"<>", b"\n", b"\t\r",
]
_CLASS = np.full(256, len(CLASSES), dtype=np.int64)
for _i, _members in enumerate(CLASSES):
    _CLASS[list(_members)] = _i
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
N_FEATURES = len(CLASSES) + 1 + 10
# Texts are encoded in pieces of about so many bytes, at some 100 bytes of memory for each.
ENCODE_BYTES = 1 << 17
# A word is compared with so many before it.
LOOK_BACK = 3
_BASE = 0x9E3779B97F4A7C15


def encode_passages(data: np.ndarray, offsets: np.ndarray, words_each: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for every passage, and the number of passages of every text.

    A passage is ``words_each`` words of a text, its last one what remains; a text without
    words is one passage of zeros.  Texts longer than a piece are cut between passages.
    """
    features, bags = [np.zeros((0, N_FEATURES), np.float32)], [np.zeros(0, np.int64)]
    first = 0
    while first < len(offsets) - 1:
        after = max(first + 1, int(np.searchsorted(offsets, offsets[first] + ENCODE_BYTES, side="right")) - 1)
        piece, own = data[offsets[first] : offsets[after]], offsets[first : after + 1] - offsets[first]
        found, each = _encode(piece, own, words_each) if len(piece) <= ENCODE_BYTES else _encode_long(piece, words_each)
        features.append(found)
        bags.append(each)
        first = after
    return np.concatenate(features), np.concatenate(bags)


def _encode_long(data: np.ndarray, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """``encode_passages`` of one text, some passages at a time; a passage is never cut."""
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return np.zeros((1, N_FEATURES), np.float32), np.ones(1, np.int64)
    bounds = np.concatenate([starts[::words_each], [len(data)]])
    features, first = [], 0
    while first < len(bounds) - 1:
        after = max(first + 1, int(np.searchsorted(bounds, bounds[first] + ENCODE_BYTES, side="right")) - 1)
        # The first words of a piece are compared with those of the passages before it.
        lead = min(first, -(-LOOK_BACK // words_each))
        piece = data[bounds[first - lead] : bounds[after]]
        features.append(_encode(piece, np.array([0, len(piece)]), words_each)[0][lead:])
        first = after
    return np.concatenate(features), np.array([len(bounds) - 1])


def _encode(data: np.ndarray, offsets: np.ndarray, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    n_texts = len(offsets) - 1
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    text = np.searchsorted(offsets, starts, side="right") - 1
    n_words = np.bincount(text, minlength=n_texts)
    bags = np.maximum(1, -(-n_words // words_each))
    features = np.zeros((int(bags.sum()), N_FEATURES), dtype=np.float32)
    if not len(starts):
        return features, bags
    first_word = np.concatenate([[0], np.cumsum(n_words)])
    first_bag = np.concatenate([[0], np.cumsum(bags)])
    within = np.arange(len(starts)) - first_word[text]
    passage = first_bag[text] + within // words_each
    n_passages = len(features)

    # Characters: a passage runs from its first word to the next passage, or to the text's end.
    opens = np.flatnonzero(within % words_each == 0)
    where, begin = passage[opens], starts[opens]
    width = len(CLASSES) + 1
    marks = np.zeros(len(data), dtype=np.int64)
    marks[begin] = np.arange(1, len(begin) + 1)
    inside_of = np.maximum.accumulate(marks) - 1  # the passage each byte is in, or comes after
    # White space before the first word of a text is in no passage.
    byte_text = np.repeat(np.arange(n_texts), np.diff(offsets))
    own = (inside_of >= 0) & (text[opens][inside_of] == byte_text)
    counts = np.bincount(inside_of[own] * width + _CLASS[data[own]], minlength=len(begin) * width).reshape(-1, width)
    size = np.maximum(counts.sum(axis=1), 1)
    features[where, :width] = counts / size[:, None]

    # Words.
    lengths = (ends - starts).astype(np.float64)
    total = np.bincount(passage, minlength=n_passages)
    each = np.maximum(total, 1)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), _BASE, np.uint64)]))
    inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), pow(_BASE, -1, 1 << 64), np.uint64)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]

    def share(flags: np.ndarray, at: np.ndarray = passage) -> np.ndarray:
        return np.bincount(at, weights=flags, minlength=n_passages) / each

    mean = share(lengths)
    columns = [mean / 10, np.sqrt(np.maximum(share(lengths**2) - mean**2, 0)) / 10, share(lengths == 1), share(lengths <= 3), share(lengths >= 14)]
    for back in range(1, LOOK_BACK + 1):
        same = np.zeros(len(hashes))
        same[back:] = (hashes[back:] == hashes[:-back]) & (text[back:] == text[:-back])
        columns.append(share(same))
    keyed = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    distinct = np.concatenate([[True], keyed[1:] != keyed[:-1]])
    columns.append(np.bincount((keyed[distinct] >> np.uint64(40)).astype(np.int64), minlength=n_passages) / each)
    columns.append(np.minimum(total / words_each, 1.0))
    features[:, width:] = np.stack(columns, axis=1)
    return features, bags


@dataclass
class AttentionModel:
    """Gated attention over passages; all arrays are small."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None

    def score(self, features: np.ndarray, bags: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        return _forward((features - self.mean) / self.scale, bags, self.weights)["score"]


def _segments(bags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(bags)[:-1]])


def _forward(x: np.ndarray, bags: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    firsts, owner = _segments(bags), np.repeat(np.arange(len(bags)), bags)
    hidden = np.tanh(x @ w["encode"] + w["encode0"])
    looks = np.tanh(hidden @ w["look"])
    gates = 1 / (1 + np.exp(-(hidden @ w["gate"])))
    logits = (looks * gates) @ w["attend"]
    logits = np.exp(logits - np.maximum.reduceat(logits, firsts)[owner])
    attention = logits / np.add.reduceat(logits, firsts)[owner]
    pooled = np.add.reduceat(attention[:, None] * hidden, firsts, axis=0)
    score = 1 / (1 + np.exp(-np.clip(pooled @ w["out"] + w["out0"], -30, 30)))
    return {"owner": owner, "firsts": firsts, "hidden": hidden, "looks": looks, "gates": gates, "attention": attention, "pooled": pooled, "score": score}


def train(features: np.ndarray, bags: np.ndarray, labels: np.ndarray, seed: int = 7) -> AttentionModel:
    """Minimizes log loss over bags.  With one label only, or none, the score is a constant."""
    if len(np.unique(labels)) < 2:
        n = len(labels)
        return AttentionModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), constant=float((labels.sum() + 1) / (n + 2)))
    mean, scale = features.mean(axis=0, dtype=np.float64), features.std(axis=0, dtype=np.float64) + 1e-3
    x = (features - mean) / scale
    random = np.random.default_rng(seed)
    w = {
        "encode": random.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, HIDDEN)), "encode0": np.zeros(HIDDEN),
        "look": random.normal(0, 0.3, (HIDDEN, GATE)), "gate": random.normal(0, 0.3, (HIDDEN, GATE)),
        "attend": random.normal(0, 0.3, GATE), "out": random.normal(0, 0.3, HIDDEN), "out0": np.zeros(1),
    }
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    for epoch in range(1, EPOCHS + 1):
        gradient = _gradient(x, bags, labels, w)
        for k in w:
            g = gradient[k] + WEIGHT_DECAY * w[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w[k] = w[k] - STEP * (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.999**epoch)) + 1e-8)
    return AttentionModel(mean, scale, w)


def _gradient(x, bags, labels, w) -> dict[str, np.ndarray]:
    f = _forward(x, bags, w)
    owner, hidden, looks, gates, attention = (f[k] for k in ("owner", "hidden", "looks", "gates", "attention"))
    error = (f["score"] - labels) / len(labels)
    of_pooled = error[:, None] * w["out"]
    of_attention = (of_pooled[owner] * hidden).sum(axis=1)
    centre = np.add.reduceat(attention * of_attention, f["firsts"])
    of_logit = attention * (of_attention - centre[owner])
    of_product = of_logit[:, None] * w["attend"]
    of_look = of_product * gates * (1 - looks**2)
    of_gate = of_product * looks * gates * (1 - gates)
    of_hidden = attention[:, None] * of_pooled[owner] + of_look @ w["look"].T + of_gate @ w["gate"].T
    of_sum = of_hidden * (1 - hidden**2)
    return {
        "out": f["pooled"].T @ error, "out0": np.array([error.sum()]), "attend": (looks * gates).T @ of_logit,
        "look": hidden.T @ of_look, "gate": hidden.T @ of_gate, "encode": x.T @ of_sum, "encode0": of_sum.sum(axis=0),
    }


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    train_docs: int = TRAIN_DOCS,
) -> AttentionModel:
    """Learns from at most ``train_docs`` labelled documents that are not held out, whole texts.

    A document labelled more than once counts as 1 if most of its labels do; NULL labels are
    left out.
    """
    order = F.xxhash64("_id")
    chosen = (
        labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_label"))
        .where(F.col("_label").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
        .groupBy("_id")
        .agg((F.avg("_label") >= 0.5).cast("int").alias("_label"))
        .orderBy(order, "_id")
        .limit(train_docs)
    )
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        flat = []
        for data, offsets in chunks(batch.column("_text")):
            features, bags = encode_passages(data, offsets)
            flat += [x.ravel() for x in np.split(features, np.cumsum(bags)[:-1])]
        return [pa.array(flat, pa.list_(pa.float32()))]

    column = T.StructField("_features", T.ArrayType(T.FloatType()))
    # An id that repeats in the documents does not make the sample larger.
    sample = with_arrow_columns(texts, [column], compute, ["_id", "_label"]).orderBy(order, "_id").limit(train_docs)
    rows = sample.select("_label", "_features").toArrow()
    if not rows.num_rows:
        return train(np.zeros((0, N_FEATURES)), np.zeros(0, np.int64), np.zeros(0))
    flat = rows.column("_features").combine_chunks()
    features = flat.flatten().to_numpy().reshape(-1, N_FEATURES)
    bags = np.array([len(x) for x in flat]) // N_FEATURES
    return train(features, bags, rows.column("_label").to_numpy().astype(np.float64))


def with_scores(
    docs: DataFrame, model: AttentionModel, score: str = "score", text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``keep`` (all columns by default) and ``score``, from 0 to 1.

    A NULL text counts as empty, and an empty one has the score of a passage of zeros.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        scores = [shared.value.score(*encode_passages(*chunk)) for chunk in chunks(batch.column(text))]
        return [pa.array(np.concatenate([*scores, np.zeros(0)]))]

    return with_arrow_columns(docs, [T.StructField(score, T.DoubleType())], compute, docs.columns if keep is None else keep)
