"""Benchmark decontamination: hits of test-set word windows in training texts.

The windows of the benchmark go to every task as a hash set; tasks slide over the words of
whole texts, look up a rolling hash, and compare the words of every hit.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from footfall.llm.common import ascii_lower, fresh_name, let, quoted, text_or_empty, with_arrow_columns
from footfall.session import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
# At most so many (window, item) rows are broadcast at once, about 100 bytes each; of a larger
# benchmark those that occur are found first.
MAX_WINDOWS = 500_000
# So many hashes take the memory of a window with its item.
HASHES_EACH = 12
# Texts are worked on in pieces of about so many bytes, at some 50 bytes of memory for each.
CHUNK_BYTES = 1 << 20

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("after", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
RUN = pa.struct([("first", pa.int64()), ("after", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
ARROW_HITS = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("items", pa.list_(pa.string()))])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so they have inverses
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def benchmark_windows(
    benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH
) -> DataFrame:
    """``item, window``, distinct: ``width`` consecutive words, space-joined.

    An item of fewer words is one window, one without words has none.  NULL items keep their
    windows; their hits count, but they have no name to list.
    """
    words = F.regexp_extract_all(ascii_lower(text_or_empty(text)), F.lit(WORD), 0)

    def windows(w):
        n = F.size(w)
        sliding = F.transform(
            F.sequence(F.lit(1), n - width + 1), lambda i: F.array_join(F.slice(w, i, width), " ")
        )
        return F.when(n >= width, sliding).when(n > 0, F.array(F.array_join(w, " "))).otherwise(
            F.array().cast("array<string>")
        )

    return benchmark.select(
        F.col(item).cast("string").alias("item"), F.explode(let(words, windows)).alias("window")
    ).distinct()


class Powers:
    """1, b, b*b, ... modulo 2**64, and of the inverse of b; grows on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.size = base, pow(base, -1, 1 << 64), 0

    def __reduce__(self):
        return Powers, (self.base,)  # the numbers are not worth sending

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, 1 << 20)
            self.up, self.down = (
                np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(self.size - 1, b, np.uint64)]))
                for b in (self.base, self.inverse)
            )
        return self.up[:n], self.down[:n]


class Words:
    """Words of several texts lying one after the other in ``data``, lower-cased."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, powers: tuple[Powers, Powers]):
        self.data, self.powers = _LOWER[data], powers
        inside = _IN_WORD[self.data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.text = np.searchsorted(offsets, self.starts, side="right") - 1
        up, down = powers[0].upto(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.data * up[:-1], out=sums[1:], dtype=np.uint64)
        hashes = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        self.hashes = (hashes ^ (hashes >> np.uint64(29))) * _MIX

    def window_sums(self) -> np.ndarray:
        up, _ = self.powers[1].upto(len(self.hashes) + 1)
        sums = np.zeros(len(self.hashes) + 1, dtype=np.uint64)
        np.cumsum(self.hashes * up[:-1], out=sums[1:], dtype=np.uint64)
        return sums

    def windows(self, sums: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the windows that lie within one text."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        _, down = self.powers[1].upto(len(self.hashes) + 1)
        values = (sums[width:] - sums[:n]) * down[:n]
        whole = self.text[:n] == self.text[width - 1 :]
        return np.flatnonzero(whole), values[whole]

    def phrase(self, first: int, width: int) -> bytes:
        spots = range(first, first + width)
        return b" ".join([self.data[self.starts[i] : self.ends[i]].tobytes() for i in spots])


def window_hashes(windows: list[bytes], powers: tuple[Powers, Powers]) -> dict[int, np.ndarray]:
    """Hashes of windows, by their number of words."""
    by_width: dict[int, list[bytes]] = {}
    for window in windows:
        by_width.setdefault(window.count(b" ") + 1, []).append(window)
    found = {}
    for width, same in sorted(by_width.items()):
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in same])])
        words = Words(np.frombuffer(b"".join(same), np.uint8), offsets, powers)
        found[width] = words.windows(words.window_sums(), width)[1]
    return found


class HashSet:
    """Hashes of windows by their number of words: a bit table, and sorted, 8 bytes each."""

    TABLE_BITS = 20

    def __init__(self, by_width: dict[int, np.ndarray]):
        self.powers = (Powers(_BYTE_BASE), Powers(_WORD_BASE))
        self.hashes = {}
        for width, values in by_width.items():
            table = np.zeros(1 << self.TABLE_BITS, dtype=bool)
            table[self.slot(values)] = True
            self.hashes[width] = table, np.unique(values)

    def slot(self, values: np.ndarray) -> np.ndarray:
        return (values >> np.uint64(64 - self.TABLE_BITS)).astype(np.int64)

    def spots(self, words: Words):
        """Words per window, and the first words of the windows whose hash is known."""
        sums = words.window_sums()
        for width, (table, known) in self.hashes.items():
            spots, values = words.windows(sums, width)
            likely = np.flatnonzero(table[self.slot(values)])
            at = np.minimum(np.searchsorted(known, values[likely]), len(known) - 1)
            yield width, spots[likely[known[at] == values[likely]]].tolist()

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> set[bytes]:
        """The windows of the texts whose hash is known."""
        words = Words(data, offsets, self.powers)
        return {words.phrase(first, width) for width, spots in self.spots(words) for first in spots}


class WindowSet(HashSet):
    """Windows with their items; hashes find the places, the words themselves decide."""

    def __init__(self, rows: Iterable[tuple[str | None, str]]):
        self.items: dict[bytes, list[str | None]] = {}
        for item, window in rows:
            self.items.setdefault(window.encode(), []).append(item)
        super().__init__(window_hashes(list(self.items), (Powers(_BYTE_BASE), Powers(_WORD_BASE))))

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[dict]:
        """For each text its words, the runs of words that are hit, and the items."""
        words = Words(data, offsets, self.powers)
        n_texts = len(offsets) - 1
        firsts = np.searchsorted(words.text, np.arange(n_texts + 1))
        hit = np.zeros(len(words.starts) + 1, dtype=np.int64)
        items: dict[int, set] = {}
        for width, spots in self.spots(words):
            for first in spots:
                found = self.items.get(words.phrase(first, width))
                if found is not None:
                    hit[first] += 1
                    hit[first + width] -= 1
                    items.setdefault(int(words.text[first]), set()).update(found)
        covered = np.cumsum(hit[:-1]) > 0
        results = [{"n_words": int(n), "runs": [], "items": []} for n in np.diff(firsts)]
        if items:
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        for text, names in items.items():
            a, b = firsts[text], firsts[text + 1]
            flags = np.concatenate([[False], covered[a:b], [False]]).astype(np.int8)
            steps = np.diff(flags)
            zero = points[offsets[text]]
            for x, y in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)):
                start, end = words.starts[a + x], words.ends[a + y - 1]
                results[text]["runs"].append(
                    {"first": int(x), "after": int(y), "start": int(points[start] - zero), "end": int(points[end] - zero)}
                )
            results[text]["items"] = sorted(n for n in names if n is not None)
        return results


def _merged(old: dict, new: dict) -> dict:
    runs: list[dict] = []
    for run in sorted(old["runs"] + new["runs"], key=lambda r: r["first"]):
        if runs and run["first"] <= runs[-1]["after"]:
            if run["after"] > runs[-1]["after"]:
                runs[-1] |= {"after": run["after"], "end": run["end"]}
        else:
            runs.append(dict(run))
    return {"n_words": new["n_words"], "runs": runs, "items": sorted({*old["items"], *new["items"]})}


def chunks(texts: pa.Array, most: int = CHUNK_BYTES):
    """``bytes, offsets`` of consecutive texts, as many as fit into ``most`` bytes, at least one."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        after = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield data[offsets[first] : offsets[after]], offsets[first : after + 1] - offsets[first]
        first = after


def occurring(docs: DataFrame, windows: DataFrame, text: str, most: int) -> DataFrame:
    """Those of ``item, window`` whose window is in any text.

    What is broadcast is the hashes of at most ``most`` windows, 8 bytes each; for more the texts
    are read again.  Nothing is written of them but the windows found: tasks send each once
    a batch, and a join with the windows decides.
    """
    spark = docs.sparkSession
    hashed = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("value", T.LongType())])
    phrase = T.StructType([T.StructField("phrase", T.StringType())])

    def hashes(batches):
        powers = (Powers(_BYTE_BASE), Powers(_WORD_BASE))
        for batch in batches:
            found = window_hashes([w.encode() for w in batch.column("window").to_pylist()], powers)
            for width, values in found.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), width, np.int32)), pa.array(values.view(np.int64))], names=hashed.names
                )

    distinct = materialize(windows.select("window").distinct().mapInArrow(hashes, hashed).distinct(), "window-hashes")
    passes = max(1, -(-distinct.count() // most))
    found = None
    for number in range(passes):
        rows = distinct.where(F.pmod(F.xxhash64("value"), F.lit(passes)) == number).toArrow()
        widths, values = (rows.column(c).to_numpy() for c in ("width", "value"))
        shared = spark.sparkContext.broadcast(HashSet({int(w): values[widths == w].view(np.uint64) for w in np.unique(widths)}))

        def search(batches, shared=shared):
            for batch in batches:
                here: set[bytes] = set()
                for data, offsets in chunks(batch.column("text")):
                    here |= shared.value.phrases(data, offsets)
                if here:
                    yield pa.RecordBatch.from_arrays([pa.array([p.decode() for p in here])], names=phrase.names)

        one = docs.select(F.col(quoted(text)).alias("text")).mapInArrow(search, phrase)
        found = one if found is None else found.unionByName(one)
    return windows.join(found.distinct(), F.col("window") == F.col("phrase"), "left_semi")


def with_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    hits: str = "hits",
    keep: list[str] | None = None,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """``keep`` (all columns of ``docs`` by default) and ``hits``, one row per row of ``docs``.

    ``hits`` holds ``n_words``; ``runs``, the stretches of words inside any occurrence of a
    window, as word numbers (``first``, ``after``) and code points (``start``, ``end``); and
    ``items``, the sorted names of the items with occurring windows.  A NULL text has no
    words.  The benchmark is counted first: windows with their items are broadcast if they are
    at most ``max_windows``.  Of a larger benchmark the texts are first searched for hashes,
    which tells the windows that occur at all; these are broadcast, and only if they are still
    too many they follow in several passes.  The result is the same.
    """
    keep = docs.columns if keep is None else keep
    spark = docs.sparkSession
    windows = materialize(benchmark_windows(benchmark, item, item_text, width), "windows")
    if windows.count() > max_windows:
        windows = materialize(occurring(docs, windows, text, max_windows * HASHES_EACH), "occurring")
    passes = max(1, -(-windows.count() // max_windows))
    block = F.pmod(F.xxhash64("window", "item"), F.lit(passes))
    field = T.StructField(hits, HITS)
    frame = docs
    for number in range(passes):
        rows = [tuple(r) for r in windows.where(block == number).select("item", "window").collect()]
        shared = spark.sparkContext.broadcast(WindowSet(rows))
        last = number == passes - 1
        frame = _scan(frame, shared, field, text, keep if last else docs.columns, again=number > 0)
        if not last:
            frame = materialize(frame, "hits")
    return frame


def _scan(frame: DataFrame, shared, field: T.StructField, text: str, keep, again: bool) -> DataFrame:
    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        found: list[dict] = []
        for data, offsets in chunks(batch.column(text)):
            found += shared.value.find(data, offsets)
        if again:
            found = [_merged(a, b) for a, b in zip(batch.column(field.name).to_pylist(), found)]
        return [pa.array(found, ARROW_HITS)]

    return with_arrow_columns(frame, [field], compute, keep)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """``docs`` without contaminated ``documents``, or with the hit ``spans`` cut from the texts.

    Columns stay as they are.  A text whose words are all hit becomes what stood around them.
    """
    hits = fresh_name(docs, "hits")
    text = options.get("text", "text")
    found = with_hits(docs, benchmark, hits=hits, **options)
    runs = F.col(f"{hits}.runs")
    if remove == "documents":
        return found.where(F.size(runs) == 0).select(*[F.col(quoted(c)) for c in docs.columns])
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    cuts = F.concat(
        F.array(F.lit(0).cast("long")), F.flatten(F.transform(runs, lambda r: F.array(r["start"], r["end"]))),
        F.array(F.length(text)),
    )
    kept = let(
        cuts,
        lambda c: F.array_join(
            F.transform(
                F.sequence(F.lit(0), F.size(runs)),
                lambda i: F.substr(F.col(text), c[i * 2] + 1, c[i * 2 + 1] - c[i * 2]),
            ),
            "",
        ),
    )
    return found.withColumn(text, F.when(F.size(runs) > 0, kept).otherwise(F.col(text))).select(*[F.col(quoted(c)) for c in docs.columns])
