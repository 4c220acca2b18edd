"""Sharding, the archive, packing, the quality model and the pipeline."""

import json
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T
from tokenizers import Tokenizer

import corpus_pipeline
from footfall.arrow import BATCH_BYTES
from footfall.llm import config_lp, packing, quality, sharding, simhash, warc
from footfall.llm.common import with_arrow_columns, with_group_ranks
from footfall.llm.queries import VOCABULARY as VOCABULARY_NAME, op7_sharding, op9_packing, op10_quality, vocabulary_file
from footfall.session import new_scratch_path
from tests.llm import brute
from tests.llm.conftest import SMALL

VOCABULARY = vocabulary_file()


def test_jump_is_the_published_loop():
    keys = np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)
    for shards in (1, 2, 16, 17, 1000):
        assert sharding.jump(keys, shards).tolist() == [brute.jump(int(k), shards) for k in keys]
    before, after = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert set(after[before != after]) == {16}


@pytest.mark.parametrize("name", ["odd_documents", "small_documents"])
def test_shards(request, name):
    docs = request.getfixturevalue(name)
    found = sharding.assign_shards(docs, 16, grown=17).collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        {(i, len(t.encode()) + 1, zlib.crc32(t.encode())): n for (i, t), n in texts.items()}
    )
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = defaultdict(set)
    for r in found:
        by_id[r["doc_id"]].add(r["shard"])
    assert all(len(s) == 1 for s in by_id.values())
    assert sharding.assign_shards(docs.limit(0), 16).count() == 0


def test_shards_query_and_files(spark, small_documents):
    rows = op7_sharding(spark, SMALL).collect()
    assert len(rows) == small_documents.count() and {r["law"] for r in rows} == {"key"}
    path = new_scratch_path(spark, "shard-files")
    assert sharding.write_shards(small_documents, path, 16) == "shard"
    stored = spark.read.parquet(path)
    assert {(r["doc_id"], r["shard"]) for r in stored.collect()} == {(r["doc_id"], r["shard"]) for r in rows}


def test_shard_files_keep_a_column_of_that_name(spark, odd_documents):
    path = new_scratch_path(spark, "shard-files")
    name = sharding.write_shards(odd_documents, path, 3)
    stored = spark.read.parquet(path)
    assert {r["shard"] for r in stored.collect()} == {79} and {r[name] for r in stored.collect()} <= {0, 1, 2}


def test_ranks_with_clashing_names(spark, odd_documents):
    ranked = with_group_ranks(odd_documents, "text", ["doc_id", "a.b"], "own", "ranks")
    assert ranked.columns == [*odd_documents.columns, "own"]
    assert sorted(map(repr, ranked.drop("own").collect())) == sorted(map(repr, odd_documents.collect()))
    found = defaultdict(list)
    for r in ranked.collect():
        found[r["text"]].append((r["doc_id"], r["own"]))
    assert all([rank for _, rank in sorted(rows, key=lambda x: (x[0] is not None, x))] == list(range(len(rows))) for rows in found.values())


def pages_of(spark):
    big = "<p>" + "ü" * 80
    rows = [
        (5, "http://a/5", big, 1), (3, "http://a/3", big, 1), (9, None, big, 1), (4, "http://a/4", "tiny", 1),
        (2, "http://a/2 x\r\nWARC-Type: revisit", "tiny", 1), (6, "u", None, 1), (7, "u", "", 1), (8, "u", "x" * 99, 1),
        (1, "u", "x" * 99, 1), (10, "u", "y" * 100, 1), (11, "u", "y" * 100, 1), (11, "u", "y" * 100, 1),
        (12, "u", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n" * 4, 1),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, first int")


def test_archive_round_trip(spark):
    pages = pages_of(spark)
    archive = warc.write_archive(pages, new_scratch_path(spark, "warc"))
    rows = pages.collect()
    assert archive.payloads(spark).count() == len({r["html"] or "" for r in rows})
    records = warc.read_records(spark, archive)
    payloads = Counter((r["page_id"], bytes(r["payload"])) for r in records.collect())
    assert payloads == Counter((r["page_id"], (r["html"] or "").encode()) for r in rows)
    for r in records.collect():
        header, record = bytes(r["header"]), bytes(r["record"])
        kind = b"revisit" if b"WARC-Type: revisit\r\n" in header else b"response"
        assert record == header + (b"" if kind == b"revisit" else bytes(r["payload"])) + b"\r\n\r\n"
        assert header.startswith(b"WARC/1.1\r\n") and header.endswith(b"\r\n\r\n") and header.count(b"\r\nWARC-Type:") == 1
    first = {}
    for r in rows:
        first[r["html"]] = min(first.get(r["html"], r["page_id"]), r["page_id"])
    facts = warc.record_facts(records).collect()
    for r in facts:
        html = next(x["html"] or "" for x in rows if x["page_id"] == r["page_id"])
        again = len(html.encode()) >= 100 and first[html] != r["page_id"]
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == brute.sha(html)
        assert r["record_type"] == ("revisit" if again else "response")
        assert r["refers_to"] == (first[html] if again else None)
    assert len(facts) == len(rows)


def test_archive_of_nothing_and_damage(spark):
    pages = pages_of(spark)
    path = new_scratch_path(spark, "warc")
    assert warc.read_records(spark, warc.write_archive(pages.limit(0), path)).count() == 0
    archive = warc.write_archive(pages, new_scratch_path(spark, "warc"))
    broken = new_scratch_path(spark, "warc")
    archive.headers(spark).write.parquet(f"{broken}/headers")
    archive.payloads(spark).withColumn("payload", F.lit(b"other")).write.parquet(f"{broken}/payloads")
    with pytest.raises(Exception, match="does not have the digest"):
        warc.read_records(spark, warc.Archive(broken, archive.id_type)).collect()


@pytest.mark.parametrize("name", ["odd_documents", "small_documents"])
def test_packing(request, name):
    docs = request.getfixturevalue(name)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    found = packing.pack_documents(docs, VOCABULARY).collect()
    wanted = []
    for r in docs.collect():
        ids = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        first = len(ids) % 1024 or 1024
        edges = [0, *range(min(first, len(ids)), len(ids) + 1, 1024)]
        wanted += [(r["doc_id"], i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == Counter(wanted)
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= brute.best_fit_decreasing([w[3] for w in wanted], 1024)


def test_packing_of_nothing(small_documents):
    assert packing.pack_documents(small_documents.limit(0), VOCABULARY).count() == 0


def test_packing_query(spark):
    assert {"sequence_id", "offset"} <= set(op9_packing(spark, SMALL).columns)


def held_by(configurations):
    held = Counter()
    for configuration in configurations:
        assert configuration.bins > 0
        assert sum(l * n for l, n in configuration.copies.items()) <= 1024
        for length, n in configuration.copies.items():
            held[length] += n * configuration.bins
    return held


@pytest.mark.parametrize("lengths", [
    [1024] * 5, [1] * 3000, [512] * 7, [600, 500, 424, 300, 124] * 9, [341, 342, 343] * 100, list(range(1, 1025)), [700] * 50 + [324] * 49,
    [513] * 100 + [300] * 200 + [211] * 100, [511] * 300 + [257] * 300 + [256] * 300, [],
    np.random.default_rng(3).integers(1, 1024, 4000).tolist(), np.random.default_rng(4).choice([97, 130, 342, 343, 500, 520, 350, 700, 810], 3000).tolist(),
])
def test_configurations_hold_exactly_the_items(lengths):
    plan = config_lp.solve(Counter(lengths), 1024)
    assert held_by(plan.configurations) == Counter(lengths)
    assert -(-sum(lengths) // 1024) <= plan.bound <= plan.bins <= brute.best_fit_decreasing(lengths, 1024)


def test_known_optima():
    # One of each in every bin, and pairs of the long ones with thirds of the middle ones.
    assert config_lp.solve({511: 300, 257: 300, 256: 300}, 1024).bins == 300
    assert config_lp.solve({513: 100, 300: 200, 211: 100}, 1024).bins <= 134
    assert config_lp.solve(Counter([341, 342, 343] * 100), 1024).bins == 125  # best-fit takes 134


def fewest_bins(lengths, capacity):
    """By trying all."""
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best[0]


def test_cover_and_bound_enclose_the_program():
    random = np.random.default_rng(8)
    for _ in range(60):
        lengths = sorted(random.integers(3, 20, random.integers(1, 10)).tolist(), reverse=True)
        cover = config_lp.solve_program(Counter(lengths), 20)
        fewest = fewest_bins(lengths, 20)
        assert cover.bound <= cover.value + 1e-9 and cover.bound <= fewest + 1e-9
        covered = Counter()
        for copies, amount in cover.amounts.items():
            assert sum(l * n for l, n in copies) <= 20 and amount > 0
            for l, n in copies:
                covered[l] += n * amount
        assert all(covered[l] >= n - 1e-6 for l, n in Counter(lengths).items())
        assert abs(sum(cover.amounts.values()) - cover.value) < 1e-6 and cover.value <= 1.05 * cover.bound
        plan = config_lp.solve(Counter(lengths), 20)
        assert plan.bound <= fewest <= plan.bins


def test_bulk_best_fit_is_best_fit():
    random = np.random.default_rng(9)
    for _ in range(200):
        lengths = random.integers(1, 1025, random.integers(1, 80)).tolist()
        assert config_lp.best_fit_decreasing(Counter(lengths), 1024).count() == brute.best_fit_decreasing(lengths, 1024)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_tokenizers(name, odd_documents, small_documents):
    path = vocabulary_file(name)
    with open(path, encoding="utf-8") as file:
        encoder = packing.ByteLevelEncoder(file.read())
    assert (encoder.words is not None) == (name == VOCABULARY_NAME)
    tokenizer = Tokenizer.from_file(path)
    for r in [*odd_documents.collect(), *small_documents.limit(60).collect()]:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        assert encoder.encode(r["text"] or "") == np.array(ids, dtype="<u4").tobytes()


def test_only_plain_byte_level_files_are_looked_up():
    with open(VOCABULARY, encoding="utf-8") as file:
        spec = json.load(file)
    assert packing.is_plain_byte_level(spec)
    model = spec["model"]
    merges = model["merges"]
    for change in (
        {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}},
        {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {**model, "merges": [merges[1], merges[0], *merges[2:]]}},
        {"model": {**model, "merges": merges[:-1]}}, {"model": {**model, "dropout": 0.1}}, {"added_tokens": [{"content": "end", "id": 1}]},
    ):
        assert not packing.is_plain_byte_level({**spec, **change})


def test_too_long_for_a_bin():
    with pytest.raises(ValueError):
        config_lp.solve({2000: 1}, 1024)


def test_passages_do_not_depend_on_what_is_encoded_together():
    texts = ["", "one two three", "Ä b! " * 500, "   ", "x", "a a a a b b"]

    def encode(group):
        data = [t.encode() for t in group]
        offsets = np.cumsum([0, *map(len, data)])
        return quality.encode_passages(np.frombuffer(b"".join(data), np.uint8), offsets)

    together, bags = encode(texts)
    apart = [encode([t]) for t in texts]
    assert bags.tolist() == [int(b[0]) for _, b in apart]
    assert np.array_equal(together, np.concatenate([f for f, _ in apart]))


def test_passages_of_many_and_of_long_texts_take_little_memory():
    words = ["a", "b", "cc", "dd", "Ä!", "\n", "  ", "x1", "longer-than-most-words-are"]
    random = np.random.default_rng(0)
    long = "  " + " ".join(random.choice(words, 400_000))
    texts = ["", long, " " * 300_000, "y" * 300_000, *[long[i : i + 5000] for i in range(0, 1_000_000, 5000)], "z", ""]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    flat = np.frombuffer(b"".join(data), np.uint8)
    for words_each in (2, quality.PASSAGE_WORDS):
        tracemalloc.start()
        features, bags = quality.encode_passages(flat, offsets, words_each)
        peak = tracemalloc.get_traced_memory()[1] - 3 * features.nbytes
        tracemalloc.stop()
        assert peak < 60 << 20  # what one text of 300,000 letters takes, and not what 3 MB take
        together, of_all = quality._encode(flat, offsets, words_each)
        assert np.array_equal(features, together) and np.array_equal(bags, of_all)


def test_batches_of_long_rows_are_small(spark):
    texts = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("0123456789"), 1000).alias("a.b"))

    def compute(batch):
        return [pa.array([batch.nbytes] * batch.num_rows)]

    column = T.StructField("bytes", T.LongType())
    rows = with_arrow_columns(texts, [column], compute, ["id", "a.b"]).select("id", "bytes").collect()
    assert [r["id"] for r in rows] == list(range(3000)) and max(r["bytes"] for r in rows) < BATCH_BYTES + 50_000


def test_gradient_is_the_slope_of_the_loss():
    random = np.random.default_rng(0)
    bags, labels = np.array([2, 1, 3]), np.array([1.0, 0.0, 1.0])
    x = random.normal(size=(6, 4))
    w = {"encode": random.normal(size=(4, 3)), "encode0": random.normal(size=3), "look": random.normal(size=(3, 2)),
         "gate": random.normal(size=(3, 2)), "attend": random.normal(size=2), "out": random.normal(size=3), "out0": np.zeros(1)}

    def loss():
        p = quality._forward(x, bags, w)["score"]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    gradient = quality._gradient(x, bags, labels, w)
    for name, value in w.items():
        for at in np.ndindex(value.shape):
            value[at] += 1e-6
            up = loss()
            value[at] -= 2e-6
            slope = (up - loss()) / 2e-6
            value[at] += 1e-6
            assert abs(slope - gradient[name][at]) < 1e-5


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = op10_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert len(held) > 50 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95


def test_quality_of_odd_tables(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (6, 1, 0), (6, None, 0), (None, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd_documents, labels)
    scored = quality.with_scores(odd_documents, model, score="own")
    assert scored.count() == odd_documents.count() and scored.where("own is null or own < 0 or own > 1").count() == 0
    assert scored.columns == [*odd_documents.columns, "own"]
    constant = quality.fit(odd_documents, labels.limit(0))
    assert {r["own"] for r in quality.with_scores(odd_documents, constant, "own").collect()} == {0.5}
    assert quality.with_scores(odd_documents.limit(0), model, "own").count() == 0


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = new_scratch_path(spark, "stage")
        stage(spark, frames[-1], SMALL).write.parquet(path)
        frames.append(spark.read.parquet(path))
        if name != "packing":
            assert frames[-1].columns == columns
    kept = [{r["doc_id"]: r["text"] for r in f.collect()} for f in frames[:-1]]
    last = {}
    for i, t in kept[1].items():
        last[t] = max(last.get(t, i), i)
    assert kept[2] == {i: t for t, i in last.items()}
    ids = list(kept[2])
    roots = brute.component_ids(ids, [brute.fingerprint(kept[2][i]) for i in ids])
    assert kept[3].keys() == set(roots)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hit = brute.hits(list(kept[3].values()), items)
    assert kept[4].keys() == {i for i, (_, places, _) in zip(kept[3], hit) if not places}
    assert {r["doc_id"] for r in frames[5].collect()} == kept[4].keys()
    packed = corpus_pipeline.run(spark, SMALL)
    assert Counter(map(tuple, packed.drop("sequence_id", "offset").collect())) == Counter(
        map(tuple, frames[5].drop("sequence_id", "offset").collect())
    )
    scores = {r["doc_id"]: r["predicted"] for r in op10_quality(spark, SMALL).collect()}
    assert kept[1].keys() == {i for i, p in scores.items() if p}


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_of_odd_documents(spark, odd_documents, empty):
    frame = odd_documents.limit(0) if empty else odd_documents
    for name, stage in corpus_pipeline.STAGES:
        path = new_scratch_path(spark, "stage")
        stage(spark, frame, SMALL).write.parquet(path)
        frame = spark.read.parquet(path)
    assert (frame.count() == 0) == empty


def test_chunks_keep_every_text():
    from footfall.llm.decontaminate import chunks

    texts = ["a" * n for n in (0, 5, 0, 900, 3, 3000, 1, 0)] + [None]
    for sliced in (pa.array(texts), pa.array(["x", *texts]).slice(1)):
        back = []
        for data, offsets in chunks(sliced, 1000):
            back += [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])]
        assert back == [t or "" for t in texts]
    assert simhash.fingerprint("") == 0
