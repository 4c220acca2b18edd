"""The operators on the test tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from footfall.llm import (
    conversation_repair, decontaminate, exact_dedup, line_dedup, packing, pii, prefix_trie, quality, secret_scan, sharding,
    simhash, spans, url_filter, warc,
)
from footfall.llm.common import streamed_digests, table
from footfall.session import materialize, new_scratch_path

VOCABULARY = "byte_bpe_50k.json"
SHARDS = 16


def vocabulary_file(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.with_hits(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]
    )
    hit = F.aggregate("hits.runs", F.lit(0).cast("long"), lambda n, r: n + r["after"] - r["first"])
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        _sha256(F.array_join(F.array_sort("hits.items"), ",")).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[spans.count_of(F.col("strict"), k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)],
        _sha256(spans.written(F.col("strict"), pii.KINDS)).alias("base_sha256"),
        spans.written(F.col("redact"), pii.KINDS).alias("spans"),
        F.size("redact").cast("long").alias("n_spans"),
        (F.size("redact") > 0).alias("has_personal_data"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).withColumn("fingerprint", simhash.as_hex())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", _sha256(F.col("kept")).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(
        table(spark, sf_dir, "documents"), owner=F.col("source"), repository=F.concat_ws("/", "source", "lang")
    )
    strict = F.filter("found", lambda s: s["kind"] < secret_scan.STRICT_KINDS)
    live = F.filter("found", lambda s: s["live"])
    return found.select(
        "doc_id",
        *[
            spans.count_of(F.col("found"), k).alias(f"n_{name}")
            for k, name in enumerate(secret_scan.KINDS[: secret_scan.STRICT_KINDS])
        ],
        _sha256(spans.written(strict, secret_scan.KINDS)).alias("base_sha256"),
        spans.written(F.col("found"), secret_scan.KINDS).alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        spans.written(live, secret_scan.KINDS).alias("live_spans"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS, grown=SHARDS + 1)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"), new_scratch_path(spark, "warc"))
    return warc.record_facts(warc.read_records(spark, archive))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_file())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.with_scores(docs, model, keep=["doc_id"]).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations, a quarter of them damaged by their CRC-32."""

    def shown(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    return (
        conversations.withColumn("kind", kind)
        .where(F.col("kind") != 0)
        .select(
            "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"),
            F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.repair(damaged(rows), conversations=rows)
    lines = found.repaired.select("conv_id", "pos", "nth", F.concat_ws(":", "role", "text").alias("line"))
    hashes = streamed_digests(lines, ["conv_id"], ["pos", "nth"], "line", "\n", "repaired_sha256").withColumnRenamed("conv_id", "_id")
    return found.summary.join(hashes, F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(
        *found.summary.columns, F.coalesce("repaired_sha256", _sha256(F.lit(""))).alias("repaired_sha256")
    )


def rebuilt(tokens: DataFrame) -> DataFrame:
    """Turns of conversations that begin like the one whose id is rounded down to twenties."""
    ids = tokens.select(F.col("conv_id").alias("_id")).distinct()
    shown = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    turn = F.struct("pos", "token", "words")
    heads = (
        tokens.where((F.col("pos") < 3) & (F.col("conv_id") % 20 == 0))
        .groupBy(F.col("conv_id").alias("_base"))
        .agg(F.array_sort(F.collect_list(turn)).alias("head"))
    )
    share = (
        ids.withColumn("h", (F.crc32(shown.cast("binary")) % 4).cast("int"))
        .join(heads, F.col("_id") - F.col("_id") % 20 == F.col("_base"), "left")
        .select("_id", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,token:binary,words:bigint>>")), F.lit(1), F.col("h")).alias("head"))
    )
    shared = share.select(F.col("_id").alias("conv_id"), F.inline("head"))
    own = (
        tokens.join(share.select("_id", "h", F.size("head").alias("n")), F.col("conv_id").eqNullSafe(F.col("_id")))
        .where(F.col("pos") >= F.col("h"))
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "token", "words")
    )
    return shared.unionByName(own)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = prefix_trie.prefix_trie(rebuilt(prefix_trie.as_tokens(rows)), rows.select("conv_id"))
    nodes = materialize(found.nodes, "trie")
    # Ids are joined by runs first, so that a node where very many conversations end is a few pieces.
    runs = found.ends.groupBy("end", F.expr("conv_id div 4096").alias("run")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    pieces = runs.select("end", "run", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids")).where("ids != ''")
    hashes = streamed_digests(pieces, ["end"], ["run"], "ids", ",", "ends_sha256").withColumnRenamed("end", "_end")
    return nodes.join(hashes, F.col("end") == F.col("_end"), "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", _sha256(F.lit(""))).alias("ends_sha256"),
    )


URL_RULES = [
    url_filter.Rule("org", "/", "allow"), url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"), url_filter.Rule("com", "/fr/", "allow"), url_filter.Rule("com", "/de/", "block"),
]


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url, bad`` for the pages that show a labelled document: the number that ends the path
    names it, and a document of low quality or with toxic text is bad."""
    path = url_filter.host_and_path(F.col("url"))[1]
    number = F.regexp_extract(path, r"/([0-9]+)(?:\.html)?/?$", 1).try_cast("bigint")
    shown = pages.select("url", number.alias("_doc"))
    bad = F.greatest(F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0), F.when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 0))
    return shown.join(labels.select(F.col("doc_id").alias("_id"), bad.alias("bad")), F.col("_doc") == F.col("_id")).select("url", "bad")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = page_outcomes(pages, table(spark, sf_dir, "labels"))
    return url_filter.judge(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES = [
    op1_decontamination, op2_personal_data, op3_simhash, op4_line_dedup, op5_exact_dedup, op6_secrets, op7_sharding,
    op8_warc, op9_packing, op10_quality, op11_conversation_repair,
    op12_prefix_trie, op13_url_filter,
]

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# CRC-32 of a string of ASCII characters, bit by bit.
_CRC32 = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), "
    "lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), CAST(4294967295 AS BIGINT))"
)

_USER, _ASSISTANT = "'user'", "'assistant'"


def _moved(state: str, cost: int | str, edit: str, role: str | None = None, text: str = "''") -> str:
    """SQL of a state after an edit: cost, letters, and lines; NULL if the state is."""
    line = f" || chr(10) || {role} || ':' || {text}" if role else ""
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 't': {state}.t || '{edit}', 'l': {state}.l{line}}} END"


ORACLE_SQL = {
    "op1_decontamination": rf"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
sizes AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, sizes WHERE len(w) >= k)),
hits AS (SELECT d.doc_id, d.k, d.i, t.item_id FROM doc_windows d JOIN item_windows t ON d.k = t.k AND d.win = t.win),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(x.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(x.items, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words w LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items x USING (doc_id)
""",
    "op4_line_dedup": rf"""
WITH pieces AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, i, ls[i] AS line,
    {_LOWER.format("trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM pieces)),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.doc_id, l.i, l.line, s.key IS NOT NULL AND l.doc_id <> s.keeper AS gone
  FROM lines l LEFT JOIN shared s ON l.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op8_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM p
""",
    "op13_url_filter": rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, {_LOWER.format("host")} AS host, substr(rest, length(host) + 1) AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/]*') AS host FROM cut)),
rules(h, prefix, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
ruled AS (
  SELECT page_id, arg_max(h || prefix, length(h || prefix)) AS rule, arg_max(verdict, length(h || prefix)) AS verdict
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, prefix) GROUP BY page_id),
outcomes AS (
  SELECT host, greatest(CAST(quality = 0 AS INT), CAST(toxic = 1 AS INT)) AS bad
  FROM p JOIN labels ON try_cast(nullif(regexp_extract(path, '/([0-9]+)(\.html)?/?$', 1), '') AS BIGINT) = doc_id),
hosts AS (
  SELECT host, regexp_extract(bare, '[^.]*$') AS suffix, regexp_extract(bare, '([^.]*\.)?[^.]*$') AS domain,
    count(bad) AS n, coalesce(sum(bad), 0) AS bad
  FROM (SELECT DISTINCT host, regexp_extract(host, '^[^:]*') AS bare FROM p) LEFT JOIN outcomes USING (host) GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
suffix_prior AS (SELECT *, (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0.5) FROM suffixes) AS prior FROM suffixes),
suffix_strength AS (
  SELECT least(greatest(coalesce(CASE WHEN spread - plain <= 0 THEN 1e4 ELSE more / (spread - plain) - 1 END, 1e4), 1.0), 1e4) AS s
  FROM (SELECT sum(n * (bad / n - prior) ^ 2) AS spread, sum(prior * (1 - prior)) AS plain, sum(prior * (1 - prior) * (n - 1)) AS more FROM suffix_prior WHERE n > 0)),
domain_prior AS (
  SELECT d.*, (x.bad + s * x.prior) / (x.n + s) AS prior FROM domains d JOIN suffix_prior x USING (suffix), suffix_strength),
domain_strength AS (
  SELECT least(greatest(coalesce(CASE WHEN spread - plain <= 0 THEN 1e4 ELSE more / (spread - plain) - 1 END, 1e4), 1.0), 1e4) AS s
  FROM (SELECT sum(n * (bad / n - prior) ^ 2) AS spread, sum(prior * (1 - prior)) AS plain, sum(prior * (1 - prior) * (n - 1)) AS more FROM domain_prior WHERE n > 0)),
host_prior AS (
  SELECT h.*, (x.bad + s * x.prior) / (x.n + s) AS prior FROM hosts h JOIN domain_prior x USING (domain, suffix), domain_strength),
host_strength AS (
  SELECT least(greatest(coalesce(CASE WHEN spread - plain <= 0 THEN 1e4 ELSE more / (spread - plain) - 1 END, 1e4), 1.0), 1e4) AS s
  FROM (SELECT sum(n * (bad / n - prior) ^ 2) AS spread, sum(prior * (1 - prior)) AS plain, sum(prior * (1 - prior) * (n - 1)) AS more FROM host_prior WHERE n > 0)),
posterior AS (SELECT host, bad + s * prior AS a, n - bad + s * (1 - prior) AS b FROM host_prior, host_strength)
SELECT page_id, host, path, rule,
  coalesce(ruled.verdict, CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) ^ 2 * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN ruled USING (page_id) LEFT JOIN posterior USING (host)
""",
    "op11_conversation_repair": rf"""
WITH RECURSIVE shown AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC32.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM shown WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy) AS pos,
    trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM damaged),
marked AS (
  SELECT *, left(role, 1) AS initial, bare = '' AS blank,
    bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS duplicate,
    right(bare, 1) NOT IN ('.', '!', '?') AS cut,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair
  FROM placed),
ruled AS (
  SELECT *, blank OR duplicate AS doomed, CASE WHEN cut AND NOT blank AND NOT duplicate THEN 5 ELSE 0 END AS extra FROM marked),
solved AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, {{'c': 0, 't': '', 'l': ''}} AS s0, CAST(NULL AS STRUCT(c INTEGER, t VARCHAR, l VARCHAR)) AS s1,
    CAST(NULL AS STRUCT(c INTEGER, t VARCHAR, l VARCHAR)) AS s2, CAST(NULL AS STRUCT(c INTEGER, t VARCHAR, l VARCHAR)) AS s3
  FROM (SELECT DISTINCT conv_id FROM placed)
  UNION ALL
  SELECT conv_id, pos,
    list_min([{_moved("e0", 2, "D")}]),
    list_min([{_moved("e1", 2, "D")}, CASE WHEN NOT doomed AND initial = 's' THEN {_moved("e0", "extra", "K", "role", "text")} END]),
    list_min([{_moved("e2", 2, "D")}, {", ".join(f"CASE WHEN NOT doomed AND initial = 'u' THEN {_moved(e, 'extra', 'K', 'role', 'text')} END, CASE WHEN NOT doomed THEN {_moved(e, '1 + extra', 'R', _USER, 'text')} END" for e in ("e0", "e1", "e3"))}]),
    list_min([{_moved("e3", 2, "D")}, CASE WHEN NOT doomed AND initial = 'a' THEN {_moved("e2", "extra", "K", "role", "text")} END,
      CASE WHEN NOT doomed THEN {_moved("e2", "1 + extra", "R", _ASSISTANT, "text")} END])
  FROM (
    SELECT *, list_min([s3, {_moved("e2", 5, "I", _ASSISTANT, "''")}]) AS e3
    FROM (
      SELECT r.conv_id, r.pos, role, text, initial, doomed, extra, s3, s0 AS e0, s1 AS e1,
        list_min([s2, {", ".join(_moved(f"s{i}", 5, "I", _USER, "''") for i in (0, 1, 3))}]) AS e2
      FROM solved s JOIN ruled r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.pos = s.pos + 1))),
ended AS (
  SELECT conv_id, list_min([s0, s3, {_moved("e2", 5, "I", _ASSISTANT, "''")}]) AS best
  FROM (
    SELECT conv_id, s0, s3, list_min([s2, {", ".join(_moved(f"s{i}", 5, "I", _USER, "''") for i in (0, 1, 3))}]) AS e2
    FROM solved QUALIFY pos = max(pos) OVER (PARTITION BY conv_id))),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (extra = 5) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ruled GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost,
  coalesce(best.t, '') AS audit, sha256(coalesce(substr(best.l, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM i.conv_id
""",
    "op12_prefix_trie": rf"""
WITH t AS (
  SELECT conv_id AS c, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS token,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
  FROM conversations),
ids AS (SELECT c, {_CRC32.format("CAST(c AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
heads AS (SELECT i.c, t.pos, token, words FROM ids i JOIN t ON t.c = i.c - i.c % 20 AND t.pos < i.h),
sizes AS (SELECT c, h, (SELECT count(*) FROM heads WHERE heads.c = ids.c) AS n FROM ids),
seq AS (
  SELECT * FROM heads UNION ALL
  SELECT t.c, t.pos - h + n, token, words FROM t JOIN sizes USING (c) WHERE t.pos >= h),
lists AS (
  SELECT c, coalesce(list(token ORDER BY pos) FILTER (pos IS NOT NULL), []) AS s, coalesce(list(words ORDER BY pos) FILTER (pos IS NOT NULL), []) AS w
  FROM ids LEFT JOIN seq USING (c) GROUP BY c),
members AS (
  SELECT c, d, array_to_string(list_slice(s, 1, d), '') AS key, coalesce(w[d], 0) AS words, d = len(s) AS ends
  FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM lists)),
nodes AS (
  SELECT d, key, min(c) AS conv_id, count(*) AS n, any_value(words) AS words,
    coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ends
  FROM members GROUP BY d, key),
children AS (SELECT left(key, CAST(64 * (d - 1) AS BIGINT)) AS key, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
spread AS (
  SELECT left(key, CAST(64 * up AS BIGINT)) AS key, up AS d, sum((n - 1) * words) AS saved, count(*) FILTER (leaf) AS leaves
  FROM (
    SELECT n.key, n.n, n.words, c.key IS NULL AS leaf, unnest(range(0, n.d + 1)) AS up
    FROM nodes n LEFT JOIN children c ON c.key = n.key AND c.d = n.d)
  GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c.n_children, 0) AS n_children,
  s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN spread s ON s.key = n.key AND s.d = n.d LEFT JOIN children c ON c.key = n.key AND c.d = n.d
LEFT JOIN nodes p ON p.d = n.d - 1 AND p.key = left(n.key, CAST(64 * greatest(n.d - 1, 0) AS BIGINT))
""",
}
