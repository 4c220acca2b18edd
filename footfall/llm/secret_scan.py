"""Secrets, told from examples by how many owners have them.

A credential of somebody is found with one owner; what documentation and templates copy is
found with many.  So candidates are hashed, counted by distinct repository and owner over
the whole corpus, and judged by that and by their form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm import spans
from footfall.llm.common import let, text_or_empty
from footfall.session import materialize

KINDS = ["assign", "access", "hex", "token", "key"]
_WORDS = "password|passwd|secret|token|api_?key"
_VALUE = "A-Za-z0-9+/_.=-"
ASSIGN = rf"(?:(?i){_WORDS})[\"']?+\x20*+[:=]\x20*+[\"']?+[{_VALUE}]++"
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
# Besides: long runs of token characters, and blocks of private keys.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
# These may begin with header lines, such as Proc-Type and DEK-Info, and an empty line.
KEY = (
    r"-----BEGIN\x20(?:[A-Z0-9]++\x20)*?PRIVATE\x20KEY-----"
    r"(?:\s*+[A-Za-z0-9-]++:[^\n]*+\n)*+[A-Za-z0-9+/=\s]++-----END\x20"
)

# A value with more owners, or more repositories, is an example that was copied.
MOST_OWNERS = 2
MOST_REPOSITORIES = 3
MIN_ENTROPY = 3.0


def value_of(match: Column) -> Column:
    """What an assignment assigns: what follows the first : or = after the word."""
    return F.regexp_extract(match, rf"^(?:(?i){_WORDS})[\"']?+\x20*+[:=]\x20*+[\"']?+([{_VALUE}]++)$", 1)


def entropy(value: Column) -> Column:
    """Bits per character, from the counts of its distinct characters."""
    size = F.length(value).cast("double")
    letters = F.array_distinct(F.split(value, ""))

    def bits(c: Column) -> Column:
        share = (size - F.length(F.replace(value, c, F.lit("")))) / size
        return F.when(share > 0, -share * F.log2(share)).otherwise(0.0)

    return F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0.0), lambda total, c: total + bits(c))


def looks_live(value: Column) -> Column:
    """Varied like a random string: letters and digits, and hardly any repetition."""
    return F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]")) & (entropy(value) >= MIN_ENTROPY)


def assignments(text: Column) -> Column:
    """``(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)``,
    the word in either case, the value of 12 characters or more."""
    return F.filter(spans.find(text, ASSIGN), lambda s: F.length(value_of(s["text"])) >= 12)


def access_keys(text: Column) -> Column:
    """``AKIA[A-Z0-9]+`` of 18 characters or more."""
    return F.filter(spans.find(text, ACCESS, needs="AKIA"), lambda s: F.length(s["text"]) >= 18)


def hex_strings(text: Column) -> Column:
    """``[0-9a-f]+`` of 16 characters or more."""
    return spans.find(text, HEX)


def tokens(text: Column) -> Column:
    return F.filter(spans.find(text, TOKEN), lambda s: looks_live(s["text"]))


def private_keys(text: Column) -> Column:
    return spans.find(text, KEY, needs="PRIVATE KEY")


GENERATORS = [
    ("assign", assignments), ("access", access_keys), ("hex", hex_strings), ("token", tokens), ("key", private_keys),
]
STRICT_KINDS = 3


def candidates(text: Column) -> Column:
    """``start, kind, end, hash, live`` of all generators, by start, then kind."""

    def named(found: Column, kind: int, name: str) -> Column:
        certain = name in ("access", "key")
        return F.transform(
            found,
            lambda s: let(
                value_of(s["text"]) if name == "assign" else s["text"],
                lambda value: F.struct(
                    s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"),
                    F.unhex(F.md5(value)).alias("hash"),
                    (F.lit(True) if certain else looks_live(value)).alias("live"),
                ),
            ),
        )

    parts = [named(generate(text), kind, name) for kind, (name, generate) in enumerate(GENERATORS)]
    return F.array_sort(F.concat(*parts))


def scan_secrets(
    docs: DataFrame, owner: Column, repository: Column, doc_id: str = "doc_id", text: str = "text",
    most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES,
) -> DataFrame:
    """``doc_id, found`` per row; ``found`` has ``start, kind, end, owners, repositories, live``.

    ``kind`` is a place in KINDS.  ``live``: varied like a real secret, and with at most
    ``most_owners`` owners and ``most_repositories`` repositories in the whole corpus; others
    are widely copied examples or plain words.  Spans of the three strict kinds are always
    listed; of the others those that are live and not within a strict span.  A NULL text is
    empty; a NULL owner or repository counts as one of its own.
    """
    rows = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
            F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
            candidates(text_or_empty(text)).alias("found"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "secrets",
    )
    each = rows.select("row", "owner", "repository", F.explode("found").alias("s")).select("row", "owner", "repository", "s.*")
    # Combined per hash, owner and repository first, so a value that is everywhere shrinks where it is read.
    held = each.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    counted = materialize(
        held.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.count(F.lit(1)).alias("repositories")),
        "owners",
    )
    strict = F.col("kind") < STRICT_KINDS
    judged = (
        each.join(counted, "hash")
        .withColumn("live", F.col("live") & (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories))
        .where(strict | F.col("live"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories", "live"))).alias("spans"))
    )

    def alone(s: Column, all_spans: Column) -> Column:
        inside = F.exists(
            all_spans,
            lambda b: (b["kind"] < STRICT_KINDS) & (b["start"] <= s["start"]) & (b["end"] >= s["end"]),
        )
        return (s["kind"] < STRICT_KINDS) | ~inside

    nothing = F.array().cast("array<struct<start:int,kind:int,end:int,owners:bigint,repositories:bigint,live:boolean>>")
    found = let(F.coalesce("spans", nothing), lambda all_spans: F.filter(all_spans, lambda s: alone(s, all_spans)))
    return rows.select("row", "doc_id").join(judged, "row", "left").select(F.col("doc_id").alias(doc_id), found.alias("found"))
