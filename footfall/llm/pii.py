"""Personal data by candidate gradient boosting.

Generators propose spans, generously and overlapping: every stretch of digit groups with as
many digits as a card or a phone number may have, whatever stands beside it, and loose forms of
the other kinds.  Boosted trees score each by its form and its surroundings; a threshold
calibrated on documents kept from training decides, and of proposals that overlap the best one
stays.  The strict patterns are found besides and always stay.  What the trees learn from are
strict matches as they are, and disguised so that no strict pattern fits them any more.
DataFrame functions and Spark's own trees only.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm import spans
from footfall.llm.common import let, quoted, text_or_empty
from footfall.session import materialize

KINDS = ["email", "ip", "card", "phone"]

# Strict patterns; a match starts where no earlier start could reach.
_LOCAL = r"A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Generous ones: addresses with other letters or spelled-out signs, addresses of four or more
# groups with other separators; numbers are put together from groups of digits.
LOOSE_EMAIL = r"(?<![^\s<>(),;:\"@\[\]])[^\s<>(),;:\"@\[\]]++(?:@|\x20?[(\[]at[)\]]\x20?)[^\s<>(),;:\"@\[\]]++"
LOOSE_ADDRESS = r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}+(?:(?:\[\.\]|[:.])[0-9A-Fa-f]{1,4}+){3,7}+"
DIGITS = r"[0-9]++"
# What may stand between the groups of one number.
SEPARATOR = r"^[\x20()./_+-]{1,3}$"
FEWEST_DIGITS, MOST_DIGITS = 9, 19  # of a phone number and of a card
CARD_DIGITS, PHONE_DIGITS = (12, 19), (9, 15)

CUES = {
    "email": r"(?i)mail|contact|write",
    "ip": r"(?i)\bip\b|addr|host|server|client|from",
    "card": r"(?i)card|visa|master|amex|pay|credit",
    "phone": r"(?i)phone|tel|call|mobile|cell|fax",
    "other": r"(?i)order|invoice|isbn|issn|page|vol|no\.|#|id\b|version",
}

LEADS = ["", "", "", "write to ", "mail: ", "call ", "from ", "host ", "card ", "paid by ", "tel. ", "the ", "is (", "order ", "id "]

# Of every strict match.
DRAWS = 16
MATCHES_A_TASK = 500
TREES, DEPTH = 14, 4
FOLDS = 4
# Of accepted candidates, before the best of those that overlap is chosen, which raises it.
PRECISION = 0.9
# Thresholds are whole multiples of 1 / STEPS: margins are counted by these.
STEPS = 1024


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = digit * 2
        return F.when(i % 2 == 0, digit).otherwise(doubled - F.when(doubled > 9, 9).otherwise(0))

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda total, i: total + worth(i))


def luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits holds."""
    return (F.length(digits) > 0) & (_luhn_sum(digits) % 10 == 0)


def _in_range(part: Column) -> Column:
    short = F.ltrim(part, F.lit("0"))
    return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))


def emails(text: Column) -> Column:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``"""
    return spans.find(text, EMAIL, needs="@")


def ips(text: Column) -> Column:
    """``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with no part above 255."""
    return F.filter(spans.find(text, IP), lambda s: F.forall(F.split(s["text"], r"\."), _in_range))


def cards(text: Column) -> Column:
    """``[0-9]([\\x20-]?[0-9])+`` of 12 to 19 digits that pass Luhn."""
    return F.filter(
        spans.find(text, CARD),
        lambda s: F.length(s["text"]).between(12, 37)
        & let(_digits(s["text"]), lambda d: F.length(d).between(12, 19) & luhn(d)),
    )


def phones(text: Column) -> Column:
    """``\\+[0-9][\\x20().0-9-]+[0-9]`` of 9 to 15 digits."""
    return F.filter(spans.find(text, PHONE, needs="+"), lambda s: F.length(_digits(s["text"])).between(9, 15))


STRICT = [("email", emails), ("ip", ips), ("card", cards), ("phone", phones)]


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _count(text: Column, others: str) -> Column:
    """How many characters of ``text`` are not in the class ``others``."""
    return F.length(F.regexp_replace(text, others, ""))


def _surroundings(before: Column, after: Column) -> list[Column]:
    return [
        _flag(F.rlike(before, F.lit(r"[A-Za-z0-9]$"))),
        _flag(F.rlike(after, F.lit(r"^[A-Za-z0-9]"))),
        _flag(F.rlike(before, F.lit(r"[$€£#.,:]\x20?$"))),
        _flag(F.rlike(after, F.lit(r"^\x20?[%$€£]"))),
        *[_flag(F.rlike(before, F.lit(cue))) for cue in CUES.values()],
    ]


# Of numbers and of the other kinds; each has zeros in the place of the other's features.
_NUMBER_FEATURES, _TEXT_FEATURES = 17, 11


def _vector(kind: Column, number: list[Column] | None, text: list[Column] | None, around: list[Column]) -> Column:
    zeros = [F.lit(0)]
    values = [kind, *(number or zeros * _NUMBER_FEATURES), *(text or zeros * _TEXT_FEATURES), *around]
    return F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])


def _text_features(text: Column) -> list[Column]:
    digits = _digits(text)
    groups = F.filter(F.split(text, "[^0-9]+", -1), lambda g: g != "")
    return [
        F.length(text), F.length(digits), _count(text, "[^A-Za-z]"), _count(text, r"[\x00-\x7F]"), _count(text, "[^.]"),
        _count(text, r"[^\x20]"), _count(text, r"[^():\[\]_/-]"), _flag(F.contains(text, F.lit("@"))),
        _flag(F.rlike(text, F.lit(r"\.[A-Za-z]{2,}$"))), F.size(groups), F.size(F.filter(groups, _in_range)),
    ]


def _proposal(kind: Column, start: Column, end: Column, alike: Column, features: Column) -> Column:
    """``alike``: it looks so much like its kind that it is no example of anything else."""
    return F.struct(
        kind.cast("int").alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"),
        alike.alias("alike"), features.alias("features"),
    )


def _numbers(text: Column) -> Column:
    """Proposals of cards and phone numbers: from every group of digits on, each stretch of
    groups with as many digits as fit.  A group begins at most MOST_DIGITS stretches."""

    def numbers(groups: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(groups)), lambda i: beginning(groups, i)))

    def beginning(groups: Column, i: Column) -> Column:
        def step(state: Column, g: Column) -> Column:
            joined = (state["n"] == 0) | ((g["start"] - state["end"] <= 3) & F.rlike(g["before"], F.lit(SEPARATOR)))
            digits = state["digits"] + F.length(g["text"])
            goes_on = state["on"] & joined & (digits <= MOST_DIGITS)
            n = state["n"] + 1
            fits = goes_on & (digits >= FEWEST_DIGITS)
            return F.struct(
                goes_on.alias("on"), n.alias("n"), digits.alias("digits"), g["end"].alias("end"),
                F.when(fits, F.concat(state["found"], F.array(n))).otherwise(state["found"]).alias("found"),
            )

        begin = F.struct(
            F.lit(True).alias("on"), F.lit(0).alias("n"), F.lit(0).alias("digits"), F.lit(0).alias("end"),
            F.array().cast("array<int>").alias("found"),
        )
        counts = F.aggregate(F.slice(groups, i, F.lit(MOST_DIGITS)), begin, step, lambda state: state["found"])
        return F.flatten(F.transform(counts, lambda n: let(F.slice(groups, i, n), lambda own: stretch(groups, i, n, own))))

    def stretch(groups: Column, i: Column, n: Column, own: Column) -> Column:
        first, last, after = own[0], F.element_at(own, -1), F.get(groups, i + n - 1)
        before = F.get(groups, i - 2)
        digits = F.array_join(F.transform(own, lambda g: g["text"]), "")
        gaps = F.transform(F.slice(own, F.lit(2), F.size(own)), lambda g: g["before"])
        sizes = F.transform(own, lambda g: F.length(g["text"]))
        sign = F.regexp_extract(first["before"], r"[+(]{1,2}$", 0)
        near = F.lit(SEPARATOR)

        def described(digits: Column, between: Column) -> Column:
            number = F.length(digits)
            valid = luhn(digits)
            features = [
                last["end"] - first["start"], number, n, F.array_max(sizes), F.array_min(sizes), sizes[0], F.element_at(sizes, -1),
                _count(between, r"[^\x20]"), _count(between, "[^-]"), _count(between, "[^.]"), _count(between, "[^()]"), _count(between, "[^/_+]"),
                F.size(F.array_distinct(gaps)), _flag(F.contains(sign, F.lit("+"))), _flag(valid),
                _flag((first["start"] - before["end"] <= 3) & F.rlike(first["before"], near)),
                _flag((after["start"] - last["end"] <= 3) & F.rlike(after["before"], near)),
            ]
            around = _surroundings(first["before"], last["after"])
            card = _proposal(F.lit(2), first["start"], last["end"], valid, _vector(F.lit(2), features, None, around))
            spoken = (sign != "") | F.contains(between, F.lit("(")) | F.rlike(first["before"], F.lit(CUES["phone"])) | ((n >= 3) & (F.array_max(sizes) <= 4))
            phone = _proposal(F.lit(3), first["start"] - F.length(sign), last["end"], spoken, _vector(F.lit(3), features, None, around))
            return F.concat(
                F.when(number.between(*CARD_DIGITS), F.array(card)).otherwise(F.array().cast(_PROPOSALS)),
                F.when(number.between(*PHONE_DIGITS), F.array(phone)).otherwise(F.array().cast(_PROPOSALS)),
            )

        return let(digits, lambda d: let(F.array_join(gaps, ""), lambda between: described(d, between)))

    found = spans.find(text, DIGITS)
    return let(found, lambda g: F.when(F.size(g) > 0, numbers(g)).otherwise(F.array().cast(_PROPOSALS)))


_PROPOSALS = "array<struct<kind:int,start:int,end:int,alike:boolean,features:array<double>>>"


# Signs at the ends of what a loose pattern finds are not part of it.
SIGNS = r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E"


def _texts(found: Column, kind: int, alike: Callable[[Column], Column]) -> Column:
    """Proposals of other kinds."""

    def one(s: Column) -> Column:
        left = F.length(F.regexp_extract(s["text"], f"^[{SIGNS}]*+", 0))
        right = F.length(F.regexp_extract(s["text"], f"(?<![{SIGNS}])[{SIGNS}]*+$", 0))
        return let(
            F.struct(left.alias("left"), right.alias("right")),
            lambda cut: let(F.substr(s["text"], cut["left"] + 1, F.length(s["text"]) - cut["left"] - cut["right"]), lambda t: made(s, cut, t)),
        )

    def made(s: Column, cut: Column, t: Column) -> Column:
        around = _surroundings(s["before"], s["after"])
        return _proposal(F.lit(kind), s["start"] + cut["left"], s["end"] - cut["right"], alike(t), _vector(F.lit(kind), None, _text_features(t), around))

    return F.transform(found, one)


def candidates(text: Column) -> Column:
    """Proposals of all generators: ``kind, start, end, alike, features``."""

    def address(t: Column) -> Column:
        parts = F.filter(F.split(t, "[^0-9]+", -1), lambda g: g != "")
        return (F.size(parts) == 4) & F.forall(parts, _in_range)

    return F.concat(
        _texts(spans.find(text, LOOSE_EMAIL), 0, lambda t: F.contains(t, F.lit("@")) | F.rlike(t, F.lit(r"\.[A-Za-z]{2,}$"))),
        _texts(spans.find(text, LOOSE_ADDRESS), 1, address),
        _numbers(text),
    )


def _found(text: Column) -> Column:
    """Strict matches of all kinds with their surroundings, by start, then kind's place."""

    def named(found: Column, kind: int) -> Column:
        return F.transform(
            found,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["text"].alias("text"),
                s["before"].alias("before"), s["after"].alias("after"),
            ),
        )

    return F.array_sort(F.concat(*[named(find_kind(text), kind) for kind, (_, find_kind) in enumerate(STRICT)]))


def propose(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, strict, matches, candidates``: strict spans, the same with their texts and
    surroundings, and proposals with features and labels.

    A candidate's label is 1 if it is a strict span of its kind, 0 if it overlaps one but is not
    it, or if it overlaps none and does not look like its kind; NULL otherwise: it may be one
    in disguise.
    """
    found = docs.select(F.col(quoted(doc_id)).alias("doc_id"), text_or_empty(text).alias("_text")).select(
        "doc_id", _found(F.col("_text")).alias("matches"), candidates(F.col("_text")).alias("found")
    )

    # Compared with the strict spans of the text; both are few where texts are prose.
    def label(c: Column) -> Column:
        overlapping = F.filter("matches", lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"]))
        return let(
            overlapping,
            lambda o: F.when(
                F.exists(o, lambda s: (s["kind"] == c["kind"]) & (s["start"] == c["start"]) & (s["end"] == c["end"])), 1
            ).when((F.size(o) > 0) | ~c["alike"], 0),
        )

    labelled = F.transform(
        "found",
        lambda c: F.struct(
            c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), label(c).alias("label"), c["features"].alias("features")
        ),
    )
    strict = F.transform("matches", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select("doc_id", strict.alias("strict"), "matches", labelled.alias("candidates"))


def disguised(kind: Column, text: Column, draw: Column) -> tuple[Column, Column, Column]:
    """What comes before, the value and what comes behind it when a strict match is disguised.

    ``draw`` is a LONG that picks one of four ways: other separators or spelled-out signs, or
    another number close by.  No strict pattern finds the value in these.
    """
    # Cards of other lengths too, with the check digit that they need.
    body = F.left(_digits(text), F.lit(15) - F.pmod(F.shiftrightunsigned(draw, 2), F.lit(4)).cast("int"))
    digits = F.concat(body, (F.pmod(-_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10))).cast("string"))
    way = F.pmod(draw, F.lit(4))
    other = F.rpad(F.translate(F.abs(draw).cast("string"), "-", ""), 16, "7")
    in_fours = F.rtrim(F.regexp_replace(digits, "(.{4})", "$1_"), F.lit("_"))

    def by_way(*values: Column) -> Column:
        return F.when(way == 0, values[0]).when(way == 1, values[1]).when(way == 2, values[2]).otherwise(values[3])

    at = by_way(F.lit("(at)"), F.lit(" [at] "), F.lit("[at]"), F.lit("(at)"))
    card = by_way(F.translate(in_fours, "_", "."), F.regexp_replace(in_fours, "_", "  "), digits, digits)
    phone = by_way(F.translate(text, "+", ""), F.translate(text, " ()-", "////"), text, F.translate(text, "-", "_"))
    address = by_way(*[F.regexp_replace(text, r"\.", "[.]")] * 4)
    # Addresses without digits, with other names, with a shorter domain, with another end.
    def bit(i: int) -> Column:
        return F.getbit(draw, F.lit(i)) == 1

    plain = F.when(bit(5), F.regexp_replace(text, "[0-9]", "")).otherwise(text)
    letters = F.translate(F.abs(draw).cast("string"), "0123456789", "etaoinshrd")
    named = F.when(bit(6), F.concat(F.left(letters, F.pmod(F.shiftright(draw, 8), F.lit(9)).cast("int") + 2), F.regexp_extract(plain, "[0-9]*@.*", 0))).otherwise(plain)
    short = F.when(bit(7), F.regexp_replace(named, r"@[^.]*\.(?=[^.]+\.)", "@")).otherwise(named)
    ends = F.array(*[F.lit(e) for e in (".com", ".org", ".net", ".info")])
    short = F.concat(F.regexp_replace(short, r"\.[^.@]*$", ""), ends[F.pmod(F.shiftright(draw, 12), F.lit(4)).cast("int")])
    value = F.when(kind == 0, F.regexp_replace(short, "@", at)).when(kind == 1, address).when(kind == 2, card).otherwise(phone)
    number = F.when((kind == 2) & (way == 3), F.concat(other, F.lit(" "))).otherwise("")
    behind = F.when((kind >= 2) & (way == 2), F.concat(F.lit(" "), F.when(kind == 2, other).otherwise("190.137.223.204"))).otherwise("")
    return number, value, behind


@dataclass(frozen=True)
class Boosted:
    """Trees as nested tests, and for every kind the lowest margin at which a span is redacted.

    ``trees`` are (weight, node); a node is a number or (feature, threshold, low, high).
    """

    trees: list[tuple[float, object]]
    thresholds: list[float]

    def accepts(self, kind: Column, margin: Column) -> Column:
        return margin >= F.array(*[F.lit(t) for t in self.thresholds])[kind]

    def margin(self, features: Column) -> Column:
        def node(n) -> Column:
            if isinstance(n, float):
                return F.lit(n)
            feature, threshold, low, high = n
            return F.when(features[feature] <= threshold, node(low)).otherwise(node(high))

        total = F.lit(0.0)
        for weight, root in self.trees:
            total = total + node(root) * weight
        return total


def _node(java_node):
    if java_node.subtreeDepth() == 0:
        return float(java_node.prediction())
    split = java_node.split()
    return (int(split.featureIndex()), float(split.threshold()), _node(java_node.leftChild()), _node(java_node.rightChild()))


def distractors(draw: Column) -> Column:
    """Texts that are no personal data, but may look like it: lists of numbers, times, orders,
    versions, and words with an at sign."""
    digits = F.rpad(F.translate(F.abs(draw).cast("string"), "-", ""), 18, "35")

    def part(first: int, size: int) -> Column:
        return F.substr(digits, F.lit(first), F.lit(size))

    counted = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.pmod(draw, F.lit(80)) + i), " ")
    listed = F.concat_ws(" ", *[part(i, 1 + i % 3) for i in range(1, 14, 2)])
    time = F.concat(F.lit("20"), part(1, 2), F.lit("-0"), part(3, 1), F.lit("-1"), part(4, 1), F.lit(" 1"), part(5, 1), F.lit(":3"), part(6, 1), F.lit(":00."), part(7, 6))
    order = F.concat(F.lit("order no. "), part(1, 10), F.lit(" of "), part(4, 2), F.lit(" items"))
    version = F.concat(F.lit("version "), part(3, 1), F.lit("."), part(5, 2), F.lit("."), part(7, 4), F.lit("-"), part(9, 6))
    name = F.translate(part(2, 5), "0123456789", "abcdefghij")
    clock = F.concat(F.lit("at 1"), part(1, 1), F.lit(":2"), part(2, 1), F.lit(":0"), part(3, 1), F.lit(":"), part(4, 2))
    release = F.concat_ws(".", *[part(i, 1 + i % 4) for i in range(1, 12, 2)])
    handle = F.concat(F.lit("by "), name, F.lit("@"), name)
    meeting = F.concat(name, F.lit(" (at) "), part(1, 1), F.lit(" and "), name, F.lit("[at]"), name)
    return F.array(counted, listed, time, order, version, clock, release, handle, meeting)


def _disguised_candidates(proposed: DataFrame) -> DataFrame:
    """``doc_id, label, values`` of the candidates in all strict matches, each disguised in DRAWS
    ways: 1 for the value itself, 0 for what only overlaps it.  Numbers that are no personal
    data are added in the place of each, as corpora may have none to learn from."""
    order = F.xxhash64("doc_id", "m.start", "m.kind", "m.text")
    matches = materialize(
        proposed.select("doc_id", F.explode("matches").alias("m")).select(
            "doc_id", "m.kind", "m.text", "m.before", "m.after", order.alias("order")
        ),
        "matches",
    )
    # Rows of few bytes, but much work: tasks by their number.
    matches = matches.repartition(max(math.ceil(matches.count() / MATCHES_A_TASK), 1))
    # The lowest two bits of a draw are the way, so that all ways occur alike.
    draw = F.shiftleft(F.xxhash64("order", "nth"), 2).bitwiseOR((F.col("nth") % 4).cast("long"))
    # Whatever words stand before it, a value is one: cues of all kinds come before all of them.
    said = F.array(*[F.lit(w) for w in LEADS])

    def lead(draw: Column) -> Column:
        return said[F.pmod(F.xxhash64(draw), F.lit(len(LEADS))).cast("int")]

    drawn = matches.withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))).withColumn("draw", draw).withColumn(
        "before", F.concat("before", lead(F.col("draw")))
    )
    ahead, value, behind = disguised(F.col("kind"), F.col("text"), F.col("draw"))
    shown = drawn.select(
        "doc_id", F.col("kind").alias("own"), F.concat("before", ahead).alias("ahead"), value.alias("value"), F.concat(behind, F.col("after")).alias("behind")
    ).select(
        "doc_id", "own", F.length("ahead").alias("first"), (F.length("ahead") + F.length("value")).alias("after"),
        F.explode(candidates(F.concat("ahead", "value", "behind"))).alias("c"),
    )
    here = (F.col("c.start") < F.col("after")) & (F.col("c.end") > F.col("first"))
    same = (F.col("c.kind") == F.col("own")) & (F.col("c.start") == F.col("first")) & (F.col("c.end") == F.col("after"))
    found = shown.where(here).select("doc_id", F.when(same, 1.0).otherwise(0.0).alias("label"), F.col("c.features").alias("values"))
    apart = matches.select(
        "doc_id", "before", "after", F.posexplode(distractors(F.col("order"))).alias("nth", "text"), "order"
    ).withColumn("before", F.concat("before", lead(F.xxhash64("order", "nth"))))
    return found.unionByName(
        apart.select("doc_id", F.explode(candidates(F.concat("before", "text", "after"))).alias("c")).select("doc_id", F.lit(0.0).alias("label"), F.col("c.features").alias("values"))
    )


def examples(proposed: DataFrame) -> DataFrame:
    """``held, label, values, n``: all that is learned from and judged by, which is every
    labelled candidate, and every candidate in disguised strict matches.  Alike ones are counted,
    in the task that finds them first; ``held`` ones are of the documents kept from training."""
    plain = (
        proposed.select("doc_id", F.explode("candidates").alias("c"))
        .where(F.col("c.label").isNotNull())
        .select("doc_id", F.col("c.label").cast("double").alias("label"), F.col("c.features").alias("values"))
    )
    held = (F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0).alias("held")
    return (
        plain.unionByName(_disguised_candidates(proposed))
        .groupBy(held, "label", "values")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fit(proposed: DataFrame, precision: float = PRECISION) -> Boosted | None:
    """Learns from all labelled candidates and the candidates in all strict matches, disguised.

    A quarter of the documents is kept from training; a kind's threshold is the lowest margin,
    in steps of 1 / STEPS, above which the share of true candidates there (among all, if no true
    one is there) is at least ``precision``, and without such a margin none of the kind is
    accepted.  None if the candidates are all true or all false, or if no kind has a threshold.
    Where a feature may be split Spark's trees choose by themselves, from 10,000 counted
    candidates if there are more; the trees and the thresholds are made of all.
    """
    found = materialize(examples(proposed), "candidates")
    learn = found.where(~F.col("held"))
    counts = {r["label"]: r["n"] for r in learn.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if len(counts) < 2:
        return None
    # True and false candidates weigh the same in total.
    weight = F.col("n") * F.when(F.col("label") == 1, counts[0.0] / counts[1.0]).otherwise(1.0)
    trees = GBTClassifier(featuresCol="features", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=17, cacheNodeIds=False).fit(
        learn.select("label", weight.alias("weight"), array_to_vector("values").alias("features"))
    )
    model = Boosted(
        [(float(w), _node(t._java_obj.rootNode())) for w, t in zip(trees.treeWeights, trees.trees)], [float("inf")] * len(KINDS)
    )
    # All margins are counted; a margin's step is one of some thousands, as the trees' sums are
    # bounded, whatever the number of candidates.
    step = F.floor(model.margin(F.col("values")) * STEPS).alias("step")
    judged = found.groupBy(F.col("values")[0].cast("int").alias("kind"), "held", step).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("true")
    ).collect()
    thresholds = []
    for k in range(len(KINDS)):
        kept = [r for r in judged if r["kind"] == k and r["held"]]
        if not any(r["true"] for r in kept):
            kept = [r for r in judged if r["kind"] == k]
        steps: dict[int, list[int]] = {}
        for r in kept:
            n, true = steps.get(r["step"], (0, 0))
            steps[r["step"]] = (n + r["n"], true + r["true"])
        thresholds.append(_threshold(steps, precision))
    return None if min(thresholds) == float("inf") else Boosted(model.trees, thresholds)


def _threshold(steps: dict[int, tuple[int, int]], precision: float) -> float:
    """The lowest positive margin from which on at least ``precision`` of the candidates are
    true, or rather half the way from it to the next lower one, or to zero.  ``steps`` are
    margins in steps, with how many candidates have these and how many of them are true."""
    n, true, found = 0, 0, float("inf")
    ordered = sorted(steps, reverse=True)
    for step, following in zip(ordered, [*ordered[1:], -1]):
        n, true = n + steps[step][0], true + steps[step][1]
        if step >= 0 and true >= precision * n:
            # No margin is between the end of the next lower step and the beginning of this.
            found = (step + max(following + 1, 0)) / 2 / STEPS
    return found


# Accepted proposals that one is compared with on either side; a number's stretches overlap
# fewer.  If ever more overlap, further ones stay besides: nothing is lost.
NEIGHBOURS = 64


def _best_of_overlapping(accepted: Column) -> Column:
    """Accepted proposals (``start, kind, end, margin``, in order) without those that overlap
    one with a larger margin; of equal ones the longer stays, then the earlier."""

    def better(a: Column, b: Column) -> Column:
        def rank(x: Column) -> Column:
            return F.struct(x["margin"].alias("m"), (x["end"] - x["start"]).alias("n"), (-x["start"]).alias("s"), (-x["kind"]).alias("k"))

        return (a["start"] < b["end"]) & (a["end"] > b["start"]) & (rank(a) > rank(b))

    return let(
        accepted,
        lambda all_: F.filter(
            all_,
            lambda b, i: ~F.exists(
                F.slice(all_, F.greatest(i - NEIGHBOURS, F.lit(0)) + 1, F.lit(2 * NEIGHBOURS + 1)), lambda a: better(a, b)
            ),
        ),
    )


def find_personal_data(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", precision: float = PRECISION
) -> DataFrame:
    """``doc_id, strict, redact`` per row: strict spans, and all spans to redact.

    Spans are ``start, kind, end`` by start, then kind (its place in KINDS).  ``redact`` adds
    to the strict spans the candidates above the threshold that reach beyond every strict
    span they overlap; of those that overlap each other the one with the largest margin.  A
    NULL text is an empty one; where nothing can be learned, for example because no text has
    a candidate, ``redact`` is ``strict``.  Rows that repeat an id are rows like others.
    """
    proposed = materialize(propose(docs, doc_id, text), "proposed")
    model = fit(proposed, precision)
    if model is None:
        added = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    else:
        scored = F.transform(
            "candidates",
            lambda c: F.struct(
                c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), model.margin(c["features"]).alias("margin")
            ),
        )
        accepted = F.array_sort(
            F.filter(
                scored,
                lambda c: model.accepts(c["kind"], c["margin"])
                & ~F.exists("strict", lambda s: (s["start"] <= c["start"]) & (s["end"] >= c["end"])),
            )
        )
        added = F.transform(
            _best_of_overlapping(accepted),
            lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")),
        )
    return proposed.select(
        F.col("doc_id").alias(doc_id), "strict",
        F.array_sort(F.array_distinct(F.concat("strict", added))).alias("redact"),
    )
