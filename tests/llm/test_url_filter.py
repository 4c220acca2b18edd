"""URL filters against brute force."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from footfall.llm import url_filter
from footfall.llm.queries import URL_RULES, op13_url_filter, page_outcomes
from tests.llm.conftest import SMALL

URLS = [
    None, "", "no scheme", "http://", "HTTP://Example.ORG/es/1", "x://example.org", "x://example.org?q=/es/", "x://example.org#/es/",
    "x://a.EXAMPLE.org/en/1", "x://a.example.org/en/2", "x://badexample.org/es/", "x://org/", "x://org", "x://b.com/fr/", "x://b.com/fr",
    "x://com/de/x?y#z", "x://b.com/de/://c.org/es/", "x://İ.net/ÄÖ", "x://u:p@h.net:80/a/b?c", "x:///path", "x://h.net" + "/a" * 30_000,
    "x://.com/de/", "x://h.net/a#b?c", "x://h.net?b#c/d", "x://shop.co.uk/", "x://h.net/a\nb/", "x://h.net/a", "x://h.net/a",
]


def plain_place(url):
    if url is None or "://" not in url:
        return "", ""
    rest = re.match(r"[^?#]*", url.split("://", 1)[1]).group()
    host = re.match(r"[^/]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[len(host) :]


def plain_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def plain_domain(host, suffixes=()):
    bare = host.split(":")[0]
    known = [s for s in suffixes if bare == s or bare.endswith("." + s)]
    suffix = max(known, key=len, default=bare.split(".")[-1])
    before = bare[: max(0, len(bare) - len(suffix) - 1)]
    return (f"{before.split('.')[-1]}.{suffix}" if before else suffix), suffix


def plain_bounds(outcomes, hosts, suffixes=()):
    """outcomes: (host, bad).  Lower bound per host."""
    n, bad = Counter(), Counter()
    for host, b in outcomes:
        domain, suffix = plain_domain(host, suffixes)
        for key in ((), ("s", suffix), ("d", domain, suffix), ("h", host)):
            n[key] += 1
            bad[key] += b
    every = {("h", h) for h in hosts} | {k for k in n if k and k[0] == "h"}

    def above(key):
        domain, suffix = plain_domain(key[1], suffixes) if key[0] == "h" else (None, key[-1])
        return {"h": ("d", domain, suffix), "d": ("s", suffix), "s": ()}[key[0]]

    mean = {(): bad[()] / n[()] if n[()] else 0.5}
    level = {above(above(k)) for k in every}, {above(k) for k in every}, every
    for keys in level:
        prior = {k: mean[above(k)] for k in keys}
        seen = [k for k in keys if n[k]]
        excess = sum(n[k] * (bad[k] / n[k] - prior[k]) ** 2 - prior[k] * (1 - prior[k]) for k in seen)
        more = sum(prior[k] * (1 - prior[k]) * (n[k] - 1) for k in seen)
        strength = min(max(more / excess - 1 if excess > 0 else 1e4, 1.0), 1e4)
        out = {}
        for k in keys:
            a, b = bad[k] + strength * prior[k], n[k] - bad[k] + strength * (1 - prior[k])
            mean[k] = a / (a + b)
            out[k] = mean[k] - 1.645 * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    return {k[1]: v for k, v in out.items()}


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [(i, u, "x", 1, "r") for i, u in enumerate(URLS)] + [(None, "x://h.net/a", "x", 1, None)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, _rule int, `a.b` string").repartition(3)


def outcome_rows():
    """Hosts that differ within domains that differ within suffixes, and a busy good one."""
    rows = []
    for s, suffix in enumerate(("net", "com", "co.uk")):
        for d in range(4):
            for h in range(6):
                n = 3 + 7 * h
                bad = min(n, (n * (s + d + h % 3)) // 7)
                rows += [(f"x://h{h}.d{d}.{suffix}/p{i}", int(i < bad)) for i in range(n)]
    return rows + [("x://h.net/a", 0)] * 400 + [("x://bad.d3.co.uk:8080/", 1)] * 40 + [(None, 1), ("x://h.net/", None), ("x://shop.co.uk/", 1)]


@pytest.mark.parametrize("suffixes", [(), ("co.uk",)])
def test_reputation(spark, odd_pages, suffixes):
    rows = outcome_rows()
    outcomes = spark.createDataFrame(rows, "link string, bad int").repartition(5)
    labelled = [(plain_place(u)[0], b) for u, b in rows if b is not None]
    pages = odd_pages.unionByName(outcomes.selectExpr("1L as page_id", "link as url", "'x' as host", "1 as _rule", "'r' as `a.b`"))
    hosts = pages.select(url_filter.host_and_path(F.col("url"))[0].alias("host"))
    found = {r["host"]: r["lower"] for r in url_filter.reputations(outcomes.select(url_filter.host_and_path(F.col("link"))[0].alias("host"), "bad"), hosts, suffixes).collect()}
    wanted = plain_bounds(labelled, [r["host"] for r in hosts.distinct().collect()], suffixes)
    assert found.keys() == wanted.keys()
    assert all(abs(found[h] - wanted[h]) < 1e-9 for h in wanted)
    judged = url_filter.judge(pages, outcomes, URL_RULES, outcome_url="link", suffixes=suffixes)
    assert judged.columns == [*pages.columns, "host_", "path", "rule", "verdict"]
    seen = Counter()
    for r in judged.collect():
        host, path = plain_place(r["url"])
        rule = plain_rule(host, path)
        verdict = rule.verdict if rule else "block" if wanted[host] > 0.5 else "allow"
        assert (r["host_"], r["path"], r["rule"], r["verdict"], r["host"]) == (host, path, rule and rule.name, verdict, "x")
        seen[bool(rule), verdict] += 1
    assert sum(seen.values()) == pages.count() and len(seen) == 4


def test_no_labels_and_no_pages(spark, odd_pages):
    none = spark.createDataFrame([], "url string, bad int")
    judged = url_filter.judge(odd_pages, none, URL_RULES)
    assert judged.count() == odd_pages.count() and judged.where("rule is null and verdict != 'allow'").count() == 0
    assert url_filter.judge(odd_pages.limit(0), none, URL_RULES).count() == 0
    assert url_filter.reputations(none.selectExpr("url as host", "bad"), none.selectExpr("url as host")).count() == 0


def test_outcomes_are_those_of_the_documents_shown(spark):
    pages = spark.createDataFrame([("x://h/en/12.html?y=3",), ("x://h/12/",), ("x://h/en/13#z",), ("x://h/14x",), ("x://h/" + "9" * 30,), (None,), ("x://h/15",)], "url string")
    labels = spark.createDataFrame([(12, 0, 0), (13, 1, 1), (15, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted((r["url"], r["bad"]) for r in page_outcomes(pages, labels).collect()) == [
        ("x://h/12/", 1), ("x://h/15", 0), ("x://h/en/12.html?y=3", 1), ("x://h/en/13#z", 1)
    ]


def test_query_uses_no_python(spark):
    plan = op13_url_filter(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
