"""URL filters: rules by host and path, and the reputation of hosts where no rule fits.

Reputation is empirical Bayes.  Labelled outcomes of pages (good or bad) are counted per host,
registered domain and suffix.  The share of bad pages of a suffix is shrunk towards that of
all pages, a domain's towards its suffix's, a host's towards its domain's; how strongly is
estimated at every level from how much the shares differ beyond chance (the moments of a
beta-binomial).  A page goes if the host's posterior is bad with a margin: if its lower bound
is above the limit.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.common import ascii_lower, fresh_name, quoted
from footfall.session import materialize

ALLOW, BLOCK = "allow", "block"
LIMIT = 0.5  # share of bad pages above which a host is blocked
CERTAINTY = 1.645  # standard deviations of the posterior that the share has to be above it
WEAKEST, STRONGEST = 1.0, 1e4  # bounds of a prior's strength, in pages


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains, where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What comes after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    then what follows up to ``?``, ``#`` or the end.  Without ``://``, or for NULL, both are
    empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    bare = F.regexp_extract(rest, r"^[^?#]*", 0)
    host = F.regexp_extract(bare, r"^[^/]*", 0)
    return ascii_lower(host), F.substr(bare, F.length(host) + 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``name, verdict`` of the longest rule that fits (of equally long ones the first); NULL if
    none does."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def domain_and_suffix(host: Column, suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """A host's registered domain and its suffix.

    The suffix is the longest of ``suffixes`` (such as ``co.uk``) that the host ends with, else
    its last label; the domain has one label more, if there is one.  Ports do not count.
    """
    bare = F.regexp_extract(host, r"^[^:]*", 0)
    suffix = F.substring_index(bare, ".", -1)
    for known in sorted(suffixes, key=len):
        suffix = F.when((bare == known) | F.endswith(bare, F.lit("." + known)), F.lit(known)).otherwise(suffix)
    before = F.left(bare, F.greatest(F.length(bare) - F.length(suffix) - 1, F.lit(0)))
    domain = F.when(before == "", suffix).otherwise(F.concat_ws(".", F.substring_index(before, ".", -1), suffix))
    return domain, suffix


def _strength(groups: DataFrame, mean: str) -> Column:
    """How many pages a prior at ``mean`` counts for, by moments over groups with ``n, bad``.

    If shares vary around their priors no more than binomial draws do, the prior is as strong
    as it may be.
    """
    share = F.col("bad") / F.col("n")
    chance = F.col(mean) * (1 - F.col(mean))
    # E[n (share - mean)^2] = chance (1 + (n - 1) / (strength + 1)), summed over groups.
    spread, plain, more = F.sum(F.col("n") * (share - F.col(mean)) ** 2), F.sum(chance), F.sum(chance * (F.col("n") - 1))
    excess = spread - plain
    found = F.when(excess <= 0, STRONGEST).otherwise(more / excess - 1)
    return groups.agg(F.least(F.greatest(F.coalesce(found, F.lit(STRONGEST)), F.lit(WEAKEST)), F.lit(STRONGEST)).alias("s")).scalar()


def _shrunk(groups: DataFrame, prior: str, strength: Column) -> DataFrame:
    """Adds ``alpha, beta`` of the posterior and its ``mean``."""
    return (
        groups.withColumn("_s", strength)
        .withColumns({"alpha": F.col("bad") + F.col("_s") * F.col(prior), "beta": F.col("n") - F.col("bad") + F.col("_s") * (1 - F.col(prior))})
        .withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))
        .drop("_s")
    )


def reputations(labelled: DataFrame, hosts: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    """``host, domain, suffix, n, bad, alpha, beta, mean, lower`` for every one of ``hosts``.

    ``labelled`` has ``host`` and ``bad`` (0 or 1; NULL is no label), one row per labelled page.
    ``alpha`` and ``beta`` are the host's posterior and ``lower`` is CERTAINTY standard
    deviations below its mean.  A host without labels has the posterior of its domain's prior.
    Without any label all shares are 1/2.
    """
    counted = labelled.where(F.col("bad").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    known = hosts.select("host").where(F.col("host").isNotNull()).distinct().join(counted, "host", "full")
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    # From here on one row per host.
    by_host = materialize(
        known.select("host", domain.alias("domain"), suffix.alias("suffix"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "bad")]), "hosts"
    )
    sums = [F.sum(c).alias(c) for c in ("n", "bad")]
    by_domain = materialize(by_host.groupBy("domain", "suffix").agg(*sums), "domains")
    by_suffix = materialize(by_domain.groupBy("suffix").agg(*sums), "suffixes")
    all_pages = by_suffix.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("n")), F.lit(0.5)).alias("mean")).scalar()

    def level(groups: DataFrame, prior: str) -> DataFrame:
        return _shrunk(groups, prior, _strength(groups.where("n > 0"), prior))

    suffix_posterior = level(by_suffix.withColumn("prior", all_pages), "prior")
    with_suffix = by_domain.join(suffix_posterior.select("suffix", F.col("mean").alias("prior")), "suffix")
    domain_posterior = level(materialize(with_suffix, "domain-priors"), "prior")
    with_domain = by_host.join(domain_posterior.select("domain", "suffix", F.col("mean").alias("prior")), ["domain", "suffix"])
    host_posterior = level(materialize(with_domain, "host-priors"), "prior")
    total = F.col("alpha") + F.col("beta")
    deviation = F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1)))
    return host_posterior.select(
        "host", "domain", "suffix", "n", "bad", "alpha", "beta", "mean", (F.col("mean") - deviation * CERTAINTY).alias("lower")
    )


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], url: str = "url", outcome_url: str = "url", bad: str = "bad",
    suffixes: Sequence[str] = (), limit: float = LIMIT,
) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``.

    The verdict is that of the longest rule that fits, else ``block`` where the lower bound of
    the host's share of bad pages is above ``limit``, and ``allow`` otherwise.  ``outcomes`` has
    a row per labelled page, with its URL and whether it is ``bad`` (0, 1, or NULL for no
    label); rows of one URL all count.  A NULL URL, or one without ``://``, has the empty host,
    which has a reputation like any other.  Columns of ``pages`` stay; of a clashing name the
    new column is ``host_`` and so on.  Very long URLs and repeated rows are pages like others;
    an empty table gives no rows.
    """
    host, path = host_and_path(F.col(quoted(url)))
    names = {n: fresh_name(pages, n) for n in ("host", "path", "rule", "verdict")}
    found = fresh_name(pages, "_rule")
    placed = pages.withColumns({names["host"]: host, names["path"]: path})
    placed = placed.withColumn(found, rule_of(F.col(names["host"]), F.col(names["path"]), rules))
    labelled = outcomes.select(host_and_path(F.col(quoted(outcome_url)))[0].alias("host"), F.col(quoted(bad)).alias("bad"))
    hosts = pages.select(host.alias("host"))
    known = reputations(labelled, hosts, suffixes).select(F.col("host").alias("_host"), (F.col("lower") > limit).alias("_bad")).alias("_known")
    own = placed.alias("_own")

    def of_page(column: str) -> Column:
        return F.col(f"_own.{quoted(column)}")

    # A frequent host is split at run time, or the hosts are broadcast if Spark finds them small.
    judged = own.join(known, of_page(names["host"]) == F.col("_known._host"), "left")
    verdict = F.coalesce(of_page(found)["verdict"], F.when(F.col("_known._bad"), BLOCK).otherwise(ALLOW))
    return judged.select(
        *[of_page(c) for c in (*pages.columns, names["host"], names["path"])],
        of_page(found)["name"].alias(names["rule"]), verdict.alias(names["verdict"]),
    )
