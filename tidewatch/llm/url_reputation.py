"""URL verdicts from rules and from empirical-Bayes host reputation, in native column expressions.

Labelled pages have an outcome, bad or not. The bad rate of a host is shrunk towards that of its registered domain, that
towards the domain's suffix, and that towards all pages: each level has a beta prior whose mean is the level above and
whose weight follows from how much the groups of the level differ beyond chance (moments of the beta-binomial). A page is
blocked if its host's bad rate is high at the lower bound of the posterior. A host without labelled pages has what its
domain says of a host not seen yet, or else what its suffix says of one of a domain not seen yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A page is blocked if its host is bad at this rate or more, at a bound so many standard deviations below the mean.
MAX_BAD, BOUND = 0.5, 1.28
#: Weights of a prior, in pages, that the estimate is held to.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1000.0
#: Suffixes of two labels under which domains are registered (fixed values); a parameter of the functions.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")


def with_parts(pages: DataFrame, url_col: str = "url", suffixes: tuple[str, ...] = LONG_SUFFIXES) -> DataFrame:
    """pages with host, path, domain and suffix. Without a url or :// all four are empty; earlier columns of these names
    are replaced. Host: between the first :// and /, ?, # or the end, A-Z lower-cased; path: from there to ? or #."""
    others = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "domain", "suffix", "_rest")]
    url = F.col(url_col).cast("string")
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    out = pages.select(*others, F.coalesce(rest, F.lit("")).alias("_rest"))
    upper = F.regexp_extract("_rest", "^([^/?#]*)", 1)
    out = out.withColumn("host", F.translate(upper, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    out = out.withColumn("path", F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1)).drop("_rest")
    name = F.regexp_replace("host", "^.*@|:[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    long = two.isin(*suffixes) if suffixes else F.lit(False)
    out = out.withColumn("suffix", F.when(long, two).otherwise(F.substring_index(name, ".", -1)))
    return out.withColumn("domain", F.when(long, F.substring_index(name, ".", -3)).otherwise(two))


def rule_of(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls. rules: (verdict, host, path), a short list.

    A rule fits its host and all its subdomains if the path starts with the rule's. Of equal rules the first one wins.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, of, start in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)[::-1]:
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        name, verdict = F.when(fits, of + start).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _weight(groups: DataFrame) -> float:
    """Weight of the prior of one level, from n and bad of its groups (moments of the beta-binomial)."""
    total = groups.agg(F.sum("n"), F.sum("bad"), F.sum(F.col("n") * F.col("n")), F.count(F.lit(1))).first()
    n, bad, squares, count = (float(x or 0) for x in total)
    rate = bad / n if n else 0.0
    spread = n - squares / n if n else 0.0
    if not 0 < rate < 1 or spread <= 0:
        return MOST_WEIGHT
    apart = groups.agg(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - rate, 2))).first()[0]
    alike = (apart - (count - 1) * rate * (1 - rate)) / (spread * rate * (1 - rate))
    return MOST_WEIGHT if alike <= 0 else min(MOST_WEIGHT, max(LEAST_WEIGHT, (1 - alike) / alike))


def _bounded(mean: Column, deviation: Column) -> list[Column]:
    return [mean.alias("mean"), (mean - BOUND * deviation).alias("bound")]


def reputations(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Posterior means of bad rates and their lower bounds: (host, n, bad, mean, bound) of each labelled host, (domain,
    mean, bound) of a host without labels of each labelled domain, (suffix, mean, bound) of one of a domain without labels.

    outcomes: a row per labelled page with host, domain, suffix (of with_parts) and bad (0 or 1; null is no label).
    """
    hosts = outcomes.where("bad IS NOT NULL").groupBy("host", "domain", "suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    overall = (total[1] + 1) / (total[0] + 2) if total[0] else 0.5
    s, d, h = (_weight(x) for x in (suffixes, domains, hosts))
    top = suffixes.select("suffix", ((F.col("bad") + s * overall) / (F.col("n") + s)).alias("above"))
    middle = domains.join(top, "suffix").select("domain", "suffix", ((F.col("bad") + d * F.col("above")) / (F.col("n") + d)).alias("above"))
    a, b = F.col("bad") + h * F.col("above"), F.col("n") - F.col("bad") + h * (1 - F.col("above"))
    rows = hosts.join(middle, ["domain", "suffix"]).select("host", "n", "bad", (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("deviation"))
    # Without labels the prior is the posterior; a domain's own rate is unknown too where it has no labels.
    spread = F.col("above") * (1 - F.col("above"))
    of_domain = middle.select("domain", *_bounded(F.col("above"), F.sqrt(spread / (h + 1))))
    of_suffix = top.select("suffix", *_bounded(F.col("above"), F.sqrt(spread * (1 / (d + 1) + d / ((d + 1) * (h + 1))))))
    return rows.select("host", "n", "bad", *_bounded(F.col("mean"), F.col("deviation"))), of_domain, of_suffix


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, mean, bound): posterior mean of each labelled host's bad rate and its lower bound."""
    return reputations(outcomes)[0]


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", max_bad: float = MAX_BAD) -> DataFrame:
    """(id, host, path, rule, verdict, bad_rate, bound) per page: the rule's verdict, else that of the host's reputation.

    outcomes: (url, bad) of labelled pages. A host without labels has the rate and bound of its domain, or else of its
    suffix; of numeric addresses the parts tell nothing. Where the suffix has no labels either, the rate is null and the
    page allowed, as nothing speaks against it beyond what is usual; so are pages without a host and rule. Null ids and
    repeated rows give a row each.
    """
    labelled = with_parts(outcomes.select(F.col("url").cast("string").alias("url"), F.col("bad").cast("int").alias("bad")))
    levels = zip(("host", "domain", "suffix"), reputations(labelled), strict=True)
    parts = with_parts(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")))
    name, verdict = rule_of(rules, F.col("host"), F.col("path"))
    rows = parts.select("id", "host", "path", "domain", "suffix", name.alias("rule"), verdict.alias("ruled"))
    named = F.col("suffix").rlike("[^0-9]")
    for part, of in levels:
        own = of.select(F.col(part).alias(f"_{part}"), F.col("mean").alias(f"_{part}_mean"), F.col("bound").alias(f"_{part}_bound"))
        key = F.col(part) if part == "host" else F.when(named, F.col(part))
        rows = rows.join(own, key == F.col(f"_{part}"), "left")
    mean, bound = (F.coalesce(*(F.col(f"_{part}_{what}") for part in ("host", "domain", "suffix"))) for what in ("mean", "bound"))
    learnt = F.when((F.col("host") != "") & (bound >= max_bad), "block").otherwise("allow")
    return rows.select("id", "host", "path", "rule", F.coalesce("ruled", learnt).alias("verdict"), mean.alias("bad_rate"), bound.alias("bound"))
