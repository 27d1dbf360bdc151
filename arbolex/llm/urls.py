"""URL filter: rules first, then the reputation of the host.

Labelled pages are counted per host, registered domain and public suffix. A host's share of bad pages has a beta prior
whose mean is the posterior mean of its domain, that of a domain comes from its suffix, that of a suffix from all
pages: a host with few labels stays near its domain, one with many speaks for itself. The strength of each level's
prior is its empirical Bayes estimate by moments: how much more the counts of its units vary than binomial ones would.
A page is blocked where no rule fits and the lower bound of its host's share of bad pages is above a limit.

Everything is a DataFrame expression. Pages are counted before any shuffle. A host, domain or item with many rows is no
single task, see ``looked_up``.

Defined results. A null url, or one without ``://``, has an empty host and path and no labels; it is judged like any
other host, the empty one. Hosts of digits and dots, and single words, are their own domain. Pages with equal ids or
urls are counted and returned each. A null outcome, or one of no page, counts for nothing; an item with several
outcomes is bad if one of them is. Without outcomes every page that no rule fits is allowed. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolex.llm.lookups import looked_up
from arbolex.session import materialize

#: (verdict, host and path of the rule)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
# Suffixes of two words under which names are registered; pass a fuller list where one is at hand.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")
#: a host is blocked if its share of bad pages is above LIMIT, as sure as CERTAINTY standard deviations below the mean say
LIMIT, CERTAINTY = 0.5, 1.645
#: share of variance between units (1 / (strength + 1)) where a level doesn't tell, and its bounds
USUAL, LEAST, MOST = 0.1, 0.001, 0.9
LEVELS = ("suffix", "domain", "host")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def item_of(path: Column) -> Column:
    """The number that ends a path, before ``.html`` or a slash; null if there is none."""
    return F.regexp_extract(path, r"/([0-9]{1,18})(\.html|/)?\z", 1).try_cast("long")


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain: the public suffix and one word more."""
    name = F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$", "")
    words = F.split(name, r"\.")
    double = F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), ".").isin(*suffixes)
    keep = F.when(double, 3).otherwise(2)
    short = F.array_join(F.slice(words, F.greatest(F.size(words) - keep + 1, F.lit(1)), F.size(words)), ".")
    return F.when(name.rlike(r"^[0-9.]*$"), name).otherwise(short)


def suffix_of(domain: Column) -> Column:
    """What follows the first word of a registered domain; the domain itself where it is one word or an address."""
    return F.when(domain.rlike(r"^[0-9.]*$") | ~F.contains(domain, F.lit(".")), domain).otherwise(F.regexp_replace(domain, r"^[^.]*\.", ""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, of equally long ones that of the longer host; else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].find("/"), r[1])):
        top = rule.split("/", 1)[0]
        start = rule[len(top) :]
        fits = ((host == top) | F.endswith(host, F.lit(f".{top}"))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def strength(units: DataFrame) -> float:
    """Prior strength of a level from ``n, bad`` and the parent's ``mean`` of its units, by the method of moments."""
    spread = F.col("mean") * (1 - F.col("mean"))
    over = F.sum((F.col("bad") - F.col("n") * F.col("mean")) ** 2 - F.col("n") * spread)
    pairs = F.sum(F.col("n") * (F.col("n") - 1) * spread)
    rho = F.when(pairs > 0, F.greatest(F.lit(LEAST), F.least(F.lit(MOST), over / pairs))).otherwise(USUAL)
    rho = units.agg(rho.alias("rho")).first()["rho"]
    return 1 / rho - 1


def lower_bound(a: Column, b: Column, certainty: float) -> Column:
    """Lower bound of a beta variable, from the normal approximation of its log odds."""
    return 1 / (1 + F.exp(-(F.log(a / b) - certainty * F.sqrt(1 / a + 1 / b))))


def host_reputation(
    pages: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES, certainty: float = CERTAINTY
) -> DataFrame:
    """host, n_labelled, n_bad, bad_mean, bad_bound: one row per host of ``pages`` (host, item).

    ``outcomes`` has item and bad (boolean or 0 and 1).
    """
    pairs = materialize(pages.groupBy("host", "item").agg(F.count(F.lit(1)).alias("pages")), "hosts-items")
    bad = outcomes.where("item is not null and bad is not null").groupBy("item").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    labelled = looked_up(pairs.where("item is not null"), bad, "item").where("bad is not null")
    known = labelled.groupBy("host").agg(F.sum("pages").alias("n"), F.sum(F.col("pages") * F.col("bad")).alias("bad"))
    hosts = pairs.select("host").distinct().join(known, "host", "left").select(
        "host", domain_of(F.col("host"), suffixes).alias("domain"),
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"),
    )
    hosts = materialize(hosts, "hosts")
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = materialize(domains.withColumn("suffix", suffix_of(F.col("domain"))), "domains")
    tops = materialize(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    n, x = tops.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    # each level: the mean of the level above, the strength, the posterior mean
    tops = tops.withColumn("mean", F.lit((x + 0.5) / (n + 1)))
    above = with_posterior(tops, strength(tops)).select("suffix", F.col("posterior").alias("mean"))
    domains = looked_up(domains, above, "suffix")
    above = with_posterior(domains, strength(domains)).select("domain", F.col("posterior").alias("mean"))
    hosts = materialize(looked_up(hosts, above, "domain"), "host-priors")
    s = strength(hosts)
    a, b = F.col("bad") + s * F.col("mean"), F.col("n") - F.col("bad") + s * (1 - F.col("mean"))
    return hosts.select(
        "host", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"),
        (a / (a + b)).alias("bad_mean"), lower_bound(a, b, certainty).alias("bad_bound"),
    )


def with_posterior(units: DataFrame, s: float) -> DataFrame:
    return units.withColumn("posterior", (F.col("bad") + s * F.col("mean")) / (F.col("n") + s))


def filter_urls(
    pages: DataFrame, outcomes: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, limit: float = LIMIT,
    certainty: float = CERTAINTY, suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled, n_bad, bad_mean, bad_bound of every page (page_id, url).

    ``outcomes`` (item, bad) are labels of the things that urls end with the number of, see ``item_of``.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if outcomes is None:
        outcomes = parsed.sparkSession.createDataFrame([], "item long, bad int")
    known = host_reputation(parsed.select("host", item_of(F.col("path")).alias("item")), outcomes, suffixes, certainty)
    rated = looked_up(parsed, materialize(known, "reputation"), "host")
    by_rule = rule_of(F.col("host"), F.col("path"), rules)
    by_host = F.when((F.col("n_labelled") > 0) & (F.col("bad_bound") > limit), "block").otherwise("allow")
    return rated.withColumn("_rule", by_rule).select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), by_host).alias("verdict"),
        "n_labelled", "n_bad", "bad_mean", "bad_bound",
    )
