"""URL filter: parsing and rules against a plain version, and the reputation of hosts."""

import math

import pytest
from pyspark.sql import functions as F

from arbolex.llm import lookups, urls

URLS = [
    None, "", "no scheme", "http://", "http://A.COM", "http://a.com/", "HTTP://www.Example.com/en/1?x=/y", "x://example.com/en/", "http://notexample.com/en/5",
    "http://a.www.example.com/en/2.html", "http://b.net/es/9#t", "http://b.net/ES/9", "http://net/fr/", "http://b.net?/fr/", "http://example.com#/en/",
    "a://b://c.com/d", "http://u:p@h.co.uk:80/7/", "http://10.0.0.1:81/3", "http://h.org./3", "http://x.net/en/" + "9" * 30, "http://ünï.com/é\n/4", "http://long.org/" + "p" * 9000 + "/12",
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def ruled(host, path):
    fits = []
    for verdict, rule in urls.RULES:
        top = rule.split("/")[0]
        if (host == top or host.endswith("." + top)) and path.startswith(rule[len(top) :]):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def test_hosts_paths_and_rules_equal_the_plain_ones(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)] + [(None, URLS[5])], "page_id long, url string")
    rows = urls.filter_urls(pages.selectExpr("*", "1 as host", "'x' as item")).collect()
    assert len(rows) == 2 * len(URLS) + 1
    for r in rows:
        host, path = split(URLS[r.page_id % len(URLS)] if r.page_id is not None else URLS[5])
        rule, verdict = ruled(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert urls.filter_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("host, domain, suffix", [
    ("a.b.co.uk", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "uk"), ("b.com:80", "b.com", "com"), ("x.y.b.com.", "b.com", "com"), ("com", "com", "com"), ("", "", ""), ("u@1.2.3.4:8", "1.2.3.4", "1.2.3.4"),
])
def test_registered_domains(spark, host, domain, suffix):
    name = urls.domain_of(F.lit(host))
    assert tuple(spark.range(1).select(name, urls.suffix_of(name)).first()) == (domain, suffix)


def pages_of(spark, counts):
    """Pages of hosts from {host: (labelled, bad, others)}, and the outcomes of their items."""
    rows, outcomes, item = [], [], 0
    for host, (labelled, bad, others) in counts.items():
        for k in range(labelled + others):
            item += 1
            rows.append((item, f"http://{host}/x/{item}"))
            if k < labelled:
                outcomes.append((item, k < bad))
    return spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(outcomes, "item long, bad boolean")


COUNTS = {
    **{f"h{i}.good.org": (40, 2, 5) for i in range(6)}, **{f"h{i}.spam.org": (40, 36, 5) for i in range(6)}, "new.spam.org": (1, 1, 9),
    "new.good.org": (1, 1, 9), "unknown.spam.org": (0, 0, 5), "mixed.org": (30, 15, 5), "bad.info": (50, 45, 5), "fresh.biz": (0, 0, 3),
}


def test_a_host_with_few_labels_stays_near_its_domain(spark):
    pages, outcomes = pages_of(spark, COUNTS)
    rows = {r.host: r for r in urls.filter_urls(pages, outcomes).collect()}
    blocked = {h for h, r in rows.items() if r.verdict == "block"}
    assert blocked == {*(f"h{i}.spam.org" for i in range(6)), "new.spam.org", "bad.info"}
    assert rows["new.good.org"].bad_mean < 0.3 < 0.8 < rows["new.spam.org"].bad_mean
    assert rows["mixed.org"].bad_bound < 0.5 and rows["unknown.spam.org"].bad_mean > rows["fresh.biz"].bad_mean
    for r in rows.values():
        assert r.bad_bound < r.bad_mean and (r.n_labelled, r.n_bad) == COUNTS[r.host][:2]


def test_posteriors_equal_the_plain_ones(spark):
    pages, outcomes = pages_of(spark, COUNTS)
    level = {h: c[:2] for h, c in COUNTS.items()}
    of = {h: ".".join(h.split(".")[-2:]) for h in level}

    def pooled(level, of):
        out = {}
        for unit, (n, x) in level.items():
            a, b = out.get(of[unit], (0, 0))
            out[of[unit]] = a + n, b + x
        return out

    def strength(level, mean):
        over = sum((x - n * mean[u]) ** 2 - n * mean[u] * (1 - mean[u]) for u, (n, x) in level.items())
        pairs = sum(n * (n - 1) * mean[u] * (1 - mean[u]) for u, (n, x) in level.items())
        return 1 / max(0.001, min(0.9, over / pairs)) - 1

    domains = pooled(level, of)
    top = {d: d.split(".")[-1] for d in domains}
    suffixes = pooled(domains, top)
    n, x = map(sum, zip(*suffixes.values(), strict=True))
    means = dict.fromkeys(suffixes, (x + 0.5) / (n + 1))
    for units, parent in ((suffixes, {s: s for s in suffixes}), (domains, top), (level, of)):
        mean = {u: means[parent[u]] for u in units}
        s = strength(units, mean)
        means = {u: (x + s * mean[u]) / (n + s) for u, (n, x) in units.items()}
    rows = urls.filter_urls(pages, outcomes).select("host", "bad_mean").distinct().collect()
    assert {r.host for r in rows} == set(means)
    assert all(math.isclose(r.bad_mean, means[r.host], rel_tol=1e-9) for r in rows)


def test_null_and_repeated_outcomes(spark):
    pages, outcomes = pages_of(spark, {"a.org": (4, 1, 2)})
    more = spark.createDataFrame([(None, True), (2, None), (2, True), (99, True), (3, False)], outcomes.schema)
    row = urls.filter_urls(pages, outcomes.unionByName(more)).first()
    assert (row.n_labelled, row.n_bad) == (4, 2)


def test_look_ups_outside_the_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(lookups, "HOT", 2)
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 50), ("b", 40), ("c", 3), (None, 5), ("d", 2)) for i in range(n)], "key string, v int")
    table = spark.createDataFrame([("a", 1, None), ("c", 3, "x"), ("e", 5, "y")], "key string, w int, z string")
    got = lookups.looked_up(rows, table, "key").collect()
    assert len(got) == rows.count()
    assert {(r.key, r.w, r.z) for r in got} == {("a", 1, None), ("b", None, None), ("c", 3, "x"), (None, None, None), ("d", None, None)}
