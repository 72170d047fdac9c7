import math

from tidewatch.llm import url_reputation as u
from tidewatch.llm.contracts import RULES


def judged(spark, urls, outcomes=(), rules=RULES):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    known = spark.createDataFrame(list(outcomes), "url string, bad int")
    return {r.id: r for r in u.judge(pages, known, rules).collect()}


def test_parts_and_rules(spark):
    cases = {
        "http://WWW.Example.COM/en/1?x#y": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "https://example.com/En/": ("example.com", "/En/", "com/", "allow"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "ftp://a.net/es/?q": ("a.net", "/es/", "net/es/", "block"),
        "http://a.net/es": ("a.net", "/es", None, "allow"),
        "http://a.com?q=/x": ("a.com", "", None, "allow"),
        "http://a.com#/x": ("a.com", "", None, "allow"),
        "http://É.COM/ä?b://c": ("É.com", "/ä", "com/", "allow"),
        "no scheme.com/en/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    out = judged(spark, list(cases))
    assert [(out[i].host, out[i].path, out[i].rule, out[i].verdict) for i in range(len(cases))] == list(cases.values())


def weight(groups):
    """Weight of a prior from (n, bad) of its groups, by moments."""
    n, bad = (sum(x) for x in zip(*groups, strict=True))
    rate, spread = bad / n, n - sum(g[0] ** 2 for g in groups) / n
    if not 0 < rate < 1 or spread <= 0:
        return u.MOST_WEIGHT
    apart = sum(g[0] * (g[1] / g[0] - rate) ** 2 for g in groups)
    alike = (apart - (len(groups) - 1) * rate * (1 - rate)) / (spread * rate * (1 - rate))
    return u.MOST_WEIGHT if alike <= 0 else min(u.MOST_WEIGHT, max(u.LEAST_WEIGHT, (1 - alike) / alike))


def added(groups, up):
    out = {}
    for k, (n, bad) in groups.items():
        a, b = out.get(up(k), (0, 0))
        out[up(k)] = a + n, b + bad
    return out


def test_reputation_equals_brute_force(spark):
    hosts = {"a.evil.org": (40, 38), "b.evil.org": (2, 2), "c.evil.org": (30, 1), "x.good.org": (60, 1), "y.good.org": (1, 1), "p.some.io": (20, 4), "q.some.io": (25, 20)}
    outcomes = [(f"http://{h}/{i}", int(i < bad)) for h, (n, bad) in hosts.items() for i in range(n)] + [("http://x.good.org/n", None)]
    domains = added(hosts, lambda h: h.split(".", 1)[1])
    suffixes = added(domains, lambda d: d.split(".")[1])
    n, bad = (sum(x) for x in zip(*suffixes.values(), strict=True))
    s, d, w = (weight(list(g.values())) for g in (suffixes, domains, hosts))
    out = judged(spark, [f"http://{h}/page" for h in hosts] + ["http://new.evil.org/"], outcomes, [])
    for i, (h, (of, own)) in enumerate(hosts.items()):
        domain = h.split(".", 1)[1]
        top = (suffixes[domain.split(".")[1]][1] + s * (bad + 1) / (n + 2)) / (suffixes[domain.split(".")[1]][0] + s)
        above = (domains[domain][1] + d * top) / (domains[domain][0] + d)
        a, b = own + w * above, of - own + w * (1 - above)
        mean, deviation = a / (a + b), math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        assert math.isclose(out[i].bad_rate, mean, rel_tol=1e-9) and math.isclose(out[i].bound, mean - u.BOUND * deviation, rel_tol=1e-9)
        assert out[i].verdict == ("block" if mean - u.BOUND * deviation >= u.MAX_BAD else "allow")
    assert out[0].verdict == "block" and out[3].verdict == "allow" and out[4].verdict == "allow"


def test_nothing_and_repeats(spark):
    assert judged(spark, []) == {}
    pages = spark.createDataFrame([(None, "http://a.org/"), (1, "http://a.org/"), (1, "http://a.org/")], "page_id long, url string").selectExpr("*", "'x' host", "1 known")
    none = spark.createDataFrame([], "url string, bad int")
    assert u.judge(pages, none, RULES).count() == 3


def test_hosts_without_labels_have_the_rate_of_the_level_above(spark):
    hosts = {f"{c}.evil.org": (40, 40) for c in "abc"} | {f"{c}.good{i}.org": (40, 0) for c in "ab" for i in range(3)}
    hosts |= {f"a.spam{i}.bad": (40, 40) for i in range(30)} | {f"{i}.0.0.7": (40, 40) for i in range(3)}
    outcomes = [(f"http://{h}/{i}", int(i < bad)) for h, (n, bad) in hosts.items() for i in range(n)]
    urls = ["http://new.evil.org/", "http://evil.org:80/", "http://new.good1.org/", "http://x.other.org/", "http://x.unseen.bad/", "http://x.com/", "http://9.0.0.7/", "nothing"]
    out = judged(spark, urls, outcomes, [])
    assert [out[i].verdict for i in range(len(urls))] == ["block", "block", "allow", "allow", "block", "allow", "allow", "allow"]
    domains = added(hosts, lambda h: h.split(".", 1)[1] if h[0].isalpha() else "0.7")
    suffixes = added(domains, lambda d: d.rsplit(".", 1)[-1])
    n, bad = (sum(x) for x in zip(*suffixes.values(), strict=True))
    s, d, w = (weight(list(g.values())) for g in (suffixes, domains, hosts))
    top = {k: (v[1] + s * (bad + 1) / (n + 2)) / (v[0] + s) for k, v in suffixes.items()}
    above = (domains["evil.org"][1] + d * top["org"]) / (domains["evil.org"][0] + d)
    for i, mean, share in [(0, above, 1 / (w + 1)), (3, top["org"], 1 / (d + 1) + d / (d + 1) / (w + 1))]:
        assert math.isclose(out[i].bad_rate, mean, rel_tol=1e-9)
        assert math.isclose(out[i].bound, mean - u.BOUND * math.sqrt(mean * (1 - mean) * share), rel_tol=1e-9)
    assert all(out[i].bad_rate is None and out[i].bound is None for i in (5, 6, 7))
