import re

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import url_reputation
from quillon.llm.queries import RULES

URLS = ["http://A.Net/x", "http://net", "http://net/", "https://sub.example.net/en/1?x", "https://example.net/de/#y", "ftp://xexample.net/en/", "http://example.com/de/z", "http://example.com/de", "http://é.example.com/de/?q", "http://w.org/fr/1", "http://org/fr/", "http://org/en/", "no scheme", None, "", "://h?p/x", "http://a.b/c://d/e", "http://ÀB.org/FR/", "http://host\n.net/\nx"]


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    found = [(len(r), v, r) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(found)[1:] if found else (None, None)


def mass_above(a, b, x):
    """Share of 200,000 draws of the beta distribution above x."""
    return float((np.random.default_rng(1).beta(a, b, 200_000) > x).mean())


def posterior(rows, bad):
    """Plain version of the hierarchy: {host: (a, b)} of the posterior, and the overall rate."""
    def strength(level):
        over = sum(n * (k / n - m) ** 2 - m * (1 - m) for n, k, m in level)
        base = sum(m * (1 - m) * (n - 1) for n, k, m in level)
        return 1000.0 if not base or over <= 0 else min(1000.0, max(1.0, base / over - 1))

    hosts = {}
    for page, host in rows:
        if page in bad:
            n, k = hosts.get(host, (0, 0))
            hosts[host] = (n + 1, k + bad[page])
    names = lambda h: (".".join(h.split(".")[-2:]), h.split(".")[-1])
    mean = (sum(k for _, k in hosts.values()) + 1) / (sum(n for n, _ in hosts.values()) + 2)
    prior = {}
    for depth in (1, 0):
        level = {}
        for h, (n, k) in hosts.items():
            name = names(h)[depth]
            a, b, _ = level.get(name, (0, 0, 0))
            level[name] = (a + n, b + k, prior.get(("s", names(h)[1]), mean))
        s = strength(level.values())
        prior |= {("sd"[1 - depth], name): (k + s * m) / (n + s) for name, (n, k, m) in level.items()}
    of = lambda h: prior.get(("d", names(h)[0]), prior.get(("s", names(h)[1]), mean))
    s = strength([(n, k, of(h)) for h, (n, k) in hosts.items()])
    out = {}
    for _, h in rows:
        n, k = hosts.get(h, (0, 0))
        a, b = s * of(h) + k, s * (1 - of(h)) + n - k
        out[h] = a, b
    return out, mean


def test_rules_and_reputation(spark):
    urls = [*URLS, *(f"http://good.site{k % 4}.com/{k}" for k in range(60)), *(f"http://bad.farm.info/{k}" for k in range(40)), "http://other.farm.info/", "http://new.info/", "http://new.xyz/"]
    pages = spark.createDataFrame([(k, u, "x", 1, 2.0) for k, u in enumerate(urls)], "page_id long, url string, host string, n int, m double")
    bad = {k: int("farm" in (u or "") or k % 17 == 0) for k, u in enumerate(urls) if k % 3}
    labels = spark.createDataFrame([*((k, bool(b)) for k, b in bad.items()), (1, None), (None, True)], "page_id long, bad boolean")
    got = url_reputation.judge(pages, labels, RULES).collect()
    parsed = {k: parse(u) for k, u in enumerate(urls)}
    after, mean = posterior([(k, h) for k, (h, _) in parsed.items()], bad)
    chance = {h: mass_above(a, b, mean) for h, (a, b) in after.items()}
    assert len(got) == len(urls)
    for r in got:
        host, path = parsed[r.page_id]
        verdict, name = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name)
        a, b = after[host]
        assert abs(r.bad_mean - a / (a + b)) < 1e-9
        assert abs(r.bad_chance - chance[host]) < 0.01
        assert r.verdict == (verdict or ("block" if chance[host] > 0.95 else "allow"))
    verdicts = {urls[r.page_id]: r.verdict for r in got}
    assert verdicts["http://bad.farm.info/0"] == "block" and verdicts["http://good.site0.com/0"] == "allow"


def test_without_labels_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, None)], "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    assert [r.verdict for r in url_reputation.judge(pages, labels, RULES).collect()] == ["allow"] * 3
    assert url_reputation.judge(pages.limit(0), labels, RULES).collect() == []


def test_names_of_hosts(spark):
    want = {"a.b.co.uk": ("b.co.uk", "co.uk"), "x.y.com:8080": ("y.com", "com"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "com": ("com", "com"), "": ("", "")}
    rows = spark.createDataFrame([(h,) for h in want], "h string").select("h", url_reputation.domain_of(F.col("h")).alias("d"), url_reputation.suffix_of(F.col("h")).alias("s")).collect()
    assert {r.h: (r.d, r.s) for r in rows} == want
    own = spark.createDataFrame([("a.b.city.jp",)], "h string").select(url_reputation.domain_of(F.col("h"), ["city.jp"])).first()[0]
    assert own == "b.city.jp"


def test_the_reputation_decides_where_hosts_differ(spark):
    """Of sixty hosts six are worse by far: all of their pages are blocked, none of the others' is; without a difference none."""
    import random

    r = random.Random(3)
    for rate, blocked in ((0.9, 6), (0.1, 0)):
        urls = [f"http://h{k % 60}.site{k % 60 % 7}.com/{k}" for k in range(6000)]
        pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        labels = spark.createDataFrame([(k, r.random() < (rate if k % 60 < 6 else 0.1)) for k in range(6000) if k // 60 % 2], "page_id long, bad boolean")
        got = url_reputation.judge(pages, labels, RULES).select("host", "verdict").distinct().collect()
        found = {x.host.split(".")[0] for x in got if x.verdict == "block"}
        assert found <= {f"h{k}" for k in range(6)} and len(found) == blocked
