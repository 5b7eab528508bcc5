"""URL filter by empirical-Bayes host reputation, under hand-written rules.

Every labelled page is a trial of its host, and a bad page a success. The rate of bad pages is shrunk level by
level: the posterior mean of a suffix is the prior mean of its registered domains, theirs that of their hosts. How
strongly a level is shrunk (the beta prior's number of pseudo-pages) is fitted for the level by the method of
moments of the beta-binomial distribution. A page without a rule is blocked if the lower ``sure`` bound of its host's
beta posterior lies above ``limit``, the overall rate of bad pages unless given: that is, if the posterior puts at least
``sure`` of its mass above the limit. So where hosts don't differ by more than chance, no host is blocked.

The registered domain is the suffix and the label before it; ``suffixes`` names those of several labels. Ports don't
count there, and an address of digits is a domain and suffix of its own.

Counts are summed up host by host, then domain by domain from the hosts, so a host or domain with a third of all
pages is a few partial sums. Hosts are joined back through a written table, whose partitions adaptive execution
may split.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule, and is judged by the
prior. An unlabelled host is judged by its domain, suffix or the overall rate. With no labels at all every page
without a rule is allowed. A null label counts as not bad; several labels of a page count once, bad if any is.
Repeated rows are judged alike and all returned. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import store

#: Suffixes of two labels; the others have one. A caller's own list may replace them.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (verdict, host/path) that fits, as struct(rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, tail = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + tail)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _bare(host: Column) -> tuple[Column, Column]:
    """The host without its port, and whether it is an address of digits."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    return bare, bare.rlike(r"^[0-9.]+$")


def suffix_of(host: Column, suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    bare, address = _bare(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(address | two.isin(*suffixes), F.when(address, bare).otherwise(two)).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column, suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    bare, address = _bare(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(address, bare).when(two.isin(*suffixes), F.substring_index(bare, ".", -3)).otherwise(two)


def chance_above(a: Column, b: Column, limit: Column, steps: int = 400) -> Column:
    """Mass of a beta distribution above ``limit``, by the midpoint rule over eight deviations around its mean."""
    mean = a / (a + b)
    deviation = F.sqrt(mean * (1 - mean) / (a + b + 1))
    low, high = F.greatest(F.lit(0.0), mean - 8 * deviation), F.least(F.lit(1.0), mean + 8 * deviation)
    at = lambda i: low + (i + 0.5) * (high - low) / steps
    mass = lambda t: F.exp((a - 1) * (F.log(t) - F.log(mean)) + (b - 1) * (F.log(1 - t) - F.log(1 - mean)))
    points = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.struct(at(i).alias("t"), mass(at(i)).alias("f")))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, p: s + p["f"])
    return total(F.filter(points, lambda p: p["t"] > limit)) / total(points)


def _strength(level: DataFrame, least: float, most: float) -> float:
    """Pseudo-pages of a level's prior: ``level`` has n, k and the prior mean m of each member."""
    p, spread = F.col("k") / F.col("n"), F.col("m") * (1 - F.col("m"))
    x = level.where("n > 0").agg(F.sum(F.col("n") * (p - F.col("m")) ** 2 - spread).alias("over"), F.sum(spread * (F.col("n") - 1)).alias("base")).first()
    if not x.base or x.over is None:
        return most
    rho = x.over / x.base
    return most if rho <= 0 else min(most, max(least, 1 / rho - 1))


def reputation(outcomes: DataFrame, least: float = 1.0, most: float = 1000.0, suffixes: Sequence[str] = LONG_SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, float, float]:
    """From (host, bad): tables of host (a, b of the posterior), domain (m), suffix (m), the overall mean, and the
    hosts' prior strength."""
    hosts = store(outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k")).withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = ((total.k or 0) + 1) / ((total.n or 0) + 2)
    domains = store(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    ends = store(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("m", F.lit(mean)))
    s = _strength(ends, least, most)
    ends = store(ends.select("suffix", ((F.col("k") + s * F.col("m")) / (F.col("n") + s)).alias("m")))
    domains = store(domains.join(ends, "suffix"))
    s = _strength(domains, least, most)
    domains = store(domains.select("domain", ((F.col("k") + s * F.col("m")) / (F.col("n") + s)).alias("m")))
    hosts = store(hosts.drop("suffix").join(domains, "domain"))
    s = _strength(hosts, least, most)
    hosts = store(hosts.select("host", (s * F.col("m") + F.col("k")).alias("a"), (s * (1 - F.col("m")) + F.col("n") - F.col("k")).alias("b")))
    return hosts, domains, ends, mean, s


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], limit: float | None = None, sure: float = 0.95, suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_mean, bad_chance (that the rate is above the limit) for each row of ``pages``
    (page_id, url).

    ``labels``: page_id, bad (boolean).
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    outcome = labels.groupBy("page_id").agg(F.max(F.coalesce("bad", F.lit(False))).alias("bad"))
    hosts, domains, ends, mean, s = reputation(rows.join(outcome, "page_id").select("host", "bad"), suffixes=suffixes)
    # Hosts without a label fall back to the mean of the nearest level that has one.
    every = store(rows.groupBy("host").agg(F.lit(1).alias("one")).select("host", domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix")))
    prior = F.coalesce("dm", "sm", F.lit(mean))
    known = every.join(hosts, "host", "left").join(domains.withColumnRenamed("m", "dm"), "domain", "left").join(ends.withColumnRenamed("m", "sm"), "suffix", "left")
    known = known.select("host", F.coalesce("a", s * prior).alias("a"), F.coalesce("b", s * (1 - prior)).alias("b"))
    chance = chance_above(F.col("a"), F.col("b"), F.lit(mean if limit is None else limit))
    known = store(known.select("host", (F.col("a") / (F.col("a") + F.col("b"))).alias("bad_mean"), chance.alias("bad_chance")))
    out = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).join(known, "host", "left")
    verdict = F.coalesce("fit.verdict", F.when(F.col("bad_chance") > sure, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "bad_mean", "bad_chance")


def _strength_sql(name: str, level: str) -> str:
    """A level's pseudo-pages by the method of moments, as :func:`_strength` has them."""
    return f"""{name} AS (SELECT CASE WHEN base IS NULL OR base = 0 OR over_ <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, base / over_ - 1)) END AS s
  FROM (SELECT sum(n * (k / n - m) * (k / n - m) - m * (1 - m)) AS over_, sum(m * (1 - m) * (n - 1)) AS base FROM {level} WHERE n > 0))"""


#: The same in SQL, with the query's rules, labels and parameters.
ORACLE = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
w AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS bare FROM p),
x AS (SELECT *, regexp_matches(bare, '^[0-9.]+$') AS address, string_split(bare, '.')[-1] AS s1, array_to_string(string_split(bare, '.')[-2:], '.') AS s2, array_to_string(string_split(bare, '.')[-3:], '.') AS s3 FROM w),
q AS (SELECT *, CASE WHEN address THEN bare WHEN s2 IN {LONG_SUFFIXES} THEN s2 ELSE s1 END AS suffix, CASE WHEN address THEN bare WHEN s2 IN {LONG_SUFFIXES} THEN s3 ELSE s2 END AS domain FROM x),
o AS (SELECT doc_id, CAST(bool_or(coalesce(quality = 0 OR toxic = 1, false)) AS INT) AS bad FROM labels GROUP BY doc_id),
h AS (SELECT host, domain, suffix, count(*) AS n, CAST(sum(bad) AS DOUBLE) AS k FROM q JOIN o ON page_id = doc_id GROUP BY ALL),
g AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean FROM h),
sl AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(mean) AS m FROM h, g GROUP BY suffix), {_strength_sql("ss", "sl")},
sm AS (SELECT suffix, (k + s * m) / (n + s) AS m FROM sl, ss),
dl AS (SELECT domain, h.suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM h JOIN sm ON h.suffix = sm.suffix GROUP BY domain, h.suffix), {_strength_sql("ds", "dl")},
dm AS (SELECT domain, (k + s * m) / (n + s) AS m FROM dl, ds),
hl AS (SELECT host, n, k, m FROM h JOIN dm USING (domain)), {_strength_sql("hs", "hl")},
e AS (SELECT page_id, q.host, path, coalesce(dm.m, sm.m, mean) AS m, coalesce(n, 0) AS n, coalesce(k, 0) AS k, s FROM q LEFT JOIN hl ON hl.host = q.host LEFT JOIN dm ON dm.domain = q.domain LEFT JOIN sm ON sm.suffix = q.suffix, g, hs),
f AS (SELECT host, any_value(s * m + k) AS a, any_value(s * (1 - m) + n - k) AS b, any_value(mean) AS limit_ FROM e, g GROUP BY host),
z AS (SELECT *, a / (a + b) AS pm, sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS sd FROM f),
y AS (SELECT *, greatest(0.0, pm - 8 * sd) AS lo, least(1.0, pm + 8 * sd) AS hi FROM z),
v AS (SELECT host, a, b, limit_, pm, lo + (unnest(range(0, 400)) + 0.5) * (hi - lo) / 400 AS t FROM y),
m AS (SELECT host, t > limit_ AS above, exp((a - 1) * (ln(t) - ln(pm)) + (b - 1) * (ln(1 - t) - ln(1 - pm))) AS mass FROM v),
c AS (SELECT host, coalesce(sum(mass) FILTER (WHERE above), 0) / sum(mass) AS chance FROM m GROUP BY host),
r AS (SELECT page_id, host, path, chance,
  CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM e JOIN c USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN chance > 0.95 THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
