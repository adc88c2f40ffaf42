"""URL filter with empirical-Bayes host reputation (native).

Labelled page outcomes (good or bad) are counted per host. Each level's children
share a beta prior whose mean is the parent's posterior mean and whose strength
is estimated from the spread of the children's rates by the method of moments:
corpus -> suffix -> registered domain -> host. A parent speaks to a child without
the child's own outcomes, so none counts twice. A host is blocked when its bad
rate exceeds a limit with a set probability: the lower quantile of its beta
posterior is above the limit, which is asked as the posterior's mass up to the
limit (the incomplete beta function, as a continued fraction). Explicit allow and
block rules come first; the longest fitting one wins.

Only counts per host cross the network before the verdicts are joined back, so
a host with a third of all pages is summed on the map side; the counts are written
once, and the three strengths are single numbers. The join of pages with hosts is a
plain equi-join, broadcast when the host table is measured small and otherwise
split by adaptive skew handling.

Defined cases: a null url, or one without ``://``, has an empty host and path
(all such pages share the reputation of the empty host); pages without labels
inherit their host's; a host without labels has its domain's mean; no labels at
all block nothing; null ids never match a label; repeated rows count each time;
of rules of one length that fit, the last listed wins; urls of any length are
read whole; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldgrid.llm.common import UPPER, broadcast_if_small, materialise

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Second-level registries under which names are registered at the third level.
SECOND_LEVEL = ["ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk"]


@dataclass(frozen=True)
class Policy:
    max_bad_rate: float = 0.2
    tail: float = 0.05  # the chance of a lower rate that a blocked host may have
    z: float = 1.6448536269514722  # the normal quantile of the same tail, for posteriors beyond ``normal_from``
    normal_from: float = 20_000.0
    min_strength: float = 1.0
    max_strength: float = 1000.0


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where that is a known second-level registry."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(SECOND_LEVEL), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label before it; the host itself if there is none."""
    return F.when(F.size(F.split(suffix, r"\.")) == 2, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _strength(children: DataFrame, mean: Column, policy: Policy) -> float:
    """The prior strength that the spread of the children's rates around ``mean`` supports.
    Weighted moments: E[sum n (k/n - m)^2] = sum m(1-m) (1 + (n-1) rho) with rho = 1/(strength+1)."""
    rows = children.select(mean.alias("m"), F.col("n").cast("double").alias("n"), F.col("bad").cast("double").alias("bad")).filter("n > 0")
    off = F.col("bad") / F.col("n") - F.col("m")
    r = rows.agg(F.sum(F.col("n") * off * off).alias("s"), F.sum(F.expr("m * (1 - m)")).alias("w"), F.sum(F.expr("m * (1 - m) * (n - 1)")).alias("x")).first()
    if not r.x or r.s <= r.w:
        return policy.max_strength
    return min(max(r.x / (r.s - r.w) - 1, policy.min_strength), policy.max_strength)


STEPS = 200


def _ln_gamma(z: Column) -> Column:
    """Stirling's series eight places further on, and the recurrence back."""
    y = z + 8
    series = (y - 0.5) * F.ln(y) - y + F.lit(0.9189385332046727) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    back = z
    for k in range(1, 8):
        back = back * (z + k)
    return series - F.ln(back)


def with_mass_below(df: DataFrame, limit: float, name: str) -> DataFrame:
    """df(alpha, beta) with the mass of the beta distribution up to ``limit``. The coefficients of the continued fraction are a
    stored array, which one pass folds; on the side of the mean where it converges fast the complement is taken."""
    x, a, b = F.lit(limit), F.col("alpha"), F.col("beta")
    straight = x < (a + 1) / (a + b + 2)
    df = df.withColumn("_i", straight).withColumn("_a", F.when(straight, a).otherwise(b)).withColumn("_b", F.when(straight, b).otherwise(a)).withColumn("_x", F.when(straight, x).otherwise(1 - x))
    a, b, x = F.col("_a"), F.col("_b"), F.col("_x")

    def coefficient(j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return F.when(j % 2 == 0, even).otherwise(-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

    df = df.withColumn("_k", F.transform(F.sequence(F.lit(1), F.lit(2 * STEPS)), coefficient))
    start = F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("d"), F.lit(1.0).alias("h"))
    step = lambda s, k: F.struct((1 + k / s.c).alias("c"), (1 / (1 + k * s.d)).alias("d"), (s.h * (1 + k / s.c) / (1 + k * s.d)).alias("h"))
    front = F.exp(_ln_gamma(a + b) - _ln_gamma(a) - _ln_gamma(b) + a * F.ln(x) + b * F.ln(1 - x)) / a
    part = front / F.aggregate("_k", start, step, lambda s: s.h)
    return df.withColumn(name, F.when(F.col("_i"), part).otherwise(1 - part)).drop("_i", "_a", "_b", "_x", "_k")


def host_reputation(hosts: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """hosts(host, n, bad) -> host, n, bad, bad_mean, bad_tail (the chance that the rate is within the limit) and blocked."""
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = materialise(hosts.groupBy("domain", "suffix").agg(*sums), "domains")
    suffixes = materialise(domains.groupBy("suffix").agg(*sums), "suffixes")
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    up = lambda df, key, p: df.select(key, F.col("n").alias(f"n_{p}"), F.col("bad").alias(f"bad_{p}"))
    # each mean leaves out the outcomes of the row itself
    corpus = (F.lit(total.bad) - F.col("bad") + 0.5) / (F.lit(total.n) - F.col("n") + 1)
    in_parent = lambda k, prior, p: (k * prior + F.col(f"bad_{p}") - F.col("bad")) / (k + F.col(f"n_{p}") - F.col("n"))
    k1 = _strength(suffixes, corpus, policy)
    below_suffix = domains.join(up(suffixes, "suffix", "s"), "suffix")
    k2 = _strength(below_suffix, in_parent(k1, corpus, "s"), policy)
    below = hosts.join(up(domains, "domain", "d"), "domain").join(up(suffixes, "suffix", "s"), "suffix")
    below = below.withColumn("m", in_parent(k2, in_parent(k1, corpus, "s"), "d"))
    k3 = _strength(below, F.col("m"), policy)
    posterior = below.select("host", "n", "bad", (k3 * F.col("m") + F.col("bad")).alias("alpha"), (k3 * (1 - F.col("m")) + F.col("n") - F.col("bad")).alias("beta"))
    size = F.col("alpha") + F.col("beta")
    mean = F.col("alpha") / size
    sd = F.sqrt(F.col("alpha") * F.col("beta") / (size * size * (size + 1)))
    sure = F.when(size > policy.normal_from, mean - policy.z * sd > policy.max_bad_rate).otherwise(F.col("bad_tail") < policy.tail)
    return with_mass_below(posterior, policy.max_bad_rate, "bad_tail").select("host", "n", "bad", mean.alias("bad_mean"), "bad_tail", sure.alias("blocked"))


def judge_pages(pages: DataFrame, outcomes: DataFrame, rules=RULES, policy: Policy = Policy()) -> DataFrame:
    """pages(page_id, url), outcomes(page_id, n, bad) -> a verdict for every page."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labelled = parts.select("page_id", "host").join(outcomes, "page_id", "left")
    hosts = labelled.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = materialise(hosts, "hosts")
    seen = materialise(host_reputation(hosts, policy).withColumnsRenamed({"n": "host_labels", "bad": "host_bad"}), "reputation")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("blocked"), "block").otherwise("allow")
    return parts.join(broadcast_if_small(seen), "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learnt).alias("verdict"), "host_labels", "host_bad")


def outcomes_from_labels(labels: DataFrame) -> DataFrame:
    """A page's outcome is the quality label of the same number: bad when quality is 0."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return known.groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n"), F.sum((F.col("quality") == 0).cast("long")).alias("bad"))


ORACLE_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages
), o AS (
  SELECT doc_id AS page_id, count(*) AS n, sum((quality = 0)::BIGINT) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), h AS (
  SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM p LEFT JOIN o USING (page_id) GROUP BY host
), h2 AS (
  SELECT *, CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ('ac.uk','co.in','co.jp','co.kr','co.nz','co.uk','co.za','com.ar','com.au','com.br','com.cn','com.mx','com.tr','gov.uk','ne.jp','net.au','or.jp','org.au','org.uk')
    THEN 2 ELSE 1 END AS w FROM h
), h3 AS (
  SELECT *, array_to_string(string_split(host, '.')[-w:], '.') AS suffix, array_to_string(string_split(host, '.')[-(w + 1):], '.') AS domain FROM h2
), d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h3 GROUP BY domain, suffix
), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix
), t AS (SELECT sum(n) AS n, sum(bad) AS bad FROM s
), s1 AS (SELECT s.*, (t.bad - s.bad + 0.5) / (t.n - s.n + 1) AS m FROM s, t
), k1 AS (SELECT greatest(1.0, least(1000.0, CASE WHEN sum(m * (1 - m) * (n - 1)) <> 0 AND sum(n * (bad / n - m) ** 2) > sum(m * (1 - m))
    THEN sum(m * (1 - m) * (n - 1)) / (sum(n * (bad / n - m) ** 2) - sum(m * (1 - m))) - 1 ELSE 1000.0 END)) AS k FROM s1 WHERE n > 0
), d1 AS (SELECT d.*, (k * (t.bad - d.bad + 0.5) / (t.n - d.n + 1) + s.bad - d.bad) / (k + s.n - d.n) AS m FROM d JOIN s USING (suffix), t, k1
), k2 AS (SELECT greatest(1.0, least(1000.0, CASE WHEN sum(m * (1 - m) * (n - 1)) <> 0 AND sum(n * (bad / n - m) ** 2) > sum(m * (1 - m))
    THEN sum(m * (1 - m) * (n - 1)) / (sum(n * (bad / n - m) ** 2) - sum(m * (1 - m))) - 1 ELSE 1000.0 END)) AS k FROM d1 WHERE n > 0
), h4 AS (
  SELECT h3.host, h3.n, h3.bad, (k2.k * (k1.k * (t.bad - h3.bad + 0.5) / (t.n - h3.n + 1) + s.bad - h3.bad) / (k1.k + s.n - h3.n) + d.bad - h3.bad) / (k2.k + d.n - h3.n) AS m
  FROM h3 JOIN d USING (domain) JOIN s ON s.suffix = h3.suffix, t, k1, k2
), k3 AS (SELECT greatest(1.0, least(1000.0, CASE WHEN sum(m * (1 - m) * (n - 1)) <> 0 AND sum(n * (bad / n - m) ** 2) > sum(m * (1 - m))
    THEN sum(m * (1 - m) * (n - 1)) / (sum(n * (bad / n - m) ** 2) - sum(m * (1 - m))) - 1 ELSE 1000.0 END)) AS k FROM h4 WHERE n > 0
), ab AS (SELECT host, n, bad, k * m + bad AS a0, k * (1 - m) + n - bad AS b0 FROM h4, k3
), ab2 AS (
  SELECT *, 0.2 < (a0 + 1) / (a0 + b0 + 2) AS straight, CASE WHEN straight THEN a0 ELSE b0 END AS a, CASE WHEN straight THEN b0 ELSE a0 END AS b, CASE WHEN straight THEN 0.2::DOUBLE ELSE 0.8::DOUBLE END AS x FROM ab
), cf AS (
  SELECT host, a, b, x, 0 AS j, 1.0::DOUBLE AS c, 0.0::DOUBLE AS e, 1.0::DOUBLE AS f FROM ab2
  UNION ALL
  SELECT host, a, b, x, j, 1 + q / c, 1 / (1 + q * e), f * (1 + q / c) / (1 + q * e) FROM (
    SELECT host, a, b, x, c, e, f, j + 1 AS j, ((j + 1) // 2)::DOUBLE AS m,
      CASE WHEN (j + 1) % 2 = 0 THEN m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) ELSE -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) END AS q
    FROM cf WHERE j < 400)
), g AS (
  SELECT ab2.*, exp(lgamma(ab2.a + ab2.b) - lgamma(ab2.a) - lgamma(ab2.b) + ab2.a * ln(ab2.x) + ab2.b * ln(1 - ab2.x)) / ab2.a / f AS part FROM ab2 JOIN cf USING (host) WHERE j = 400
), v AS (
  SELECT host, n, bad, CASE WHEN CASE WHEN a0 + b0 > 20000 THEN a0 / (a0 + b0) - 1.6448536269514722 * sqrt(a0 * b0 / ((a0 + b0) * (a0 + b0) * (a0 + b0 + 1))) > 0.2
    ELSE CASE WHEN straight THEN part ELSE 1 - part END < 0.05 END THEN 'block' ELSE 'allow' END AS learnt FROM g
), r AS (
  SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) r(kind, rh, rp)
), u AS (
  SELECT host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(kind, length(rh || rp)) AS kind
  FROM (SELECT DISTINCT host, path FROM p) q JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(kind, learnt) AS verdict, n::BIGINT AS host_labels, bad::BIGINT AS host_bad
FROM p LEFT JOIN u USING (host, path) LEFT JOIN v USING (host)
"""
