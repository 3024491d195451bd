"""URL filtering: host and path rules, then empirical-Bayes host reputation.

A url that a rule decides keeps that verdict.  For the rest, labelled pages give each host
k bad outcomes among n.  Rates are shrunk by beta-binomial priors down the name's levels:
all pages to suffix, suffix to registered domain, domain to host.  The strength of each
prior (its number of pseudo-outcomes) is the moment estimate of how much the rates of
siblings differ, and at most the number of others' outcomes behind it; a level's prior leaves
out what the level itself has seen.  A host is blocked if the lower bound of its posterior bad rate, mean less
``z`` standard deviations, exceeds ``max_bad_rate``: few outcomes never block a host.

Outcome counts are pre-aggregated per host; only tables of host, domain and suffix counts
follow.  The host table joins the pages by broadcast if counted small, else by shuffle.

Defined results: null url, or none with ``://``, has empty host and path, and no rule fits;
hosts without outcomes have their domain's prior; labels of one id are merged, bad wins, null
labels count as good and labels with no page are ignored; repeated page rows stay; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritome.llm.common import LOWER, UPPER, broadcast_if_small, cut, table


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Fixed values of the production rule list.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
MAX_BROADCAST_HOSTS = 50_000
#: Bad rate to start from, as one pseudo-outcome.
BASE_RATE = 0.1
#: Prior strength is kept within these bounds.
KAPPA = (1.0, 10_000.0)


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null.  A rule list is code, a few dozen lines at most."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.host, r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, F.lit(r.host + r.path)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _strength(groups: DataFrame, k: str, n: str) -> float:
    """Moment estimate of the beta prior's pseudo-count over groups with k of n outcomes; one aggregate row."""
    p = F.col("k") / F.col("n")
    tot = groups.select(F.col(k).cast("double").alias("k"), F.col(n).cast("double").alias("n")).filter("n > 0")
    r = tot.agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("r"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * p * p).alias("npp")).first()
    return strength(r["k"] or 0.0, r["n"] or 0.0, r["r"], r["nn"] or 0.0, r["npp"] or 0.0)


def strength(k: float, n: float, groups: int, nn: float, npp: float) -> float:
    if n <= 0 or groups < 2 or k <= 0 or k >= n:
        return KAPPA[1]
    p = k / n
    spread = npp - n * p * p
    base, room = (groups - 1) * p * (1 - p), (n - nn / n - (groups - 1)) * p * (1 - p)
    rho = (spread - base) / room if room > 0 else 0.0
    return KAPPA[1] if rho <= 0 else min(KAPPA[1], max(KAPPA[0], 1 / rho - 1))


def host_reputation(outcomes: DataFrame, hosts: DataFrame, *, z: float = 1.645) -> DataFrame:
    """(host, n, k, mean, lower): posterior bad rate of each host from ``outcomes`` (host, n, k)."""
    every = hosts.select("host").unionByName(outcomes.select("host")).distinct().join(outcomes, "host", "left").na.fill(0, ["n", "k"])
    part = F.regexp_extract(F.col("host"), r"([^.]*)$", 1)
    named = cut(every.select("host", "n", "k", part.alias("suffix"), F.regexp_extract(F.col("host"), r"([^.]*\.[^.]*|[^.]*)$", 1).alias("domain")))
    domains = cut(named.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk")))
    suffixes = cut(domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk")))
    all_ = suffixes.agg(F.sum("sn").alias("n"), F.sum("sk").alias("k")).first()
    n, k = all_["n"] or 0, all_["k"] or 0
    k0, k1, k2 = _strength(suffixes, "sk", "sn"), _strength(domains, "dk", "dn"), _strength(named, "k", "n")
    # A prior is as strong as siblings are alike, but never stronger than the outcomes of others behind it.
    held = lambda kappa, others: F.least(F.lit(kappa), F.greatest(F.lit(1.0), others.cast("double")))
    root = (k - F.col("sk") + BASE_RATE) / (n - F.col("sn") + 1.0)
    suffixes = suffixes.select("suffix", "sn", "sk", root.alias("rm"), held(k0, n - F.col("sn")).alias("c0"))
    domains = domains.join(suffixes, "suffix").select(
        "domain", "dn", "dk", ((F.col("sk") - F.col("dk") + F.col("c0") * F.col("rm")) / (F.col("sn") - F.col("dn") + F.col("c0"))).alias("sm"), held(k1, F.col("sn") - F.col("dn")).alias("c1")
    )
    dm = (F.col("dk") - F.col("k") + F.col("c1") * F.col("sm")) / (F.col("dn") - F.col("n") + F.col("c1"))
    rows = named.join(domains, "domain").withColumn("dm", dm).withColumn("c2", held(k2, F.col("dn") - F.col("n")))
    a, b = F.col("k") + F.col("c2") * F.col("dm"), F.col("n") - F.col("k") + F.col("c2") * (1 - F.col("dm"))
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return rows.select("host", "n", "k", (a / (a + b)).alias("mean"), (a / (a + b) - z * sd).alias("lower"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES, max_bad_rate: float = 0.5, z: float = 1.645) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, bad_rate, bad_rate_lower.  ``outcomes``: (id, bad 0/1)."""
    host, path = host_path(pages[url_col].cast("string"))
    split = pages.select(pages[id_col].alias("_id"), host.alias("host"), path.alias("path"))
    bad = outcomes.groupBy(F.col(outcomes.columns[0]).alias("_id")).agg(F.max(F.coalesce(F.col(outcomes.columns[1]), F.lit(0))).cast("long").alias("bad"))
    counts = cut(split.join(bad, "_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")))
    reputation = cut(host_reputation(counts, counts, z=z).select("host", "mean", "lower"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = split.join(broadcast_if_small(reputation, MAX_BROADCAST_HOSTS), "host", "left")
    by_host = F.when(F.col("lower") > max_bad_rate, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), F.col("mean").alias("bad_rate"), F.col("lower").alias("bad_rate_lower"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    bad = labels.select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return filter_urls(table(spark, sf_dir, "pages"), bad).select("page_id", "host", "path", "rule", "verdict")


_STRENGTH = """SELECT CASE WHEN n <= 0 OR r < 2 OR k <= 0 OR k >= n THEN 10000.0::DOUBLE
  WHEN (n - nn / n - (r - 1)) * (k / n) * (1 - k / n) <= 0 OR npp - n * (k / n) * (k / n) - (r - 1) * (k / n) * (1 - k / n) <= 0 THEN 10000.0::DOUBLE
  ELSE least(10000.0::DOUBLE, greatest(1.0::DOUBLE, ((n - nn / n - (r - 1)) * (k / n) * (1 - k / n)) / (npp - n * (k / n) * (k / n) - (r - 1) * (k / n) * (1 - k / n)) - 1)) END AS kappa
  FROM (SELECT coalesce(sum({k}), 0)::DOUBLE AS k, coalesce(sum({n}), 0)::DOUBLE AS n, count(*)::DOUBLE AS r, sum({n}::DOUBLE * {n}) AS nn, sum({n} * ({k}::DOUBLE / {n}) * ({k}::DOUBLE / {n})) AS npp FROM {t} WHERE {n} > 0)"""

ORACLE = rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), bad AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), h AS (
  SELECT host, regexp_extract(host, '([^.]*)$', 1) AS suffix, regexp_extract(host, '([^.]*\.[^.]*|[^.]*)$', 1) AS domain,
    count(bad)::BIGINT AS n, coalesce(sum(bad), 0)::BIGINT AS k FROM p LEFT JOIN bad ON page_id = doc_id GROUP BY host
), d AS (SELECT suffix, domain, sum(n)::BIGINT AS dn, sum(k)::BIGINT AS dk FROM h GROUP BY ALL
), s AS (SELECT suffix, sum(dn)::BIGINT AS sn, sum(dk)::BIGINT AS sk FROM d GROUP BY ALL
), m AS (SELECT CASE WHEN sum(sn) > 0 THEN sum(sk)::DOUBLE / sum(sn) ELSE 0 END AS m FROM s
), k0 AS ({_STRENGTH.format(k="sk", n="sn", t="s")}
), k1 AS ({_STRENGTH.format(k="dk", n="dn", t="d")}
), k2 AS ({_STRENGTH.format(k="k", n="n", t="h")}
), c0 AS (SELECT suffix, sn, sk, (g.k - sk + 0.1) / (g.n - sn + 1.0) AS rm, least(k0.kappa, greatest(1.0, g.n - sn)) AS c0 FROM s, k0, (SELECT coalesce(sum(sn), 0)::DOUBLE AS n, coalesce(sum(sk), 0)::DOUBLE AS k FROM s) g
), c1 AS (SELECT domain, dn, dk, (sk - dk + c0 * rm) / (sn - dn + c0) AS sm, least(k1.kappa, greatest(1.0, sn - dn)::DOUBLE) AS c1 FROM d JOIN c0 USING (suffix), k1
), c2 AS (SELECT host, n, k, (dk - k + c1 * sm) / (dn - n + c1) AS dm, least(k2.kappa, greatest(1.0, dn - n)::DOUBLE) AS c2 FROM h JOIN c1 USING (domain), k2
), ab AS (SELECT host, k + c2 * dm AS a, n - k + c2 * (1 - dm) AS b FROM c2
), rep AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower_ FROM ab
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN lower_ > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN rep USING (host)
"""
