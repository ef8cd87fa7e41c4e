"""Empirical-Bayes host reputation for URL filters.

Labelled page outcomes are counted per site: the host without user name and port. A
beta prior for the rate of bad pages is fitted to all sites by moments; the suffix
(public ending) shrinks its counts to it, the registered domain to its suffix, and the
site to its domain. A page is blocked by the method when the lower bound of its site's
posterior lies above ``max_bad``. Fixed rules come first: the longest rule that fits host
and path decides.

A site without outcomes has the posterior of no counts: its domain's mean, else its
suffix's, else the global prior. An IP address is its own domain and suffix.

Defined cases: a null url or one without ``://`` has empty host and path and
falls under the global prior unless such pages have outcomes; pages without an outcome count in no rate; several
outcomes of a page count each; ties in rule length are broken by the rule's
text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Endings under which names are registered one level deeper (fixed values).
TWO_PART_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "org.uk")

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: A method's verdict needs this share of bad pages at the bound's lower end; z of the one-sided bound.
MAX_BAD, Z = 0.5, 1.645
#: Pseudo-counts with which the parent's mean enters a domain and a site.
DOMAIN_STRENGTH, HOST_STRENGTH = 20.0, 5.0
#: Least and most pseudo-counts of the fitted prior (where sites' rates differ much, and not at all).
LEAST, MOST = 2.0, 100.0


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) by the contract's rule."""
    after = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    rest = F.substr(url, F.length(after) + 4)
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1),
                                  "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def site_of(host: Column) -> Column:
    """The host without user name and port."""
    bare = F.regexp_replace(host, "^.*@", "")
    return F.regexp_replace(bare, r":[0-9]*$", "")


def is_address(site: Column) -> Column:
    return site.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | site.startswith("[")


def suffix_of(site: Column) -> Column:
    two = F.substring_index(site, ".", -2)
    return F.when(is_address(site), site).when(two.isin(*TWO_PART_SUFFIXES), two).otherwise(F.substring_index(site, ".", -1))


def domain_of(site: Column) -> Column:
    two = F.substring_index(site, ".", -2)
    return F.when(is_address(site), site).when(two.isin(*TWO_PART_SUFFIXES), F.substring_index(site, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def reputations(outcomes: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Posterior of every site from (host, bad) rows with bad 0 or 1, host being a site; columns
    host, n, bad, alpha, beta, lower. Sites of ``wanted`` (column host) without
    outcomes come with n = 0 if their domain or suffix has some. The last row has a
    null host: the global prior, for all others."""
    hosts = staged(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.sum("bad").alias("k"))
                   .where("n > 0").withColumn("domain", domain_of(F.col("host")))
                   .withColumn("suffix", suffix_of(F.col("host"))), "host_counts")
    prior = staged(global_prior(hosts), "host_prior")
    pa, pb = prior.select("a").scalar(), prior.select("b").scalar()
    up = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffix = (up.groupBy("suffix").agg(F.sum("n").alias("sn"), F.sum("k").alias("sk"))
              .select("suffix", ((pa + F.col("sk")) / (pa + pb + F.col("sn"))).alias("sm")))
    domain = (up.join(suffix, "suffix")
              .select("domain", "suffix", ((F.col("sm") * DOMAIN_STRENGTH + F.col("k"))
                                           / (F.col("n") + DOMAIN_STRENGTH)).alias("dm")))
    a = F.col("dm") * HOST_STRENGTH + F.col("k")
    b = (1 - F.col("dm")) * HOST_STRENGTH + F.col("n") - F.col("k")
    if wanted is not None:
        new = wanted.select("host").where("host <> ''").distinct().join(hosts.select("host"), "host", "left_anti")
        zero = F.lit(0).cast("long")
        hosts = hosts.unionByName(new.select("host", zero.alias("n"), zero.cast(hosts.schema["k"].dataType).alias("k"),
                                             domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")))
    own = (hosts.join(suffix, "suffix").join(domain, ["suffix", "domain"], "left")
           .withColumn("dm", F.coalesce("dm", "sm")))
    own = own.select("host", "n", F.col("k").alias("bad"), a.alias("alpha"), b.alias("beta"))
    rest = prior.select(F.lit(None).cast("string").alias("host"), F.lit(0).cast("long").alias("n"),
                        F.lit(0).cast("long").alias("bad"), F.col("a").alias("alpha"), F.col("b").alias("beta"))
    return own.union(rest).withColumn("lower", lower_bound(F.col("alpha"), F.col("beta")))


def global_prior(hosts: DataFrame) -> DataFrame:
    """One row (a, b): beta prior by moments over hosts weighted by their pages,
    with the sampling part taken off the variance; (1, 1) without outcomes. The
    strength is held between 2 and 100 pseudo-counts."""
    m = hosts.agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.count("*").alias("h"),
                  F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"))
    mean = F.col("k") / F.col("n")
    var = F.col("kk") / F.col("n") - mean * mean
    noise = mean * (1 - mean) * F.col("h") / F.col("n")
    left = F.greatest(var - noise, F.lit(1e-9))
    strength = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), mean * (1 - mean) / left - 1))
    return m.select(F.coalesce(mean * strength, F.lit(1.0)).alias("a"),
                    F.coalesce((1 - mean) * strength, F.lit(1.0)).alias("b"))


def lower_bound(a: Column, b: Column) -> Column:
    """Lower end of the one-sided posterior interval (normal approximation)."""
    mean = a / (a + b)
    return mean - Z * F.sqrt(mean * (1 - mean) / (a + b + 1))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """page_id, host, path, rule, verdict, lower of every page. Outcomes are the
    labels whose doc_id is the page's id: bad if toxic or of quality 0."""
    host, path = split_url(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("_site", site_of(F.col("host")))
    sites = p.select("page_id", F.col("_site").alias("host"))
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(
        F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    marks = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).where("bad is not null")
    rep = staged(reputations(sites.join(marks, "page_id").select("host", "bad"), sites), "host_reputation")
    other = rep.where("host is null").select("lower").scalar()
    known = rep.where("host is not null").select(F.col("host").alias("_host"), "lower")
    fit = rule_of(F.col("host"), F.col("path"), rules)
    lower = F.coalesce("lower", other)
    return (p.join(known, F.col("_site") == F.col("_host"), "left")
            .withColumn("_fit", fit)
            .select("page_id", "host", "path", F.col("_fit.rule").alias("rule"),
                    F.coalesce(F.col("_fit.verdict"), F.when(lower > max_bad, "block").otherwise("allow")).alias("verdict"),
                    lower.alias("lower")))


#: DuckDB: the same rows, written from the definition.
SQL = r"""
WITH r AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id, COALESCE(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         COALESCE(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
t AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site FROM p),
u AS (
  SELECT DISTINCT site, string_split(site, '.') AS parts,
    CASE WHEN regexp_matches(site, '^[0-9]{1,3}(\.[0-9]{1,3}){3}$') OR starts_with(site, '[') THEN 0
         WHEN array_to_string(string_split(site, '.')[-2:], '.') IN
           ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'org.uk') THEN 2 ELSE 1 END AS deep FROM t),
v AS (
  SELECT site, CASE deep WHEN 0 THEN site ELSE array_to_string(parts[-deep:], '.') END AS suffix,
         CASE deep WHEN 0 THEN site ELSE array_to_string(parts[-(deep + 1):], '.') END AS domain FROM u),
c AS (
  SELECT site, count(*)::DOUBLE AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END)::DOUBLE AS k
  FROM t JOIN labels ON page_id = doc_id WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY site),
d AS (SELECT * FROM c JOIN v USING (site)),
m AS (SELECT sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) AS sq, count(*) / sum(n) AS share FROM d),
g AS (
  SELECT COALESCE(mean * s, 1) AS pa, COALESCE((1 - mean) * s, 1) AS pb FROM (
    SELECT mean, greatest(2.0::DOUBLE, least(100.0::DOUBLE, mean * (1 - mean)
      / greatest(sq - mean * mean - mean * (1 - mean) * share, 1e-9::DOUBLE) - 1)) AS s FROM m)),
s AS (SELECT suffix, (any_value(pa) + sum(k)) / (any_value(pa) + any_value(pb) + sum(n)) AS sm FROM d, g GROUP BY suffix),
e AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k, any_value(sm) AS sm FROM d JOIN s USING (suffix) GROUP BY suffix, domain),
o AS (SELECT suffix, domain, (sm * 20 + k) / (n + 20) AS dm FROM e),
b AS (
  SELECT v.site,
    CASE WHEN v.site = '' AND c.n IS NULL OR s.sm IS NULL THEN pa ELSE COALESCE(dm, sm) * 5 + COALESCE(k, 0) END AS a,
    CASE WHEN v.site = '' AND c.n IS NULL OR s.sm IS NULL THEN pb
         ELSE (1 - COALESCE(dm, sm)) * 5 + COALESCE(n, 0) - COALESCE(k, 0) END AS b
  FROM v LEFT JOIN c USING (site) LEFT JOIN s ON v.suffix = s.suffix
    LEFT JOIN o ON v.suffix = o.suffix AND v.domain = o.domain, g),
x AS (SELECT site, a / (a + b) - 1.645::DOUBLE * sqrt(a * b / ((a + b) * (a + b)) / (a + b + 1)) AS lower FROM b),
f AS (
  SELECT t.*, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM t)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN x.lower > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM f JOIN x USING (site)
"""
