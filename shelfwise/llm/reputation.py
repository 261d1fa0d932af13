"""URL filter by empirical-Bayes host reputation, with rules that go first.

Labelled page outcomes (bad or not) are counted per host, registered domain and suffix.
Each level's share of bad pages is shrunk towards that of the level above by a
beta-binomial prior whose weight is estimated from how much the groups of that level
differ. A host is blocked if even the lower bound of its posterior share of bad pages
exceeds ``LIMIT``; hosts without labels fall back on their domain or suffix.

Host: what stands between the first ``://`` and ``/``, ``?`` or ``#``, A-Z lower-cased;
path: what follows up to ``?`` or ``#``; null and urls without ``://`` have both empty.
Only counts per host are shuffled; hot hosts are added up in the map tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

LIMIT, Z = 0.15, 1.645
#: Suffixes of two labels below which names are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    text: str  # host, then the beginning of the path, such as example.com/en/

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


#: The rules of the contract.
RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user, port and a dot at its end."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\.$", "")


def suffix_of(name: Column) -> Column:
    two = F.substring_index(name, ".", -2)
    ip = name.rlike(r"^[0-9.]+$|^\[")
    return F.when(ip, name).when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(name: Column, suffix: Column) -> Column:
    more = F.size(F.split(suffix, r"\.")) + 1
    return F.when(name == suffix, name).otherwise(F.array_join(F.slice(F.split(name, r"\."), -F.least(more, F.size(F.split(name, r"\."))), more), "."))


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct (length, rule, verdict); null if none does. A list held in the plan."""
    table_of = F.array(
        *(F.struct(F.lit(len(r.text)).alias("length"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.host).alias("host"), F.lit(r.path).alias("path")) for r in rules)
    )
    fits = F.filter(
        table_of,
        lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]),
    )
    return F.array_max(fits)


def weight(level: DataFrame) -> float:
    """Weight of the prior, in pages, from the counts (n, k) of a level's groups: the
    moment estimate of the beta-binomial, between 1 and 1e6."""
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    total = level.where("n > 0").agg(
        F.count(F.lit(1)).alias("m"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(n * n).alias("nn"), F.sum(k * k / n).alias("kk")
    ).first()
    if not total["m"] or total["m"] < 2 or not 0 < total["k"] < total["n"]:
        return 1.0 if total["m"] and total["m"] >= 2 else 1e6
    p = total["k"] / total["n"]
    spread = (total["kk"] - total["k"] ** 2 / total["n"]) / (p * (1 - p))
    free = total["m"] - 1
    room = total["n"] - total["nn"] / total["n"] - free
    rho = (spread - free) / room if room > 0 else 0.0
    return min(1e6, max(1.0, 1 / rho - 1)) if rho > 0 else 1e6


def reputation(hosts: DataFrame) -> DataFrame:
    """``hosts`` (host, n labelled, k bad) with share (posterior mean) and bound (its lower bound)."""
    name = name_of(F.col("host"))
    named = hosts.withColumn("suffix", suffix_of(name)).withColumn("domain", domain_of(name, F.col("suffix")))
    domains = named.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    every = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    root = ((every["k"] or 0) + 1) / ((every["n"] or 0) + 2)

    def shrunk(up: Column, w: float) -> Column:
        return (up * w + F.col("k")) / (F.col("n") + w)

    suffixes = suffixes.select("suffix", shrunk(F.lit(root), weight(suffixes)).alias("suffix_share"))
    domains = domains.join(suffixes, "suffix").select("suffix", "domain", shrunk(F.col("suffix_share"), weight(domains)).alias("domain_share"))
    w = weight(named)
    a = F.col("domain_share") * w + F.col("k")
    b = (1 - F.col("domain_share")) * w + F.col("n") - F.col("k")
    share = a / (a + b)
    bound = share - Z * F.sqrt(share * (1 - share) / (a + b + 1))
    return named.join(domains, ["suffix", "domain"]).select("host", share.alias("share"), bound.alias("bound"))


def url_verdicts(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, share and bound
    of its host. ``outcomes``: page_id, bad (0 or 1); null values do not count, and of
    several for one page the worst does."""
    url = F.col("url")
    cut = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    labelled = cut.select("page_id", "host").join(known, "page_id", "left")
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    judged = cut.withColumn("match", matched_rule(F.col("host"), F.col("path"), rules)).join(reputation(hosts), "host")
    method = F.when(F.col("bound") > LIMIT, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("match.rule").alias("rule"), F.coalesce("match.verdict", method).alias("verdict"), "share", "bound")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page is bad if the document that its path names (its first number) is labelled as of low quality."""
    number = F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') as bigint)")
    named = pages.select("page_id", path_of(F.col("url")).alias("path")).select("page_id", number.alias("doc_id")).where("doc_id is not null")
    bad = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    return named.join(bad, "doc_id").select("page_id", "bad")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_verdicts(pages, page_outcomes(pages, table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH cut AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
bad AS (SELECT doc_id, 1 - min(quality) AS bad FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
numbered AS (SELECT page_id, try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS bigint) AS doc_id FROM cut),
known AS (SELECT page_id, max(bad) AS bad FROM numbered JOIN bad USING (doc_id) WHERE page_id IS NOT NULL GROUP BY page_id),
hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k,
         CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN host ELSE split_part(host, '.', -1) END AS suffix
  FROM cut LEFT JOIN known USING (page_id) GROUP BY host),
named AS (
  SELECT *, CASE WHEN host = suffix THEN host ELSE split_part(host, '.', -2) || '.' || suffix END AS domain FROM hosts),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM named GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
levels AS (
  SELECT 'host' AS level, n, k FROM named UNION ALL SELECT 'domain', n, k FROM domains UNION ALL SELECT 'suffix', n, k FROM suffixes),
sums AS (
  SELECT level, count(*) AS m, sum(n) AS n, sum(k) AS k, sum(n * n)::DOUBLE AS nn, sum(k::DOUBLE * k / n) AS kk
  FROM levels WHERE n > 0 GROUP BY level),
spreads AS (
  SELECT level, m, n, k, (kk - k::DOUBLE * k / n) / nullif((k::DOUBLE / n) * (1 - k::DOUBLE / n), 0) AS spread, n - nn / n - (m - 1) AS room FROM sums),
weights AS (
  SELECT level,
         CASE WHEN m < 2 THEN 1e6 WHEN k = 0 OR k = n THEN 1.0
              WHEN room <= 0 OR spread - (m - 1) <= 0 THEN 1e6
              ELSE least(1e6, greatest(1.0, room / (spread - (m - 1)) - 1)) END AS w
  FROM spreads),
w AS (SELECT max(w) FILTER (level = 'host') AS wh, max(w) FILTER (level = 'domain') AS wd, max(w) FILTER (level = 'suffix') AS ws FROM weights),
root AS (SELECT (sum(k) + 1) / (sum(n) + 2)::DOUBLE AS r FROM suffixes),
s AS (SELECT suffix, (r * ws + k) / (n + ws) AS share FROM suffixes, w, root),
d AS (SELECT domains.suffix, domain, (s.share * wd + k) / (n + wd) AS share FROM domains JOIN s USING (suffix), w),
ab AS (SELECT host, d.share * wh + k AS a, (1 - d.share) * wh + n - k AS b FROM named JOIN d USING (suffix, domain), w),
judged AS (SELECT host, a / (a + b) - 1.645 * sqrt((a / (a + b)) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM ab),
rules(rule, rhost, rpath, verdict) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
  ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
fits AS (
  SELECT DISTINCT host, path, first_value(rule) OVER win AS rule, first_value(verdict) OVER win AS verdict
  FROM (SELECT DISTINCT host, path FROM cut) c JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  WINDOW win AS (PARTITION BY host, path ORDER BY length(rule) DESC))
SELECT page_id, cut.host, cut.path, fits.rule, coalesce(fits.verdict, CASE WHEN bound > 0.15 THEN 'block' ELSE 'allow' END) AS verdict
FROM cut JOIN judged USING (host) LEFT JOIN fits ON cut.host = fits.host AND cut.path = fits.path
"""
