"""Operator 1: URL filtering by listed rules and, where none fits, by empirical-Bayes host reputation.

Pages with a known outcome (1 good, 0 bad) are counted per host, registered domain and suffix. Each level's good rate
has a beta prior centred on its parent's posterior mean; the prior's strength is fitted to the level's overdispersion, so
that sparse hosts lean on their domain, sparse domains on their suffix. A host whose posterior mean stays below one half
even with a margin of so many posterior standard deviations is blocked; every other host is allowed.

Defined results: a null url, or one without "://", has an empty host and path, which no rule fits; pages of hosts
without any outcome get their domain's or suffix's reputation; repeated rows count each time; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.shared import ascii_lower, written

#: (verdict, rule): a rule is a host, with its subdomains, and the start of a path.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Posterior standard deviations of margin, and the rate below which a host is bad.
MARGIN, LEAST = 1.64, 0.5
#: Bounds of the intra-class correlation, and what it is where a level has too few counts to tell.
LOW, HIGH, UNKNOWN = 0.001, 0.9, 0.05


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumn("host", ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_column(rules):
    """The longest rule that fits host and path, as struct(verdict, rule), or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit("/" + path))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def domain_of(host):
    return F.substring_index(host, ".", -2)


def suffix_of(host):
    return F.substring_index(host, ".", -1)


def strength(level: DataFrame) -> float:
    """Prior counts of a level's beta prior, from (n, s, centre): Pearson's chi-square over what a binomial would give."""
    m = F.col("centre")
    chi = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - m, F.lit(2)) / (m * (1 - m)))
    r = level.where("n > 0").agg(((chi - F.count("n")) / F.sum(F.col("n") - 1)).alias("rho")).first()
    rho = UNKNOWN if r.rho is None else min(HIGH, max(LOW, r.rho))
    return 1 / rho - 1


def host_reputation(hosts: DataFrame, outcomes: DataFrame, margin: float = MARGIN, least: float = LEAST) -> DataFrame:
    """hosts (host) and outcomes (host, good) to host, n, mean, upper, verdict. One row per distinct host."""
    counts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.sum("good").alias("s"))
    per_host = hosts.select("host").distinct().join(counts, "host", "left").fillna(0, ["n", "s"])
    per_host = per_host.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))).cache()
    per_domain = per_host.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).cache()
    per_suffix = per_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).cache()
    total = per_suffix.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    root = ((total.s or 0) + 1.0) / ((total.n or 0) + 2.0)

    def shrunk(level: DataFrame) -> tuple[DataFrame, float]:
        k = strength(level)
        return level.withColumn("mean", (F.col("s") + k * F.col("centre")) / (F.col("n") + k)), k

    suffixes, _ = shrunk(per_suffix.withColumn("centre", F.lit(root)))
    domains, _ = shrunk(per_domain.join(suffixes.select("suffix", F.col("mean").alias("centre")), "suffix"))
    hosts, k = shrunk(per_host.join(domains.select("domain", F.col("mean").alias("centre")), "domain"))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + k + 1))
    hosts = hosts.withColumn("upper", F.col("mean") + margin * deviation)
    return hosts.select("host", "n", "mean", "upper", F.when(F.col("upper") < least, "block").otherwise("allow").alias("reputed"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """pages (page_id, url) and outcomes (url, good) to page_id, host, path, rule, verdict, and the host's reputation."""
    parts = with_parts(pages.select("page_id", "url"))
    known = with_parts(outcomes.select("url", "good")).select("host", "good")
    # A table of its own, so that a host with very many pages can be split in the join.
    reputed = written(host_reputation(parts, known))
    ruled = parts.withColumn("found", rule_column(rules))
    verdict = F.coalesce(F.col("found.verdict"), F.col("reputed"))
    return ruled.join(reputed, "host").select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), F.round("mean", 9).alias("host_mean"))


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, good): a page shows the document whose number ends its path, and has that document's quality label."""
    shown = with_parts(pages.select("url")).select("url", F.expr("try_cast(regexp_extract(path, '/([0-9]{1,18})(?:/|[.]html)?$', 1) AS BIGINT)").alias("doc_id"))
    quality = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("good"))
    return shown.join(quality, "doc_id").select("url", "good")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return judge(pages, labelled_outcomes(pages, labels))


OP1_SQL = r"""
WITH p AS (
    SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
    SELECT page_id, url, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p
), rules(verdict, rule, rhost, rpath) AS (
    VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), fit AS (
    SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
    FROM q JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
), o AS (
    SELECT host, quality AS good FROM q JOIN labels ON labels.doc_id = TRY_CAST(regexp_extract(path, '/([0-9]{1,18})(?:/|[.]html)?$', 1) AS BIGINT) WHERE quality IS NOT NULL
), h AS (
    SELECT host, coalesce(n, 0) AS n, coalesce(s, 0) AS s, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, string_split(host, '.')[-1] AS suffix
    FROM (SELECT DISTINCT host FROM q) LEFT JOIN (SELECT host, count(good) AS n, sum(good) AS s FROM o GROUP BY host) USING (host)
), d0 AS (SELECT suffix, domain, sum(n) AS n, sum(s) AS s FROM h GROUP BY ALL
), s0 AS (SELECT suffix, sum(n) AS n, sum(s) AS s FROM d0 GROUP BY ALL
), s1 AS (SELECT *, (SELECT (sum(s) + 1.0) / (sum(n) + 2.0) FROM s0) AS centre FROM s0
), sk AS (SELECT 1 / least(0.9, greatest(0.001, coalesce((sum(n * pow(s / n - centre, 2) / (centre * (1 - centre))) - count(*)) / nullif(sum(n - 1), 0), 0.05))) - 1 AS k FROM s1 WHERE n > 0
), s2 AS (SELECT suffix, (s + k * centre) / (n + k) AS mean FROM s1, sk
), d1 AS (SELECT d0.*, mean AS centre FROM d0 JOIN s2 USING (suffix)
), dk AS (SELECT 1 / least(0.9, greatest(0.001, coalesce((sum(n * pow(s / n - centre, 2) / (centre * (1 - centre))) - count(*)) / nullif(sum(n - 1), 0), 0.05))) - 1 AS k FROM d1 WHERE n > 0
), d2 AS (SELECT domain, (s + k * centre) / (n + k) AS mean FROM d1, dk
), h1 AS (SELECT h.*, mean AS centre FROM h JOIN d2 USING (domain)
), hk AS (SELECT 1 / least(0.9, greatest(0.001, coalesce((sum(n * pow(s / n - centre, 2) / (centre * (1 - centre))) - count(*)) / nullif(sum(n - 1), 0), 0.05))) - 1 AS k FROM h1 WHERE n > 0
), h2 AS (SELECT host, n, k, (s + k * centre) / (n + k) AS mean FROM h1, hk
), h3 AS (SELECT host, mean, CASE WHEN mean + 1.64 * sqrt(mean * (1 - mean) / (n + k + 1)) < 0.5 THEN 'block' ELSE 'allow' END AS reputed FROM h2
)
SELECT q.page_id, q.host, q.path, fit.rule, coalesce(fit.verdict, reputed) AS verdict, round(mean, 9) AS host_mean FROM q JOIN h3 USING (host) LEFT JOIN fit USING (page_id)
"""
