"""URL filters: rules first, then empirical-Bayes reputation of hosts.

Labelled page outcomes are counted by host. A host's rate of bad pages is shrunk towards
that of its registered domain, the domain's towards its suffix, the suffix's towards all
pages, through beta-binomial priors whose strength is fitted at each level by the method
of moments. A host is blocked when the lower bound of its posterior rate is above
``BLOCK_ABOVE``. The suffix is the last label of the host, or its last two where they are one
of ``TWO_LABEL_SUFFIXES``; the registered domain has one label more.

Rules are joined to hosts by their suffixes, so that their number is not bounded; each host
carries the rules that fit it, longest first, then first by text, then block before allow.

A url that is null or lacks "://" has an empty host and path and follows the rules and
reputation of the empty host. Null outcomes do not count; repeated labels of a page count
once, bad if any is. Repeated pages are judged one by one. Without any label no host is
blocked by reputation; empty tables give empty results. Only page_id, url and the named
label columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Rules of the query (fixed values): verdict and host/path.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]

BLOCK_ABOVE = 0.5
Z = 1.6448536269514722  # one-sided 95 %
LEAST_RHO, MOST_RHO, RHO_WITHOUT_DATA = 0.001, 0.5, 0.05
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Common public suffixes of two labels (fixed values).
TWO_LABEL_SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.hk", "com.mx", "com.my", "com.ng",
    "com.pe", "com.ph", "com.pk", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.br", "edu.cn", "go.jp", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br",
    "net.cn", "net.nz", "nhs.uk", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za", "sch.uk",
)
#: Hosts up to which their table is broadcast (some hundred bytes each); beyond it the join shuffles.
BROADCAST_HOSTS = 100_000


def split_url(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def _tail(labels: Column, n: Column | int) -> Column:
    """The last n labels (all, if fewer) with dots between."""
    n = F.least(F.size(labels), F.lit(n) if isinstance(n, int) else n)
    return F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")


def fitting(hosts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """host and its rules (verdict, host/path) best first, for the hosts that any rule fits."""
    cut = [(verdict, rule, rule.partition("/")[0], "/" + rule.partition("/")[2]) for verdict, rule in rules]
    table = hosts.sparkSession.createDataFrame(cut, "verdict string, rule string, rule_host string, rule_path string")
    labels = F.split("host", r"\.")
    ends = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: _tail(labels, n))).alias("rule_host"))
    one = F.struct((-F.length("rule")).alias("n"), "rule", (F.col("verdict") != "block").alias("allows"), "verdict", "rule_path")
    return ends.join(table, "rule_host").groupBy("host").agg(F.array_sort(F.collect_list(one)).alias("rules"))


def _rho(groups: DataFrame, parent: str) -> float:
    """Within-group correlation from Pearson's statistic against the parent's rate."""
    m = F.col(parent)
    x = F.col("n") * F.pow(F.col("bad") / F.col("n") - m, 2) / (m * (1 - m))
    pearson, g, n = groups.where("n > 0").agg(F.sum(x), F.count("*"), F.sum("n")).first()
    if not g or n <= g:
        return RHO_WITHOUT_DATA
    return min(MOST_RHO, max(LEAST_RHO, (pearson - g) / (n - g)))


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per host: n, bad (labelled pages), mean and lower (posterior rate and its bound).

    pages: host, page_id; outcomes: page_id, bad (boolean).
    """
    labelled = outcomes.where("bad is not null and page_id is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    counted = pages.join(labelled, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    labels = F.split("host", r"\.")
    size = F.when(_tail(labels, 2).isin(*TWO_LABEL_SUFFIXES), 2).otherwise(1)
    hosts = written(counted.withColumns({"suffix": _tail(labels, size), "domain": _tail(labels, size + 1)}), "hosts")
    n, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    root = (bad + 1.0) / (n + 2.0)

    level = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("p", F.lit(root))
    kappa = 1 / _rho(level, "p") - 1
    suffixes = level.select("suffix", ((F.col("bad") + kappa * F.col("p")) / (F.col("n") + kappa)).alias("p"))
    level = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix")
    kappa = 1 / _rho(level, "p") - 1
    domains = level.select("domain", ((F.col("bad") + kappa * F.col("p")) / (F.col("n") + kappa)).alias("p"))
    level = hosts.join(domains, "domain")
    kappa = 1 / _rho(level, "p") - 1
    a, total = F.col("bad") + kappa * F.col("p"), F.col("n") + kappa
    mean = a / total
    return level.select("host", "n", "bad", mean.alias("mean"), (mean - Z * F.sqrt(mean * (1 - mean) / (total + 1))).alias("lower"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, bad_rate, bad_rate_lower."""
    host, path = split_url(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = host_reputation(cut, outcomes).select("host", "mean", "lower")
    known = written(known.join(fitting(known.select("host"), rules if rules is not None else RULES), "host", "left"), "known")
    if known.count() <= BROADCAST_HOSTS:
        known = F.broadcast(known)
    by_reputation = F.when(F.col("lower") > BLOCK_ABOVE, "block").otherwise("allow")
    judged = cut.join(known, "host", "left").withColumn("best", F.get(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])), F.lit(0)))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", by_reputation).alias("verdict"), F.col("mean").alias("bad_rate"), F.col("lower").alias("bad_rate_lower"))


def outcomes_of_labels(labels: DataFrame) -> DataFrame:
    """Outcomes by the labels table: toxic or of low quality is bad; no label, no outcome."""
    bad = F.when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0))
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


def _level_sql(name: str, groups: str) -> str:
    """Strength of the prior of one level; groups has n, bad and the parent's rate p."""
    return f"""{name}_rho AS (
    SELECT CASE WHEN count(*) = 0 OR sum(n) <= count(*) THEN {RHO_WITHOUT_DATA}::DOUBLE
      ELSE least({MOST_RHO}::DOUBLE, greatest({LEAST_RHO}::DOUBLE, (sum(n * pow(bad / n::DOUBLE - p, 2) / (p * (1 - p))) - count(*)) / (sum(n) - count(*)))) END AS rho
    FROM {groups} WHERE n > 0),
  {name}_k AS (SELECT 1 / rho - 1 AS k FROM {name}_rho)"""


_SIZE = "CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN (" + ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES) + ") THEN 2 ELSE 1 END"
SQL = f"""
WITH outcome AS (
    SELECT doc_id AS page_id, max(CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END) AS bad
    FROM labels WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY 1),
  cut AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
      coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
  hosts AS (
    SELECT host, count(o.bad) AS n, coalesce(sum(o.bad), 0)::BIGINT AS bad, {_SIZE} AS size,
      array_to_string(string_split(host, '.')[-size:], '.') AS suffix, array_to_string(string_split(host, '.')[-(size + 1):], '.') AS domain
    FROM cut LEFT JOIN outcome o USING (page_id) GROUP BY host),
  root AS (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2.0::DOUBLE) AS p FROM hosts),
  s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(root.p) AS p FROM hosts, root GROUP BY suffix),
  {_level_sql("s", "s")},
  sp AS (SELECT suffix, (bad + k * p) / (n + k) AS p FROM s, s_k),
  d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(sp.p) AS p FROM hosts JOIN sp USING (suffix) GROUP BY domain, suffix),
  {_level_sql("d", "d")},
  dp AS (SELECT domain, (bad + k * p) / (n + k) AS p FROM d, d_k),
  h AS (SELECT host, n, bad, dp.p FROM hosts JOIN dp USING (domain)),
  {_level_sql("h", "h")},
  hp AS (SELECT host, (bad + k * p) / (n + k) AS mean, n + k AS total FROM h, h_k),
  rules AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)}) AS r(verdict, rule, rule_host, rule_path)),
  fit AS (
    SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
    FROM (SELECT DISTINCT host, path FROM cut) JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND prefix(path, rule_path) GROUP BY host, path)
SELECT page_id, cut.host, cut.path, fit.rule,
  coalesce(fit.verdict, CASE WHEN mean - {Z}::DOUBLE * sqrt(mean * (1 - mean) / (total + 1)) > {BLOCK_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict
FROM cut LEFT JOIN fit ON cut.host = fit.host AND cut.path = fit.path LEFT JOIN hp ON cut.host = hp.host
"""
