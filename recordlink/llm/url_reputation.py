"""URL filter: listed rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (good or bad) are counted per host, registered domain and
suffix. Each level's rate is shrunk towards the level above through a beta-binomial
prior whose concentration is estimated from the spread of the level's units:

    suffix <- all pages, domain <- suffix, host <- domain

A host's posterior is Beta(a, b). A page is blocked only if even the upper bound of
its host's share of good pages, mean + z * deviation, is below ``min_good``. Hosts
without labels have the posterior that their domain or suffix gives them.

Only DataFrame functions run. The counts are partial sums; the host with a third of
all pages is joined by broadcast (``join_group_facts``), the others by shuffle.

Defined cases: a url that is null or has no ``://`` has an empty host and path and is
judged like the host ''; null labels and labels of no page are ignored; a page labelled
several times is bad if any label says so; repeated pages count each; no labels at all
leave the prior mean 1/2, which blocks nothing. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlink.llm.common import ascii_lower, only, table
from recordlink.operators.ordering import join_group_facts


@dataclass(frozen=True)
class Rule:
    """A listed verdict for a host with its subdomains and a prefix of the path."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# fixed values: the rules of the contract
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)

# Suffixes of two labels under which names are registered; extend as needed.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")

MIN_GOOD = 0.5
Z = 1.645
# Bounds and default of the correlation of outcomes within a unit.
LEAST_RHO, MOST_RHO, DEFAULT_RHO = 0.001, 0.5, 0.1


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(found), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule], what: str) -> Column:
    """``text`` or ``verdict`` of the longest rule that fits, else null."""
    chosen: Column = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = (host == rule.host) | host.endswith("." + rule.host)
        chosen = F.when(fits & path.startswith(rule.path), getattr(rule, what)).otherwise(chosen)
    return chosen


def suffix_and_domain(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """The public suffix and the registered domain; an IPv4 address is its own domain."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    last_two = F.substring_index(name, ".", -2)
    wide = last_two.isin(*two_label)
    address = name.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    suffix = F.when(address, "ip").when(wide, last_two).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(address, name).when(wide, F.substring_index(name, ".", -3)).otherwise(last_two)
    return suffix, domain


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages with ``good``: 1, 0 or null. A label belongs to the page of the same id."""
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    known = labels.where(F.col("quality").isNotNull() | F.col("toxic").isNotNull())
    judged = known.groupBy(F.col("doc_id").alias("page_id")).agg((1 - bad).alias("good"))
    return only(pages, "page_id", "url").join(judged, "page_id", "left")


def _concentration(units: DataFrame, rate: str) -> Column:
    """Prior weight, in pages, from how far the units stray from the rate above them."""
    p = F.col(rate)
    usable = (p > 0) & (p < 1) & (F.col("n") > 0)
    spread = F.sum(F.when(usable, (F.col("k") - F.col("n") * p) ** 2 / (p * (1 - p))))
    pages = F.sum(F.when(usable, F.col("n")))
    pairs = F.sum(F.when(usable, F.col("n") * (F.col("n") - 1.0)))
    rho = F.when(pairs > 0, (spread - pages) / pairs).otherwise(F.lit(DEFAULT_RHO))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(DEFAULT_RHO)), F.lit(LEAST_RHO)), F.lit(MOST_RHO))
    return (1 - rho) / rho


def _shrunk(units: DataFrame, rate: str) -> DataFrame:
    """Add ``a`` and ``b`` of each unit's posterior, given the rate above it."""
    weight = units.agg(_concentration(units, rate).alias("weight"))
    return (
        units.crossJoin(F.broadcast(weight))  # one row
        .withColumn("a", F.col("weight") * F.col(rate) + F.col("k"))
        .withColumn("b", F.col("weight") * (1 - F.col(rate)) + F.col("n") - F.col("k"))
        .withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))
        .drop("weight")
    )


def host_reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """One row per host: ``n_pages``, ``n_labelled``, ``good_mean``, ``good_upper``."""
    host = url_host(F.col("url"))
    hosts = outcomes.groupBy(host.alias("host")).agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count("good").alias("n"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("k"),
    )
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = hosts.withColumns({"suffix": suffix, "domain": domain})

    def sums(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    overall = hosts.agg(((F.sum("k") + 1.0) / (F.sum("n") + 2.0)).alias("rate"))
    domains = sums(hosts, "suffix", "domain")
    suffixes = sums(domains, "suffix").crossJoin(F.broadcast(overall))  # one row
    suffixes = _shrunk(suffixes, "rate").select("suffix", F.col("mean").alias("rate"))
    domains = _shrunk(domains.join(suffixes, "suffix"), "rate")
    domains = domains.select("suffix", "domain", F.col("mean").alias("rate"))
    a, b = F.col("a"), F.col("b")
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return _shrunk(hosts.join(domains, ["suffix", "domain"]), "rate").select(
        "host",
        "n_pages",
        F.col("n").alias("n_labelled"),
        F.round("mean", 6).alias("good_mean"),
        F.round(F.col("mean") + z * deviation, 6).alias("good_upper"),
    )


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[Rule] = RULES,
    min_good: float = MIN_GOOD,
    z: float = Z,
) -> DataFrame:
    """Every page with host, path, the rule that fits, the reputation and the verdict."""
    reputation = host_reputation(page_outcomes(pages, labels), z)
    url = F.col("url")
    rows = only(pages, "page_id", "url").withColumns({"host": url_host(url), "path": url_path(url)})
    joined = join_group_facts(rows, reputation, ["host"], "n_pages")
    host, path = F.col("host"), F.col("path")
    by_method = F.when(F.col("good_upper") < min_good, "block").otherwise("allow")
    return joined.select(
        "page_id",
        "host",
        "path",
        rule_for(host, path, rules, "text").alias("rule"),
        F.coalesce(rule_for(host, path, rules, "verdict"), by_method).alias("verdict"),
        "n_labelled",
        "good_mean",
        "good_upper",
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


_TWO = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)


def _sql_level(name: str, source: str) -> str:
    """Posterior of each unit of ``source`` (columns n, k, rate), as ``_shrunk`` does it."""
    usable = "FILTER (WHERE rate > 0 AND rate < 1 AND n > 0)"
    return f"""
{name}_rho AS (
  SELECT least(greatest(coalesce(CASE WHEN sum(n * (n - 1.0)) {usable} > 0
      THEN (sum((k - n * rate) ** 2 / (rate * (1 - rate))) {usable} - sum(n) {usable})
           / sum(n * (n - 1.0)) {usable} END, {DEFAULT_RHO}), {LEAST_RHO}), {MOST_RHO}) AS rho
  FROM {source}),
{name} AS (
  SELECT *, (1 - rho) / rho * rate + k AS a, (1 - rho) / rho * (1 - rate) + n - k AS b
  FROM {source}, {name}_rho)"""


OP2_SQL = f"""
WITH parsed AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
judged AS (
  SELECT doc_id, 1 - max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS good
  FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
host_counts AS (
  SELECT host, count(good) AS n, coalesce(sum(good), 0) AS k,
    regexp_replace(host, ':[0-9]*$', '') AS name
  FROM parsed LEFT JOIN judged ON page_id = doc_id GROUP BY host),
named AS (
  SELECT *, string_split(name, '.') AS parts,
    array_to_string(string_split(name, '.')[-2:], '.') AS last_two,
    regexp_matches(name, '^[0-9]+(\\.[0-9]+){{3}}$') AS address FROM host_counts),
hosts AS (
  SELECT host, n, k,
    CASE WHEN address THEN 'ip' WHEN last_two IN ({_TWO}) THEN last_two ELSE parts[-1] END AS suffix,
    CASE WHEN address THEN name WHEN last_two IN ({_TWO})
      THEN array_to_string(parts[-3:], '.') ELSE last_two END AS domain
  FROM named),
domain_counts AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffix_counts AS (
  SELECT suffix, sum(n) AS n, sum(k) AS k,
    (SELECT (sum(k) + 1.0) / (sum(n) + 2.0) FROM hosts)::DOUBLE AS rate
  FROM domain_counts GROUP BY suffix),
{_sql_level("suffixes", "suffix_counts")},
domain_rates AS (
  SELECT d.*, a / (a + b) AS rate FROM domain_counts d JOIN suffixes s USING (suffix)),
{_sql_level("domains", "domain_rates")},
host_rates AS (
  SELECT h.*, a / (a + b) AS rate FROM hosts h JOIN domains d USING (suffix, domain)),
{_sql_level("posterior", "host_rates")},
reputation AS (
  SELECT host, n AS n_labelled, round(a / (a + b), 6) AS good_mean,
    round(a / (a + b) + {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) AS good_upper
  FROM posterior),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR suffix_of(host, '.www.example.com')) AND starts_with(path, '/en/')
      THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR suffix_of(host, '.example.com')) AND starts_with(path, '/en/')
      THEN 'example.com/en/'
    WHEN (host = 'net' OR suffix_of(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR suffix_of(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR suffix_of(host, '.com')) AND starts_with(path, '/') THEN 'com/'
    END AS rule FROM parsed)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN good_upper < {MIN_GOOD} THEN 'block' ELSE 'allow' END AS verdict,
  n_labelled, good_mean, good_upper
FROM ruled JOIN reputation USING (host)
""".replace("suffix_of(", "ends_with(")
