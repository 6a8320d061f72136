"""URL filters: host reputation by empirical Bayes, under explicit rules. DataFrame functions only.

The outcome of a labelled page is bad if its quality is 0. Bad rates are estimated from the top down: all pages,
public suffix, registered domain, host. At each level the units' rates follow a beta distribution around
their parent's posterior mean, whose strength (in pages) is found from all units' over-dispersion by the
method of moments; a unit's posterior mixes its own outcomes with that prior, so units with few labelled
pages stay near their parents. A page is blocked if its host's bad rate lies above the limit even at the
lower end of the posterior (mean less `sds` standard deviations). Rules come first: a rule names a host (and
all its subdomains) and the beginning of a path; of the rules that fit, the longest decides.

A null url, or one without "://", has an empty host and path, no rule, and the verdict of its posterior (the
suffix, domain and host "" are units like any other). Pages without a label have no outcome; labels that
repeat count by their worst quality; null page ids match no label. Without any label no page is blocked.
Counts are pre-aggregated by host, so a hot host is no task's alone. Further columns are kept; those named
host, path, rule, verdict, bad_mean and bad_low are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Own, materialize, number, table

#: verdict, host, beginning of the path
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Public suffixes of two labels that a registered domain lies under; all others have one.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.au", "org.uk")
LIMIT, SDS = 0.5, 1.645

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"^(?s)(?:(?!://).)*://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda n: F.coalesce(F.regexp_extract(url, _URL, n), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that decides, and its verdict; null if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def domains(host: Column) -> tuple[Column, Column]:
    """Public suffix and registered domain."""
    two = F.substring_index(host, ".", -2)
    suffix = F.when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))
    return suffix, F.when(two.isin(*LONG_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def _posterior(units: DataFrame, key: str, name: str) -> DataFrame:
    """units: key, n, bad, prior (the parent's mean). Adds mean and strength of each unit's posterior."""
    p = F.col("prior")
    excess = F.sum(F.when((p > 0) & (p < 1) & (F.col("n") > 0), (F.pow(F.col("bad") - F.col("n") * p, 2) / (p * (1 - p)) - F.col("n"))))
    spread = F.sum(F.when((p > 0) & (p < 1), F.col("n") * (F.col("n") - 1)))
    # Var(bad) = n p (1 - p) (1 + (n - 1) rho) gives rho, and 1 / rho - 1 is the prior's strength.
    rho = F.greatest(F.lit(0.001), F.least(F.lit(0.5), F.coalesce(F.try_divide(excess, spread.cast("double")), F.lit(0.001))))
    strength = number(units.agg((1 / rho - 1).alias("m")))
    mean = (F.col("bad") + strength * p) / (F.col("n") + strength)
    return units.select("*", mean.alias(f"{name}_mean"), (F.col("n") + strength).alias(f"{name}_strength"))


def reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """pages: page_id, host; labels: doc_id, quality. host, n, bad, bad_mean, bad_low for every host."""
    outcome = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"))
    marked = pages.join(outcome, pages.page_id == outcome.doc_id, "left")
    suffix, domain = domains(F.col("host"))
    hosts = marked.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).select("host", suffix.alias("suffix"), domain.alias("domain"), "n", "bad")
    # One row per host: pages are counted once, and all levels are found from what was counted.
    hosts = materialize(hosts, "hosts")
    total = number(hosts.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1.0)).alias("p")))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("prior", total)
    suffixes = _posterior(suffixes, "suffix", "s").select("suffix", F.col("s_mean").alias("prior"))
    by_domain = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix")
    by_domain = _posterior(by_domain, "domain", "d").select("domain", F.col("d_mean").alias("prior"))
    done = _posterior(hosts.join(by_domain, "domain"), "host", "h")
    m, k = F.col("h_mean"), F.col("h_strength")
    return done.select("host", "n", "bad", m.alias("bad_mean"), (m - SDS * F.sqrt(m * (1 - m) / (k + 1))).alias("bad_low"))


def judge(pages: DataFrame, labels: DataFrame, url: str = "url", page_id: str = "page_id", rules=RULES, limit: float = LIMIT, drop: tuple[str, ...] = ()) -> DataFrame:
    """pages with host, path, rule, verdict, bad_mean, bad_low."""
    own = Own(pages, ("host", "path", "rule", "verdict", "bad_mean", "bad_low", *drop))
    host, path = host_and_path(F.col(own.name(url)))
    columns = [f"c{i}" for i in own.kept]
    cut = own.df.select(*columns, F.col(own.name(page_id)).alias("page_id"), host.alias("host"), path.alias("path"))
    known = reputation(cut.select("page_id", "host"), labels).select("host", "bad_mean", "bad_low")
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_low") > limit, "block").otherwise("allow")
    judged = cut.join(known, "host").withColumns({"rule": rule, "verdict": F.coalesce(verdict, method)})
    return judged.select(*own.back(), "host", "path", "rule", "verdict", "bad_mean", "bad_low")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    def level(name: str, source: str, key: str, prior: str) -> str:
        return f"""
    {name}_m AS (SELECT 1 / greatest(0.001, least(0.5, coalesce(sum(CASE WHEN n > 0 THEN pow(bad - n * {prior}, 2) / ({prior} * (1 - {prior})) - n END)
        / nullif(sum(n * (n - 1)), 0), 0.001))) - 1 AS m FROM {source}),
    {name} AS (SELECT x.*, (bad + m * {prior}) / (n + m) AS {name}_mean, n + m AS {name}_k FROM {source} x, {name}_m),"""

    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    two = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)
    return f"""
    WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    c AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    o AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
    g AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, list_reverse(string_split(host, '.')) AS ls FROM c LEFT JOIN o ON page_id = doc_id GROUP BY host),
    h AS (SELECT host, n, bad, CASE WHEN len(ls) > 1 AND ls[2] || '.' || ls[1] IN ({two}) THEN 2 ELSE 1 END AS k, ls FROM g),
    hs AS (SELECT host, n, bad, array_to_string(list_reverse(ls[1:k]), '.') AS suffix, array_to_string(list_reverse(ls[1:k + 1]), '.') AS domain FROM h),
    total AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) AS p FROM hs),
    s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(p) AS prior FROM hs, total GROUP BY suffix),{level("s", "s0", "suffix", "prior")}
    d0 AS (SELECT domain, sum(hs.n) AS n, sum(hs.bad) AS bad, any_value(s_mean) AS prior FROM hs JOIN s USING (suffix) GROUP BY suffix, domain),{level("d", "d0", "domain", "prior")}
    h0 AS (SELECT host, hs.n, hs.bad, d_mean AS prior FROM hs JOIN d USING (domain)),{level("e", "h0", "host", "prior")}
    rules(v, rh, rp) AS (VALUES {rules}),
    f AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v FROM c, rules
          WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
    SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.v, CASE WHEN e_mean - {SDS} * sqrt(e_mean * (1 - e_mean) / (e_k + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
    FROM c JOIN e ON c.host = e.host LEFT JOIN f ON c.page_id = f.page_id"""


SQL = _sql()
