"""URL filter: rules first, else an empirical-Bayes reputation of the host
(DataFrame functions only).

Labelled outcomes (host, good) are counted per host, registered domain and
suffix. Each level's beta-binomial prior comes from the level above: the mean
is the parent's posterior mean, the weight is estimated from the spread of the
children by the method of moments (kept in 1..100). A host without labels thus
takes its domain's reputation, a new domain its suffix's, a new suffix the
overall one. A host is blocked if the upper bound of its posterior good rate,
mean + ``Z`` standard deviations, is below ``THRESHOLD``: blocking needs
evidence.

Rules are configuration, a list of at most ``MAX_RULES`` ``host/path`` strings;
they become one conditional expression, no join.

Edge cases: a null url or one without ``://`` has empty host and path, and the
empty host is judged like any other; no labelled outcomes: all unruled urls are
allowed (mean 1/2, wide bound); a null page_id passes; repeated pages are each
judged and each counted as an outcome. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import ascii_lower, written

Z = 1.645
THRESHOLD = 0.5
MAX_RULES = 1000
#: Fixed: second-level labels under which country domains are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule, the smaller text of equals; null if none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule = verdict = None
    for text, said in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        its_host, _, its_path = text.partition("/")
        fits = ((host == its_host) | host.endswith(f".{its_host}")) & path.startswith(f"/{its_path}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def suffix_of(host: Column) -> Column:
    """The last label, or the last two below a country's second-level label."""
    last = F.element_at(F.split(host, r"\."), -1)
    two = F.substring_index(host, ".", -2)
    second = F.substring_index(two, ".", 1)
    return F.when((F.length(last) == 2) & (two != host) & second.isin(*SECOND_LEVEL), two).otherwise(last)


def domain_of(host: Column, suffix: Column) -> Column:
    """The registered domain: the suffix and one label more, if there is one."""
    labels = F.size(F.split(suffix, r"\.")) + 1
    return F.when(labels == 2, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -3))


def _weight(children: DataFrame) -> float:
    """Prior weight of a level from its children's (n, good), by moments."""
    r = children.where("n > 0").agg(F.sum("n").alias("n"), F.sum("good").alias("g"), F.count("*").alias("m"),
                                    F.sum(F.col("good") * F.col("good") / F.col("n")).alias("gg")).first()
    if not r.n or r.m == r.n:
        return 1.0
    p = r.g / r.n
    if p in (0, 1):
        return 100.0
    between = (r.gg / r.n - p * p) / (p * (1 - p))
    rho = (between - (r.m - 1) / r.n) / (1 - r.m / r.n)
    return min(100.0, max(1.0, 1 / rho - 1)) if rho > 0 else 100.0


def host_reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """``outcomes`` (host, good 0/1/null): every host with n, good, posterior
    ``mean`` and ``upper`` bound of its good rate; null outcomes only name a host."""
    counts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    counts = counts.withColumn("suffix", suffix_of(F.col("host")))
    hosts = written(counts.withColumn("domain", domain_of(F.col("host"), F.col("suffix"))), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = ((total.good or 0) + 1) / ((total.n or 0) + 2)

    def mean(prior: Column, weight: float) -> Column:
        return (F.col("good") + prior * weight) / (F.col("n") + weight)

    suffixes = suffixes.select("suffix", mean(F.lit(overall), _weight(suffixes)).alias("suffix_mean"))
    domains = (domains.join(suffixes, "suffix")
               .select("domain", mean(F.col("suffix_mean"), _weight(domains)).alias("domain_mean")))
    weight = _weight(hosts)
    size = F.col("n") + weight
    out = hosts.join(domains, "domain").withColumn("mean", mean(F.col("domain_mean"), weight))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))
    return out.select("host", "domain", "suffix", "n", "good", "mean", (F.col("mean") + z * deviation).alias("upper"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict). The pages that a rule decides are
    the labelled outcomes (allow is good) from which the others' hosts are judged."""
    host, path = F.col("host"), F.col("path")
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matching_rule(host, path, rules)
    ruled = urls.withColumns({"rule": rule, "said": verdict})
    good = F.when(F.col("said") == "allow", 1).when(F.col("said") == "block", 0)
    reputation = host_reputation(ruled.select("host", good.cast("bigint").alias("good")))
    method = F.when(F.col("upper") < threshold, "block").otherwise("allow")
    return (ruled.join(reputation.select("host", "upper"), "host")
            .select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict")))
