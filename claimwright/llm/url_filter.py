"""URL filtering by empirical-Bayes host reputation.

Labelled pages give each host a count of bad ones.  A host's rate of bad pages has a beta
prior around the rate of its registered domain, that one around its suffix's, and that
one around the rate of all; the priors' strengths are fitted to how much the groups
differ (method of moments).  A page whose host's posterior rate is bad with confidence,
i.e. whose lower bound exceeds the cut, is blocked.  A host without labelled pages has its prior as its posterior: that of its
domain, else of its suffix, else of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.llm.scratch import cut

#: Block where the posterior rate's lower bound, so many deviations below its mean, exceeds the cut.
DEVIATIONS = 1.645
CUT = 0.5
#: Least and most prior pages, whatever the moments say.
STRENGTH = (2.0, 200.0)

#: Path rules (host, path, verdict) of the registered query: fixed values.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

#: Public suffixes of two labels, as far as the default goes; give a longer list where pages need it: fixed values.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "com.br", "com.cn", "co.in", "co.jp", "ne.jp", "or.jp", "co.kr", "com.mx", "co.nz", "com.tr", "com.tw", "co.za")


def host_of(url: str = "url") -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: str = "host", suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """A host's public suffix: its last two labels where `suffixes` lists them, else the last."""
    two = F.substring_index(F.col(host), ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(F.col(host), ".", -1))


def domain_of(host: str = "host", suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """A host's registered domain: its suffix and the label before it."""
    two = F.substring_index(F.col(host), ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(F.col(host), ".", -3)).otherwise(two)


def apply_rules(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """`pages` (with host and path) with the longest fitting rule and its verdict, or nulls.

    A rule fits its host and all subdomains if the path starts with the rule's.  Rules
    are configuration, not data: they become one expression of the plan.
    """
    best = F.lit(None).cast("string"), F.lit(None).cast("string")
    # the shortest first, so that a longer one that fits replaces it; among equals the last by name
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        best = F.when(fits, F.lit(host + path)).otherwise(best[0]), F.when(fits, F.lit(verdict)).otherwise(best[1])
    return pages.withColumn("rule", best[0]).withColumn("rule_verdict", best[1])


def _strength(groups: DataFrame, parent: str | None) -> DataFrame:
    """How many pages the prior of groups under `parent` weighs, from the spread of the groups' rates.

    With n pages, rate p and a parent rate m, the squared deviations of the groups, weighed
    by n, tell the spread beyond chance; the strength is m(1-m)/spread - 1.
    """
    keys = [parent] if parent else []
    agg = groups.groupBy(*keys).agg(
        F.sum("n").alias("N"), F.sum("bad").alias("B"), F.count("*").alias("G"),
        F.sum(F.col("n") * F.col("n")).cast("double").alias("N2"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("S"),
    )
    mean = F.col("B") / F.col("N")
    chance = mean * (1 - mean)
    # between-group variance by moments: (sum n (p-m)^2 - (G-1) m(1-m)) / (N - N2/N)
    spread = (F.col("S") - F.col("B") * mean - (F.col("G") - 1) * chance) / F.when(F.col("N") > F.col("N2") / F.col("N"), F.col("N") - F.col("N2") / F.col("N"))
    fitted = F.when(F.col("G") < 2, STRENGTH[0]).when(spread > 0, chance / spread - 1).otherwise(STRENGTH[1])
    return agg.select(*keys, F.least(F.greatest(F.coalesce(fitted, F.lit(STRENGTH[0])), F.lit(STRENGTH[0])), F.lit(STRENGTH[1])).alias("strength"))


def reputations(labelled: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> dict[str, DataFrame]:
    """The posterior rates of bad pages: hosts, domains, suffixes and all, each with its key, mean and weight.

    labelled: host and outcome (1 bad, 0 good; null rows are no evidence).  A host's
    prior is its domain's posterior mean, whose prior is its suffix's, whose prior is the
    rate of all labelled pages.  weight is what a host's bound goes by: its pages and its
    prior's strength; of the other levels the strength that a host without pages has.
    """
    hosts = labelled.filter("outcome IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), F.sum("outcome").cast("long").alias("bad"))
    # a row a host, which all levels are made of
    hosts = cut(hosts.withColumn("domain", domain_of("host", suffixes)).withColumn("suffix", suffix_of("host", suffixes)))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # of one row: the rate of all labelled pages and the strength of the suffixes' prior
    every = tops.agg((F.sum("bad") / F.sum("n")).alias("mean"), F.lit(1).alias("all"))
    every = every.join(F.broadcast(_strength(tops, None).withColumn("all", F.lit(1))), "all").filter("mean IS NOT NULL").withColumnRenamed("strength", "weight")
    posterior = (F.col("bad") + F.col("prior") * F.col("strength")) / (F.col("n") + F.col("strength"))
    above = lambda rates, key: rates.select(key, F.col("mean").alias("prior"), F.col("weight").alias("strength"))
    top_rates = tops.withColumn("all", F.lit(1)).join(F.broadcast(above(every, "all")), "all").withColumn("mean", posterior)
    top_rates = top_rates.join(_strength(domains, "suffix").withColumnRenamed("strength", "weight"), "suffix").select("suffix", "mean", "weight")
    domain_rates = domains.join(above(top_rates, "suffix"), "suffix").withColumn("mean", posterior)
    domain_rates = domain_rates.join(_strength(hosts, "domain").withColumnRenamed("strength", "weight"), "domain").select("domain", "mean", "weight")
    host_rates = hosts.join(above(domain_rates, "domain"), "domain").withColumn("mean", posterior).withColumn("weight", F.col("n") + F.col("strength"))
    return {"host": host_rates.select("host", "n", "bad", "prior", "mean", "weight"), "domain": domain_rates, "suffix": top_rates, "all": every.select("all", "mean", "weight")}


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, mean, bound for every row of `pages`.

    pages: page_id, url; other columns are ignored.  labelled: host, outcome; by default
    the pages that a rule decides, blocked ones bad.  A rule's verdict holds; any other
    page is blocked if its host's lower bound exceeds the cut.  A host without labelled
    pages is judged by its domain's rate, else by its suffix's, else by that of all
    labelled pages; without any, all such pages are allowed.  A null url or one without
    `://` has an empty host and path, no rule and no reputation, and is allowed.
    Repeated rows are each answered.
    """
    parsed = apply_rules(pages.select("page_id", host_of().alias("host"), path_of().alias("path")), rules)
    if labelled is None:
        labelled = parsed.filter("rule IS NOT NULL").select("host", (F.col("rule_verdict") == "block").cast("int").alias("outcome"))
    rates = reputations(labelled.filter("host <> ''"), suffixes)
    # hosts are few against pages: each host's rate is found once and joined to its pages
    found = parsed.select("host").filter("host <> ''").distinct().withColumn("domain", domain_of("host", suffixes)).withColumn("suffix", suffix_of("host", suffixes)).withColumn("all", F.lit(1))
    for level, table in rates.items():
        found = found.join(table.select(level, F.col("mean").alias(f"m_{level}"), F.col("weight").alias(f"w_{level}")), level, "left")
    found = found.select("host", *[F.coalesce(*[f"{x}_{level}" for level in rates]).alias(name) for x, name in (("m", "mean"), ("w", "weight"))])
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    judged = parsed.join(found.select("host", "mean", (F.col("mean") - DEVIATIONS * deviation).alias("bound")), "host", "left")
    verdict = F.coalesce(F.col("rule_verdict"), F.when(F.col("bound") > CUT, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mean", "bound")
