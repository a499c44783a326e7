"""URL filter: listed rules first, else the reputation of the host by empirical Bayes.

Labelled pages give each host counts of good and all outcomes. Beta-binomial priors pull a host
towards its registered domain, a domain towards its suffix and a suffix towards the whole, each with
the strength that the spread of a level's groups around their own parents shows (moments of the nested
layout). A page is allowed when the lower bound of its host's posterior, mean less ``z`` deviations, reaches
``least``.

Hosts are counted before they are joined, so the tables of hosts, domains and suffixes are small
beside the pages; a host with a large share of the pages is split by adaptive execution in the last
join, whose right side has one row per host.

Defined results: a null url and one without ``://`` have empty host and path and share the reputation
of the empty host. Outcomes of a page id that occurs more than once are averaged; null ids and
outcomes are no outcomes. Without outcomes every host has the neutral prior of one good in two.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from egresslens.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Level to the one above it.
LEVELS = {"suffix": None, "domain": "suffix", "host": "domain"}


@dataclass(frozen=True)
class Params:
    z: float = 1.645
    least: float = 0.5
    #: Bounds of a prior's strength, in outcomes.
    weakest: float = 1.0
    strongest: float = 1000.0


def host_of(url: str = "url") -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest rule that fits, else null. A rule is a host, a slash and the start of a path."""
    found = F.lit(None).cast("string")
    for rule in sorted(set(rules), key=lambda r: (len(r), r)):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def domain_of(host: str = "host") -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: str = "host") -> Column:
    return F.substring_index(host, ".", -1)


def strength(groups: DataFrame, parent: str | None, params: Params) -> float:
    """Strength of the prior from groups with ``n`` outcomes, ``good`` of them, by the moments of the nested layout.

    Groups are spread around their own parent, so parents that differ do not make their groups look spread.
    """
    rate = F.col("good") / F.col("n")
    above = F.col(parent) if parent else F.lit("")
    parents = groups.filter("n > 0").groupBy(above.alias("parent")).agg(
        F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum("good").alias("good"),
        F.sum(F.col("good") * rate).alias("a"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    row = parents.agg(
        F.sum("g").alias("g"), F.count(F.lit(1)).alias("d"), F.sum("n").alias("n"), F.sum("good").alias("good"),
        F.sum("a").alias("a"), F.sum(F.col("good") * rate).alias("above"), F.sum(F.col("nn") / F.col("n")).alias("nn")).first()
    if not row["d"] or row["g"] == row["d"] or row["n"] <= row["g"]:
        return params.strongest
    free = row["g"] - row["d"]
    between = (row["a"] - row["above"]) / free
    within = (row["good"] - row["a"]) / (row["n"] - row["g"])
    size = (row["n"] - row["nn"]) / free
    spread = between + (size - 1) * within
    share = (between - within) / spread if spread > 0 else 0.0
    return min(params.strongest, max(params.weakest, 1 / share - 1)) if share > 0 else params.strongest


def reputation(pages: DataFrame, outcomes: DataFrame, params: Params = Params()) -> DataFrame:
    """(host, n, good, mean, bound) of every host of ``pages`` (page_id, host), from (page_id, good) outcomes."""
    single = (outcomes.filter(F.col("page_id").isNotNull() & F.col("good").isNotNull())
              .groupBy("page_id").agg(F.avg("good").alias("good")))
    seen = (pages.join(single, "page_id").groupBy("host").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("good").alias("good")))
    hosts = (pages.select("host").distinct().join(seen, "host", "left")
             .select("host", domain_of().alias("domain"), suffix_of().alias("suffix"),
                     F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("good", F.lit(0.0)).alias("good")))
    hosts = materialize(hosts, "hosts")
    tables = {level: materialize(hosts.groupBy(*{"domain": ("domain", "suffix")}.get(level, (level,))).agg(
        F.sum("n").alias("n"), F.sum("good").alias("good")), level) for level in ("suffix", "domain")}
    tables["host"] = hosts
    pulls = {level: strength(tables[level], parent, params) for level, parent in LEVELS.items()}
    whole = tables["suffix"].agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = (whole["good"] + 0.5) / (whole["n"] + 1) if whole["n"] else 0.5

    def shrunk(level: str, towards: Column) -> Column:
        return (F.col("good") + pulls[level] * towards) / (F.col("n") + pulls[level])

    suffixes = tables["suffix"].select("suffix", shrunk("suffix", F.lit(mean)).alias("above"))
    domains = tables["domain"].join(suffixes, "suffix").select("domain", shrunk("domain", F.col("above")).alias("above"))
    posterior = hosts.join(domains, "domain").select("host", "n", "good", shrunk("host", F.col("above")).alias("mean"))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + pulls["host"] + 1))
    return materialize(posterior.withColumn("bound", F.col("mean") - params.z * deviation), "reputation")


def judge(pages: DataFrame, outcomes: DataFrame, allow: list[str], block: list[str],
          params: Params = Params()) -> DataFrame:
    """(page_id, host, path, rule, verdict, mean, bound) of every page."""
    if set(allow) & set(block):
        raise ValueError("a rule can't both allow and block")
    rows = pages.select("page_id", host_of().alias("host"), path_of().alias("path"))
    known = reputation(rows, outcomes, params).select("host", "mean", "bound")
    return (rows.join(known, "host", "left")
            .withColumn("rule", rule_of(F.col("host"), F.col("path"), [*allow, *block]))
            .withColumn("verdict", F.when(F.col("rule").isNull(), F.when(F.col("bound") >= params.least, "allow")
                                          .otherwise("block"))
                        .when(F.col("rule").isin(allow), "allow").otherwise("block"))
            .select("page_id", "host", "path", "rule", "verdict", "mean", "bound"))
