"""URL filters: fixed rules first, then the host's empirical-Bayes reputation.

Labelled pages are good or bad outcomes of their host. A host's rate of bad
pages has a beta prior whose mean is the rate of its registered domain, whose
own prior comes from the suffix, and that from all hosts. How strongly a level
holds its children is estimated from their overdispersion (the beta-binomial
moment estimate). A host is blocked where even the lower bound of its posterior
rate is above the limit; without labels of its own it stands as its domain does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, join_dealt

#: A host is blocked if its rate of bad pages is above this with the given normal quantile of certainty.
LIMIT = 0.5
QUANTILE = 1.645
#: Bounds of the estimated overdispersion.
LEAST_RHO, MOST_RHO = 0.0001, 0.9
#: So many rules are tried one by one in an expression; more of them meet the hosts in a join.
MOST_RULES = 500
#: Second-level names that belong to the suffix under a two-letter country. Fixed values.
SECOND_LEVEL = tuple("ac co com edu gob gouv gov go id ltd me mil ne net nhs nom or org plc police sch".split())
#: Suffixes of hosting services, under which each name is a tenant's own. Fixed values.
HOSTING = tuple(
    "appspot.com azurewebsites.net blogspot.com cloudfront.net firebaseapp.com fly.dev github.io gitlab.io herokuapp.com netlify.app"
    " ngrok.io onrender.com pages.dev readthedocs.io s3.amazonaws.com surge.sh tumblr.com vercel.app web.app weebly.com wixsite.com wordpress.com".split()
)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, with A-Z lowered, and the path; both empty without a scheme's mark."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _order(rule: Rule) -> tuple:
    """Rules from the shortest: by host and path together, then by host, then by name."""
    return len(rule.name), len(rule.host), rule.name


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path together; then the longer host) and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=_order):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def with_rule(rows: DataFrame, rules, put: Scratch, most: int = MOST_RULES) -> DataFrame:
    """Add rule and ruled (its verdict) to rows with host and path. ``rules`` are a list, or a table of verdict, host and path.

    Beyond ``most`` rules each distinct host's own and parent names meet the
    rules' hosts in a join; a host then carries the rules that may fit it, the
    longest first, and each row takes the first whose path fits.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= most:
            name, verdict = matched(F.col("host"), F.col("path"), rules)
            return rows.withColumn("rule", name).withColumn("ruled", verdict)
        rules = rows.sparkSession.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    rules = rules.where("host is not null and path is not null").select("verdict", F.col("host").alias("parent"), F.col("path").alias("begin"))
    name = F.concat("parent", "begin")
    rules = rules.select("parent", F.struct((-F.length(name)).alias("a"), (-F.length("parent")).alias("b"), name.alias("rule"), "begin", "verdict").alias("r"))
    hosts = put(rows.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n")))
    labels = F.split("host", "[.]")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    own = hosts.select("host", F.explode(parents).alias("parent")).join(rules, "parent").groupBy("host").agg(F.array_sort(F.collect_list("r")).alias("rules"))
    own = put(own)
    found = join_dealt(rows, own, ["host"], hosts, "page_id", "left")
    first = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["begin"])), F.lit(0))
    return found.withColumn("rule", first["rule"]).withColumn("ruled", first["verdict"]).drop("rules")


def domain_sql(host: str) -> str:
    """SQL for the registered domain: the suffix and the label before it. Suffixes have one label, two under a country's second level or of a hosting service."""
    second = ", ".join(f"'{s}'" for s in SECOND_LEVEL)
    hosting = "|".join(s.replace(".", "[.]") for s in HOSTING)
    tenant = f"regexp_extract({host}, '(?:^|[.])([^.]+[.](?:{hosting}))$', 1)"
    return f"CASE WHEN {tenant} <> '' THEN {tenant} WHEN regexp_extract({host}, '([^.]*)[.][a-z][a-z]$', 1) IN ({second}) THEN regexp_extract({host}, '([^.]*[.][^.]*[.][^.]*|[^.]*[.][^.]*)$', 1) WHEN regexp_extract({host}, '([^.]*[.][^.]*)$', 1) <> '' THEN regexp_extract({host}, '([^.]*[.][^.]*)$', 1) ELSE {host} END"


def suffix_sql(domain: str) -> str:
    """SQL for the suffix of a registered domain: what follows its first label."""
    return f"CASE WHEN {domain} LIKE '%.%' THEN regexp_extract({domain}, '^[^.]*[.](.*)$', 1) ELSE {domain} END"


def _digamma(x: str) -> str:
    y = f"({x} + 6)"
    return f"(ln{y} - 1 / (2 * {y}) - 1 / (12 * power({y}, 2)) + 1 / (120 * power({y}, 4)) - " + " - ".join(f"1 / ({x} + {k})" for k in range(6)) + ")"


def _trigamma(x: str) -> str:
    y = f"({x} + 6)"
    return f"(1 / {y} + 1 / (2 * power({y}, 2)) + 1 / (6 * power({y}, 3)) - 1 / (30 * power({y}, 5)) + " + " + ".join(f"1 / power({x} + {k}, 2)" for k in range(6)) + ")"


def lower_bound_sql(a: str, b: str) -> str:
    """SQL for the lower bound of a beta variable's logit, from the exact mean and variance of the logit."""
    return f"({_digamma(a)} - {_digamma(b)} - {QUANTILE} * sqrt({_trigamma(a)} + {_trigamma(b)}))"


#: The rate of all labels: before any, one bad page in 20.
ROOT_SQL = "(sum(bad) + 1) / (sum(n) + 20)"
#: The moment estimate of a level's concentration from rows with n, bad and the mean of the level above.
RHO_SQL = "coalesce(sum((bad - n * above) * (bad - n * above) - n * above * (1 - above)) / nullif(sum(n * (n - 1) * above * (1 - above)), 0), 0)"
KAPPA_SQL = f"1 / greatest({LEAST_RHO}, least({MOST_RHO}, rho)) - 1"


def _level(children: DataFrame, parents: DataFrame, key: str, put: Scratch) -> DataFrame:
    """Posterior means of a level: children have n, bad and the parent's key; parents have the key, a mean and their own n.

    A parent counts for no more labels than it has.
    """
    counts = put(children.groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    rows = put(join_dealt(children, parents.withColumnRenamed("n", "n_above"), [key], counts, children.columns[0]).withColumnRenamed("mean", "above"))
    kappa = rows.agg(F.expr(RHO_SQL).alias("rho")).select(F.expr(KAPPA_SQL).alias("kappa"))
    strength = kappa.first()["kappa"]  # one number
    return rows.withColumn("kappa", F.least(F.lit(float(strength)), F.col("n_above") + 1)).withColumn("mean", F.expr("(bad + kappa * above) / (n + kappa)"))


def reputation(outcomes: DataFrame, put: Scratch | None = None) -> DataFrame:
    """host, n, bad, above (the domain's rate), kappa, mean and lower for every host of ``outcomes``.

    ``outcomes`` has host and bad (1, 0, or null for pages without a label).
    An empty table gives an empty one.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    hosts = hosts.withColumn("domain", F.expr(domain_sql("host"))).withColumn("suffix", F.expr(suffix_sql("domain")))
    put = put or Scratch()
    hosts = put(hosts)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = put(domains)
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("root", F.lit(1))
    suffixes = put(suffixes)
    root = suffixes.groupBy("root").agg(F.expr(ROOT_SQL).alias("mean"), F.sum("n").alias("n"))
    if hosts.isEmpty():
        return hosts.select("host", "n", "bad", *(F.lit(0.0).alias(c) for c in ("above", "kappa", "mean", "lower")))
    suffix_means = _level(suffixes, root, "root", put).select("suffix", "mean", "n")
    domain_means = _level(domains, suffix_means, "suffix", put).select("domain", "mean", "n")
    out = _level(hosts, domain_means, "domain", put)
    bound = lower_bound_sql("(bad + kappa * above)", "(n - bad + kappa * (1 - above))")
    return out.select("host", "n", "bad", "above", "kappa", "mean", F.expr(f"1 / (1 + exp(-{bound}))").alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages``.

    ``pages`` has page_id and url, ``outcomes`` page_id and bad (1 or 0; one
    page may have several); other columns are ignored. A null url, or one
    without ``://``, has an empty host and path, and the empty host's own
    reputation. Repeated rows stay. Outcomes of unknown pages are not used.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    known = outcomes.select(F.col("page_id").cast("long").alias("page_id"), F.col("bad").cast("int").alias("bad")).where("bad is not null")
    put = Scratch()
    counts = put(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")))
    ranked = reputation(rows.select("page_id", "host").join(known, "page_id", "left").select("host", "bad"), put)
    blocked = put(ranked.where(F.col("lower") > limit).select("host", F.lit(True).alias("blocked")))
    ruled = with_rule(rows, rules, put)
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    out = put(join_dealt(ruled, blocked, ["host"], counts, "page_id", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict")))
    put.end(out)
    return out
