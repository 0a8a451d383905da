"""URL rules and Empirical-Bayes host reputation, in DataFrame functions only.

A rule names a host with all its subdomains and a path prefix; the longest fitting rule decides. Rules meet the
distinct hosts by a hash join on the hosts' suffixes, so the plan does not grow with them, and a page tries only those
of its host. Other pages are judged by reputation: labelled page outcomes are counted by host, and every level's share of
good pages is shrunk to the level above it (suffix to all pages, registered domain to suffix, host to
domain) by a beta-binomial prior whose strength comes from the method of moments. A page is allowed
when the lower posterior bound of its host reaches the threshold.

Nulls and edge cases: a null url, or one without "://", has an empty host and path; the empty host is judged like any
other, by the outcomes of its own pages; null labels count as none; a page that is labelled more than once counts once,
with its least label, and one listed with several hosts counts for the least of them; ties: of equally long rules the
least by name decides, and block before allow; repeated pages come back repeated; with no labels at all the prior is
uniform; an empty table gives an empty result; very long urls are read whole. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import BROADCAST_KEYS, Workspace, salted_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Registries that sell names at the second level; more can be given.
TWO_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "com.br", "co.in", "co.nz", "com.cn", "com.mx", "co.za")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool


@dataclass(frozen=True)
class Config:
    least: float = 0.5  # lower bound that a host must reach
    z: float = 1.645  # one-sided 95 %
    two_level: tuple[str, ...] = TWO_LEVEL


def host_path(url: Column) -> tuple[Column, Column]:
    rest = url.substr(F.instr(url, "://") + 3, F.length(url))
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(has, host).otherwise(""), F.when(has, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rules_of_hosts(hosts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(host, rules): the rules that fit a host, the longest first, as structs (size, name, allow, path)."""
    spark = hosts.sparkSession
    listed = spark.createDataFrame([(r.host, r.host + r.path, r.allow, r.path) for r in rules], "suffix string, name string, allow boolean, path string")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    met = hosts.select("host", F.explode(suffixes).alias("suffix")).join(F.broadcast(listed) if len(rules) <= BROADCAST_KEYS // 10 else listed, "suffix")
    one = F.struct((-F.length("name")).alias("size"), "name", "allow", "path")
    return met.groupBy("host").agg(F.sort_array(F.collect_list(one)).alias("rules"))


def domain_suffix(host: Column, two_level: tuple[str, ...]) -> tuple[Column, Column]:
    last_two = F.substring_index(host, ".", -2)
    is_two = last_two.isin(list(two_level)) & (host != last_two)
    return F.when(is_two, F.substring_index(host, ".", -3)).otherwise(last_two), F.when(is_two, last_two).otherwise(F.substring_index(host, ".", -1))


def strength(groups: DataFrame, n: str, k: str, mean: Column) -> DataFrame:
    """One row `s`: the prior's strength, from the spread of the groups' shares around their prior means.

    With intra-class correlation r, E[n (p - m)^2] = m (1 - m) (1 + (n - 1) r); s = 1 / r - 1.
    """
    p, v = F.col(k) / F.col(n), mean * (1 - mean)
    spread, base = F.sum(F.col(n) * (p - mean) * (p - mean)), F.sum(v)
    rho = (spread - base) / F.nullif(F.sum(v * (F.col(n) - 1)), F.lit(0.0))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.01)), F.lit(0.001)), F.lit(0.9))
    return groups.where(F.col(n) > 0).agg((1 / rho - 1).alias("s"))


#: Tables that `reputation` writes.
LEVELS = ("counted", "domains", "suffixes", "by-suffix", "domains-prior", "by-domain", "hosts-prior")


def reputation(ws: Workspace, outcomes: DataFrame, hosts: DataFrame, cfg: Config) -> DataFrame:
    """(host, n_labelled, bound) for every host; `outcomes` has (host, good) rows, good 0 or 1.

    Each level is written, as the next one reads it more than once.
    """
    seen = outcomes.groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("good").cast("double").alias("k"))
    domain, suffix = domain_suffix(F.col("host"), cfg.two_level)
    h = hosts.join(seen, "host", "left").fillna(0.0, ["n", "k"]).select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k")
    h = ws.write(h, "counted")
    top = h.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("m0"))
    top = top.select(F.coalesce("m0", F.lit(0.5)).alias("m0"))

    def level(groups: DataFrame, mean: Column, name: str) -> DataFrame:
        s = strength(groups, "n", "k", mean)
        return groups.join(F.broadcast(s)).withColumn(name, (F.col("k") + F.col("s") * mean) / (F.col("n") + F.col("s"))).withColumnRenamed("s", f"s_{name}")

    domains = ws.write(h.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = ws.write(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(F.broadcast(top)), "suffixes")
    by_suffix = ws.write(level(suffixes, F.col("m0"), "m1").select("suffix", "m1"), "by-suffix")
    domains = ws.write(domains.join(by_suffix, "suffix"), "domains-prior")
    by_domain = ws.write(level(domains, F.col("m1"), "m2").select("domain", "m2"), "by-domain")
    by_host = level(ws.write(h.join(by_domain, "domain"), "hosts-prior"), F.col("m2"), "m3")
    a = F.col("k") + F.col("s_m3") * F.col("m2")
    b = F.col("n") - F.col("k") + F.col("s_m3") * (1 - F.col("m2"))
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return by_host.select("host", F.col("n").cast("bigint").alias("n_labelled"), F.round(a / (a + b) - cfg.z * sd, 6).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", cfg: Config = Config()) -> DataFrame:
    """(id, host, path, rule, verdict, n_labelled, bound) for every row of `pages`.

    `outcomes` has (id, good): labelled pages. A short table of hosts is broadcast, behind a check of its
    size; beyond it the join is salted, so a host with a third of the pages is dealt over many tasks.
    """
    ws = Workspace(pages.sparkSession, "url")
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    good = outcomes.where(F.col("good").isin(0, 1)).groupBy(F.col(id_col)).agg(F.min("good").alias("good"))
    good = rows.groupBy(id_col).agg(F.min("host").alias("host")).join(good, id_col)
    hosts = ws.write(rows.select("host").distinct(), "hosts")
    known = reputation(ws, good, hosts, cfg).join(rules_of_hosts(hosts, rules), "host", "left")
    known = ws.write(known, "known")
    small = known.count() <= BROADCAST_KEYS // 10 and len(rules) <= BROADCAST_KEYS // 10
    got = rows.join(F.broadcast(known), "host") if small else salted_join(ws.write(rows, "rows"), known, "host", chunk=50_000)
    ws.drop("hosts", *LEVELS)
    fit = F.try_element_at(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(1))
    got = got.withColumn("fit", fit)
    by_bound = F.when(F.col("bound") >= cfg.least, "allow").otherwise("block")
    by_rule = F.when(F.col("fit.allow"), "allow").otherwise("block")
    return got.select(
        id_col, "host", "path", F.col("fit.name").alias("rule"), F.when(F.col("fit").isNotNull(), by_rule).otherwise(by_bound).alias("verdict"), "n_labelled", "bound"
    )
