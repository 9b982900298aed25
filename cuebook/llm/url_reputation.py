"""URL filter by Empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes (1: bad) are counted per host. Reputations are shrunk level by level,
suffix -> registered domain -> host, each through a beta-binomial prior: its mean is the parent's
posterior mean, its strength is one number per level, estimated from how much the level's groups
vary around their parents (method of moments; weak variation shrinks strongly). The top prior is
the share of bad outcomes overall, smoothed by one good and one bad page.

A url is judged by the longest rule that fits; without one it is blocked where the lower posterior
bound of its host's bad rate, mean - z * sd, is above ``limit``. Hosts without an outcome have
their domain's reputation, or else their suffix's, or else the overall one.

Outcomes are combined per host before any shuffle, so a host with a third of all pages is
one row. Reputations go by the site: the host without user, port and final dots. Its suffix is the longest of the
public ``suffixes`` that it ends with, else its last label; the registered domain has one label more; an address in
numbers or brackets is its own domain and suffix. ``suffixes`` is a list for the expression (a whole public list, some
ten thousand texts, is fine; its wildcards and exceptions are not read); the default holds common ones. A site that is itself a
suffix is its own domain. Null urls and urls without ``://`` have an empty host and path: no rule, and the overall reputation. Outcomes with a null url or value are
ignored. Repeated rows each get a row, extra columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written

Z, LIMIT = 1.645, 0.25
LEVELS = ("suffix", "domain", "host")
# Public suffixes of two labels in common use.
SUFFIXES = """
ac.uk co.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk police.uk sch.uk
asn.au com.au edu.au gov.au id.au net.au org.au
ac.nz co.nz geek.nz govt.nz net.nz org.nz school.nz
ac.jp ad.jp co.jp ed.jp go.jp gr.jp lg.jp ne.jp or.jp
com.br edu.br gov.br net.br org.br
ac.cn com.cn edu.cn gov.cn net.cn org.cn
ac.in co.in edu.in firm.in gen.in gov.in ind.in net.in org.in
ac.kr co.kr go.kr ne.kr or.kr re.kr
ac.za co.za gov.za net.za org.za web.za
ac.il co.il gov.il net.il org.il
ac.id co.id go.id or.id web.id
ac.th co.th go.th in.th or.th
com.tr edu.tr gov.tr net.tr org.tr
com.mx edu.mx gob.mx net.mx org.mx
com.ar com.co com.hk com.my com.pe com.ph com.pk com.pl com.sg com.tw com.ua com.vn
net.pl org.pl org.tw org.hk edu.tw edu.hk co.at or.at co.ke co.hu
""".split()


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """The host without user, port and final dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*\z", ""), r"\.+\z", "")


def suffix_of(site: Column, suffixes: list[str]) -> Column:
    """The longest of ``suffixes`` at the end of the site, else its last label; an address itself."""
    found = F.substring_index(site, ".", -1)
    for n in sorted({x.count(".") + 1 for x in suffixes}):  # the longest is asked first
        tail = F.substring_index(site, ".", -n)
        found = F.when(tail.isin([x for x in suffixes if x.count(".") + 1 == n]), tail).otherwise(found)
    return F.when(site.rlike(r"^([0-9]+(\.[0-9]+){3}\z|\[)"), site).otherwise(found)


def domain_of(site: Column, suffix: Column) -> Column:
    """One label more than the suffix."""
    return F.call_function("substring_index", site, F.lit("."), -1 - F.size(F.split(suffix, r"\.")))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the rules (verdict, host + path) that fits; null if none does.

    A rule fits its host and all subdomains, where the path starts with the rule's path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def levels(hosts: DataFrame, site: Column, suffixes: list[str], *others: str) -> DataFrame:
    """(others, host, domain, suffix) of rows with a site; the level "host" goes by the site."""
    named = hosts.select(*others, site.alias("_cue_site")).withColumn("suffix", suffix_of(F.col("_cue_site"), suffixes))
    return named.select(*others, F.col("_cue_site").alias("host"), domain_of(F.col("_cue_site"), F.col("suffix")).alias("domain"), "suffix")


def reputations(outcomes: DataFrame, z: float = Z, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """(key, mean, bound) per site, domain, suffix and overall (the empty key) from rows (url, bad)."""
    counted = outcomes.filter("url is not null and bad is not null").groupBy(site_of(host_of(F.col("url"))).alias("site")) \
        .agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("x"))
    named = written(levels(counted, F.col("site"), suffixes, "n", "x"), "outcomes")
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("x"), F.lit(0)).alias("x")).first()
    top = (float(total.x) + 1.0, float(total.n - total.x) + 1.0)  # two numbers
    found = outcomes.sparkSession.createDataFrame([("", *top)], "key string, a double, b double")
    above = None
    for level, parent in zip(LEVELS, ("", *LEVELS), strict=False):
        own = named.filter(F.col(level) != "")
        if above is None:
            own = own.groupBy(F.col(level).alias("key")).agg(F.sum("n").alias("n"), F.sum("x").alias("x")).withColumn("m", F.lit(top[0] / sum(top)))
        else:
            prior = above.select(F.col("key").alias("up"), (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))
            own = own.groupBy(F.col(level).alias("key"), F.col(parent).alias("up")).agg(F.sum("n").alias("n"), F.sum("x").alias("x")).join(prior, "up")
        even = F.col("m") * (1 - F.col("m"))
        spread = own.agg(F.sum(F.pow(F.col("x") - F.col("n") * F.col("m"), 2) - F.col("n") * even).alias("over"),
                         F.sum(F.col("n") * (F.col("n") - 1) * even).alias("room")).first()
        share = min(max(spread.over / spread.room if spread.room else 0.0, 0.01), 0.9)
        strength = F.lit(1 / share - 1)  # one number per level
        above = written(own.select("key", (strength * F.col("m") + F.col("x")).alias("a"),
                                   (strength * (1 - F.col("m")) + F.col("n") - F.col("x")).alias("b")), level)
        found = found.unionAll(above.select(F.concat(F.lit(level + ":"), "key").alias("key"), "a", "b"))
    both = F.col("a") + F.col("b")
    mean = F.col("a") / both
    return found.select("key", F.round(mean, 6).alias("bad_mean"),
                        F.round(mean - z * F.sqrt(F.col("a") * F.col("b") / (both * both * (both + 1))), 6).alias("bad_bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], limit: float = LIMIT, z: float = Z,
          id_col: str = "page_id", url_col: str = "url", suffixes: list[str] = SUFFIXES) -> DataFrame:
    """(id, host, path, rule, verdict, bad_mean, bad_bound) for each page."""
    own = pages.select(pages[id_col].alias("_cue_id"), pages[url_col].alias("_cue_url")) \
        .select("_cue_id", host_of(F.col("_cue_url")).alias("host"), path_of(F.col("_cue_url")).alias("path"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    known = reputations(outcomes.select("url", "bad"), z, suffixes)
    rep = known.select("key", F.struct("bad_mean", "bad_bound").alias("r"))
    hosts = levels(own.select(F.col("host").alias("_cue_host")).distinct(), site_of(F.col("_cue_host")), suffixes, "_cue_host")
    keyed = hosts.select("_cue_host", F.explode(F.array(
        F.struct(F.lit(3).alias("depth"), F.concat(F.lit("host:"), "host").alias("key")),
        F.struct(F.lit(2).alias("depth"), F.concat(F.lit("domain:"), "domain").alias("key")),
        F.struct(F.lit(1).alias("depth"), F.concat(F.lit("suffix:"), "suffix").alias("key")),
        F.struct(F.lit(0).alias("depth"), F.lit("").alias("key")))).alias("k")).select("_cue_host", "k.*")
    # Written, so that the join below is one of two plain tables, where Spark may split a host with many pages.
    best = written(keyed.join(rep, "key").groupBy("_cue_host").agg(F.max(F.struct("depth", "r")).alias("b"))
                   .select("_cue_host", "b.r.*"), "hosts")
    judged = own.join(best, own["host"] == best["_cue_host"], "left")
    by_method = F.when(F.col("bad_bound") > limit, "block").otherwise("allow")
    return judged.select(F.col("_cue_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(said, by_method).alias("verdict"),
                         "bad_mean", "bad_bound")


def allowed(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], limit: float = LIMIT, z: float = Z,
            url_col: str = "url", suffixes: list[str] = SUFFIXES) -> DataFrame:
    """The rows of ``pages``, all columns, whose url is not blocked."""
    judged = judge(pages, outcomes, rules, limit, z, url_col, url_col, suffixes).filter("verdict = 'block'")
    blocked = judged.select(F.col(url_col).alias("_cue_blocked")).distinct()  # a verdict follows from the url alone
    return pages.join(blocked, pages[url_col].eqNullSafe(F.col("_cue_blocked")), "left_anti")
