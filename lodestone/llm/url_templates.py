"""URL filter by a tree of path templates, in DataFrame operations only.

Explicit rules decide first. For the rest, the paths of each host form a tree: variable segments become wildcards, sibling
branches that are alike in what follows and in their labels are merged, and templates whose smoothed share of blocked
labelled urls is too large are rejected. Labelled urls are those that a rule decides; a template without any has the
share that the same paths have on other hosts, each domain a witness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """The host (after the first ://, A-Z lower-cased) and the path of a url; both empty for null or without ://."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written host/path, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # later, longer rules win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def shaped(path: Column, depth: int) -> Column:
    """The path's segments, runs of digits as {n} and long hexadecimal runs as {h}; all those beyond depth as one."""
    segs = F.filter(F.split(path, "/"), lambda s: s != "")
    segs = F.transform(segs, lambda s: F.regexp_replace(F.regexp_replace(s, r"(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F-]{8,}", "{h}"), r"[0-9]+", "{n}"))
    return F.when(F.size(segs) > depth, F.concat(F.slice(segs, 1, depth), F.array(F.array_join(F.slice(segs, depth + 1, F.size(segs)), ">")))).otherwise(segs)


def expected(t: DataFrame, strength: float, prior: float, witness_labels: int = 2) -> DataFrame:
    """t (key, host, segs, labelled, blocked, ...) with g, an array: g[k] is what other evidence says of the key's first k segments.

    Domains (the last witness_labels labels of a host) are the witnesses, so that one site with many hosts counts once:
    the mean over domains of the blocked share of their labelled urls under these segments, drawn toward g[k - 1] as if
    `strength` domains had that. g[0] is the prior: paths that no labelled url shares a segment with
    are not judged by others.
    """
    prefixes = F.transform(F.filter(F.sequence(F.lit(0), F.size("segs")), lambda k: k > 0), lambda k: F.array_join(F.slice("segs", 1, k), "/"))
    own = t.where("labelled > 0").select(F.substring_index("host", ".", -witness_labels).alias("domain"), "labelled", "blocked", F.explode(prefixes).alias("p"))
    shares = own.groupBy("domain", "p").agg((F.sum("blocked") / F.sum("labelled")).alias("share")).groupBy("p").agg(F.count("*").alias("m"), F.sum("share").alias("h"))
    keys = t.groupBy("key").agg(F.first("segs").alias("segs")).select("key", F.posexplode_outer(prefixes).alias("k", "p"))  # a key has one list of segments
    one = F.when(F.col("k").isNotNull(), F.struct("k", F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("h", F.lit(0.0)).alias("h")))
    found = keys.join(shares, "p", "left").groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("x"))
    step = lambda acc, x: F.concat(acc, F.array((x["h"] + strength * F.element_at(acc, -1)) / (x["m"] + strength)))
    g = F.aggregate("x", F.array(F.lit(float(prior))), step)
    return t.join(found.select("key", g.alias("g")), "key")


def _level(t: DataFrame, k: int, strength: float) -> DataFrame:
    """The tree's k-th segment decided: t (host, prefix, key, segs, g, n, labelled, blocked), prefix one segment longer.

    Sibling branches merge that are alike, to a quarter, in how often they end, go on with a variable segment or with a
    word, and in the share of blocked urls that is to be expected of them; counts pull each share toward what is known
    without them, so that rare branches count as alike until they differ. Aggregations only, however many branches.
    """
    after = F.coalesce(F.try_element_at("segs", F.lit(k + 1)), F.lit(""))
    open_ = F.size("segs") >= k
    t = t.withColumn("seg", F.coalesce(F.try_element_at("segs", F.lit(k)), F.lit("")))
    here = F.element_at("g", F.least(F.lit(k), F.size("segs")) + 1)
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    shapes = [F.sum(F.when(c, F.col("n")).otherwise(0)).alias(x) for x, c in (("ends", after == ""), ("varies", after.contains("{")))]
    child = t.where(open_).groupBy("host", "prefix", "seg").agg(*sums, *shapes, F.sum(F.col("n") * here).alias("gn"))
    quarter = lambda x, n, base: F.floor((x + strength * base) / (n + strength) * 4 + 0.5).cast("int")
    alike = F.concat_ws("", quarter(F.col("ends"), F.col("n"), 1 / 3), quarter(F.col("varies"), F.col("n"), 1 / 3), F.lit("."), quarter(F.col("blocked"), F.col("labelled"), F.col("gn") / F.col("n")))
    child = child.select("host", "prefix", "seg", alike.alias("alike"))
    sizes = child.groupBy("host", "prefix", "alike").agg(F.count("*").alias("branches"))
    names = child.join(sizes, ["host", "prefix", "alike"]).select("host", "prefix", "seg", F.when(F.col("branches") > 1, F.concat(F.lit("*"), "alike")).otherwise(F.col("seg")).alias("name"))
    grown = t.join(names, ["host", "prefix", "seg"], "left")
    return grown.select("host", F.when(open_, F.concat("prefix", F.lit("/"), "name")).otherwise(F.col("prefix")).alias("prefix"), "key", "segs", "g", "n", "labelled", "blocked")


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, depth: int = 16, strength: float = 4.0, prior: float = 0.25, reject_at: float = 0.6,
) -> DataFrame:
    """(page_id, host, path, rule, template, purity, verdict): one row per row of pages.

    A url without a rule is blocked if its template's purity is at least reject_at: the share of blocked urls among its
    labelled ones, drawn as if by `strength` urls toward what the same paths show on all domains (expected). A template
    whose paths no domain has labelled is drawn toward their parents' shares, at last the prior.
    Numbers and long hexadecimal runs are variable segments; of siblings that are alike the name is a wildcard * and the
    quarters in which they are. Ties: a share on the border of two quarters belongs to the upper one. A path's segments
    beyond depth, if it has so many, are one segment. Null urls and those without :// have an empty host and path and form one template. Repeated
    rows count and are judged each; other columns are ignored. An empty table gives an empty result.
    """
    host, path = host_path(F.col(url_col))
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", name).withColumn("by_rule", verdict).withColumn("key", F.array_join(shaped(F.col("path"), depth), "/"))
    t = base.groupBy("host", "key").agg(F.count("*").alias("n"), F.count("by_rule").alias("labelled"), F.count_if(F.col("by_rule") == "block").alias("blocked"))
    t = cut(t.withColumn("segs", F.filter(F.split("key", "/"), lambda s: s != "")))
    t = cut(expected(t, strength, prior).withColumn("prefix", F.lit("")))
    deepest = t.agg(F.max(F.size("segs"))).first()[0] or 0  # a job for each level that the table has, depth + 1 at most
    for k in range(1, deepest + 1):
        t = cut(_level(t, k, strength))
    own = F.sum(F.col("n") * F.element_at("g", -1)) / F.sum("n")
    judged = t.groupBy("host", "prefix").agg(((F.sum("blocked") + strength * own) / (F.sum("labelled") + strength)).alias("purity"))
    by_key = t.select("host", "key", "prefix").join(judged, ["host", "prefix"])
    out = base.join(by_key, ["host", "key"])
    method = F.when(F.col("purity") >= reject_at, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.col("prefix").alias("template"), "purity", F.coalesce("by_rule", method).alias("verdict"))
