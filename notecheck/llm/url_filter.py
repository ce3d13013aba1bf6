"""URL filter: rules, and a path-template tree for the urls that no rule fits. DataFrame functions only.

A rule is (host, path, verdict); it fits its host and all subdomains if the url's path starts with the rule's; the longest
rule wins (ties: the first by code point). Urls that a rule fits are the labels of the tree. Its leaves are the different (host, path);
so pages that repeat change nothing. From the host down, for each level of the path:

1. Wildcards. Of a node's children, those with less than 1/`kids` of its leaves are light; if there are `kids` light ones or more, the
   segment varies, and they become `*`. So a node has fewer than 2 * `kids` + 1 branches left.
2. Merges. Two branches of a node with `support` leaves each are similar if the shares of all their children (named as in step 1; the end
   of a path counts as one, and a child where paths end is another than one where they go on) differ by no more than the Hoeffding bound c * (1/sqrt(n1) + 1/sqrt(n2)), c = sqrt(ln(2 / alpha) / 2). In the
   order of size, branches that are similar to no larger one lead; each other branch joins the largest leader that it is similar to. A
   group, with or without labels, goes on as one node, `(a|b)`, and its children are counted together.
3. At the end, a template is rejected if its smoothed purity (blocked + 1) / (labelled + 2) is at least `purity`: urls that no rule fits are
   blocked where enough labelled ones of their template, or of branches merged into it, were. A template without labels has 1/2 and is allowed.

Nulls and edges: a null url, or one without `://`, has empty host and path, fits no rule and is allowed unless its template (the empty
path of the empty host) is rejected; null or repeated page_ids are judged row by row; segments beyond `levels` - 1 count as one, so a very long
url is a leaf like any other; ties of size go to the first name by code point; an empty table gives an empty result; other columns are
ignored. `rules` are a parameter of at most MAX_RULES entries, as they become a literal of the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, materialize

MAX_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class UrlParams:
    rules: tuple[tuple[str, str, str], ...] = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
    kids: int = 12
    support: int = 8
    alpha: float = 0.2
    purity: float = 0.9
    levels: int = 6

    @property
    def bound(self) -> float:
        return math.sqrt(math.log(2 / self.alpha) / 2)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    known = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p"), F.lit(v).alias("v")) for h, p, v in ordered])
    fits = F.filter(known, lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]))
    named = F.transform(fits, lambda r: F.struct(F.concat(r["h"], r["p"]).alias("rule"), r["v"].alias("verdict")))
    return F.get(named, F.lit(0))


def _named(leaves: DataFrame, level: int, params: UrlParams, name: str) -> DataFrame:
    """Leaves (host, path, segs, node) with `branch`: their segment of this level, `*` where it varies, null where the path has ended."""
    seg = F.get("segs", F.lit(level))
    kids = materialize(leaves.where(F.size("segs") > level).groupBy("host", "node", seg.alias("seg")).agg(F.count(F.lit(1)).alias("n")), f"{name}-kids")
    # A node may have any number of children, so its sums are joined to them and not taken over a window.
    sums = materialize(kids.groupBy("host", "node").agg(F.sum("n").alias("all")), f"{name}-sums")
    weighed = join_small(kids, sums, ["host", "node"], F.xxhash64("seg")).withColumn("light", F.col("n") * params.kids < F.col("all"))
    many = materialize(weighed.where("light").groupBy("host", "node").agg(F.count(F.lit(1)).alias("lights")).where(F.col("lights") >= params.kids), f"{name}-many")
    kept = join_small(weighed, many, ["host", "node"], F.xxhash64("seg"), "left").where("not light or lights is null")
    kept = materialize(kept.select("host", "node", "seg", F.lit(True).alias("kept")), f"{name}-kept")
    found = join_small(leaves.withColumn("seg", seg), kept, ["host", "node", "seg"], F.xxhash64("path"), "left")
    return found.withColumn("branch", F.when(F.size("segs") > level, F.when(F.col("kept"), F.col("seg")).otherwise("*"))).drop("seg", "kept")


def _groups(profiles: DataFrame, params: UrlParams) -> DataFrame:
    """host, node, branch, leader: which branch each similar one joins (itself: it leads or stays alone).

    profiles: host, node, branch, child (null: end), n. A node has fewer than 2 * kids + 1 branches, and a branch twice as many children.
    """
    shapes = profiles.groupBy("host", "node", "branch").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct(F.coalesce("child", F.lit("/")), "n"))).alias("shape"))
    shapes = materialize(shapes, "url-shapes")
    able = shapes.where(F.col("n") >= params.support)
    one = able.select("host", "node", F.col("branch").alias("a"), F.col("n").alias("na"), F.col("shape").alias("sa"))
    two = able.select("host", "node", F.col("branch").alias("b"), F.col("n").alias("nb"), F.col("shape").alias("sb"))
    share = lambda shape, key, n: F.coalesce(F.element_at(shape, key), F.lit(0)) / n
    gap = F.array_max(F.transform(F.array_union(F.map_keys("sa"), F.map_keys("sb")), lambda k: F.abs(share(F.col("sa"), k, F.col("na")) - share(F.col("sb"), k, F.col("nb")))))
    limit = F.lit(params.bound) * (1 / F.sqrt(F.col("na").cast("double")) + 1 / F.sqrt(F.col("nb").cast("double")))
    # b stands before a: it is larger, or as large and first by name.
    before = (F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    similar = materialize(one.join(two, ["host", "node"]).where(before & (gap <= limit)).select("host", "node", "a", "b", "nb"), "url-similar")
    follows = similar.select("host", "node", F.col("a").alias("b")).distinct()
    led = similar.join(follows, ["host", "node", "b"], "left_anti").groupBy("host", "node", F.col("a").alias("branch")).agg(F.min_by("b", F.struct(-F.col("nb"), "b")).alias("leader"))
    return shapes.select("host", "node", "branch").join(led, ["host", "node", "branch"], "left").withColumn("leader", F.coalesce("leader", "branch"))


def template_verdicts(leaves: DataFrame, params: UrlParams) -> DataFrame:
    """host, path, template, reject for each leaf (host, path, segs, labelled, blocked; both 0 or 1)."""
    deepest = leaves.agg(F.max(F.size("segs"))).first()[0] or 0
    tree = leaves.withColumn("node", F.lit(""))
    for level in range(deepest):
        named = materialize(_named(tree, level, params, "url"), "url-named")
        going = named.where("branch is not null").withColumn("parent", F.col("node")).withColumn("node", F.concat_ws("/", "node", "branch"))
        below = _named(going.select("host", "path", "segs", "node", "parent", F.col("branch").alias("over")), level + 1, params, "url-below")
        profiles = below.groupBy("host", F.col("parent").alias("node"), F.col("over").alias("branch"), F.concat("branch", F.when(F.size("segs") > level + 2, "/").otherwise("")).alias("child")).agg(F.count(F.lit(1)).alias("n"))
        groups = _groups(profiles, params)
        names = groups.groupBy("host", "node", "leader").agg(F.array_sort(F.collect_list("branch")).alias("all"))
        titled = names.select("host", "node", F.when(F.size("all") > 1, F.concat(F.lit("("), F.array_join("all", "|"), F.lit(")"))).otherwise(F.col("leader")).alias("title"), F.explode("all").alias("branch"))
        tree = join_small(named, materialize(titled, "url-titles"), ["host", "node", "branch"], F.xxhash64("path"), "left")
        tree = materialize(tree.withColumn("node", F.when(F.col("branch").isNotNull(), F.concat_ws("/", "node", "title")).otherwise(F.col("node"))).drop("branch", "title"), "url-tree")
    sums = tree.groupBy("host", "node").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    judged = materialize(sums.select("host", "node", (F.col("blocked") + 1 >= params.purity * (F.col("labelled") + 2)).alias("reject")), "url-judged")
    return join_small(tree.select("host", "path", "node"), judged, ["host", "node"], F.xxhash64("path")).select("host", "path", F.when(F.col("node") == "", "/").otherwise(F.col("node")).alias("template"), "reject")


def filter_urls(pages: DataFrame, params: UrlParams = UrlParams()) -> DataFrame:
    """page_id, host, path, rule, verdict and template for every row of pages."""
    url = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = url.withColumn("__r", fitting_rule(F.col("host"), F.col("path"), params.rules)).select("page_id", "host", "path", F.col("__r.rule").alias("rule"), F.col("__r.verdict").alias("label"))
    ruled = materialize(ruled, "url-ruled")
    # A segment that is written like a mark of the tree is told apart.
    segs = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), lambda x: F.when(x.isin("*", "/"), F.concat(F.lit("\\"), x)).otherwise(x))
    last = F.array_join(F.slice("__s", params.levels, 1 << 30), "/")
    leaves = ruled.groupBy("host", "path").agg(F.max("label").alias("label")).withColumn("__s", segs)
    leaves = leaves.select("host", "path", F.when(F.size("__s") <= params.levels, F.col("__s")).otherwise(F.concat(F.slice("__s", 1, params.levels - 1), F.array(last))).alias("segs"), F.col("label").isNotNull().cast("int").alias("labelled"), F.coalesce((F.col("label") == "block").cast("int"), F.lit(0)).alias("blocked"))
    judged = materialize(template_verdicts(materialize(leaves, "url-leaves"), params), "url-verdicts")
    found = join_small(ruled, judged, ["host", "path"], F.xxhash64("page_id"), "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("label", F.when(F.col("reject"), "block"), F.lit("allow")).alias("verdict"), "template")
