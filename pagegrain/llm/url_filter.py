"""URL filters: listed rules first, then path templates learnt for each host.

Each host's paths form a tree of segments.  Level by level a variable segment becomes
a wildcard (digits, hashes, or a node with many rare children), and sibling branches
are merged if a statistical test finds them alike: their continuations by the
Jensen-Shannon divergence from those of all candidates together, their labels by the
deviation of their share of bad urls, both with room for small counts.  A branch
without labels joins the labelled ones it looks like, unless good and bad ones do.

A template's purity is its share of bad urls, smoothed by its first branch, that by
the host, and that by all hosts.  Urls without a label count against it by a
fraction.  The tree is built on distinct generalised paths with counts, so a host or
url that holds a third of all rows is summed in each task before any shuffle."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query, (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
CHILDREN = 16  # a node with at least so many children and none frequent is a variable
DIVERGENCE = 0.1  # most Jensen-Shannon divergence (at most 0.69) of a merged branch, plus FEW / its urls
FEW = 2.0
SMOOTHING = 10.0  # urls that the level above counts for
UNLABELLED = 0.25  # of a good url that one without a label counts for
REJECT = 0.8  # smoothed share of bad urls from which a template is rejected
NODE = ["host", "prefix"]
CHILD = [*NODE, "seg"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules=tuple(RULES)) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host, or a domain above it, and the
    path's beginning; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # a longer one replaces a shorter one
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def generalised(segment: Column) -> Column:
    """A segment whose form is variable, as a wildcard that keeps its ending."""
    digits = F.regexp_replace(segment, r"^\d+(\.[a-z]{1,5})?$", "<n>$1")
    return F.regexp_replace(digits, r"^(?=[^.]*\d)[0-9a-fA-F-]{8,}(\.[a-z]{1,5})?$", "<h>$1")


def segments(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), generalised)


def variable(n: str, total: str, count: str, most: str) -> Column:
    """Whether a child with n of its parent's total urls is one of many rare ones."""
    return (F.col(count) >= CHILDREN) & (F.col(most) * 2 < F.col(total)) & (F.col(n) * F.col(count) <= 2 * F.col(total))


def branches(held: DataFrame, seg: Column, after: Column) -> DataFrame:
    """(host, prefix, seg, token, alone) of the children of every node of a level."""
    sums = [F.sum(c).alias(c) for c in ("n", "paths", "labelled", "bad")]
    follow = held.groupBy(*NODE, seg.alias("seg"), F.coalesce(after, F.lit("")).alias("next")).agg(F.sum("n").alias("n"), F.count("*").alias("paths"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    follow = materialise(follow, "continuations")
    # many rare continuations are one: branches over different names may be alike
    child = follow.groupBy(*CHILD).agg(*sums, F.count("*").alias("kinds"), F.max("n").alias("most_next"))
    child = materialise(child, "children")
    follow = follow.select(*CHILD, "next", F.col("n").alias("m")).join(child, CHILD)
    follow = follow.withColumn("next", F.when(variable("m", "n", "kinds", "most_next"), "*").otherwise(F.col("next"))).groupBy(*CHILD, "next").agg(F.sum("m").alias("m"))
    follow = materialise(follow, "next-tokens")
    top = follow.groupBy(*CHILD).agg(F.max(F.struct("m", "next"))["next"].alias("top"))
    state = F.when(F.col("labelled") == 0, "none").when(2 * F.col("bad") >= F.col("labelled"), "bad").otherwise("good")
    child = materialise(child.join(top, CHILD).withColumn("state", state), "states")
    sides = child.groupBy(*NODE, "top").agg(F.max(F.col("state") == "bad").alias("some_bad"), F.max(F.col("state") == "good").alias("some_good"))
    joined = F.when((F.col("state") != "none") | (F.col("some_bad") == F.col("some_good")), F.col("state")).when(F.col("some_bad"), "bad").otherwise("good")
    group = [*NODE, "top", "state"]
    child = materialise(child.join(sides, [*NODE, "top"]).withColumn("state", joined).drop("some_bad", "some_good"), "candidates")
    pooled = follow.join(child.select(*CHILD, "top", "state"), CHILD).groupBy(*group, "next").agg(F.sum("m").alias("pool_m"))
    whole = child.groupBy(*group).agg(F.sum("n").alias("pool_n"), F.sum("labelled").alias("pool_labelled"), F.sum("bad").alias("pool_bad"))
    p, q = F.col("m") / F.col("n"), F.col("pool_m") / F.col("pool_n")
    apart = follow.join(child.select(*CHILD, "top", "state", "n"), CHILD).join(pooled, [*group, "next"]).join(whole, group)
    middle = (p + q) / 2
    apart = apart.groupBy(*CHILD).agg((F.sum(p * F.log(p / middle) / 2 + q * F.log(q / middle) / 2) + (1 - F.sum(q)) * (math.log(2) / 2)).alias("divergence"))
    child = child.join(whole, group).join(apart, CHILD)
    rate = F.col("pool_bad") / F.greatest("pool_labelled", F.lit(1))
    off = F.abs(F.col("bad") / F.greatest("labelled", F.lit(1)) - rate)
    labels = (F.col("labelled") == 0) | (off <= 2 * F.sqrt(rate * (1 - rate) / F.greatest("labelled", F.lit(1))) + F.lit(0.5) / F.greatest("labelled", F.lit(1)) + 0.05)
    child = materialise(child.withColumn("alike", labels & (F.col("divergence") <= DIVERGENCE + FEW / F.col("n"))), "compared")
    merged = child.where("alike").groupBy(*group).agg(F.min("seg").alias("name"), F.count("*").alias("members"))
    node = child.groupBy(*NODE).agg(F.sum("n").alias("total"), F.count("*").alias("count"), F.max("n").alias("most"), F.sum("paths").alias("node_paths"))
    out = child.join(node, NODE).join(merged, group, "left")
    token = F.when(variable("n", "total", "count", "most"), "*").when(F.col("alike") & (F.col("members") > 1), F.concat(F.lit("{"), "name", F.lit("..}"))).otherwise(F.col("seg"))
    return out.select(*CHILD, token.alias("token"), (F.col("node_paths") == 1).alias("alone"))


def templates(paths: DataFrame) -> DataFrame:
    """paths(host, segs, n, labelled, bad) -> the same with template, and its first branch.  A path
    leaves the loop where it ends, or where it alone has its prefix: nothing below can be
    merged then.  So the rounds follow the depth that paths share, without a limit."""
    held = materialise(paths.withColumns({"prefix": F.lit(""), "branch": F.lit(""), "template": F.when(F.size("segs") == 0, "")}), "paths")
    done, level = [], 0
    while True:
        done.append(held.where("template is not null"))
        held = held.where("template is null")
        if held.isEmpty():
            break
        seg, after = F.try_element_at("segs", F.lit(level + 1)), F.try_element_at("segs", F.lit(level + 2))
        named = materialise(branches(held, seg, after), "tokens")
        joined = held.withColumn("seg", seg).join(named, CHILD)
        prefix = F.concat("prefix", F.lit("/"), "token")
        rest = F.concat("prefix", F.lit("/"), F.array_join(F.slice("segs", level + 1, F.size("segs")), "/"))
        template = F.when(F.col("alone"), rest).when(F.size("segs") == level + 1, prefix)
        branch = prefix if level == 0 else F.col("branch")
        held = materialise(joined.select("host", "segs", "n", "labelled", "bad", prefix.alias("prefix"), branch.alias("branch"), template.alias("template")), "paths")
        level += 1
    return reduce(DataFrame.union, done).drop("prefix")


def purities(found: DataFrame) -> DataFrame:
    """(host, template, purity) of all templates: each level's share of bad urls is smoothed by the
    level above.  The driver gets the sums over all hosts."""
    weight = F.col("labelled") + UNLABELLED * (F.col("n") - F.col("labelled"))
    found = found.withColumn("weight", weight)
    sums = found.agg(F.sum("bad").alias("bad"), F.sum("weight").alias("weight")).first()
    above, keys = F.lit(min(0.5, float(sums["bad"] or 0) / float(sums["weight"])) if sums["weight"] else 0.0), []
    rows = found.groupBy("host", "branch", "template").agg(F.sum("bad").alias("bad"), F.sum("weight").alias("weight"))
    levels = None
    for key in ("host", "branch", "template"):
        keys.append(key)
        level = rows.groupBy(*keys).agg(F.sum("bad").alias("bad"), F.sum("weight").alias("weight"))
        if levels is not None:
            level = level.join(levels, keys[:-1])
        levels = level.select(*keys, ((F.col("bad") + SMOOTHING * above) / (F.col("weight") + SMOOTHING)).alias("purity" if key == "template" else f"{key}_purity"))
        above = F.col(f"{key}_purity")
    return levels


def filter_urls(pages: DataFrame, rules=tuple(RULES), bad: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row.

    A rule decides where one fits.  Elsewhere the verdict is block if the template's
    smoothed share of bad urls is at least 0.8, else allow.  Labels are the rules'
    verdicts, or the 0/1/null column named bad where it isn't null.  A null url has empty
    host and path, template "", and is allowed unless its like is labelled; repeated rows
    get equal answers; other columns don't matter; an empty table gives an empty one."""
    host, path = host_and_path(F.col("url").cast("string"))
    given = F.col(f"`{bad}`").cast("int") if bad else F.lit(None).cast("int")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), given.alias("label"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict, "segs": segments(F.col("path"))})
    label = F.coalesce("label", (F.col("said") == "block").cast("int"))
    paths = rows.withColumn("label", label).groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    found = materialise(templates(paths), "templates")
    known = found.select("host", "segs", "branch", "template").join(purities(found), ["host", "branch", "template"]).drop("branch")
    out = rows.join(known, ["host", "segs"], "left")
    verdict = F.coalesce("said", F.when((F.col("purity") >= REJECT), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
