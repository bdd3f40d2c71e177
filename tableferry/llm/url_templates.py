"""URL filters: rules first, then a tree of path templates per host.

Variable segments (numbers, dates, long hex) become wildcards by their form, and at a node with many
rarely used children by their number. Sibling branches whose labelled rates do not differ
significantly are merged. A template is rejected by the smoothed share of bad labels among its pages: it is
smoothed by the share of its parent node, that by the host's share, and that by the overall one. Labels reach
pages without any under the same node, and stay on their host: a host without labels has nothing rejected, nor have
branches at a host's root that have none.

A null url, or one without ``://``, has an empty host and path. Urls may be of any length; segments past 64
characters are variable. Repeated rows give repeated results; the labels of repeated urls add up. Ties: of two
rules that fit and are equally long, the one last by (verdict, host, path) wins. Columns other than the key and
the url are not looked at, whatever their names. An empty table gives an empty result. Without labels nothing
is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A node with more children than this, of fewer pages each than that, has a variable segment.
MANY_CHILDREN, FEW_PAGES = 24, 8.0
#: Siblings merge if their rates differ by fewer standard errors.
SIGNIFICANT = 1.96
#: Pseudo-labels of the rate that smooths, labels asked for (of the template or its parent), and the share of bad ones
#: that rejects.
SMOOTHING, LEAST_LABELS, REJECT = 4.0, 5, 0.9

Rule = tuple[str, str, str]  # verdict, host, path

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def by_rules(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, like ``net/``, and its verdict; nulls if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def generalised(path: Column) -> Column:
    """Segments of a path with variable forms replaced."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(
        segments,
        lambda s: F.when(s.rlike(r"^[0-9]+(\.[A-Za-z]+)?$|^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$|^[0-9A-Fa-f-]{16,}(\.[A-Za-z]+)?$|^.{65,}$"), F.lit("*")).otherwise(s),
    )


def templates(labelled: DataFrame) -> DataFrame:
    """host, form (generalised path), template, n, n_labelled, n_bad, near_labelled (labels of the template's parent
    node, or of the template itself below the host's root), prior (the parent's smoothed rate), purity, rejected.

    ``labelled``: host, path, bad (1, 0 or null). Pages are first summed by host and form. Each level of
    the tree sums these rows by branch and the branches by node, so no node meets in one task, and joins
    back only the branches that become wildcards. Levels are written, as each is read twice, and so are the sums
    that rows of a host or template are joined to: Spark splits a frequent key only between two plain shuffles.
    Levels go on until no two forms share a node: below it a form has no siblings, so the rest of it stands as it is.
    """
    counts = ["n", "n_labelled", "n_bad"]
    form = F.array_join(generalised(F.col("path")), "/")
    leaves = written(
        labelled.groupBy("host", form.alias("form"))
        .agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("n_labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("n_bad"))
        .withColumn("template", F.lit("")),
        "forms",
    )
    segments = F.filter(F.split("form", "/"), lambda s: s != "")
    done, level = None, 0
    while True:
        crowd = leaves.groupBy("host", "template").agg(F.count(F.lit(1)).alias("forms")).where("forms > 1").select("host", "template", F.lit(True).alias("crowd"))
        more = F.coalesce("crowd", F.lit(False)) & (F.size(segments) > level)
        leaves = written(leaves.join(written(crowd, "crowd"), ["host", "template"], "left").select("host", "form", *counts, "template", more.alias("more")), f"level{level}")
        rest = F.array_join(F.transform(F.slice(segments, F.lit(level + 1), F.size(segments)), lambda s: F.concat(F.lit("/"), s)), "")
        ended = leaves.where("NOT more").select("host", "form", *counts, F.concat("template", rest).alias("template"))
        done = ended if done is None else done.unionByName(ended)
        leaves = leaves.where("more").drop("more")
        if leaves.isEmpty():
            break
        level += 1
        leaves = leaves.withColumn("segment", F.try_element_at(segments, F.lit(level)))
        branches = leaves.where("segment <> '*'").groupBy("host", "template", "segment").agg(*(F.sum(c).alias(c) for c in counts))
        nodes = branches.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"), *(F.sum(c).alias(f"all_{c}") for c in counts))
        seen, bad, all_seen, all_bad = (F.col(c) for c in ("n_labelled", "n_bad", "all_n_labelled", "all_n_bad"))
        others = F.greatest(all_seen - seen, F.lit(1))
        rate = all_bad / F.greatest(all_seen, F.lit(1))
        error = F.sqrt(rate * (1 - rate) * (1 / F.greatest(seen, F.lit(1)) + 1 / others))
        alike = (seen > 0) & (all_seen > seen) & (F.abs(bad / F.greatest(seen, F.lit(1)) - (all_bad - bad) / others) <= SIGNIFICANT * error)
        variable = (F.col("children") > MANY_CHILDREN) & (F.col("all_n") / F.col("children") < FEW_PAGES)
        wild = branches.join(written(nodes, "nodes"), ["host", "template"]).where(alike | variable).select("host", "template", "segment", F.lit(True).alias("wild"))
        step = F.when(F.coalesce("wild", F.col("segment") == "*"), "/*").otherwise(F.concat(F.lit("/"), F.col("segment")))
        leaves = leaves.join(wild, ["host", "template", "segment"], "left").select("host", "form", *counts, F.concat("template", step).alias("template"))
    done = written(done, "templates")
    bad, seen = done.agg(F.sum("n_bad"), F.sum("n_labelled")).first()
    overall = (bad or 0) / (seen or 1)
    smoothed = lambda n_bad, n, rate: (F.col(n_bad) + SMOOTHING * rate) / (F.col(n) + SMOOTHING)
    own = done.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in counts)).withColumn("parent", F.regexp_replace("template", "/[^/]*$", ""))
    own = written(own, "own")
    of_host = own.groupBy("host").agg(F.sum("n_labelled").alias("host_labelled"), F.sum("n_bad").alias("host_bad"))
    of_host = of_host.select("host", smoothed("host_bad", "host_labelled", F.lit(overall)).alias("host_rate"))
    nodes = own.groupBy("host", "parent").agg(F.sum("n_labelled").alias("node_labelled"), F.sum("n_bad").alias("node_bad"))
    nodes = written(nodes.join(of_host, "host").withColumn("prior", smoothed("node_bad", "node_labelled", F.col("host_rate"))), "nodes")
    judged = own.join(nodes, ["host", "parent"]).withColumn("purity", smoothed("n_bad", "n_labelled", F.col("prior")))
    judged = judged.withColumn("near_labelled", F.when(F.col("parent") == "", F.col("n_labelled")).otherwise(F.col("node_labelled")))
    judged = judged.withColumn("rejected", (F.col("near_labelled") >= LEAST_LABELS) & (F.col("purity") >= REJECT))
    return done.drop(*counts).join(judged.drop("parent", "host_rate", "node_labelled", "node_bad"), ["host", "template"])


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, template, purity.

    ``labelled`` (url, bad): labels of urls. Without it, the rules' verdicts label the pages they cover.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    rule, verdict = by_rules(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    if labelled is None:
        known = rows.select("host", "path", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0).alias("bad"))
    else:
        given = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("bad").cast("int").alias("bad"))
        known = given.unionByName(rows.select("host", "path", F.lit(None).cast("int").alias("bad")))
    tree = templates(known).select("host", "form", "template", "purity", "rejected")
    rows = rows.withColumn("form", F.array_join(generalised(F.col("path")), "/"))
    return rows.join(tree, ["host", "form"], "left").select(
        key, "host", "path", "rule",
        F.coalesce("ruled", F.when(F.coalesce("rejected", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template", "purity",
    )
