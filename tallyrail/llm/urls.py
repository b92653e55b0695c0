"""URL filters by a path-template tree.

Rules (host, path) decide first: a rule fits its host and all subdomains if the path starts with the rule's, and the longest wins. What
rules decide also labels the rest. Per host, paths form a tree of segments. Level by level, a node's branches become a wildcard where they
are variable (many children, this one rare) or statistically similar (the branch's share of blocked labels does not differ from that of
all branches of the node by a two-sided 5 % test); branches without labels have nothing that sets them apart. Each resulting template has
a smoothed purity: (blocked + w p) / (labelled + w), where p is its host's, which is smoothed in the same way towards its domain (the last two
labels), that towards the top level, and that towards one half. So labels of a host or its relatives reach branches that have none, and where there are none at all
nothing is rejected; a label counts once. Templates at or above `REJECT` are blocked, all others allowed. `held_out_figures` hides the labels of a part of the pages, chosen by hash, and counts
how the tree decides them.

Built-in Spark functions only. URLs are counted per host and canonical path before any join, so a host with a third of all pages shrinks to
its distinct canonical paths; joins are on host and path, and their skew is left to adaptive splitting.

Defined results: a null url, or one without `://`, has an empty host and path, like any other host and path; repeated rows give repeated
rows; paths with more than `depth` segments have the rest as one; an empty table gives an empty table. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrail.llm.common import UPPER, stored

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]
DEPTH = 4
MANY_CHILDREN, RARE_PERCENT = 50, 1
CRITICAL = 3.84  # of chi-square, one degree of freedom, 5 %
PRIOR, WEIGHT, REJECT = 0.5, 4.0, 0.7
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
ALLOW, BLOCK = "allow", "block"


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, PARTS, 1), UPPER, UPPER.lower()), F.regexp_extract(text, PARTS, 2)


def decided(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, suffix, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        name = F.when(fits, F.lit(suffix + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def canonical(path: Column) -> Column:
    """The path with every run of digits as `{n}`."""
    return F.regexp_replace(path, "[0-9]+", "{n}")


def segments(path: Column, depth: int = DEPTH) -> Column:
    """At most `depth` segments of a canonical path; a final slash gives a last, empty one."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(path, "^/", ""), "/", depth))


def _level(tree: DataFrame, depth: int) -> DataFrame:
    """`tree` with its templates one segment longer."""
    key = ["host", "template"]
    here = tree.withColumn("segment", F.get("segments", F.lit(depth)))
    child = here.filter("segment IS NOT NULL").groupBy(*key, "segment").agg(
        F.sum("n").alias("c_n"), F.sum("labelled").alias("c_labelled"), F.sum("blocked").alias("c_blocked"))
    parent = child.groupBy(*key).agg(F.count("*").alias("children"), F.sum("c_n").alias("p_n"),
                                     F.sum("c_labelled").alias("p_labelled"), F.sum("c_blocked").alias("p_blocked"))
    number = {c: F.col(c).cast("double") for c in ("c_labelled", "c_blocked", "p_labelled", "p_blocked")}
    gap = number["c_blocked"] * number["p_labelled"] - number["p_blocked"] * number["c_labelled"]
    similar = gap * gap <= CRITICAL * number["c_labelled"] * number["p_blocked"] * (number["p_labelled"] - number["p_blocked"])
    variable = (F.col("children") > MANY_CHILDREN) & (F.col("c_n") * 100 < F.col("p_n") * RARE_PERCENT)
    token = F.when((F.col("children") > 1) & (similar | variable), F.lit("*")).otherwise(F.col("segment"))
    tokens = child.join(parent, key).select(*key, "segment", token.alias("token"))
    return here.join(tokens, [*key, "segment"], "left").withColumn(
        "template", F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "token"))).drop(
        "segment", "token")


def templates(urls: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, path, template) for distinct (host, canonical path) with counts `n`, `labelled` and `blocked`."""
    tree = stored(urls.withColumns({"segments": segments(F.col("path"), depth), "template": F.lit("")}), "url-tree")
    for level in range(depth):
        tree = stored(_level(tree, level), "url-tree")
    return tree


def smoothed(blocked: Column, labelled: Column, parent: Column) -> Column:
    return (blocked + F.lit(WEIGHT) * parent) / (labelled + F.lit(WEIGHT))


def purities(tree: DataFrame) -> DataFrame:
    """(host, template, purity), smoothed from the top level down to the templates; a label counts once, at the lowest level that it is of."""
    host = F.col("host")
    counts = tree.groupBy("host", "template").agg(F.sum("blocked").cast("double").alias("b"), F.sum("labelled").cast("double").alias("l")).withColumns(
        {"domain": F.regexp_extract(host, r"(?:[^.]*\.)?[^.]*$", 0), "top": F.regexp_extract(host, r"[^.]*$", 0)})
    counts = rows = stored(counts, "template-counts")
    levels = ("host", "domain", "top")
    for level in levels:
        rows = rows.join(counts.groupBy(level).agg(F.sum("b").alias(f"{level}_b"), F.sum("l").alias(f"{level}_l")), level)
    purity = F.lit(PRIOR)
    names = [*reversed(levels), None]
    for level, below in zip(names, names[1:]):
        own = (f"{below}_b", f"{below}_l") if below else ("b", "l")
        purity = smoothed(F.col(f"{level}_b") - F.col(own[0]), F.col(f"{level}_l") - F.col(own[1]), purity)
    return rows.select("host", "template", smoothed(F.col("b"), F.col("l"), purity).alias("purity"))


def _learned(rows: DataFrame, depth: int) -> DataFrame:
    """(host, shape, template, purity) for `rows` with host, shape and the label `ruled` (null: none)."""
    counted = rows.groupBy("host", F.col("shape").alias("path")).agg(
        F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count(F.when(F.col("ruled") == BLOCK, 1)).alias("blocked"))
    tree = templates(counted, depth)
    return stored(tree.select("host", F.col("path").alias("shape"), "template").join(purities(tree), ["host", "template"]), "url-templates")


def _parted(pages: DataFrame, rules: Sequence[Rule], page_id: str, url: str) -> DataFrame:
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url")).select(
        "page_id", host.alias("host"), path.alias("path"))
    rule, verdict = decided(rules, F.col("host"), F.col("path"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), canonical(F.col("path")).alias("shape"))


def judge(pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url", depth: int = DEPTH,
          reject: float = REJECT) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) per page."""
    rows = _parted(pages, rules, page_id, url)
    learned = F.when(F.col("purity") >= reject, BLOCK).otherwise(ALLOW)
    return rows.join(_learned(rows, depth), ["host", "shape"]).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "template", "purity")


def held_out_figures(pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url", depth: int = DEPTH,
                     reject: float = REJECT, parts: int = 5, by_host: bool = False) -> DataFrame:
    """One row: how the tree decides pages whose labels it was not shown: `hits` (blocked by both), `false_blocks`, `misses`, and `agreed` (allowed by both).

    A page's label is hidden if the hash of its id, or with `by_host` of its host, divides by `parts`.
    """
    rows = _parted(pages, rules, page_id, url)
    key = F.col("host") if by_host else F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    rows = rows.withColumns({"label": F.col("ruled"), "hidden": F.pmod(F.xxhash64(key), F.lit(parts)) == 0})
    shown = rows.withColumn("ruled", F.when(~F.col("hidden"), F.col("label")))
    asked = rows.filter("hidden AND label IS NOT NULL").join(_learned(shown, depth), ["host", "shape"])
    blocks, is_block = F.col("purity") >= reject, F.col("label") == BLOCK
    return asked.agg(F.count_if(blocks & is_block).alias("hits"), F.count_if(blocks & ~is_block).alias("false_blocks"),
                     F.count_if(~blocks & is_block).alias("misses"), F.count_if(~blocks & ~is_block).alias("agreed"))
