"""URL verdicts from a per-host tree of path templates.

Native: DataFrame functions only.  Urls are cut into host and path; rules (host, path prefix) decide the urls they fit and
label them.  All others are judged by templates:

1. Segments that vary by nature (numbers, long hexadecimal strings) become wildcards; then rows are summed by (host, shaped path), so a host with a
   third of all urls is a few rows from here on.
2. Level by level from the root, a node whose children are many and thinly used has them replaced by one wildcard.
3. Level by level from the leaves, branches of one parent merge if they are alike: both have labelled urls, what lies below them is distributed as in all
   labelled siblings together (total variation within ``alike`` plus sampling error), and their labelled rates do not differ from the pooled rate by more than ``z``
   standard errors.  A branch without labels never merges, so it takes no neighbour's verdict.
4. A template is rejected if its smoothed labelled purity, (bad + strength * prior) / (labelled + strength), reaches ``reject``; the prior is
   the bad share among all labelled urls, at most a half, so a template without labels is kept.

Sums by host, by parent and by branch are aggregates that are joined back, so no task holds a host.

Nulls and ties: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed.  Of rules of one length the first by text wins.  Repeated
rows are judged alike.  An empty table gives no rows.  Very long paths count whole: what lies beyond ``depth - 1`` segments is one last segment, shaped and counted like
any other.  Columns of the input keep their names and values but for url_host, url_path, url_rule, url_verdict, url_template and url_purity, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANY = "*"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        hit = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return F.lit(None).cast("struct<rule: string, verdict: string>") if out is None else out


def shaped(path: Column, depth: int) -> Column:
    """The path's segments with natural wildcards; those from the ``depth``-th on are one."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)

    def shape(s: Column) -> Column:
        s = F.regexp_replace(s, "^[0-9]+(?=$|[.])", "{n}")
        return F.when(s.rlike("^[0-9a-fA-F-]{8,}$"), F.lit("{h}")).otherwise(s)

    parts = F.transform(parts, shape)
    rest = F.array_join(F.slice(parts, depth, F.greatest(F.size(parts), F.lit(1))), "/")
    return F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth - 1), F.array(rest))).otherwise(parts)


def generalised(shapes: DataFrame, levels: int, many: int, thin: float) -> DataFrame:
    """``shapes`` (host, shape, n, ...) with ``template``: children of a node that are many and thinly used become ``*``.

    A node is (host, template so far); each level is one aggregate over the summed rows and one join back, written down.
    """
    rows = shapes.withColumn("template", F.array().cast("array<string>"))
    for level in range(levels):
        child = F.get("shape", F.lit(level))
        nodes = (
            rows.where(F.size("shape") > level)
            .groupBy("host", F.concat_ws("/", "template").alias("node"), child.alias("child"))
            .agg(F.sum("n").alias("n"))
            .groupBy("host", "node")
            .agg(F.count("*").alias("kinds"), F.sum("n").alias("all"))
            .where((F.col("kinds") >= many) & (F.col("all") < thin * F.col("kinds")))
            .select(F.col("host").alias("node_host"), F.col("node").alias("node_key"), F.lit(True).alias("wide"))
        )
        joined = rows.join(nodes, (F.col("host") == F.col("node_host")) & (F.concat_ws("/", "template") == F.col("node_key")), "left")
        step = F.when(F.size("shape") > level, F.array(F.when(F.col("wide"), F.lit(ANY)).otherwise(child))).otherwise(F.array().cast("array<string>"))
        rows = written(joined.withColumn("template", F.concat("template", step)).drop("node_host", "node_key", "wide"), "url-level")
    return rows


def merged(rows: DataFrame, level: int, alike: float, z: float) -> DataFrame:
    """``rows`` (host, template, n, bad, labelled) with segment ``level`` a wildcard where that branch is like its labelled siblings."""
    branch, below = F.get("template", F.lit(level)), F.concat_ws("/", F.slice("template", level + 2, 1_000_000))
    parent = F.concat_ws("/", F.slice("template", 1, level))
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "labelled")]
    deep = rows.where(F.size("template") > level)
    cells = deep.groupBy("host", parent.alias("parent"), branch.alias("branch"), below.alias("below")).agg(*sums)
    branches = cells.groupBy("host", "parent", "branch").agg(*sums, F.count("*").alias("kinds")).where("labelled > 0")
    pools = branches.groupBy("host", "parent").agg(F.sum("n").alias("pool_n"), (F.sum("bad") / F.sum("labelled")).alias("pool"), F.count("*").alias("siblings")).where("siblings > 1")
    branches = branches.join(pools, ["host", "parent"]).withColumnRenamed("n", "branch_n")
    cells = cells.select("host", "parent", "branch", "below", "n").join(branches.select("host", "parent", "branch", "branch_n", "pool_n"), ["host", "parent", "branch"])
    of_all = cells.groupBy("host", "parent", "below").agg(F.sum("n").alias("cell_n"))
    apart = F.sum(F.greatest(F.lit(0.0), F.col("n") / F.col("branch_n") - F.col("cell_n") / F.col("pool_n")))
    apart = cells.join(of_all, ["host", "parent", "below"]).groupBy("host", "parent", "branch").agg(apart.alias("apart"))
    error = F.sqrt(F.col("pool") * (1 - F.col("pool")) / F.col("labelled"))
    same = (F.abs(F.col("bad") / F.col("labelled") - F.col("pool")) <= z * error + 1e-9) & (F.col("apart") <= alike + F.sqrt(F.col("kinds") / F.col("branch_n")) / 2)
    alike_ones = branches.join(apart, ["host", "parent", "branch"]).where(same)
    alike_ones = alike_ones.select(F.col("host").alias("b_host"), F.col("parent").alias("b_parent"), F.col("branch").alias("b_branch"))
    on = (F.col("host") == F.col("b_host")) & (parent == F.col("b_parent")) & (branch == F.col("b_branch")) & (F.size("template") > level)
    out = rows.join(alike_ones, on, "left")
    wide = F.concat(F.slice("template", 1, level), F.array(F.lit(ANY)), F.slice("template", level + 2, 1_000_000))
    return out.withColumn("template", F.when(F.col("b_host").isNotNull(), wide).otherwise(F.col("template"))).drop("b_host", "b_parent", "b_branch")


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    url: str = "url",
    depth: int = 16,
    many: int = 24,
    thin: float = 4.0,
    alike: float = 0.1,
    z: float = 2.0,
    strength: float = 10.0,
    reject: float = 0.6,
) -> DataFrame:
    """``pages`` with url_host, url_path, url_rule, url_verdict, url_template and url_purity."""
    host, path = split_url(F.col(url))
    own = [c for c in pages.columns if c not in ("url_host", "url_path", "url_rule", "url_verdict", "url_template", "url_purity")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), host.alias("url_host"), path.alias("url_path"))
    rows = rows.withColumn("hit", longest_rule(F.col("url_host"), F.col("url_path"), rules)).withColumn("shape", shaped(F.col("url_path"), depth))
    label = F.col("hit.verdict")
    shapes = rows.groupBy(F.col("url_host").alias("host"), F.concat_ws("/", "shape").alias("shape_key")).agg(
        F.first("shape").alias("shape"),
        F.count("*").alias("n"),
        F.coalesce(F.sum((label == "block").cast("long")), F.lit(0)).alias("bad"),
        F.count(label).alias("labelled"),
    )
    shapes = written(shapes, "url-shapes")
    levels, bad, labelled = shapes.agg(F.max(F.size("shape")), F.sum("bad"), F.sum("labelled")).first()
    groups = generalised(shapes, levels or 0, many, thin)
    for level in reversed(range(levels or 0) if labelled else []):
        groups = written(merged(groups, level, alike, z), "url-merged")
    prior = min(0.5, bad / labelled) if labelled else 0.0
    groups = groups.select("host", "shape_key", F.concat_ws("/", "template").alias("group"), "bad", "labelled")
    purity = (F.sum("bad") + strength * prior) / (F.sum("labelled") + strength)
    of_group = groups.groupBy(F.col("host").alias("g_host"), F.col("group").alias("g_group")).agg(purity.alias("url_purity"))
    table = groups.join(of_group, (F.col("host") == F.col("g_host")) & (F.col("group") == F.col("g_group")))
    table = table.select(F.col("host").alias("t_host"), F.col("shape_key").alias("t_shape"), F.concat("host", F.lit("/"), "group").alias("url_template"), "url_purity")
    out = rows.join(table, (F.col("url_host") == F.col("t_host")) & (F.concat_ws("/", "shape") == F.col("t_shape")), "left")
    verdict = F.coalesce(label, F.when((F.col("url_purity") >= reject) & (F.col("url_host") != ""), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in own], "url_host", "url_path", F.col("hit.rule").alias("url_rule"), verdict.alias("url_verdict"), "url_template", "url_purity")
