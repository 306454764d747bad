"""URL filters by a tree of path templates.

Rules come first; a url that no rule fits is judged by its template. A url without ``://``,
or null, has an empty host and path and is judged as the template of that empty host.
Equal urls get equal verdicts; labels of rows with a null label are ignored; an empty table
gives an empty result. The label column must not clash with the columns of the urls: all
work is done on own copies of the id and the url, so other columns never matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.llm.common import discard, stored

#: Segments with a digit vary by nature: numbers, dates, hashes.
VARIABLE = "[0-9]"
#: Levels of the tree; what is left of a longer path is the segment of the last one.
LEVELS = 12


@dataclass(frozen=True)
class Rule:
    """Allow or block what lies under ``host`` (with its subdomains) and the start of a path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, pattern, 2)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def shape(path: Column) -> Column:
    """Segments of a path, those with digits as ``*``; from the last level on they are one segment."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    tail = F.array_join(F.slice(segments, LEVELS, 2**31 - 1), "/")
    cut = F.when(F.size(segments) > LEVELS, F.concat(F.slice(segments, 1, LEVELS - 1), F.array(tail))).otherwise(segments)
    return F.transform(cut, lambda s: F.when(s.rlike(VARIABLE), "*").otherwise(s))


def _generalised(nodes: DataFrame, min_count: int, z: float) -> DataFrame:
    """What each segment (``node``, ``segment``) becomes: itself, ``+`` or ``*``.

    A segment of fewer than ``min_count`` rows, or one with digits, is a wildcard. The others are
    held against the middle share of rejects among their siblings: those that lie within ``z`` standard
    errors and one row of what it lets expect are alike and become one branch, the rest stay themselves.
    """
    kids = nodes.groupBy("node", "segment").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("b").alias("b"))
    named = kids.where((F.col("segment") != "*") & (F.col("rows") >= min_count))
    rate = F.col("b") / F.when(F.col("n") > 0, F.col("n"))
    pooled = named.groupBy("node").agg(
        F.coalesce(F.percentile_approx(rate, 0.5, F.lit(1000)), F.lit(0.0)).alias("middle"), F.sum("n").alias("pn"),
        F.count(F.lit(1)).alias("siblings"))
    share = (F.col("middle") * F.col("pn") + 0.5) / (F.col("pn") + 1)
    alike = F.abs(F.col("b") - F.col("n") * share) <= z * F.sqrt(F.col("n") * share * (1 - share)) + 1
    told = named.join(pooled, "node").select("node", "segment", F.when(
        alike & (F.col("siblings") > 1), "+").otherwise(F.col("segment")).alias("token"))
    return kids.select("node", "segment").join(told, ["node", "segment"], "left").select(
        "node", "segment", F.coalesce("token", F.lit("*")).alias("token"))


def template_tree(urls: DataFrame, min_count: int = 5, z: float = 2.0, strength: float = 8.0) -> DataFrame:
    """Templates of the hosts of ``urls`` (host, shape, bad): host, shape, template, purity.

    ``bad`` is 1.0 for a labelled url to reject, 0.0 for one to keep, null without a label. The tree
    grows level by level: a node is named by its already generalised way from the host, so the children
    of all branches that were merged or made wildcards are one set, and segments that are rare under each
    of them are frequent under all. ``purity`` is the share of rejects of a template, smoothed by
    ``strength`` rows at the host's share, itself smoothed towards that of all hosts.
    """
    shapes = stored(urls.groupBy("host", "shape").agg(
        F.count("*").alias("rows"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("b")))
    deepest = shapes.agg(F.max(F.size("shape"))).first()[0] or 0
    tree = shapes.withColumns({
        "node": F.xxhash64("host"), "tokens": F.array().cast("array<string>")})
    for level in range(deepest):
        segment = F.get("shape", F.lit(level))
        rows = tree.withColumn("segment", segment)
        said = _generalised(rows.where("segment IS NOT NULL"), min_count, z)
        grown = rows.join(said, ["node", "segment"], "left")
        more = F.col("token").isNotNull()
        last, tree = tree, stored(grown.select(
            "host", "shape", "rows", "n", "b",
            F.when(more, F.xxhash64("node", "token")).otherwise(F.col("node")).alias("node"),
            F.when(more, F.array_append("tokens", F.col("token"))).otherwise(F.col("tokens")).alias("tokens")))
        if level:
            discard(last)
    branches = tree.groupBy("host", "tokens").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    hosts = shapes.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("b").alias("hb"))
    total = shapes.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    prior = (total.b or 0.0) / total.n if total.n else 0.0
    host_share = (F.col("hb") + strength * prior) / (F.col("hn") + strength)
    branches = branches.join(hosts, "host").select(
        "host", "tokens", ((F.col("b") + strength * host_share) / (F.col("n") + strength)).alias("purity"))
    return tree.select("host", "shape", "tokens").join(branches, ["host", "tokens"]).select(
        "host", "shape", F.concat_ws("/", F.lit(""), "tokens").alias("template"), "purity")


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], id_column: str = "page_id",
    url_column: str = "url", reject_at: float = 0.5, **tree,
) -> DataFrame:
    """Id, host, path, rule, verdict, template and purity of each row of ``pages``.

    ``labels`` has ``id`` and ``bad`` (1.0 reject, 0.0 keep). A row's verdict is that of the
    longest fitting rule, else "block" if the purity of its template is ``reject_at`` or more.
    """
    host, path = url_parts(F.col(url_column))
    parsed = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("shape", shape(F.col("path")))
    marks = labels.select("id", "bad").where("id is not null and bad is not null").groupBy("id").agg(
        F.max("bad").cast("double").alias("bad"))
    tree_of = stored(template_tree(parsed.join(marks, "id", "left").select("host", "shape", "bad"), **tree))
    rule, by_rule = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.join(tree_of, ["host", "shape"], "left")
    by_tree = F.when(F.col("purity") >= reject_at, "block").otherwise("allow")
    return judged.select(
        F.col("id").alias(id_column), "host", "path", rule.alias("rule"),
        F.coalesce(by_rule, by_tree).alias("verdict"), "template", "purity")
