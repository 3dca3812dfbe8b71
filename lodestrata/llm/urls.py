"""URL filter by a path-template tree, after an explicit rule list.

Paths are first shortened to shapes: runs of digits and long hexadecimal names become
wildcards, and equal shapes of a host are counted together. Then the tree of each host is built
level by level. A segment, however small, stays a branch of its own if its labelled share of bad
pages differs significantly from that of its siblings; all other branches merge into the
parent's wildcard. The leaves are the templates. A template
is rejected if its share of bad labels, smoothed towards its host's and that towards the
whole table's, is above a threshold. Rules come first: the longest fitting one decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm._shared import col, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains where the path starts with its path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, F.lit(r.text)).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def path_shape(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"(?<![A-Za-z0-9])(?=[A-Fa-f-]*[0-9])[0-9A-Fa-f-]{8,}(?![A-Za-z0-9])", "*"), r"[0-9]+", "*")


def _templates(shapes: DataFrame, depth: int, z: float) -> DataFrame:
    """shapes (host, shape, n, labelled, bad) with its template added."""
    parts = F.split(F.regexp_replace("shape", "^/", ""), "/")
    state = shapes.withColumns({"parts": parts, "template": F.lit("")})
    deepest = state.agg(F.max(F.size("parts"))).first()[0] or 0
    for level in range(min(depth, deepest)):
        rest = F.array_join(F.slice("parts", depth, 1 << 20), "/") if level == depth - 1 else F.col("parts")[level]
        state = state.withColumn("part", F.when(F.size("parts") > level, rest))
        here = state.filter("part IS NOT NULL")
        child = here.groupBy("host", "template", "part").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
        node = child.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "bad")])
        seen = child.join(node, ["host", "template"])
        others = F.col("all_labelled") - F.col("labelled")
        pooled = F.col("all_bad") / F.col("all_labelled")
        spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / others))
        apart = F.abs(F.col("bad") / F.col("labelled") - (F.col("all_bad") - F.col("bad")) / others) >= z * spread
        own = seen.filter((F.col("labelled") > 0) & (others > 0)).filter((spread > 0) & apart)
        own = own.select("host", "template", "part", F.lit(True).alias("own"))
        named = F.when(F.col("own"), F.col("part")).otherwise(F.lit("*"))
        state = state.join(own, ["host", "template", "part"], "left").select(
            "host", "shape", "n", "labelled", "bad", "parts",
            F.when(F.col("part").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), named)).alias("template"),
        )
        state = stored(state, "url-templates")
    return state


def template_verdicts(
    labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", depth: int = 8, z: float = 2.576, weight: float = 10.0, reject: float = 0.5
) -> DataFrame:
    """host, shape, template, bad_share, rejected for every shape of the urls.

    bad is null for pages without a label. A host whose pages have no labels takes the whole
    table's share of bad labels; a table without labels rejects nothing.
    """
    url = col(url_col)
    bad = col(bad_col)
    shapes = (
        labelled.select(url_host(url).alias("host"), path_shape(url_path(url)).alias("shape"), bad.alias("bad"))
        .groupBy("host", "shape")
        .agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    )
    state = _templates(stored(shapes, "url-shapes"), depth, z)
    per_host = state.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"))
    whole = per_host.agg(F.sum("host_labelled"), F.sum("host_bad")).first()
    rate = (whole[1] or 0) / max(1, whole[0] or 0)
    smooth = lambda b, n, to: (b + weight * to) / (n + weight)
    per_template = state.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).join(per_host, "host")
    host_share = smooth(F.col("host_bad"), F.col("host_labelled"), F.lit(rate))
    judged = per_template.select("host", "template", smooth(F.col("bad"), F.col("labelled"), host_share).alias("bad_share"))
    return state.select("host", "shape", "template").join(judged, ["host", "template"]).withColumn("rejected", F.col("bad_share") > reject)


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", bad_col: str = "bad", **kw) -> DataFrame:
    """For each row: id, host, path, rule, verdict ("allow" or "block"), and what the method goes by:
    template and bad_share, its smoothed share of bad labels.

    Of rules that fit, the one with the longest text decides; of equally long ones the last in the
    list.

    A null url, or one without ://, has an empty host and path. Urls of any length are taken
    whole; path segments from the depth-th on count as one. Repeated rows are judged each, and
    null identifiers carried. An empty table gives an empty result. Other columns are ignored.
    """
    judged = template_verdicts(pages, url_col, bad_col, **kw)
    url = col(url_col)
    rows = pages.select(col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"))
    text, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", path_shape(F.col("path")).alias("shape"), text.alias("rule"), verdict.alias("by_rule"))
    own = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.coalesce("by_rule", own).alias("verdict")
    return rows.join(judged, ["host", "shape"], "left").select(F.col("id").alias(id_col), "host", "path", "rule", verdict, "template", F.round("bad_share", 6).alias("bad_share"))
