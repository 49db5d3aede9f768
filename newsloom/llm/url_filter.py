"""URL filter: listed rules first, then path templates learned per host and judged by labelled purity.

The labels are the rules' own verdicts; counts are of distinct paths, so it does not matter how often a url
occurs. Paths of a host form a tree of segments. Runs of digits are placeholders from the start; level by
level, a place with many different literals becomes one wildcard, and literals whose branches have a similar
shape (they end here, go on with a number, go on deeper) become one branch, whatever their labels. What a
path turns into is its template. A template is rejected when the smoothed share of block among its labelled
paths reaches ``REJECT`` and at least the share ``SUPPORT`` of its paths is labelled.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.containment import settled
from newsloom.llm.containment import small as bounded
from newsloom.session import durable

#: Segments told apart; what lies deeper counts as one last segment.
DEPTH = 8
#: A place is variable with at least so many literals, if they are at least one in so many distinct paths.
LITERALS, ONE_IN = 20, 5
#: Confidence of the Hoeffding bound within which a branch may differ from those it joins.
ALPHA = 0.05
REJECT, SUPPORT = 0.8, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = "^(?s:.*?)://([^/?#]*)([^?#]*)"
_COUNTS = ("n", "ends", "numbered", "deeper")


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, SPLIT, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls. ``rules``: (verdict, host and path)."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        found, verdict = F.when(fits, F.lit(text)).otherwise(found), F.when(fits, F.lit(action)).otherwise(verdict)
    return found, verdict


def _segments(path: Column) -> Column:
    every = F.array_remove(F.split(F.regexp_replace(path, "[0-9]+", "{n}"), "/"), "")
    deep = F.concat(F.slice(every, 1, DEPTH - 1), F.array(F.array_join(F.slice(every, DEPTH, F.greatest(F.size(every), F.lit(1))), "/")))
    return F.when(F.size(every) > DEPTH, deep).otherwise(every)


def _labels(level: DataFrame, k: int) -> DataFrame:
    """(host, prefix, child, label): what each child of a place is called from here on."""
    at = ["host", "prefix"]
    numbered = F.coalesce(F.contains(F.get("segments", F.lit(k)), F.lit("{n}")), F.lit(False))
    shape = {"ends": F.size("segments") == k, "numbered": numbered, "deeper": F.size("segments") > k + 1}
    each = level.withColumns({c: F.when(holds, F.col("n")).otherwise(0) for c, holds in shape.items()})
    each = each.groupBy(*at, F.get("segments", F.lit(k - 1)).alias("child")).agg(*[F.sum(c).alias(c) for c in _COUNTS])
    literal = durable(each.filter(~F.contains("child", F.lit("{n}"))))
    quarters = [f"_{c}" for c in _COUNTS[1:]]
    marked = literal.select("*", *[F.expr(f"(8 * {c} + n) div (2 * n)").alias(f"_{c}") for c in _COUNTS[1:]])
    place = literal.groupBy(*at).agg(F.count("*").alias("literals"), F.sum("n").alias("paths"))
    pool = marked.groupBy(*at, *quarters).agg(F.count("*").alias("members"), *[F.sum(c).alias(f"pool_{c}") for c in _COUNTS])
    both = marked.join(pool, [*at, *quarters]).join(place, at)
    bound = F.lit((log(2 / ALPHA) / 2) ** 0.5) * (1 / F.sqrt("n") + 1 / F.sqrt("pool_n"))
    alike = F.col("members") > 1
    for c in _COUNTS[1:]:
        alike &= F.abs(F.col(c) / F.col("n") - F.col(f"pool_{c}") / F.col("pool_n")) <= bound
    variable = (F.col("literals") >= LITERALS) & (F.col("literals") * ONE_IN >= F.col("paths"))
    merged = F.concat(F.lit("{"), F.concat_ws(".", *quarters), F.lit("}"))
    return both.select(*at, "child", F.when(variable, F.lit("{*}")).when(alike, merged).otherwise(F.col("child")).alias("label"))


def templates(rows: DataFrame) -> DataFrame:
    """(host, segments, template, purity, support) from rows of (host, path, segments, verdict)."""
    count = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).alias
    paths = rows.distinct().groupBy("host", "segments").agg(F.count("*").alias("n"), count("block")("blocked"), count("allow")("allowed"))
    state = durable(paths.withColumn("prefix", F.lit("")))
    depth = state.agg(F.max(F.size("segments"))).first()[0] or 0
    for k in range(1, depth + 1):
        level = state.filter(F.size("segments") >= k)
        labels = _labels(level, k)
        child = F.get("segments", F.lit(k - 1))
        named = state.withColumn("child", child).join(bounded(labels), ["host", "prefix", "child"], "left")
        longer = F.concat("prefix", F.lit("/"), F.coalesce("label", "child"))
        state = durable(named.select("host", "segments", "n", "blocked", "allowed", F.when(F.col("child").isNotNull(), longer).otherwise(F.col("prefix")).alias("prefix")))
    judged = state.groupBy("host", "prefix").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"), F.sum("n").alias("paths"))
    labelled = F.col("b") + F.col("a")
    judged = judged.select("host", "prefix", ((F.col("b") + 1) / (labelled + 2)).alias("purity"), (labelled / F.col("paths")).alias("support"))
    return state.join(judged, ["host", "prefix"]).select("host", "segments", F.col("prefix").alias("template"), "purity", "support")


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", ident: str = "page_id") -> DataFrame:
    """(ident, host, path, rule, verdict, template, purity, support), one row per row of ``pages``.

    A null url, or one without ``://``, has an empty host and path and the template of the empty path. Null
    and repeated ids are rows like others; other columns of ``pages``, whatever their names, are not read.
    Of several rules of one length that fit, the alphabetically last one holds. Rows with the same host and
    path get the same verdict, however many there are; of a path with more than ``DEPTH`` segments, the
    rest counts as one. Only distinct paths and their counts are shuffled, and the verdicts join back by
    broadcast while they fit the row bound.
    """
    parts = settled(pages.select(pages[ident].alias("_id"), pages[url].alias("_url")), host=host(F.col("_url")), path=path(F.col("_url")))
    found, action = rule(F.col("host"), F.col("path"), rules)
    rows = settled(parts, segments=_segments(F.col("path")), rule=found, verdict=action).drop("_url")
    learned = durable(templates(rows.select("host", "path", "segments", "verdict")))
    joined = rows.join(bounded(learned), ["host", "segments"])
    rejected = (F.col("purity") >= REJECT) & (F.col("support") >= SUPPORT)
    verdict = F.coalesce("verdict", F.when(rejected, F.lit("block")).otherwise(F.lit("allow")))
    return joined.select(F.col("_id").alias(ident), "host", "path", "rule", verdict.alias("verdict"), "template", "purity", "support")
