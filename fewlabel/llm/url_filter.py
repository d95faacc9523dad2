"""URL filters: host and path rules, whose block decisions spread over redirects and canonical links."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fewlabel.llm.common import LOWER, UPPER, frame, text_of
from fewlabel.llm.components import components
from fewlabel.operators.joins import join_small
from fewlabel.session import durable

# What can hide a tag, or is one of interest. An open end reaches to the end of the page, so one pass is enough.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|textarea|title)\b.*?(?:</\1\s*>|\Z)"
    r"""|<(link|meta|base)\b((?:[^<>"']|"[^"]*"|'[^']*')*)>""", re.I | re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
REFRESH = re.compile(r"\s*[\d.]*\s*[;,]?\s*(?:url\s*=\s*)?['\"]?([^'\"]*)", re.I)


def lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?`` or ``#``, A-Z in lower case; empty for a null or without ``://``."""
    return F.coalesce(lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """One spelling per resource: scheme and host in lower case, no fragment. Null without ``://``."""
    start = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(lower(start), rest))


def links_in(page: str, url: str) -> list[str]:
    """The targets of canonical links and of refresh tags in a page, resolved against its base, which is ``url`` if it names none."""
    base, raw = url, []
    for m in MARKUP.finditer(page):
        if not m[2]:
            continue
        has = {a[1].lower(): html.unescape(next((x for x in a.groups()[1:] if x is not None), "")) for a in ATTRIBUTE.finditer(m[3])}
        tag = m[2].lower()
        if tag == "base" and base == url and has.get("href"):
            base = _join(url, has["href"]) or url
        elif tag == "link" and "canonical" in has.get("rel", "").lower().split():
            raw.append(has.get("href", ""))
        elif tag == "meta" and has.get("http-equiv", "").strip().lower() == "refresh":
            raw.append(REFRESH.match(has.get("content", ""))[1])
    return [to for to in (_join(base, r) for r in raw if r.strip()) if to]


def _join(base: str, link: str) -> str | None:
    try:
        return urljoin(base, link.strip())
    except ValueError:  # not a URL, such as a broken IPv6 host
        return None


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``source, target``: canonical links and refresh redirects of all pages with a URL. Only pages that may hold one reach Python."""
    may = F.col("html").rlike(r"(?i)<(link|meta)\b") & F.col("html").rlike(r"(?i)canonical|refresh")
    rows = (pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
            .where(F.contains("url", F.lit("://")) & may))

    def run(batches):
        for b in batches:
            found = [(u, to) for u, page in zip(b["url"], b["html"]) for to in links_in(page, u)]
            yield frame({"source": [f[0] for f in found], "target": [f[1] for f in found]})

    return rows.mapInPandas(run, "source string, target string")


def rule_table(spark, rules: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """``rule_host, rule_path, action, rule`` from pairs such as ``("block", "example.com/en/")`` or a table ``action, rule``."""
    df = rules if isinstance(rules, DataFrame) else spark.createDataFrame([*rules], "action string, rule string")
    return df.select(lower(F.regexp_extract("rule", r"(?s)^([^/]*)", 1)).alias("rule_host"),
                     F.regexp_extract("rule", r"(?s)^[^/]*(.*)", 1).alias("rule_path"), "action", "rule").distinct()


def own_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (``host, path``, each pair once) with the ``action`` and ``rule`` of the longest rule that fits; others are left out.

    A rule fits its host and all hosts below it where the path starts with its path. Every host meets the rules of all its
    endings in one equi-join. Of equally long rules the one with the longer host counts, then ``allow``.
    """
    # Endings of more labels than any rule has cannot meet one, so a host of thousands of dots makes few.
    most = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 1
    labels = F.split("host", r"\.")
    count = F.size(labels)
    endings = F.transform(F.sequence(F.lit(1), F.least(count, F.lit(most))),
                          lambda i: F.array_join(F.slice(labels, count - i + 1, i), "."))
    met = join_small(urls.withColumn("rule_host", F.explode(endings)), rules, ["rule_host"])
    worth = F.struct(F.length("rule").alias("size"), F.length("rule_host").alias("host_size"), (F.col("action") == "allow").alias("allow"),
                     "action", "rule")
    return (met.where(F.startswith("path", F.col("rule_path"))).groupBy("host", "path").agg(F.max(worth).alias("w"))
            .select("host", "path", F.col("w.action").alias("action"), F.col("w.rule").alias("rule")))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, redirects: DataFrame | None = None,
          id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row of ``pages``.

    The longest rule that fits a URL decides. A URL without a rule is equivalent to every address it reaches over canonical
    links, refresh tags and ``redirects`` (``source, target``), in either direction: it is blocked if one of them is blocked
    by a rule and none is allowed by one, and allowed otherwise. Targets need not be pages. Addresses are compared
    without fragment, scheme and host in lower case.

    Addresses with an edge are joined into components round by round with written tables; only whether another
    round is needed reaches the driver. A component's rules are counted by partial aggregation. Pages without edges
    take no part, and the texts of pages are never shuffled.

    A null URL, or one without ``://``, has an empty host and path, no rule and no links: it is allowed. Null or empty pages
    have no links. Repeated rows are judged alike, row by row.
    """
    spark = pages.sparkSession
    table = rule_table(spark, rules)
    edges = page_links(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("source", "target"))
    edges = durable(edges.select(address(F.col("source")).alias("a"), address(F.col("target")).alias("b"))
                    .where("a <> b").distinct(), "url-edges")
    rows = pages.select(F.col(id_col), text_of(url_col).alias("url"))
    rows = rows.select(id_col, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("address"))
    ruled = own_rules(rows.where("host <> ''").select("host", "path").distinct(), table)
    rows = join_small(rows, ruled, ["host", "path"], "left")
    verdict = F.coalesce("action", F.lit("allow"))
    if edges.isEmpty():
        return rows.select(id_col, "host", "path", "rule", verdict.alias("verdict"))
    # Components over strings: an address stands for itself, so no two can be confused.
    linked = components(edges)
    linked = durable(linked.unionByName(linked.select(F.col("component").alias("node"), "component").distinct()), "url-groups")
    nodes = linked.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    known = own_rules(nodes.select("host", "path").distinct(), table)
    blocked = (nodes.join(known, ["host", "path"]).groupBy("component")
               .agg(F.max(F.col("action") == "block").alias("block"), F.max(F.col("action") == "allow").alias("allow"))
               .where("block AND NOT allow").select("component"))
    spread_to = join_small(linked, blocked, ["component"], "left_semi").select(F.col("node").alias("address"), F.lit("block").alias("passed"))
    rows = join_small(rows, spread_to, ["address"], "left")
    return rows.select(id_col, "host", "path", "rule", F.coalesce("action", "passed", F.lit("allow")).alias("verdict"))
