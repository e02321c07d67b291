"""Selectors over the table of nodes: what of a page a registry of selectors finds, and where it stands.

A selector is compiled to a Column over a node (names, classes, ids, attributes) for each of its steps;
steps that stand one below the other are joined by containment. Registries are plain data.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .pages import CONTAINER_ATTRIBUTE, CONTAINER_CLASSES, attr, containments, has, has_class, node_table

#: What the page operators look for, by purpose; each selector compiles (a test holds it).
REGISTRY = {
    "feed": ["main[aria-label]", "main", "div.scaffold-finite-scroll__content", "#main-content", "body"],
    "card": [*(f"div.{c}" for c in CONTAINER_CLASSES), f"div[{CONTAINER_ATTRIBUTE}]", "[data-urn^='urn:li:activity']", "[data-id^='urn:li:']", "article", "[role=article]"],
    "body": ["div.feed-shared-update-v2__description-wrapper", "div.update-components-text", "span.break-words", "[data-test-id*='main-feed-activity-card__commentary']"],
    "author": ["span.update-components-actor__title", "span.feed-shared-actor__name", "a.update-components-actor__meta span", "[data-test-id*=actor-name]", "a[href*='/in/']", "a[href*='/company/']"],
    "more": ["button.feed-shared-inline-show-more-text__see-more-less-toggle", "button[aria-label*='see more' i]"],
}

_COMPOUND = re.compile(r"(?:[A-Za-z][\w\-]*|\*)?(?:[#.][\w\-]+|\[[^\]]*\])*")
_PART = re.compile(r"(?P<tag>[A-Za-z][\w\-]*|\*)|#(?P<id>[\w\-]+)|\.(?P<name>[\w\-]+)|\[\s*(?P<attr>[\w\-]+)\s*(?:(?P<how>[*^$~]?=)\s*(?P<value>\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*(?P<loose>i)?\s*)?\]")


def compile_step(step: str) -> Column:
    """A step without spaces (`div.card[data-id^="x"]`) as a test of a node; ValueError if it is none."""
    if not step or not _COMPOUND.fullmatch(step):
        raise ValueError(f"not a selector: {step!r}")
    test, at = F.col("tag") != "#text", 0
    while at < len(step):
        m = _PART.match(step, at)
        if m is None:
            raise ValueError(f"not a selector: {step[at:]!r}")
        at = m.end()
        if m["tag"] and m["tag"] != "*":
            test = test & (F.col("tag") == m["tag"].lower())
        elif m["id"]:
            test = test & F.coalesce(attr("id") == m["id"], F.lit(False))
        elif m["name"]:
            test = test & has_class(m["name"])
        elif m["attr"] and not m["how"]:
            test = test & has(m["attr"].lower())
        elif m["attr"]:
            value, held = m["value"].strip("\"'"), attr(m["attr"].lower())
            if m["loose"]:
                value, held = value.lower(), F.lower(held)
            how = {"=": held == value, "*=": held.contains(value), "^=": held.startswith(value), "$=": held.endswith(value), "~=": F.array_contains(F.split(held, r"\s+"), value)}[m["how"]]
            test = test & F.coalesce(how, F.lit(False)) & F.lit(bool(value))
    return test


def steps(selector: str) -> list[tuple[str, str]]:
    """(how it stands to the step before: "" first, " " below, ">" a child; the step) of a selector without commas."""
    words = re.sub(r"\s*>\s*", " > ", _quoted(selector).strip()).split()
    out: list[tuple[str, str]] = []
    how = ""
    for word in words:
        if word == ">":
            if how != " ":
                raise ValueError(f"not a selector: {selector!r}")
            how = ">"
            continue
        out.append((how, word.replace("\0", " ").replace("\1", ">")))
        how = " "
    if not out or how == ">":
        raise ValueError(f"not a selector: {selector!r}")
    return out


def _quoted(selector: str) -> str:
    """Spaces and > within brackets hidden, so that only those between steps part them."""
    return re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(" ", "\0").replace(">", "\1"), selector)


def alternatives(selector: str) -> list[str]:
    """The selectors between commas; commas within brackets are \\3 until they are read."""
    return [s.strip() for s in re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(",", "\3"), selector).split(",")]


def matching(nodes: DataFrame, selector: str) -> DataFrame:
    """_page, node, end, depth, parent of the nodes that a selector finds: steps, below (space) and child (>), alternatives (commas)."""
    found = None
    columns = ["_page", "node", "end", "depth", "parent"]
    for one in alternatives(selector):
        rows = None
        for how, step in steps(one.replace("\3", ",")):
            own = nodes.where(compile_step(step) & (F.col("node") > 0)).select(*columns)
            if how == " ":
                own = own.join(containments(own, rows, most=1).select("_page", "node"), ["_page", "node"], "left_semi")
            elif how == ">":
                own = own.join(rows.select("_page", F.col("node").alias("parent")), ["_page", "parent"], "left_semi").select(*columns)
            rows = own
        found = rows if found is None else found.union(rows)
    return found.distinct() if "," in selector else found


def probe(pages: DataFrame, selectors: dict[str, list[str]] | list[str] | None = None, id_col: str = "page_id") -> DataFrame:
    """purpose, selector, n_pages (that have it), n_nodes, nested (of them below another of the same selector), parents (the commonest tags above, at most five).

    A row for each selector of the registry (REGISTRY if None), also for those that find nothing. An
    empty table gives zeros.
    """
    chosen = REGISTRY if selectors is None else selectors if isinstance(selectors, dict) else {"": selectors}
    nodes = node_table(pages, id_col) if "url" in pages.columns else node_table(pages.withColumn("url", F.lit(None).cast("string")), id_col)
    out = None
    for purpose, some in chosen.items():
        for selector in some:
            rows = matching(nodes, selector)
            named = [F.lit(x).alias(n) for n, x in (("purpose", purpose), ("selector", selector))]
            rows = rows.select(*named, "_page", "node", "end", "depth", "parent")
            out = rows if out is None else out.union(rows)
    found = cut(out)
    before = Window.partitionBy("purpose", "selector", "_page").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    above = found.withColumn("_nested", F.coalesce(F.max("end").over(before) > F.col("node"), F.lit(False)))
    tags = nodes.select("_page", F.col("node").alias("parent"), F.col("tag").alias("_above"))
    told = above.join(tags, ["_page", "parent"], "left")
    tagged = told.groupBy("purpose", "selector", "_above").agg(F.count("*").alias("_k"))
    commonest = tagged.groupBy("purpose", "selector").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("_k")).alias("k"), "_above"))), 1, 5), lambda x: x["_above"]).alias("parents"))
    counts = told.groupBy("purpose", "selector").agg(F.countDistinct("_page").alias("n_pages"), F.count("*").alias("n_nodes"), F.count_if("_nested").alias("nested"))
    listed = pages.sparkSession.createDataFrame([(p, s) for p, some in chosen.items() for s in some], "purpose string, selector string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = listed.join(counts, ["purpose", "selector"], "left").join(commonest, ["purpose", "selector"], "left")
    return joined.select("purpose", "selector", zero("n_pages"), zero("n_nodes"), zero("nested"), F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))
