"""Posts from web pages as Spark jobs over a table of nodes.

A small reader turns each page into rows: its elements and texts in document order, each with the
interval of nodes below it. Whatever is asked of the structure is then a question about intervals
within a page: what lies inside or above a node is a window over the nodes in order, counts and
rankings are groups by parent, and the outermost or innermost of some nodes are windows too.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import partial
from html import unescape
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.text import SPACES
from ..llm.hashing import slices
from ..plans.lineage import cut

# ---- Fixed values: names that mark feeds, posts, bodies, authors -------------------------------------

BLOCK_TAGS = frozenset("address article aside blockquote dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
SKIPPED_TAGS = frozenset("button script style noscript template".split())
FOREIGN_CLASSES = ("comment", "social-detail", "social-counts", "social-activity", "reactions", "reaction-")
CONTAINER_CLASSES = ("feed-shared-update-v2", "fie-impression-container")
CONTAINER_ATTRIBUTE = "data-finite-scroll-hotkey-item"
URN_ATTRIBUTES = ("data-urn", "data-id", "data-activity-urn")
POST_URN_TYPES = ("activity", "share", "ugcpost", "aggregate")
BODY_RULES = (
    ("div", "feed-shared-update-v2__description-wrapper", True),
    ("div", "update-components-text", True),
    ("div", "feed-shared-inline-show-more-text", True),
    ("span", "break-words", True),
    ("", "update-components-update-v2__commentary", True),
    ("", "update-components-text", False),
    ("", "description-wrapper", False),
)
BODY_TEST_ID = "main-feed-activity-card__commentary"
AUTHOR_TEST_ID = "actor-name"
MEDIA_CLASSES = ("update-components-image", "update-components-video", "update-components-document", "update-components-poll", "update-components-article", "update-components-linkedin-video")
RESHARE_CLASS = "update-components-mini-update-v2"
MORE_CLASSES = ("feed-shared-inline-show-more-text__see-more-less-toggle", "inline-show-more-text__button")
OWN_HOST = re.compile(r"^https://(?:www\.)?linkedin\.com/")
HIDDEN_CLASS = re.compile(r"(?:^|\s|-)(?:visually-hidden|sr-only|a11y-text|screen-reader)", re.I)
ACTION = re.compile(r"(?:like|comment|repost|send|share)", re.I)
SOCIAL_CONTEXT = re.compile(r"\b(?:commented on|replied to|likes|liked|loves|celebrates|supports|finds|reposted|shared)\b[^.]{0,40}\bthis\b", re.I)
#: Names: what stands before and after them, what follows a name on its line, degrees of contact, what is no name, profile addresses.
AROUND_NAMES = (r"(?i)\Aview\s+", r"(?i)['’]s\s+(?:profile(?:\s+photo)?|page).*\z", r"(?i)\s*[-–]\s*profile\s+photo\s*\z")
AFTER_NAME = r"\s*[·•|]\s.*\z"
DEGREE = r"(?i)\s*[•·]?\s*\b(?:1st|2nd|3rd)\+?\s*\z"
NOT_A_NAME = r"(?i)\A(?:follow(?:ing)?|connect|promoted|sponsored|\+\s*follow|see more|view profile|•|·)\z"
PROFILE = r"/(?:in|company|school)/([^/?#]+)"
LEAST, MOST_ITEM, MOST_POST, MOST_HEADING, MOST_NAME = 80, 8000, 6000, 40, 80
LEAST_GAIN = 40


_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SELF_CLOSING = {"p": BLOCK_TAGS, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
#: Attributes that the operators ask for; others are not kept.
ATTRIBUTES = ("class", "id", "role", "href", "style", "hidden", "alt", "data-urn", "data-id", "data-activity-urn", "data-test-id", CONTAINER_ATTRIBUTE, "aria-label", "aria-hidden", "aria-expanded")
SHORT = 160


#: One step inside a tag: its end, or an attribute with what follows its equals sign (an opening quote, or a bare value).
_STEP = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:([\"'])|([^\s>\"'][^\s>]*)|(?=>)))?)")
_OPENING, _CLOSING = re.compile(r"<([a-zA-Z][^\s/>]*)"), re.compile(r"</([a-zA-Z][^\s/>]*)")
#: Elements whose content is text up to their own closing tag.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style")}


class _Reader:
    """Rows of one page: (node, parent, depth, place, tag, attrs, text), with ends and lengths filled in as elements close.

    One pass from left to right: every search either moves on or ends the page, and an element is closed
    once, so time is in proportion to the page however broken it is. A tag, quote or comment that
    never ends takes the rest of the page with it, as in browsers.
    """

    def __init__(self) -> None:
        self.rows: list[list] = [[0, -1, 0, 0, "#page", {}, None]]
        self.ends, self.spans, self.children = [0], [[0, 0]], [0]
        self.open, self.tags = [0], Counter()
        self.pieces: list[str] = []
        self.size = 0

    def _add(self, tag: str, attrs: dict, text: str | None) -> int:
        k, parent = len(self.rows), self.open[-1]
        self.rows.append([k, parent, len(self.open), self.children[parent], tag, attrs, text])
        self.ends.append(k + 1)
        self.spans.append([self.size, self.size + len(text or "")])
        self.children.append(0)
        if text is None:
            self.children[parent] += 1
        return k

    def _begin(self, tag: str, attrs: dict) -> None:
        while len(self.open) > 1 and tag in _SELF_CLOSING.get(self.rows[self.open[-1]][4], ()):
            self._close()
        self.open.append(self._add(tag, attrs, None))
        self.tags[tag] += 1
        if tag in _VOID:
            self._close()

    def _finish(self, tag: str) -> None:
        if self.tags[tag]:  # else no such element is open, and the stack need not be searched
            while self.rows[self.open[-1]][4] != tag:
                self._close()
            self._close()

    def _data(self, data: str) -> None:
        if data:
            self._add("#text", {}, data)
            self.pieces.append(data)
            self.size += len(data)

    def _close(self) -> None:
        k = self.open.pop()
        self.tags[self.rows[k][4]] -= 1
        self.ends[k], self.spans[k][1] = len(self.rows), self.size

    def _attributes(self, html: str, at: int) -> tuple[dict, int]:
        """(the attributes that are kept, place after the tag's end; past the page if it has none)."""
        kept: dict[str, str] = {}
        while (m := _STEP.match(html, at)) is not None and m.end() > at:
            at = m.end()
            if m[1]:
                return kept, at
            value = m[4] or ""
            if m[3]:
                if (close := html.find(m[3], at)) < 0:
                    break
                value, at = html[at:close], close + 1
            if (name := m[2].lower()) in ATTRIBUTES:
                kept[name] = unescape(value)
        return kept, len(html) + 1

    def _scan(self, html: str) -> None:
        at, start, end = 0, 0, len(html)  # text from start on is not given out yet
        while (at := html.find("<", at)) >= 0:
            if (m := _OPENING.match(html, at)) is not None:
                self._data(unescape(html[start:at]))
                tag = m[1].lower()
                attrs, at = self._attributes(html, m.end())
                if at > end:
                    return
                self._begin(tag, attrs)
                if tag in _RAW:
                    close = _RAW[tag].search(html, at)
                    self._data(html[at : close.start() if close else end])
                    at = close.start() if close else end
            elif (m := _CLOSING.match(html, at)) is not None:
                self._data(unescape(html[start:at]))
                at = self._attributes(html, m.end())[1]
                if at > end:
                    return
                self._finish(m[1].lower())
            elif html.startswith(("<!", "<?", "</"), at):
                self._data(unescape(html[start:at]))
                mark = "-->" if html.startswith("<!--", at) else ">"
                at = html.find(mark, at + 2)
                if at < 0:
                    return
                at += len(mark)
            else:
                at += 1  # a sign of the text
                continue
            start = at
        self._data(unescape(html[start:]))

    def read(self, html: str) -> list[list]:
        """Rows with end, length (of the trimmed text below) and, where it is short, that text."""
        self._scan(html)
        while self.open:
            self._close()
        text = "".join(self.pieces)
        solid = [i for i, c in enumerate(text) if c not in SPACES]
        for row, end, (a, b) in zip(self.rows, self.ends, self.spans, strict=True):
            x, y = bisect_left(solid, a), bisect_left(solid, b)
            a, b = (solid[x], solid[y - 1] + 1) if x < y else (a, a)
            row += [end, b - a, text[a:b] if b - a <= SHORT else None]
        return self.rows


_NODE = {"node": pa.int32(), "parent": pa.int32(), "depth": pa.int32(), "place": pa.int32(), "tag": pa.string(), "attrs": pa.map_(pa.string(), pa.string()), "text": pa.string(), "end": pa.int32(), "length": pa.int32(), "short": pa.string()}
NODES = "node int, parent int, depth int, place int, tag string, attrs map<string,string>, text string, end int, length int, short string"


def node_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The nodes of all pages: _page (a number for each row of pages), NODES; the first node of a page carries page_id and url."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.monotonically_increasing_id().alias("_page"), F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", 1):  # nodes take many times the room of their page
            found = [_Reader().read(h or "") for h in part.column("html").to_pylist()]
            sizes = [len(x) for x in found]
            index = pa.array([i for i, n in enumerate(sizes) for _ in range(n)], pa.int32())
            first = pa.array([i if k == 0 else None for i, n in enumerate(sizes) for k in range(n)], pa.int32())
            every = [row for x in found for row in x]
            columns = [pa.array([list(r[k].items()) if n == "attrs" else r[k] for r in every], t) for k, (n, t) in enumerate(_NODE.items())]
            yield pa.RecordBatch.from_arrays([part.column("_page").take(index), part.column("page_id").take(first), part.column("url").take(first), *columns], ["_page", "page_id", "url", *_NODE])

    return cut(rows.mapInArrow(read, f"_page long, page_id {kind}, url string, {NODES}"))


# ---- what a node is, from itself ---------------------------------------------------------------------


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def has(name: str) -> Column:
    return attr(name).isNotNull()


def classes() -> Column:
    return F.coalesce(attr("class"), F.lit(""))


def has_class(*names: str) -> Column:
    return F.arrays_overlap(F.split(F.btrim(classes()), r"\s+"), F.array(*map(F.lit, names)))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def is_container() -> Column:
    urns = [F.lower(attr(a)).startswith(f"urn:li:{t}") for a in URN_ATTRIBUTES for t in POST_URN_TYPES]
    return _any([(F.col("tag") == "div") & (has_class(*CONTAINER_CLASSES) | has(CONTAINER_ATTRIBUTE)), *urns])


def may_be_post() -> Column:
    div = (F.col("tag") == "div") & (has_class(*CONTAINER_CLASSES) | has("data-id") | F.coalesce(attr("role") == "article", F.lit(False)))
    return _any([F.col("tag") == "article", has("data-urn"), attr("data-id").startswith("urn:li:"), div])


def is_named_foreign() -> Column:
    return _any([classes().contains(c) for c in FOREIGN_CLASSES] + [attr(a).contains("urn:li:comment") for a in ("data-id", "data-urn")])


def has_post_urn() -> Column:
    return _any([F.lower(F.regexp_extract(attr(a), "urn:li:([a-zA-Z]+)", 1)).isin(*POST_URN_TYPES) for a in URN_ATTRIBUTES])


def links_to(*parts: str) -> Column:
    return (F.col("tag") == "a") & _any([attr("href").contains(p) for p in parts])


def is_hidden() -> Column:
    return F.col("tag").isin(*SKIPPED_TAGS) | is_named_foreign() | has("hidden") | classes().rlike(f"(?i){HIDDEN_CLASS.pattern}") | F.coalesce(attr("style").rlike(r"display\s*:\s*none"), F.lit(False))


def in_order(*keys: str) -> WindowSpec:
    """The nodes of a page (or of each post in it) in document order."""
    return Window.partitionBy("_page", *keys).orderBy("node")


def inside(test: Column, *keys: str) -> Column:
    """Whether a node lies below one that passes the test: the furthest end of those before it is beyond it."""
    return F.coalesce(F.max(F.when(test, F.col("end"))).over(in_order(*keys).rowsBetween(Window.unboundedPreceding, -1)) > F.col("node"), F.lit(False))


def described(nodes: DataFrame) -> DataFrame:
    """Elements with authors (author links below), container, marked, foreign, after_bar, actor and others of their traits."""
    e = nodes.where("tag != '#text'").withColumns(
        {
            "container": is_container() & (F.col("node") > 0), "marked": may_be_post(), "named_foreign": is_named_foreign(), "author_link": links_to("/in/", "/company/"),
            "actor_link": links_to("/in/", "/company/", "/school/"), "button": (F.col("tag") == "button") & F.col("short").rlike(f"(?i)^{ACTION.pattern}$"),
            "social": F.coalesce(F.col("short").rlike(f"(?i){SOCIAL_CONTEXT.pattern}"), F.lit(False)),
        }
    )
    # what follows, read from the end: a frame that only grows costs the same for each row, one that shrinks is computed anew
    ahead = Window.partitionBy("_page").orderBy(F.desc("node")).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumns(
        {
            # author links up to each node: those below it are the difference between two places
            "_links": F.sum(F.col("author_link").cast("int")).over(in_order()),
            # the first action button below a node, if its place is before the node's end
            "_button": F.min(F.when(F.col("button"), F.struct("node", "parent"))).over(ahead),
            "in_container": inside(F.col("container")), "in_foreign": inside(F.col("named_foreign")),
            "in_actor": inside(classes().contains("actor")), "in_meta": inside(has_class("update-components-actor__meta")),
        }
    )
    seen = nodes.select("_page", F.col("node").alias("_k"), F.sum(links_to("/in/", "/company/").cast("int")).over(in_order()).alias("_upto"))
    e = e.withColumn("_k", F.col("end") - 1).join(seen, ["_page", "_k"]).withColumn("authors", F.col("_upto") - F.col("_links"))
    above = e.select("_page", F.col("node").alias("parent"), F.when(F.col("_button.node") < F.col("end"), F.col("_button")).alias("_bar"))
    e = e.join(above, ["_page", "parent"], "left")
    after_bar = (F.col("parent") > 0) & F.col("_bar").isNotNull() & ((F.col("_bar.parent") == F.col("parent")) | (F.col("node") > F.col("_bar.node")))
    e = e.withColumn("after_bar", F.coalesce(after_bar, F.lit(False)))
    foreign = F.col("named_foreign") | F.col("in_foreign") | F.col("after_bar") | inside(F.col("after_bar"))
    return cut(e.withColumn("foreign", foreign).drop("_links", "_button", "_upto", "_k", "_bar", "text"))


def _stacked(batches: Iterator[pa.RecordBatch], levels: int | None, most: int | None, own: bool) -> Iterator[pa.RecordBatch]:
    """Tops (until: their end) and points (until: null) of pages in document order -> _page, node, top. Held are the open tops of one page."""
    page, above = None, []
    for batch in batches:
        pages, nodes, tops = [], [], []
        for p, node, depth, until in zip(*(batch.column(c).to_pylist() for c in ("_page", "node", "depth", "until")), strict=True):
            if p != page:
                page, above = p, []
            while above and above[-1][1] <= node:
                above.pop()
            if until is not None:
                above.append((node, until, depth))
                continue
            given = 0
            for top, _, level in reversed(above):
                if given == most or levels is not None and depth - level > levels:
                    break
                if own or top != node:
                    pages.append(p)
                    nodes.append(node)
                    tops.append(top)
                    given += 1
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(nodes, pa.int32()), pa.array(tops, pa.int32())], ["_page", "node", "top"])


def containments(points: DataFrame, tops: DataFrame, levels: int | None = None, most: int | None = None, own: bool = False) -> DataFrame:
    """_page, node, top: which of tops (_page, node, end) stand above each of points (_page, node), innermost first.

    levels: at most so many levels up (both need depth); most: at most so many tops a point; own: a
    node that is a top and a point stands above itself. Nodes of a page are sorted by place once and
    read with a stack of the open tops, so the work is that of the answer, never of all pairs in a page.
    """
    depth = lambda df: F.col("depth") if levels is not None else F.lit(0).alias("depth")
    marks = tops.select("_page", "node", depth(tops), F.col("end").alias("until")).union(points.select("_page", "node", depth(points), F.lit(None).cast("int").alias("until"))).distinct()
    # of one place the top comes first, as the point may lie in it
    ordered = marks.repartition("_page").sortWithinPartitions("_page", "node", F.col("until").desc_nulls_last())
    return ordered.mapInArrow(partial(_stacked, levels=levels, most=most, own=own), "_page long, node int, top int")


# ---- discovery -----------------------------------------------------------------------------------------


def outermost(found: DataFrame) -> DataFrame:
    """Of nodes (_page, node, end), those not inside another."""
    furthest = F.max("end").over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("_far", furthest).where(F.col("_far").isNull() | (F.col("_far") <= F.col("node"))).drop("_far")


def innermost(found: DataFrame) -> DataFrame:
    """Of nodes (_page, node, end), those that hold no other."""
    following = F.lead("node").over(in_order())
    return found.withColumn("_next", following).where(F.col("_next").isNull() | (F.col("_next") >= F.col("end"))).drop("_next")


def scopes(e: DataFrame) -> DataFrame:
    """_page, scope, scope_end, scope_depth: the feed of each page - a labelled main, a main, a scroll container, the main content, or the body - or the body if nothing in it may be a post."""
    real = F.col("node") > 0
    tests = [(F.col("tag") == "main") & has("aria-label"), F.col("tag") == "main", (F.col("tag") == "div") & has_class("scaffold-finite-scroll__content"), F.coalesce(attr("id") == "main-content", F.lit(False)), F.col("tag") == "body"]
    place = F.struct("node", "end", "depth")
    first = [F.min(F.when(real & t, place)) for t in tests]
    whole = F.min(F.when(F.col("node") == 0, place))
    page = e.groupBy("_page").agg(F.coalesce(*first, whole).alias("s"), F.coalesce(first[-1], whole).alias("b"))
    held = e.where("marked").join(page, "_page").where((F.col("node") > F.col("s.node")) & (F.col("node") < F.col("s.end"))).select("_page", F.lit(True).alias("_held")).distinct()
    chosen = F.when(F.col("_held"), F.col("s")).otherwise(F.col("b"))
    return page.join(held, "_page", "left").select("_page", chosen.alias("c")).select("_page", F.col("c.node").alias("scope"), F.col("c.end").alias("scope_end"), F.col("c.depth").alias("scope_depth"))


def in_scope(e: DataFrame, scope: DataFrame) -> DataFrame:
    return e.join(scope, "_page").where((F.col("node") > F.col("scope")) & (F.col("node") < F.col("scope_end")))


def named_cards(e: DataFrame, scope: DataFrame) -> DataFrame:
    held = e.where("container").join(scope, "_page").where((F.col("node") >= F.col("scope")) & (F.col("node") < F.col("scope_end")))
    return outermost(held.select("_page", "node", "end")).withColumn("at", F.col("node"))


def headed_cards(e: DataFrame, scope: DataFrame) -> DataFrame:
    """Cards that open with a short second-level heading."""
    heads = in_scope(e, scope).where((F.col("tag") == "h2") & (F.col("place") == 0) & (F.col("length") <= MOST_HEADING) & (F.col("parent") > 0)).select("_page", F.col("parent").alias("node"))
    cards = e.where((F.col("length") >= LEAST) & (F.col("authors") > 0)).join(heads.distinct(), ["_page", "node"])
    return outermost(cards.select("_page", "node", "end")).withColumn("at", F.col("node"))


def list_items(e: DataFrame, scope: DataFrame) -> DataFrame:
    """Neighbours that look like items of a list: _page, parent, node, end, length; nodes that are lists themselves left out."""
    good = in_scope(e, scope).where(F.col("length").between(LEAST, MOST_ITEM) & (F.col("authors") > 0))
    inner = good.groupBy("_page", F.col("parent").alias("node")).agg(F.count("*").alias("_inner"))
    return good.join(inner, ["_page", "node"], "left").select("_page", "parent", "node", "end", "length", "scope", "scope_depth", (F.coalesce("_inner", F.lit(0)) < 2).alias("leaf"))


def list_candidates(items: DataFrame, e: DataFrame) -> DataFrame:
    """_page, parent, items, total_chars, top_share, depth, first: groups of two items or more, however uneven."""
    groups = items.groupBy("_page", "parent").agg(
        F.count("*").alias("_all"), F.count_if("leaf").alias("items"), F.sum(F.when(F.col("leaf"), F.col("length"))).alias("total_chars"), F.max(F.when(F.col("leaf"), F.col("length"))).alias("_top"),
        F.min("node").alias("first"), F.first("scope").alias("scope"), F.first("scope_depth").alias("scope_depth"),
    )
    groups = groups.where("_all > 1 and items > 1").join(e.select("_page", F.col("node").alias("parent"), F.col("depth").alias("_depth")), ["_page", "parent"])
    depth = F.when(F.col("parent") == F.col("scope"), 0).otherwise(F.col("_depth") - F.col("scope_depth") - 1)
    return groups.select("_page", "parent", "items", "total_chars", (F.col("_top") / F.col("total_chars")).alias("top_share"), depth.alias("depth"), "first")


def ranked_lists(candidates: DataFrame) -> DataFrame:
    """Candidates without a dominant item, with their rank: most text first, then the least depth, then page order."""
    order = Window.partitionBy("_page").orderBy(F.desc("total_chars"), "depth", "first")
    return candidates.where("top_share <= 0.95").withColumn("rank", F.row_number().over(order))


def looking_like_posts(e: DataFrame, scope: DataFrame) -> DataFrame:
    """Marked elements that pass for a single post, none of whose nearest marked element above passes too."""
    held = e.where("marked").join(scope, "_page").where((F.col("node") >= F.col("scope")) & (F.col("node") < F.col("scope_end")) & (F.col("node") > 0))
    fits = (F.col("length") <= MOST_POST) & ~F.col("foreign") & (F.col("container") | ~F.col("in_container")) & (has_post_urn() | ((F.col("length") >= LEAST) & F.col("authors").between(1, 3)))
    judged = held.select("_page", "node", "end", fits.alias("good"))
    nearest = containments(judged.where("good"), e.where("marked and node > 0"), most=1).withColumnRenamed("top", "_over")
    good = judged.where("good").select("_page", F.col("node").alias("_over"), F.lit(True).alias("_good"))
    kept = judged.where("good").join(nearest, ["_page", "node"], "left").join(good, ["_page", "_over"], "left")
    return kept.where(F.col("_good").isNull()).select("_page", "node", "end", F.col("node").alias("at"))


def author_blocks(e: DataFrame, scope: DataFrame) -> DataFrame:
    """From each author link up, through twelve elements at most, to the largest with no more authors than the first sizeable one."""
    links = in_scope(e, scope).where(F.col("author_link") & ~F.col("foreign") & ~F.col("container") & ~F.col("in_container")).select("_page", F.col("node").alias("link"), F.col("depth").alias("_depth"))
    over = e.where("node > 0").select("_page", F.col("node").alias("top"), "end", "depth", "tag", "length", "authors")
    steps = containments(links.select("_page", F.col("link").alias("node"), F.col("_depth").alias("depth")), e.where("node > 0"), levels=11, own=True)
    steps = steps.withColumnRenamed("node", "link").join(over, ["_page", "top"]).withColumnRenamed("top", "node")
    own = Window.partitionBy("_page", "link")
    steps = steps.withColumn("_stop", F.max(F.when((F.col("tag") == "body") | (F.col("length") > MOST_POST), F.col("depth"))).over(own))
    steps = steps.where((F.col("_stop").isNull() | (F.col("depth") > F.col("_stop"))) & (F.col("length") >= LEAST))
    steps = steps.withColumn("_budget", F.greatest(F.lit(1), F.min("authors").over(own))).where("authors <= _budget")
    best = steps.groupBy("_page", "link").agg(F.min(F.struct("node", "end")).alias("b")).groupBy("_page", "b.node", "b.end").agg(F.min("link").alias("at"))
    return innermost(best)


TIERS = ("cards", "headings", "structure", "heuristics", "links")


def discovered(e: DataFrame) -> DataFrame:
    """_page, node, end, tier, post_index: the posts of the first tier that has any, in order."""
    scope = cut(scopes(e))
    items = list_items(e, scope)
    best = ranked_lists(list_candidates(items, e)).where("rank = 1").select("_page", "parent")
    listed = items.where("leaf").join(best, ["_page", "parent"]).select("_page", "node", "end", F.col("node").alias("at"))
    found = None
    for k, tier in enumerate((named_cards(e, scope), headed_cards(e, scope), listed, looking_like_posts(e, scope), author_blocks(e, scope))):
        rows = tier.select("_page", "node", "end", "at", F.lit(k).alias("tier"))
        found = rows if found is None else found.union(rows)
    found = cut(found)
    first = found.groupBy("_page").agg(F.min("tier").alias("tier"))
    order = Window.partitionBy("_page").orderBy("at", "node")
    name = F.get(F.array(*(F.lit("heuristics" if t == "links" else t) for t in TIERS)), F.col("tier"))
    return cut(found.join(first, ["_page", "tier"]).withColumn("post_index", F.row_number().over(order) - 1).select("_page", "node", "end", name.alias("tier"), "post_index"))


# ---- reading -------------------------------------------------------------------------------------------


def _below(rows: DataFrame, asked: DataFrame, alone: bool) -> DataFrame:
    """rows (_page, node) below each target (_page, target, _until). alone: there is one target a page, so a join by page gives no row that isn't asked for or beside it."""
    if alone:
        return rows.join(asked, "_page").where((F.col("node") > F.col("target")) & (F.col("node") < F.col("_until")))
    over = containments(rows, asked.select("_page", F.col("target").alias("node"), F.col("_until").alias("end"))).withColumnRenamed("top", "target")
    return rows.join(over, ["_page", "node"])


def block_texts(nodes: DataFrame, targets: DataFrame, alone: bool = False) -> DataFrame:
    """_page, target, text of each target node: the text below it with line ends around blocks and for breaks, without hidden and foreign parts. alone: there is one target a page."""
    ends = nodes.select("_page", F.col("node").alias("target"), F.col("end").alias("_until"))
    asked = targets.select("_page", "target").distinct().join(ends, ["_page", "target"])
    parts = nodes.select("_page", "node", "end", "tag", "text", is_hidden().alias("_hide")).where("tag = '#text' or _hide or tag = 'br'" + "".join(f" or tag = '{t}'" for t in sorted(BLOCK_TAGS)))
    below = _below(parts, asked, alone)
    shown = below.withColumn("_in", inside(F.col("_hide"), "target")).where("not _hide and not _in")
    piece = lambda at, kind, tie, text: F.struct(at.alias("at"), F.lit(kind).alias("kind"), tie.alias("tie"), text.alias("text"))
    start = piece(F.col("node"), 1, F.lit(0), F.when(F.col("tag") == "#text", F.col("text")).otherwise("\n"))
    stop = piece(F.col("end"), 0, -F.col("node"), F.lit("\n"))
    pieces = shown.select("_page", "target", F.explode(F.when(F.col("tag").isin(*BLOCK_TAGS), F.array(start, stop)).otherwise(F.array(start))).alias("p"))
    joined = pieces.groupBy("_page", "target").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "").alias("text"))
    return asked.select("_page", "target").join(joined, ["_page", "target"], "left").withColumn("text", F.coalesce("text", F.lit("")))


@pandas_udf(StringType())
def absolute(href: pd.Series, base: pd.Series) -> pd.Series:
    """An address in the light of its page's; null where there is none to be made of it."""

    def one(h: str | None, b: str | None) -> str | None:
        try:
            return None if h is None else urljoin(b or "", h.strip())
        except ValueError:
            return None

    return pd.Series([one(h, b) for h, b in zip(href, base, strict=True)], dtype=object)


def outbound(nodes: DataFrame, targets: DataFrame, alone: bool = False) -> DataFrame:
    """_page, target, links: distinct outbound addresses below each target, absolute, in order; addresses that can't be read are left out."""
    ends = nodes.select("_page", F.col("node").alias("target"), F.col("end").alias("_until"))
    urls = nodes.where("node = 0").select("_page", "url")
    asked = targets.select("_page", "target").distinct().join(ends, ["_page", "target"]).join(urls, "_page")
    anchors = nodes.where((F.col("tag") == "a") & has("href")).select("_page", "node", attr("href").alias("href"))
    below = _below(anchors, asked.drop("url"), alone).join(asked.select("_page", "url").distinct(), "_page")
    read = below.withColumn("href", absolute("href", "url")).where(F.col("href").startswith("http") & ~F.col("href").rlike(OWN_HOST.pattern))
    return read.groupBy("_page", "target").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("node", "href"))), lambda x: x["href"])).alias("links"))


def bodies(e: DataFrame, held: DataFrame, posts: DataFrame) -> DataFrame:
    """_page, post, body, landmark: by names in order of trust, else by content - the first block whose text is its own, without author links if there is one."""
    top = e.where("node > 0").groupBy("_page", F.col("parent").alias("node")).agg(F.max("length").alias("_top"))
    rows = held.join(top, ["_page", "node"], "left")
    named = [F.min(F.when((F.lit(True) if not tag else F.col("tag") == tag) & (has_class(name) if whole else classes().contains(name)), F.struct("node", "length"))) for tag, name, whole in BODY_RULES]
    named.append(F.min(F.when(F.coalesce(attr("data-test-id").contains(BODY_TEST_ID), F.lit(False)), F.struct("node", "length"))))
    own = F.col("tag").isin("div", "span", "p") & F.col("length").between(LEAST, MOST_POST) & (F.coalesce("_top", F.lit(0)) <= 0.9 * F.col("length"))
    found = rows.groupBy("_page", "post").agg(
        *(n.alias(f"_n{i}") for i, n in enumerate(named)), F.min(F.when(own & (F.col("authors") == 0), F.col("node"))).alias("_c0"), F.min(F.when(own, F.col("node"))).alias("_c1")
    )
    content = F.coalesce("_c0", "_c1")
    body = F.coalesce(*(F.when(F.col(f"_n{i}.length") > 0, F.col(f"_n{i}.node")) for i in range(len(named))), content)
    out = found.select("_page", "post", body.alias("body"), F.coalesce(content, body).alias("landmark"))
    return posts.select("_page", F.col("node").alias("post")).join(out, ["_page", "post"], "left")


# ---- authors --------------------------------------------------------------------------------------------


def said_once(name: Column) -> Column:
    """A name that stands twice, joined or spaced, once; a run of one sign stays."""
    half = F.floor(F.length(name) / 2).cast("int")
    left, right = F.substr(name, F.lit(1), half), F.substr(name, half + 1)
    spaced = F.regexp_extract(name, r"\A(.+?)\s+\1\z", 1)
    return F.when(name.rlike(r"\A(.)\1*\z"), name).when((F.length(name) % 2 == 0) & (left == right), left).when(spaced != "", spaced).otherwise(name)


def display_name(shown: Column) -> Column:
    """A person's or company's name from what a page shows: its first line without what is set around names; null if none is left."""
    lines = F.transform(F.split(F.coalesce(shown, F.lit("")), "\n"), lambda x: F.btrim(F.regexp_replace(x, r"(?U)\s+", " ")))
    name = F.coalesce(F.get(F.filter(lines, lambda x: x != ""), 0), F.lit(""))
    for pattern in AROUND_NAMES:
        name = F.regexp_replace(name, pattern, "")
    # each step reads the name several times: it is held in an array so that it is computed once
    then = lambda value, step: F.get(F.transform(F.array(value), step), 0)
    name = then(F.btrim(F.regexp_replace(name, AFTER_NAME, "")), said_once)
    name = then(F.btrim(F.regexp_replace(name, DEGREE, "")), lambda x: F.btrim(said_once(x)))
    usable = lambda x: (F.length(x).between(1, MOST_NAME)) & ~x.rlike(NOT_A_NAME) & x.rlike(r"\p{L}")
    return then(name, lambda x: F.when(usable(x), x))


def address_name(href: Column) -> Column:
    """The name in a profile's address, its words capitalised; a last part with a digit in it is a number, not a name."""
    slug = F.regexp_extract(F.coalesce(href, F.lit("")), PROFILE, 1)
    plain = F.coalesce(F.try_url_decode(F.replace(slug, F.lit("+"), F.lit("%2B"))), slug)
    parts = F.filter(F.split(plain, "-"), lambda p: p != "")
    named = F.filter(parts, lambda p, k: (k + 1 < F.size(parts)) | ~p.rlike("[0-9]"))
    return display_name(F.array_join(F.transform(named, lambda p: F.concat(F.upper(F.substr(p, F.lit(1), F.lit(1))), F.substr(p, F.lit(2)))), " "))


def _within(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """rows (_page, node, ...) below each of tops (_page, top, top_end, ...)."""
    over = containments(rows, tops.select("_page", F.col("top").alias("node"), F.col("top_end").alias("end")))
    return rows.join(over, ["_page", "node"]).join(tops, ["_page", "top"])


def _deepest(rows: DataFrame, over: DataFrame, name: str, levels: int | None = None) -> DataFrame:
    """rows (_page, node, depth) with the deepest of `over` above each, itself included, or above it by so many levels at most."""
    near = containments(rows, over, levels, most=1, own=levels is None)
    return rows.join(near.withColumnRenamed("top", name), ["_page", "node"], "left")


#: Where an author's name may come from, in order of trust.
AUTHOR_SOURCES = (
    "shown span in a titled span", "shown span in a title", "titled span", "title", "feed actor's name", "span in the actor's link", "class names a title", "class names a name", "test id",
    "class names an actor", "text of the link", "label of the link", "image in the link", "address of the link",
)


def author_candidates(nodes: DataFrame, e: DataFrame, held: DataFrame, posts: DataFrame, body: DataFrame) -> DataFrame:
    """_page, post, rank (place in AUTHOR_SOURCES), raw (what stands there), name (null: it is no name)."""
    title, meta = "update-components-actor__title", "update-components-actor__meta"
    span, shown = F.col("tag") == "span", (F.col("tag") == "span") & F.coalesce(attr("aria-hidden") == "true", F.lit(False))
    traits = {"t_span": span & has_class(title), "t_any": has_class(title), "t_meta": (F.col("tag") == "a") & F.col("in_meta")}
    own = e.join(posts.select("_page", "node"), ["_page", "node"]).select("_page", F.col("node").alias("post"), *(t.alias(f"own_{k}") for k, t in traits.items()))
    rows = held.join(own, ["_page", "post"]).join(body, ["_page", "post"])
    rows = rows.withColumns({k: inside(t, "post") | F.col(f"own_{k}") for k, t in traits.items()} | {"_bar": F.col("after_bar") | inside(F.col("after_bar"), "post")})
    rules = [
        shown & F.col("t_span"), shown & F.col("t_any"), span & has_class(title), has_class(title), span & has_class("feed-shared-actor__name"), span & F.col("t_meta"),
        classes().contains("actor__title"), classes().contains("actor__name"), F.coalesce(attr("data-test-id").contains(AUTHOR_TEST_ID), F.lit(False)),
    ]
    before = F.col("landmark").isNull() | (F.col("node") < F.col("landmark"))
    named = rows.where((_any(rules) | F.col("actor_link")) & before & ~F.col("named_foreign") & ~F.col("in_foreign") & ~F.col("_bar"))
    named = cut(_deepest(named, e.where("social"), "_social", 4).where(F.col("_social").isNull() | (F.col("_social") <= F.col("post"))))
    actor = F.coalesce(F.min(F.when(F.col("actor_link") & (classes().contains("actor") | F.col("in_actor")), F.col("node"))), F.max(F.when(F.col("actor_link"), F.col("node"))))
    chosen = cut(named.groupBy("_page", "post").agg(*(F.min(F.when(r, F.col("node"))).alias(f"r{i}") for i, r in enumerate(rules)), actor.alias("link")))
    # posts whose own links say nothing: the nearest of four elements above that has links, if it has one alone
    silent = posts.select("_page", F.col("node").alias("post"), F.col("node"), "end").join(e.select("_page", "node", "depth"), ["_page", "node"]).join(chosen.where("link is not null").select("_page", "post"), ["_page", "post"], "left_anti")
    over = containments(silent, e.where("node > 0"), levels=4).join(silent.select("_page", "node", "post"), ["_page", "node"])
    over = over.select("_page", "post", "top").join(e.select("_page", F.col("node").alias("top"), F.col("end").alias("top_end")), ["_page", "top"])
    free = e.where("actor_link and not named_foreign and not in_foreign").select("_page", "node", "depth")
    free = _deepest(_deepest(free, e.where("after_bar"), "_after"), e.where("social"), "_social", 4)
    free = _within(free, over).where((F.col("_after").isNull() | (F.col("_after") <= F.col("top"))) & (F.col("_social").isNull() | (F.col("_social") <= F.col("top"))))
    lone = free.groupBy("_page", "post", "top").agg(F.count("*").alias("n"), F.min("node").alias("link")).groupBy("_page", "post").agg(F.max_by(F.struct("n", "link"), "top").alias("x"))
    lone = lone.where("x.n = 1").select("_page", "post", F.col("x.link").alias("link"))
    marks = chosen.select("_page", "post", F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.col(f"r{i}").alias("target")) for i in range(len(rules))))).alias("c")).select("_page", "post", "c.rank", "c.target").where("target is not null")
    links = cut(chosen.where("link is not null").select("_page", "post", "link", F.lit(True).alias("actor")).union(lone.select("_page", "post", "link", F.lit(False))))
    texts = marks.union(links.select("_page", "post", F.lit(10), F.col("link")))
    raw = texts.join(block_texts(nodes, texts), ["_page", "target"]).select("_page", "post", "rank", F.btrim("text", F.lit(SPACES)).alias("raw"))
    of_link = links.join(e.select("_page", F.col("node").alias("link"), "end", "attrs"), ["_page", "link"])
    label = of_link.select("_page", "post", F.lit(11).alias("rank"), F.coalesce(attr("aria-label"), F.lit("")).alias("raw"))
    images = e.where((F.col("tag") == "img") & has("alt")).select("_page", "node", attr("alt").alias("alt"))
    alt = _within(images, of_link.where("actor").select("_page", "post", F.col("link").alias("top"), F.col("end").alias("top_end"))).groupBy("_page", "post").agg(F.min_by("alt", "node").alias("raw"))
    spoken = raw.union(label).union(alt.select("_page", "post", F.lit(12), "raw")).select("_page", "post", "rank", "raw", display_name(F.col("raw")).alias("name"))
    return spoken.union(of_link.select("_page", "post", F.lit(13), attr("href"), address_name(attr("href"))))


def authors(nodes: DataFrame, e: DataFrame, held: DataFrame, posts: DataFrame, body: DataFrame) -> DataFrame:
    """_page, post, author: the first candidate, in order of trust, that is a name."""
    found = author_candidates(nodes, e, held, posts, body).where("name is not null")
    return found.groupBy("_page", "post").agg(F.min_by("name", "rank").alias("author"))


# ---- what users call ------------------------------------------------------------------------------------

POSTS = "post_index int, tier string, urn string, author string, raw_text string, links array<string>, has_media boolean, is_reshare boolean, can_expand boolean, text_length int, author_links int"


def _parts(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> tuple[DataFrame, ...]:
    """(nodes, elements described, posts, elements below each post, bodies)."""
    nodes = node_table(pages, id_col, url_col, html_col)
    e = described(nodes)
    posts = discovered(e)
    tops = posts.select("_page", F.col("node").alias("post"), F.col("node").alias("top"), F.col("end").alias("top_end"))
    held = cut(_within(e, tops).drop("top", "top_end"))
    return nodes, e, posts, held, cut(bodies(e, held, posts))


def author_report(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, post_index, source, raw, name, chosen: every place of every post that may name its author, what it says, and which one is taken.

    Posts without any such place give no row. Pages are read as by find_posts().
    """
    nodes, e, posts, held, body = _parts(pages, id_col, url_col, html_col)
    found = author_candidates(nodes, e, held, posts, body)
    first = F.min(F.when(F.col("name").isNotNull(), F.col("rank"))).over(Window.partitionBy("_page", "post"))
    source = F.get(F.array(*map(F.lit, AUTHOR_SOURCES)), F.col("rank"))
    told = found.withColumns({"source": source, "chosen": F.coalesce(F.col("rank") == first, F.lit(False))})
    placed = told.join(posts.select("_page", F.col("node").alias("post"), "post_index"), ["_page", "post"]).join(nodes.where("node = 0").select("_page", "page_id"), "_page")
    return placed.select("page_id", "post_index", "source", "raw", "name", "chosen")


def find_posts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each post of each page: page_id, url, and the columns of POSTS.

    Pages without posts give no row; null pages count as empty; of a page that the parser gives up on, what it
    has read so far counts, and an address that can't be read is left out (one page never fails the job). Every
    row of pages is a page of its own. Other columns are ignored. Time grows in proportion to a page's length and
    nodes, however deep or broken it is.
    """
    nodes, e, posts, held, body = _parts(pages, id_col, url_col, html_col)
    targets = body.where("body is not null").select("_page", F.col("body").alias("target"))
    texts = block_texts(nodes, targets).withColumnsRenamed({"target": "body", "text": "raw_text"})
    links = outbound(nodes, targets).withColumnRenamed("target", "body")
    more = (F.col("tag") == "button") & (has_class(*MORE_CLASSES) | F.coalesce(F.lower(attr("aria-label")).contains("see more"), F.lit(False)))
    inner = held.groupBy("_page", "post").agg(
        F.min_by(F.when(attr("data-urn").contains("urn:li:"), attr("data-urn")), F.when(attr("data-urn").contains("urn:li:"), F.col("node"))).alias("_urn"),
        F.max(has_class(*MEDIA_CLASSES)).alias("has_media"), F.max(has_class(RESHARE_CLASS)).alias("is_reshare"),
        F.min_by(F.coalesce(attr("aria-expanded") != "true", F.lit(True)), F.when(more, F.col("node"))).alias("can_expand"),
    )
    own = [F.when(attr(a).contains("urn:li:"), attr(a)) for a in URN_ATTRIBUTES]
    out = posts.join(e.select("_page", "node", F.coalesce(*own).alias("_own"), "length", "authors"), ["_page", "node"]).withColumnRenamed("node", "post")
    out = out.join(inner, ["_page", "post"], "left").join(body, ["_page", "post"], "left").join(texts, ["_page", "body"], "left").join(links, ["_page", "body"], "left")
    out = out.join(authors(nodes, e, held, posts, body), ["_page", "post"], "left").join(nodes.where("node = 0").select("_page", "page_id", "url"), "_page")
    off = F.lit(False)
    return out.select(
        "page_id", "url", "post_index", "tier", F.coalesce("_own", "_urn").alias("urn"), "author", "raw_text", F.coalesce("links", F.array().cast("array<string>")).alias("links"),
        F.coalesce("has_media", off).alias("has_media"), F.coalesce("is_reshare", off).alias("is_reshare"), F.coalesce("can_expand", off).alias("can_expand"),
        F.col("length").alias("text_length"), F.col("authors").cast("int").alias("author_links"),
    )


def read_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, text (block text of the whole body), links (outbound), tier of each row of pages; null pages are empty."""
    nodes = node_table(pages, id_col, url_col, html_col)
    e = described(nodes)
    tier = discovered(e).groupBy("_page").agg(F.first("tier").alias("tier"))
    body = cut(nodes.groupBy("_page").agg(F.coalesce(F.min(F.when((F.col("tag") == "body") & (F.col("node") > 0), F.col("node"))), F.lit(0)).alias("target")))
    out = nodes.where("node = 0").select("_page", "page_id").join(body, "_page").join(block_texts(nodes, body, True), ["_page", "target"], "left").join(outbound(nodes, body, True), ["_page", "target"], "left").join(tier, "_page", "left")
    return out.select("page_id", "text", F.coalesce("links", F.array().cast("array<string>")).alias("links"), F.coalesce("tier", F.lit("heuristics")).alias("tier"))
