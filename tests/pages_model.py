"""A plain model of post discovery, one page at a time, that the DataFrame operators are held against."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin

from prosegauge.functions.text import SPACES

from prosegauge.operators.pages import *  # noqa: F403  the fixed values


def _once(name):
    for k in range(1, len(name)):
        one, two = name[:k], name[k:]
        if (one == two or one == two.strip() != two) and len(set(name)) > 1:
            return one
    return name


def plain_name(shown):
    """What display_name() says, a line at a time."""
    name = next((x for x in (" ".join(line.split()) for line in (shown or "").split("\n")) if x), "")
    for pattern in AROUND_NAMES:  # noqa: F405
        name = re.sub(pattern.replace(r"\z", r"\Z"), "", name)
    for pattern in (AFTER_NAME, DEGREE):  # noqa: F405
        name = _once(re.sub(pattern.replace(r"\z", r"\Z"), "", name).strip()).strip()
    good = 0 < len(name) <= MOST_NAME and any(map(str.isalpha, name)) and not re.search(NOT_A_NAME.replace(r"\z", r"\Z"), name)  # noqa: F405
    return name if good else None


def address_name(href):
    found = re.search(PROFILE, href or "")  # noqa: F405
    parts = [x for x in unquote(found[1]).split("-") if x] if found else []
    parts = [x for k, x in enumerate(parts) if k < len(parts) - 1 or not re.search("[0-9]", x)]
    return plain_name(" ".join(x[0].upper() + x[1:] for x in parts))

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SELF_CLOSING = {"p": BLOCK_TAGS, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: int
    end: int = 0  # one past the last node below
    text: int = 0  # where its text begins and ends in the page's text
    text_end: int = 0
    children: list[int] = field(default_factory=list)

    @property
    def classes(self) -> str:
        return self.attrs.get("class", "")


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#page", {}, -1)]
        self.open = [0]
        self.pieces: list[str] = []
        self.size = 0
        self.runs: list[tuple[int, str]] = []  # node above, text

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while len(self.open) > 1 and tag in _SELF_CLOSING.get(self.nodes[self.open[-1]].tag, ()):
            self._close()
        k = len(self.nodes)
        self.nodes.append(Node(tag, {n: v or "" for n, v in attrs}, self.open[-1], text=self.size))
        self.nodes[self.open[-1]].children.append(k)
        self.open.append(k)
        if tag in _VOID:
            self._close()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        depth = next((d for d in range(len(self.open) - 1, 0, -1) if self.nodes[self.open[d]].tag == tag), 0)
        while depth and len(self.open) > depth:
            self._close()

    def handle_data(self, data: str) -> None:
        self.runs.append((self.open[-1], data))
        self.nodes[self.open[-1]].children.append(-len(self.runs))
        self.pieces.append(data)
        self.size += len(data)

    def _close(self) -> None:
        node = self.nodes[self.open.pop()]
        node.end, node.text_end = len(self.nodes), self.size

    def done(self) -> None:
        self.close()
        while self.open:
            self._close()


class Page:
    """The node table of a page."""

    def __init__(self, html: str):
        b = _Builder()
        b.feed(html)
        b.done()
        self.nodes, self.runs, self.all_text = b.nodes, b.runs, "".join(b.pieces)
        hrefs = [n.attrs.get("href", "") if n.tag == "a" else "" for n in self.nodes]
        self.author_links = [k for k, h in enumerate(hrefs) if "/in/" in h or "/company/" in h]
        self.actor_links = [k for k, h in enumerate(hrefs) if "/in/" in h or "/company/" in h or "/school/" in h]
        self.containers = [k for k in range(1, len(self.nodes)) if self.is_container(k)]
        self.foreign = [self._named_foreign(n) for n in self.nodes]
        self._lengths: dict[int, int] = {}
        self._bars: dict[int, int | None] = {}

    def text(self, k: int) -> str:
        return self.all_text[self.nodes[k].text : self.nodes[k].text_end]

    def length(self, k: int) -> int:
        if k not in self._lengths:
            self._lengths[k] = len(self.text(k).strip(SPACES))
        return self._lengths[k]

    def authors(self, k: int) -> int:
        """Author links below a node: those whose number falls into its interval."""
        return bisect_left(self.author_links, self.nodes[k].end) - bisect_left(self.author_links, k + 1)

    def above(self, k: int) -> Iterator[int]:
        k = self.nodes[k].parent
        while k > 0:
            yield k
            k = self.nodes[k].parent

    def holds(self, a: int, b: int) -> bool:
        return a <= b < self.nodes[a].end

    def elements(self, k: int) -> list[int]:
        return [c for c in self.nodes[k].children if c > 0]

    @staticmethod
    def _named_foreign(n: Node) -> bool:
        return any(c in n.classes for c in FOREIGN_CLASSES) or any("urn:li:comment" in n.attrs.get(a, "") for a in ("data-id", "data-urn"))

    def is_container(self, k: int) -> bool:
        n = self.nodes[k]
        names = n.classes.split()
        if n.tag == "div" and (any(c in names for c in CONTAINER_CLASSES) or CONTAINER_ATTRIBUTE in n.attrs):
            return True
        return any(n.attrs.get(a, "").lower().startswith(f"urn:li:{t}") for a in URN_ATTRIBUTES for t in POST_URN_TYPES)

    def may_be_post(self, k: int) -> bool:
        n = self.nodes[k]
        names = n.classes.split()
        return (
            n.tag == "article"
            or "data-urn" in n.attrs
            or n.attrs.get("data-id", "").startswith("urn:li:")
            or n.tag == "div" and (any(c in names for c in CONTAINER_CLASSES) or "data-id" in n.attrs or n.attrs.get("role") == "article")
        )

    def action_bar(self, k: int) -> int | None:
        """The child of k (or k itself) that holds a button to like, comment, repost, send or share."""
        if k not in self._bars:
            self._bars[k] = None
            for c in self.elements(k):
                hit = next((b for b in range(c, self.nodes[c].end) if self.nodes[b].tag == "button" and ACTION.fullmatch(self.text(b).strip(SPACES))), None)
                if hit is not None:
                    self._bars[k] = k if hit == c else c
                    break
        return self._bars[k]

    def is_foreign(self, k: int, root: int | None = None) -> bool:
        """Comments and reactions: so named, on itself or above; or placed after an action bar at some level below root."""
        if self.foreign[k] or any(self.foreign[a] for a in self.above(k)):
            return True
        while k > 0 and k != root and self.nodes[k].parent > 0:
            parent = self.nodes[k].parent
            bar = self.action_bar(parent)
            if bar is not None and bar < k:  # after it in document order, inside it included
                return True
            k = parent
        return False

    # -- discovery ---------------------------------------------------------------------------------

    def outermost(self, found: list[int]) -> list[int]:
        """Of a sorted list of nodes, those not inside another: one sweep over their intervals."""
        out, end = [], 0
        for k in sorted(set(found)):
            if k >= end:
                out.append(k)
                end = self.nodes[k].end
        return out

    def innermost(self, found: list[int]) -> list[int]:
        ordered = sorted(set(found))
        return [k for i, k in enumerate(ordered) if i + 1 == len(ordered) or ordered[i + 1] >= self.nodes[k].end]

    def qualifies(self, k: int) -> bool:
        return LEAST <= self.length(k) <= MOST_ITEM and self.authors(k) > 0

    def lists(self, scope: int) -> list[dict]:
        """Groups of neighbours that look like items of a list: parent, items, total, top share, depth."""
        groups: dict[int, list[int]] = {}
        good = {k for k in range(scope + 1, self.nodes[scope].end) if self.qualifies(k)}
        for k in sorted(good):
            groups.setdefault(self.nodes[k].parent, []).append(k)
        out = []
        for parent, items in groups.items():
            leaves = [k for k in items if sum(c in good for c in self.elements(k)) < 2]
            if len(items) < 2 or len(leaves) < 2:
                continue
            sizes = [self.length(k) for k in leaves]
            depth = sum(1 for a in self.above(parent) if a > scope and self.holds(scope, a))
            out.append({"parent": parent, "items": leaves, "total": sum(sizes), "share": max(sizes) / sum(sizes), "depth": depth})
        return out

    def ranked_lists(self, scope: int) -> list[dict]:
        return sorted((c for c in self.lists(scope) if c["share"] <= 0.95), key=lambda c: (-c["total"], c["depth"]))

    def headed(self, scope: int) -> list[int]:
        """Cards that open with a short second-level heading."""
        cards = []
        for k in range(scope + 1, self.nodes[scope].end):
            p = self.nodes[k].parent
            if self.nodes[k].tag == "h2" and p > 0 and self.elements(p)[0] == k and self.length(k) <= MOST_HEADING and self.length(p) >= LEAST and self.authors(p):
                cards.append(p)
        return self.outermost(cards)

    def by_author_links(self, scope: int) -> list[int]:
        """From each author link up to the largest node that has no more authors than the first sizeable one."""
        held = set(self.containers)
        found: list[int] = []
        for link in self.author_links:
            if not scope < link < self.nodes[scope].end or self.is_foreign(link) or link in held or any(a in held for a in self.above(link)):
                continue
            best, budget = 0, -1
            for k in [link, *self.above(link)][:12]:
                if self.nodes[k].tag == "body" or (n := self.length(k)) > MOST_POST:
                    break
                if n >= LEAST:
                    authors = self.authors(k)
                    budget = max(1, authors) if budget < 0 else budget
                    if authors > budget:
                        break
                    best = k
            if best and best not in found:
                found.append(best)
        keep = set(self.innermost(found))
        return [k for k in found if k in keep]

    def has_post_urn(self, k: int) -> bool:
        kinds = (re.search(r"urn:li:([a-zA-Z]+)", self.nodes[k].attrs.get(a, "")) for a in URN_ATTRIBUTES)
        return any(m and m[1].lower() in POST_URN_TYPES for m in kinds)

    def looks_like_post(self, k: int) -> bool:
        if self.length(k) > MOST_POST or self.is_foreign(k):
            return False
        if k not in self.containers and any(a in self.containers for a in self.above(k)):
            return False
        return self.has_post_urn(k) or self.length(k) >= LEAST and 1 <= self.authors(k) <= 3

    def root(self) -> int:
        """The feed: a labelled main, a main, a scroll container, the main content, or the body."""
        tests = (
            lambda n: n.tag == "main" and "aria-label" in n.attrs,
            lambda n: n.tag == "main",
            lambda n: n.tag == "div" and "scaffold-finite-scroll__content" in n.classes.split(),
            lambda n: n.attrs.get("id") == "main-content",
            lambda n: n.tag == "body",
        )
        for test in tests:
            if (k := next((k for k in range(1, len(self.nodes)) if test(self.nodes[k])), None)) is not None:
                return k
        return 0

    def posts(self) -> tuple[str, list[int]]:
        """(tier, posts): the first of named cards, headed cards, the best list, marked elements, author links that gives any."""
        body = next((k for k in range(1, len(self.nodes)) if self.nodes[k].tag == "body"), 0)
        scope = self.root()
        marked = lambda s: [k for k in range(s + 1, self.nodes[s].end) if self.may_be_post(k)]
        if scope != body and not marked(scope):
            scope = body
        inside = [k for k in self.containers if self.holds(scope, k)]
        if cards := self.outermost(inside):
            return "cards", cards
        if cards := self.headed(scope):
            return "headings", cards
        if lists := self.ranked_lists(scope):
            return "structure", lists[0]["items"]
        candidates = ([scope] if scope and self.may_be_post(scope) else []) + marked(scope)
        good = [k for k in candidates if self.looks_like_post(k)]
        nearest = lambda k: next((a for a in self.above(k) if self.may_be_post(a)), None)
        kept = [k for k in good if nearest(k) not in good]
        return "heuristics", kept or self.by_author_links(scope)

    # -- reading -------------------------------------------------------------------------------------

    def hidden(self, k: int) -> bool:
        n = self.nodes[k]
        style = re.search(r"display\s*:\s*none", n.attrs.get("style", ""))
        return n.tag in SKIPPED_TAGS or self.foreign[k] or "hidden" in n.attrs or bool(HIDDEN_CLASS.search(n.classes)) or style is not None

    def block_text(self, k: int) -> str:
        """The text below k with line ends around blocks and for breaks, without hidden and foreign parts."""
        out: list[str] = []
        todo: list[int | str] = list(reversed(self.nodes[k].children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(c)
            elif c < 0:
                out.append(self.runs[-c - 1][1])
            elif not self.hidden(c):
                n = self.nodes[c]
                if n.tag == "br":
                    out.append("\n")
                elif n.tag in BLOCK_TAGS:
                    out.append("\n")
                    todo += ["\n", *reversed(n.children)]
                else:
                    todo += reversed(n.children)
        return "".join(out)

    def body(self, post: int) -> int | None:
        below = range(post + 1, self.nodes[post].end)
        for tag, name, whole in BODY_RULES:
            fits = lambda n: (not tag or n.tag == tag) and (name in n.classes.split() if whole else name in n.classes)  # noqa: B023, E731
            k = next((k for k in below if fits(self.nodes[k])), None)
            if k is not None and self.length(k):
                return k
        k = next((k for k in below if BODY_TEST_ID in self.nodes[k].attrs.get("data-test-id", "")), None)
        return k if k is not None and self.length(k) else self.body_by_content(post)

    def body_by_content(self, post: int) -> int | None:
        """The first block, in document order, whose text is its own rather than one child's; without author links if there is one."""
        spare = None
        for k in range(post + 1, self.nodes[post].end):
            n = self.length(k)
            if self.nodes[k].tag not in ("div", "span", "p") or not LEAST <= n <= MOST_POST:
                continue
            if max((self.length(c) for c in self.elements(k)), default=0) > 0.9 * n:
                continue
            if not self.authors(k):
                return k
            spare = k if spare is None else spare
        return spare

    def urn(self, post: int) -> str | None:
        own = [self.nodes[post].attrs.get(a, "") for a in URN_ATTRIBUTES]
        below = (self.nodes[k].attrs.get("data-urn", "") for k in range(post + 1, self.nodes[post].end))
        return next((u for u in own if "urn:li:" in u), None) or next((u for u in below if "urn:li:" in u), None)

    def any_class(self, post: int, names: tuple[str, ...]) -> bool:
        return any(c in names for k in range(post + 1, self.nodes[post].end) for c in self.nodes[k].classes.split())

    def see_more(self, post: int) -> bool:
        for k in range(post + 1, self.nodes[post].end):
            n = self.nodes[k]
            if n.tag == "button" and (any(c in n.classes.split() for c in MORE_CLASSES) or "see more" in n.attrs.get("aria-label", "").lower()):
                return n.attrs.get("aria-expanded") != "true"
        return False

    def links(self, body: int, url: str) -> list[str]:
        """Distinct outbound links below a body, absolute, in order."""
        found = (urljoin(url, self.nodes[k].attrs["href"].strip()) for k in range(body + 1, self.nodes[body].end) if self.nodes[k].tag == "a" and "href" in self.nodes[k].attrs)
        return list(dict.fromkeys(h for h in found if h.startswith("http") and not OWN_HOST.match(h)))

    # -- authors ---------------------------------------------------------------------------------------

    def foreign_link(self, k: int, post: int) -> bool:
        if self.is_foreign(k, post):
            return True
        for a in list(self.above(k))[:4]:
            if a == post:
                return False
            t = self.text(a)
            if len(t) <= 160 and SOCIAL_CONTEXT.search(t):
                return True
        return False

    def actor_link(self, post: int, body: int | None) -> int | None:
        mine = [k for k in self.actor_links if post < k < self.nodes[post].end and not self.foreign_link(k, post)]
        before = [k for k in mine if body is None or k < body]
        named = [k for k in before if "actor" in self.nodes[k].classes or any("actor" in self.nodes[a].classes for a in self.above(k))]
        return named[0] if named else before[-1] if before else None

    def author_candidates(self, post: int, body: int | None) -> Iterator[tuple[str, str, str | None]]:
        """(source, raw, name) in order of trust."""
        below = range(post + 1, self.nodes[post].end)
        has = lambda k, c: c in self.nodes[k].classes.split()
        title, meta = "update-components-actor__title", "update-components-actor__meta"
        inside = lambda k, test: any(test(a) for a in self.above(k) if a > post or a == post)
        shown = lambda k: self.nodes[k].tag == "span" and self.nodes[k].attrs.get("aria-hidden") == "true"
        rules = (
            ("shown part of the actor's title (span)", lambda k: shown(k) and inside(k, lambda a: self.nodes[a].tag == "span" and has(a, title))),
            ("shown part of the actor's title", lambda k: shown(k) and inside(k, lambda a: has(a, title))),
            ("actor's title (span)", lambda k: self.nodes[k].tag == "span" and has(k, title)),
            ("actor's title", lambda k: has(k, title)),
            ("actor's name (span)", lambda k: self.nodes[k].tag == "span" and has(k, "feed-shared-actor__name")),
            ("link in the actor's meta", lambda k: self.nodes[k].tag == "span" and inside(k, lambda a: self.nodes[a].tag == "a" and any(has(b, meta) for b in self.above(a)))),
            ("class names a title", lambda k: "actor__title" in self.nodes[k].classes),
            ("class names a name", lambda k: "actor__name" in self.nodes[k].classes),
            ("test id", lambda k: AUTHOR_TEST_ID in self.nodes[k].attrs.get("data-test-id", "")),
        )
        for source, test in rules:
            for k in below:
                if test(k) and not self.foreign_link(k, post) and (body is None or k < body):
                    raw = self.block_text(k).strip(SPACES)
                    yield source, raw, plain_name(raw)
                    break
        link = self.actor_link(post, body)
        if link is not None:
            yield from self._of_link("actor", link)
            alt = next((self.nodes[k].attrs["alt"] for k in range(link + 1, self.nodes[link].end) if self.nodes[k].tag == "img" and "alt" in self.nodes[k].attrs), "")
            yield "avatar", alt, plain_name(alt)
            yield self._of_url("actor", link)
            return
        for a in list(self.above(post))[:4]:
            mine = [k for k in self.actor_links if a < k < self.nodes[a].end and not self.foreign_link(k, a)]
            if mine:
                if len(mine) == 1:
                    yield from self._of_link("ancestor", mine[0])
                    yield self._of_url("ancestor", mine[0])
                return

    def _of_link(self, who: str, k: int) -> Iterator[tuple[str, str, str | None]]:
        for source, raw in (("text", self.block_text(k).strip(SPACES)), ("label", self.nodes[k].attrs.get("aria-label", ""))):
            yield f"{who} link {source}", raw, plain_name(raw)

    def _of_url(self, who: str, k: int) -> tuple[str, str, str | None]:
        raw = self.nodes[k].attrs.get("href", "")
        return f"{who} link address", raw, address_name(raw)

    def author(self, post: int, body: int | None) -> str | None:
        return next((name for _, _, name in self.author_candidates(post, body) if name), None)


def posts_of(html: str, url: str) -> list[dict]:
    page = Page(html)
    tier, found = page.posts()
    out = []
    for i, k in enumerate(found):
        body = page.body(k)
        landmark = page.body_by_content(k)
        out.append(
            {
                "post_index": i, "tier": tier, "urn": page.urn(k), "author": page.author(k, landmark if landmark is not None else body),
                "raw_text": None if body is None else page.block_text(body), "links": [] if body is None else page.links(body, url),
                "has_media": page.any_class(k, MEDIA_CLASSES), "is_reshare": page.any_class(k, (RESHARE_CLASS,)), "can_expand": page.see_more(k),
                "text_length": page.length(k), "author_links": page.authors(k),
            }
        )
    return out
