"""Main text of web pages by a recurrent block labeller.

A page is read into leaf blocks; each becomes a vector of its tag path, its hashed words and a few
measures. A bidirectional LSTM in numpy reads the whole sequence and says of every block whether it
belongs to the article. It is trained on pages made up from rules, where the answer is known.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused

# Fixed values of HTML: elements that start a block, that hold no text to read, that have no end tag,
# and that end when one of the named elements starts.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("script style noscript template svg head title textarea select iframe object canvas audio video".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCKS - {"body", "html", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_STOP = re.compile(r">|=\s*+([\"'])")
_ATTR = re.compile(r"(?<![a-zA-Z\-])([a-zA-Z\-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))")
_NAMES = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none")
_RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}

PATH = 64
#: How often one name above a block counts, at most either way.
PATH_MOST = 4


@lru_cache(maxsize=100_000)
def _slot(name: str, size: int) -> tuple[int, int]:
    h = zlib.crc32(name.encode())
    return h % size, 1 if h >> 31 else -1


class Block:
    """A leaf block: its text, the hashed names of all elements above it, characters in links, the innermost name."""

    __slots__ = ("text", "path", "linked", "inner")

    def __init__(self, text: str, path: np.ndarray, linked: int, inner: str):
        self.text, self.path, self.linked, self.inner = text, path, linked, inner


def _tag_end(page: str, at: int, dead: set[str]) -> int:
    """Place of the > that ends a tag whose attributes start at `at`, or -1; a > in a quoted value is none.

    dead: quotes that close nowhere further on; each is looked for in vain once a page.
    """
    while (m := _STOP.search(page, at)) is not None:
        if (quote := m[1]) is None:
            return m.start()
        at = m.end()
        if quote not in dead:
            if (close := page.find(quote, at)) < 0:
                dead.add(quote)
            else:
                at = close + 1
    return -1


class _Stack:
    """The open elements, with running sums so that a step costs the same at any depth."""

    def __init__(self) -> None:
        self.open: list[tuple[str, list[tuple[int, int]], bool, str]] = []
        self.blocks: list[int] = []
        self.count: dict[str, int] = {}
        self.path = np.zeros(PATH, np.int64)

    def silent(self) -> bool:
        return bool(self.open) and self.open[-1][2]

    def push(self, tag: str, names: list[str], quiet: bool) -> None:
        slots = [_slot(n, PATH) for n in names]
        for k, sign in slots:
            self.path[k] += sign
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((tag, slots, quiet, names[-1]))
        self.count[tag] = self.count.get(tag, 0) + 1

    def pop(self) -> None:
        tag, slots, _, _ = self.open.pop()
        for k, sign in slots:
            self.path[k] -= sign
        self.count[tag] -= 1
        if self.blocks and self.blocks[-1] == len(self.open):
            self.blocks.pop()


def read_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, with what stands above each. Linear in the page, however deep or broken.

    A tag that never ends takes the rest of the page with it, as in browsers; so does a comment.
    """
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked = 0
    dead: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, np.clip(stack.path, -PATH_MOST, PATH_MOST).astype(np.int8), linked, stack.open[-1][3] if stack.open else ""))
            parts.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not stack.silent():
            piece = html.unescape(piece)  # a reference ends where its text does: none reaches over a tag
            parts.append(piece)
            if stack.count.get("a"):
                linked += len(piece)

    def pop_to(k: int) -> None:
        if stack.blocks and stack.blocks[-1] >= k:
            flush()
        while len(stack.open) > k:
            stack.pop()

    at, end = 0, len(page)
    while (lt := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), lt):
            text(page[at:lt])
            comment = page.startswith("<!--", lt)
            stop = page.find("-->" if comment else ">", lt + 2)
            at = end if stop < 0 else stop + (3 if comment else 1)
            continue
        if (m := _TAG.match(page, lt)) is None:
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        stop = _tag_end(page, m.end(), dead)
        if stop < 0:
            at = end
            break
        tag, attrs, at = m[1].lower(), page[m.end() : stop], stop + 1
        if page[lt + 1] == "/":
            if stack.count.get(tag):
                pop_to(next(k for k in range(len(stack.open) - 1, -1, -1) if stack.open[k][0] == tag))
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCKS:
            if not stack.silent():
                flush()
            closing = CLOSES.get(tag, ()) or ({"p"} if tag in ENDS_P else ())
            if any(map(stack.count.get, closing)):
                for k in reversed(stack.blocks):
                    if stack.open[k][0] in closing:
                        pop_to(k)
                        break
                    if stack.open[k][0] != "p":
                        break
        if tag in VOID or attrs.endswith("/") and tag in SILENT:
            continue
        if tag in ("body", "main", "article"):  # a head that was never closed
            while stack.silent():
                stack.pop()
        names = [tag]
        quiet = stack.silent() or tag in SILENT
        if attrs:
            found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
            for k in ("class", "id", "role"):
                if v := found.get(k):
                    names += [n.lower() for n in _NAMES.findall(v)]
            quiet = quiet or bool(_HIDDEN.search(re.sub(r"=\s*+(\"[^\"]*\"|'[^']*')", "=", attrs) + " " + found.get("style", "")))
        stack.push(tag, names, quiet)
        if tag in RAW:
            close = _RAW_END[tag].search(page, at)
            at = close.end() if close else end
            stack.pop()
    text(page[at:])
    flush()
    return out


WORDS, MEASURES = 48, 8
INPUTS = PATH + WORDS + MEASURES
HIDDEN = 16


def vectors(blocks: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
    """A row for each block; first and total: where the blocks stand in their page, if they are a part of it."""
    x = np.zeros((len(blocks), INPUTS), np.float32)
    total = len(blocks) if total is None else total
    for k, b in enumerate(blocks, first):
        row = x[k - first]
        row[:PATH] = b.path
        tokens = b.text.lower().split()
        for w in tokens:
            h = zlib.crc32(w.encode())
            row[PATH + h % WORDS] += 1.0 if h >> 31 else -1.0
        row[PATH : PATH + WORDS] = np.clip(row[PATH : PATH + WORDS] / max(1, len(tokens)) ** 0.5, -2, 2)  # one word many times is no louder
        n = len(b.text)
        row[-MEASURES:] = (
            np.log1p(len(tokens)) / 4, min(1.0, b.linked / n), b.text[-1] in ".!?…»\"”", sum(map(b.text.count, ".,;")) / (len(tokens) + 1),
            k / total, 1 / (1 + k), 1 / (total - k), b.inner in ("p", "b", "i", "em"),
        )
    return x


class Labeller:
    """Two LSTMs, one in each direction, and a logistic unit over both states."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        w = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"], self.p[f"u{d}"], self.p[f"c{d}"] = w(INPUTS, 4 * HIDDEN), w(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32)
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.p["v"], self.p["a"] = w(2 * HIDDEN), np.zeros(1, np.float32)

    @staticmethod
    def _gates(z: np.ndarray) -> tuple[np.ndarray, ...]:
        s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
        return s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None, carried: dict | None = None) -> np.ndarray:
        """States of one direction; x: time, page, input. Padding holds the state still. carried: takes up the state of a run before, and holds this one's."""
        steps, pages, _ = x.shape
        zx = x.reshape(-1, INPUTS) @ self.p[f"w{d}"] + self.p[f"c{d}"]
        zx = zx.reshape(steps, pages, -1)
        h, c = carried.get("state", (np.zeros((pages, HIDDEN), np.float32),) * 2) if carried is not None else (np.zeros((pages, HIDDEN), np.float32),) * 2
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            m = mask[t][:, None]
            i, f, o, g = self._gates(zx[t] + h @ self.p[f"u{d}"])
            new = f * c + i * g
            th = np.tanh(new)
            if keep is not None:
                keep.append((t, i, f, o, g, c, th, h))
            c = m * new + (1 - m) * c
            h = m * (o * th) + (1 - m) * h
            out[t] = h
        if carried is not None:
            carried["state"] = (h, c)
        return out

    def label(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        h = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], axis=2)
        return 1 / (1 + np.exp(-np.clip(h @ self.p["v"] + self.p["a"], -30, 30)))

    def label_long(self, blocks: list[Block], at_once: int = 4096) -> np.ndarray:
        """The same for one page of very many blocks, some at a time: both directions carry their state on."""
        z = np.full(len(blocks), self.p["a"][0], np.float32)
        starts = range(0, len(blocks), at_once)
        for d, v, order in (("f", self.p["v"][:HIDDEN], starts), ("b", self.p["v"][HIDDEN:], reversed(starts))):
            carried: dict = {}
            for at in order:
                x = vectors(blocks[at : at + at_once], at, len(blocks))[:, None, :]
                z[at : at + len(x)] += self._run(x, np.ones(x.shape[:2], np.float32), d, carried=carried)[:, 0] @ v
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _learn(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss."""
        kept: dict[str, list] = {"f": [], "b": []}
        hs = {d: self._run(x, mask, d, kept[d]) for d in "fb"}
        h = np.concatenate([hs["f"], hs["b"]], axis=2)
        p = 1 / (1 + np.exp(-np.clip(h @ self.p["v"] + self.p["a"], -30, 30)))
        e = (p - y) * mask / mask.sum()
        grad = {"v": np.einsum("tn,tnh->h", e, h), "a": e.sum(keepdims=True).reshape(1)}
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            dout = e[:, :, None] * self.p["v"][part]
            dw, du = np.zeros_like(self.p[f"w{d}"]), np.zeros_like(self.p[f"u{d}"])
            dc_, dh = np.zeros_like(hs[d][0]), np.zeros_like(hs[d][0])
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            for t, i, f, o, g, c, th, before in reversed(kept[d]):
                m = mask[t][:, None]
                dh = dh + dout[t]
                dn = m * dh
                dcell = m * dc_ + dn * o * (1 - th * th)
                dz = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), dn * th * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
                dz_all[t] = dz
                du += before.T @ dz
                dh = (1 - m) * dh + dz @ self.p[f"u{d}"].T
                dc_ = (1 - m) * dc_ + dcell * f
            dw += x.reshape(-1, INPUTS).T @ dz_all.reshape(-1, 4 * HIDDEN)
            grad |= {f"w{d}": dw, f"u{d}": du, f"c{d}": dz_all.sum(axis=(0, 1))}
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 3) -> Labeller:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                x, mask, y = stacked([pages[k] for k in order[at : at + batch]])
                step += 1
                for k, g in self._learn(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def stacked(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, mask, y) of pages padded to the longest: time, page, input."""
    steps = max(len(x) for x, _ in pages)
    x = np.zeros((steps, len(pages), INPUTS), np.float32)
    mask, y = np.zeros((steps, len(pages)), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, (own, label) in enumerate(pages):
        x[: len(own), k], mask[: len(own), k], y[: len(own), k] = own, 1, label
    return x, mask, y


# ---- pages made up for training -------------------------------------------------------------

_SYLLABLES = ["the an in er on re ti es or ed st ha nt ou of ing", "der sch ein ung keit ver ge ö ü en", "ción que ue as os la ñ ra", "éau le ment tion ou è que", "ка ро не ми ста ль ов", "lo ri me ta ku so"]
#: Containers of what is no article, by kind: (element, names of its class) and how its items look.
_BESIDE = {
    "menu": ("nav header div ul".split(), "nav menu navbar topnav breadcrumb navigation main-menu site-header links".split(), "links"),
    "header": ("header div".split(), "header masthead banner site-title top logo".split(), "short"),
    "notice": ("div section aside".split(), "notice cookie consent gdpr alert newsletter subscribe popup banner-message".split(), "sentence"),
    "advert": ("div aside section ins".split(), "ad ads advert sponsored promo banner adsbygoogle".split(), "sentence"),
    "sidebar": ("aside div section".split(), "sidebar widget related recommended trending tags side popular aside share social".split(), "links"),
    "form": ("form".split(), "search login subscribe form contact".split(), "form"),
    "comments": ("div section ol".split(), "comments comment-list responses replies discussion thread disqus".split(), "comments"),
    "footer": ("footer div".split(), "footer copyright legal bottom site-footer colophon".split(), "foot"),
}
_ARTICLE = ("article main div section td".split(), "article post content entry main story body text post-content entry-content page".split())


def _made_page(rng: random.Random) -> tuple[list[Block], list[int]]:
    """Blocks of one made-up page and whether each belongs to the article; marked by a sign in the text."""
    syllables = rng.choice(_SYLLABLES).split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice((1, 1, 2, 3))))
    noise = rng.choice(["", "", "", "###", "&amp;&amp;&amp;", "!!"])
    some = lambda a, b: " ".join(word() + noise for _ in range(rng.randint(a, b)))
    sentence = lambda: some(4, 22).capitalize() + "."
    para = lambda: " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 3, 5))))

    def attrs(names: list[str], most: float = 0.75) -> str:
        if rng.random() > most:
            return ""
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}{rng.choice(["", " box", " wrap", "-1", " clearfix"])}"'

    def beside(kind: str) -> str:
        tags, names, look = _BESIDE[kind]
        tag = rng.choice(tags)
        own = attrs(names, 0.97 if tag in ("div", "section", "ul", "ol", "ins") else 0.5)
        if look == "links":
            n = rng.randint(2, 9)
            inner = "<ul>" + "".join(f'<li><a href="/{word()}">{some(1, 4)}</a></li>' for _ in range(n)) + "</ul>" if rng.random() < 0.8 else "".join(f'<a href="#">{some(1, 3)}</a> ' for _ in range(n))
            if rng.random() < 0.3:
                inner = f"<h3>{some(1, 3)}</h3>" + inner
        elif look == "short":
            inner = f"<div>{some(1, 5)}</div>" + (f"<p>{some(2, 8)}</p>" if rng.random() < 0.4 else "")
        elif look == "form":
            inner = f"<label>{some(1, 3)}</label><input name=q><p>{sentence()}</p><button>{some(1, 2)}</button>"
        elif look == "comments":
            item = lambda: f'<div class="comment"><b>{some(1, 2)}</b><p>{para()}</p></div>'
            inner = f"<h3>{some(1, 2)}</h3>" + "".join(item() for _ in range(rng.randint(1, 5)))
        elif look == "foot":
            inner = f"&copy; {word()}.example.com &middot; {sentence()}" + (f"<p>{some(3, 9)}</p>" if rng.random() < 0.4 else "")
        else:
            inner = sentence() if rng.random() < 0.6 else f"<p>{sentence()}</p><a href=/x>{some(1, 3)}</a>"
        return f"<{tag}{own}>{inner}</{tag}>"

    def article() -> str:
        tag = rng.choice(_ARTICLE[0])
        own = attrs(_ARTICLE[1], 0.95 if tag in ("div", "section", "td") else 0.3)
        junk = " ".join([word().capitalize()] * rng.randint(5, 40)) if rng.random() < 0.08 else ""
        title = rng.choice([some(2, 12), para()[: rng.randint(12, 70)], junk[:60] or some(1, 3)])
        out = [f"<h1>{title}</h1>"] if rng.random() < 0.85 else []
        if junk:
            out.append(f"<p>{junk}</p>" * rng.randint(1, 3))
        for _ in range(rng.choice((1, 2, 4, 7, 12, 25))):
            r = rng.random()
            if r < 0.72:
                out.append(f"<p>{'<b>' if rng.random() < 0.12 else ''}{para()}{'<br>' if rng.random() < 0.1 else ''}{'</p>' if rng.random() < 0.9 else ''}")
            elif r < 0.80:
                out.append(f"<{(h := rng.choice(['h2', 'h3', 'h4']))}>{some(1, 8)}</{h}>")
            elif r < 0.86:
                out.append("<ul>" + "".join(f"<li>{some(2, 14)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif r < 0.91:
                out.append(f"<blockquote>{para()}</blockquote>")
            elif r < 0.94:
                out.append(f"<p>{some(2, 9)} <a href=/y>{some(1, 3)}</a> {sentence()}</p>")
            elif r < 0.97:
                out.append(f"<table><tr><td>{some(1, 4)}</td><td>{some(1, 4)}</td></tr></table>")
            else:
                out.append(f"<p>{word().capitalize()}.</p>")
        body = "".join(out)
        if rng.random() < 0.12:
            body += "\x02" + beside(rng.choice(("advert", "sidebar", "notice"))) + "\x03" + f"<p>{para()}</p>"
        wrapped = f"<table><tr><td{own}>{body}</td></tr></table>" if tag == "td" else f"<{tag}{own}>{body}</{tag}>"
        return "\x01" + wrapped + "\x04"

    parts = [beside(k) for k in ("header", "menu", "notice", "advert", "form", "sidebar") if rng.random() < 0.45] + [article()]
    parts += [beside(k) for k in ("comments", "sidebar", "advert", "form", "notice") if rng.random() < 0.3] + ([beside("footer")] if rng.random() < 0.8 else [])
    page = f"<!DOCTYPE html><html><head><title>{some(1, 5)}</title><script>var a='<p>';</script></head><body>" + "".join(parts) + "</body></html>"
    if rng.random() < 0.2:
        page = page.replace("<body>", "<body><div id=wrapper>", 1).replace("</body>", "</div></body>")
    # the signs 1-4 turn the answer on and off; they are read as text of their own and taken out again
    page = re.sub("[\x01\x02\x03\x04]", lambda m: f"<p>{m.group()}</p>", page)
    blocks, labels, on = [], [], 0
    for b in read_blocks(page):
        if b.text in ("\x01", "\x03"):
            on = 1
        elif b.text in ("\x02", "\x04"):
            on = 0
        else:
            blocks.append(b)
            labels.append(on)
    return blocks, labels


def train_labeller(pages: int = 600, seed: int = 11, epochs: int = 8) -> Labeller:
    """A labeller trained on `pages` made-up pages: the same weights for the same arguments."""
    rng = random.Random(seed)
    made = [_made_page(rng) for _ in range(pages)]
    return Labeller().fit([(vectors(b), np.array(y, np.float32)) for b, y in made if b], epochs=epochs)


def main_texts(pages: list[str | None], labeller: Labeller, at_once: int = 256, most_cells: int = 40_000, long: int = 8192) -> list[str]:
    """The article of each page: blocks labelled one half or more, in order, one to a line."""
    read = [read_blocks(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if read[k]), key=lambda k: len(read[k]))
    at = 0
    while at < len(order):
        stop = at + 1
        if len(read[order[at]]) > long:
            said = labeller.label_long(read[order[at]])[:, None]
        else:
            while stop < len(order) and stop - at < at_once and (stop - at + 1) * len(read[order[stop]]) <= most_cells:
                stop += 1
            x, mask, _ = stacked([(vectors(read[k]), np.zeros(len(read[k]), np.float32)) for k in order[at:stop]])
            said = labeller.label(x, mask)
        for n, k in enumerate(order[at:stop]):
            out[k] = "\n".join(b.text for b, p in zip(read[k], said[:, n], strict=False) if p >= 0.5)
        at = stop
    return out


def _extract(batches: Iterator[pa.RecordBatch], held: object, column: str, at_once: int = 2000) -> Iterator[pa.RecordBatch]:
    labeller = held.value
    for whole in batches:
        for at in range(0, whole.num_rows, at_once):
            batch = whole.slice(at, at_once)
            texts = main_texts(batch.column(column).to_pylist(), labeller)
            names = [n for n in batch.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, "text"])


def extract_main_text(pages: DataFrame, labeller: Labeller | None = None, html_col: str = "html") -> DataFrame:
    """pages without the html column, with a column text: the article of each whole page.

    Null and empty pages, and pages without an article, give the empty string. Reading takes time
    in proportion to the page, whatever its length, depth or faults, and very long pages are
    labelled some thousand blocks at a time. Repeated rows are read each; an empty table gives an
    empty result; a column named text is replaced, all others stay.
    """
    held = pages.sparkSession.sparkContext.broadcast(labeller or train_labeller())
    kept = [f for f in pages.drop(html_col, "text").schema]
    column = unused(pages, "_html")
    rows = pages.select(*(F.col(f"`{f.name}`") for f in kept), F.col(html_col).cast("string").alias(column))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + (", " if kept else "") + "text string"
    return rows.mapInArrow(partial(_extract, held=held, column=column), schema)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
