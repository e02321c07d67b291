"""Unit assertions on single operators, with our own sentences."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prosegauge.functions import lexicons as L
from prosegauge.functions import text as T
from prosegauge.operators import content, evaluation, pages, scoring
from prosegauge.operators.features import features, matched_phrases
from prosegauge.sources import stores
from prosegauge.streaming import feed

CORPUS = [
    ("red-1", "red", "Nobody talks about this.\n\nHere's the thing:\n\n🚀 Work hard\n🔥 Stay humble\n💡 Never quit\n\nUnpopular opinion? This changed everything.\n\nAgree? Drop a comment below 👇", []),
    ("red-2", "red", "Stop scrolling.\n\nRead that again.\n\nIt's not luck. It's discipline.\n\nRepost if you agree. Follow for more.\n\n#grind #hustle #mindset #success", []),
    ("green-1", "green", "On Tuesday our Postgres 14 cluster at Northwind lost 3 of 9 replicas for 42 minutes. We traced it to a 2.5x jump in WAL volume after the 1.8 release, moved 12 tables to a new tablespace and cut the lag from 310 s to 6 s. The full write-up with the graphs and the queries we used is linked below.", ["https://example.org/a"]),
    ("green-2", "green", "The Marston survey of 1,204 nurses in Leeds found that 61% had worked an unpaid hour in the past week, against 48% in 2019. Dr Patel of the University of York, who ran it, says the change comes mostly from wards with fewer than 20 beds.", ["https://example.org/b"]),
    ("yellow-1", "yellow", "I think good managers listen more than they talk. It is not easy and I am still learning it myself, but the teams that I have enjoyed working with all had someone who asked questions first and gave answers later.", []),
]


@pytest.fixture(scope="module")
def corpus(spark):
    df = spark.createDataFrame(CORPUS, "id string, label string, text string, links array<string>")
    return scoring.score(df, "text", "links").cache()


def one(spark, text, links=0):
    return features(spark.createDataFrame([(text, ["x"] * links)], "text string, links array<string>"), "text", "links").first()


def test_corpus_shape(corpus):
    rows = {r.id: r for r in corpus.collect()}
    assert all(0 <= r[k] <= 1 for r in rows.values() for k in L.KEYS)
    assert [rows[i].verdict for i in ("red-1", "red-2", "green-1", "green-2")] == ["red", "red", "green", "green"]
    r = evaluation.accuracy(corpus).first()
    assert r.inversions == 0 and r.exact >= 0.75 and r.least_red > r.most_green
    assert all(len(r.signals) <= 6 for r in rows.values())
    assert rows["red-1"].signals[0].weight > 0 > rows["green-1"].signals[0].weight


def test_detectors(spark):
    f = lambda t, **k: one(spark, t, **k)
    assert f("🚀 go\n🔥 on\n💡 up\n✨ out").bulletLineRatio == 1
    assert f("-5% on the year\nand more").bulletLineRatio == 0
    assert f("- a point\nnone").bulletLineRatio == 0.5
    beats = f("Keep going. Stay sharp. Never stop.")
    assert beats.entityDensity == 0 and beats.tricolon > 0.5
    assert f("THIS IS ALL LOUD AND CLEAR").entityDensity == 0
    assert f("THIS IS ALL LOUD AND CLEAR").shoutingRatio == 1
    assert f("The API uses HTTP over TLS on AWS").shoutingRatio == 0
    assert f("1. one thing to do with many more words here\n2. another thing to do with as many words").numberDensity < 0.3
    assert f("Thank you for reading this", links=1).citationDensity == pytest.approx(1 - math.exp(-1))
    assert f("thought leadership").corporateFiller == pytest.approx(1 - math.exp(-2 / 1.5))
    assert f("almost").vagueness > 0  # phrases match as substrings
    assert f("Visit the University of York today").entityDensity > 0
    assert f("It's not work. It's play.").antithesis == pytest.approx(1 - math.exp(-1 / 1.2))
    assert f("so what do you think? #one #two #three").closingHook == pytest.approx(0.7)
    assert f("a hook\n\nand the rest").hookPattern == pytest.approx(0.9)
    empty = f(None)
    assert empty.word_count == 0 and all(empty[k] == 0 for k in L.KEYS)


def test_long_chains_do_not_overflow(spark):
    r = one(spark, "a-" * 20000 + "b " + "Ab" * 20000 + " " + "#x " * 20000)
    assert all(0 <= r[k] <= 1 for k in L.KEYS)


def test_primitives(spark):
    df = spark.createDataFrame([("It's a well-known FACT. Really?\n\n yes ",)], "text string")
    r = T.analyze(df).first()
    assert r._words == ["it's", "a", "well-known", "fact", "really", "yes"] and r._lines == ["It's a well-known FACT. Really?", "yes"]
    assert r._sentences == ["It's a well-known FACT.", "Really?", "yes"]
    got = spark.range(1).select(
        T.std_dev(F.array(*[F.lit(float(x)) for x in (2, 4, 4, 4, 5, 5, 7, 9)])).alias("sd"), T.saturate(F.lit(2.0), 2).alias("sat"), T.utf16_length(F.lit("a😀")).alias("n"), T.count_emoji(F.lit("❤️")).alias("e"),
        T.ratio(F.lit(1.0), F.lit(0)).alias("zero"), T.clamp01(F.lit(7.0)).alias("c"), T.mean(F.array().cast("array<double>")).alias("m"),
    ).first()
    assert got.sd == 2 and got.sat == pytest.approx(0.632, abs=1e-3) and got.n == 3 and got.e == 2 and got.zero == 0 and got.c == 1 and got.m == 0


def test_matched_phrases(spark):
    df = spark.createDataFrame([("Hot take: we delve into synergy. Agree?",)], "text string")
    assert matched_phrases(df).first().matched_phrases == ["hot take", "synergy", "delve", "agree?"]


def test_normalize(spark):
    cases = [("a​b", "ab", False), ("a\r\nb\rc", "a\nb\nc", False), ("a\n \n\n\n b", "a\n\nb", False), ("  \n ", "", False), ("Text … see more", "Text", True), ("Text... See More ", "Text", True), ("see more later", "see more later", False), ("é 🎉", "é 🎉", False), (None, None, False)]
    df = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(cases)], "i int, text string")
    for r in content.normalize(df).collect():
        assert (r.text, r.truncated) == cases[r.i][1:]


def test_content_filter(spark):
    cases = [("too short", False), ("long enough to be a post", True), ("x" * 6001, False), ("Ann Lee | Baker | Leeds area | Bread", False), ("We tried a | b | c. And it worked", True), ("Stream Type\nsomething LIVE now", False), ("first line here\nAnn and 12 others reacted", False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string")
    assert {r.i for r in content.content_filter(df).collect()} == {i for i, (_, ok) in enumerate(cases) if ok}


def test_post_id(spark):
    def fnv(s):
        h = 0x811C9DC5
        raw = s.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[k : k + 2], "big")) * 0x01000193) & 0xFFFFFFFF
        digits = ""
        while h:
            h, d = divmod(h, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        return digits or "0"

    df = spark.createDataFrame([("héllo 😀", "Ann", None), ("x" * 300, None, None), ("t", "a", "urn:li:activity:1"), (None, None, None)], "text string, author string, urn string")
    got = [(r.post_id, r.id_is_stable) for r in content.post_id(df, "text", "author", "urn").collect()]
    assert got == [("hash:" + fnv("Ann\0héllo 😀"), False), ("hash:" + fnv("\0" + "x" * 200), False), ("urn:li:activity:1", True), ("hash:" + fnv("\0"), False)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=120), min_size=1, max_size=8))
def test_properties(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in scoring.score(df).collect():
        assert all(0 <= r[k] <= 1 for k in L.KEYS) and 0 < r.score < 1
    once = content.normalize(df).select("text")
    assert [r.text for r in content.normalize(once).collect() if "more" not in (r.text or "")] == [r.text for r in once.collect() if "more" not in (r.text or "")]


def test_label_store(spark, tmp_path):
    path = f"{tmp_path}/labels"
    assert stores.read_labels(spark, path).count() == 0
    label = lambda i, rating, at: (i, "two\nlines", rating, "green", "red", 0.5, at, "rules-2")
    stores.save_labels(spark.createDataFrame([label("a", 1, "2026-01-01T00:00:00Z"), label("b", 5, "2026-01-01T00:00:00Z")], stores.LABEL), path)
    stores.save_labels(spark.createDataFrame([label("a", 4, "2026-01-02T00:00:00Z")], stores.LABEL), path)
    assert {r.postId: r.rating for r in stores.read_labels(spark, path).collect()} == {"a": 4, "b": 5}
    stats = evaluation.label_stats(stores.read_labels(spark, path)).first()
    assert (stats.total, stats.red, stats.disagreements, stats.agreement) == (2, 2, 0, 1.0)
    stores.export_labels(spark, path, f"{tmp_path}/out", 1)
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert len(lines) == 2 and all('"text":"two\\nlines"' in x for x in lines)
    stores.remove_labels(spark, path, spark.createDataFrame([("a",)], "id string"))
    assert [r.postId for r in stores.read_labels(spark, path).collect()] == ["b"]
    stores.clear_labels(spark, path)
    assert stores.read_labels(spark, path).count() == 0
    assert evaluation.label_stats(stores.read_labels(spark, path)).first().agreement is None


def test_verdict_cache(spark, tmp_path):
    path = f"{tmp_path}/cache"
    posts = spark.createDataFrame([("p1", CORPUS[0][2]), ("p2", CORPUS[2][2])], "post_id string, text string")
    fresh = stores.score_with_cache(posts, stores.read_cache(spark, path))
    assert fresh.count() == 2
    stores.write_cache(scoring.score(posts.where("post_id = 'p1'")), path)
    again = stores.score_with_cache(posts, stores.read_cache(spark, path))
    assert sorted((r.post_id, round(r.score, 9)) for r in again.collect()) == sorted((r.post_id, round(r.score, 9)) for r in fresh.collect())
    stores.clear_cache(spark, path)
    assert stores.read_cache(spark, path).count() == 0


def test_author_names(spark):
    cases = [("Ann LeeAnn Lee", "Ann Lee"), ("Ann Lee Ann Lee", "Ann Lee"), ("View Ann Lee’s profile", "Ann Lee"), ("Ann Lee • 2nd", "Ann Lee"), ("Ann Lee 3rd+", "Ann Lee"), ("\n Ann Lee \n Baker", "Ann Lee"), ("Follow", None), ("+ follow", None), ("x" * 81, None), ("12 34", None), ("", None), (None, None), ("aaaa", "aaaa"), ("Émile Zé - profile photo", "Émile Zé")]
    got = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], "i int, raw string").select("i", pages.display_name(F.col("raw")).alias("name")).collect()
    assert {r.i: r.name for r in got} == {i: want for i, (_, want) in enumerate(cases)}
    links = [("https://x.test/in/ann-lee-4b2/", "Ann Lee"), ("https://x.test/jobs/1", None), ("/company/big%20co-x?y", "Big co X"), ("/in/%zz-top", None), (None, None), ("/in/a+b-c", "A+b C")]
    got = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(links)], "i int, href string").select("i", pages.address_name(F.col("href")).alias("name")).collect()
    assert {r.i: r.name for r in got if r.i != 3} == {i: want for i, (_, want) in enumerate(links) if i != 3}


def test_page_reading_is_linear():
    """Broken markup of a megabyte is read in seconds: each part took hours when the rest of a page was searched again and again."""
    import time

    for part in ("<a ", "<!-- ", "<div>", "</x>", "<![CDATA[", "<a b='", "<p><b>", "< ", "&amp", "<script>", "<a\"", "<li>x", "</a "):
        began = time.perf_counter()
        rows = pages._Reader().read(part * (1_000_000 // len(part)))
        assert time.perf_counter() - began < 20, part
        assert rows[0][7] == len(rows)
    deep = pages._Reader().read("<div>" * 100_000 + "</x>" * 100_000)
    assert len(deep) == 100_001


def test_broken_markup_as_browsers_read_it():
    shown = lambda html: [(r[4], r[6]) if r[6] is not None else r[4] for r in pages._Reader().read(html)[1:]]
    assert shown("a < b <i>c</i>") == [("#text", "a < b "), "i", ("#text", "c")]
    assert shown("x<!-- never closed <b>y</b>") == [("#text", "x")]
    assert shown("x<a href='never closed>y</a>") == [("#text", "x")]
    assert shown("<script>a<b></i></script>z") == ["script", ("#text", "a<b></i>"), ("#text", "z")]
    assert shown("<!doctype html><?x y?><![CDATA[q>r</>s") == [("#text", "r"), ("#text", "s")]
    row = pages._Reader().read("<A HREF=/in/a&amp;b class = 'x y' Hidden data-id=\"1>2\"/>")[1]
    assert row[5] == {"href": "/in/a&b", "class": "x y", "hidden": "", "data-id": "1>2"}


def test_structure_is_read_in_one_pass(spark):
    """A page of 10,000 author links in 50,000 elements: pairs of links and elements would be 5 * 10**8."""
    import time

    item = '<div><a href="/in/ann-lee">Ann Lee</a><p>' + "text of some length " * 5 + "</p></div>"
    wide = "<body>" + f"<div data-id=x><article>{item}</article></div>" * 10_000 + "</body>"
    nodes = pages.node_table(spark.createDataFrame([(1, None, wide)], "page_id long, url string, html string"))
    e = pages.described(nodes)
    began = time.perf_counter()
    scope = pages.scopes(e)
    assert pages.author_blocks(e, scope).count() == 10_000
    assert pages.looking_like_posts(e, scope).count() == 10_000
    assert time.perf_counter() - began < 120


def test_containments_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    rows, page = [], 0
    for page in range(6):
        reader = pages._Reader()
        reader.read("".join(rng.choice(["<div>", "<p>", "</div>", "x", "<br>", "</p>"]) for _ in range(60)))
        rows += [(page, r[0], r[2], r[7]) for r in reader.rows]
    df = spark.createDataFrame(rows, "_page long, node int, depth int, end int")
    tops, points = df.where("node % 3 != 1"), df.where("node % 2 = 0")
    for levels, own in ((None, False), (None, True), (2, False), (3, True)):
        got = {tuple(r) for r in pages.containments(points, tops, levels, own=own).collect()}
        want = {(p, n, t) for p, n, d, _ in rows if n % 2 == 0 for q, t, td, te in rows if t % 3 != 1 and p == q and (t < n or own and t == n) and n < te and (levels is None or d - td <= levels)}
        assert got == want
        last = {tuple(r) for r in pages.containments(points, tops, levels, 1, own).collect()}
        assert last == {(p, n, max(t for q, m, t in want if (q, m) == (p, n))) for p, n, _ in want}


BODY = "A post that says something at some length, so that it passes for the body of a post in the feed."


def card(urn, author, text=BODY, more=""):
    return f'<div data-urn="{urn}"><a href="/in/{author.lower().replace(" ", "-")}">{author}</a><div><p>{text}</p></div><div><button>Like</button></div>{more}</div>'


def posts_of(spark, *htmls):
    """Posts of each page, by page."""
    df = spark.createDataFrame([(i, "https://www.linkedin.com/feed/", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    out = [[] for _ in htmls]
    for r in pages.find_posts(df).orderBy("page_id", "post_index").collect():
        out[r.page_id].append(r)
    return out


def test_posts_of_each_tier(spark):
    comments = '<div class="comments"><a href="/in/cara-doe">Cara Doe</a><p>A comment that is not a post of its own, however long it may be here.</p></div>'
    cards = "<body><main>" + card("urn:li:activity:1", "Ann Lee", more=comments) + card("urn:li:activity:2", "Bob Ray", BODY + ' <a href="https://example.org/x">link</a>') + "</main></body>"
    item = lambda who, h="": f'<div>{h}<a href="/in/{who}">{who}</a><p>{BODY}</p></div>'
    headed = "<body><main>" + "".join(item(w, "<h2>Feed post</h2>") for w in ("ann", "bob", "cy")) + "</main></body>"
    plain = "<body><main><div>" + "".join(item(w) for w in ("ann", "bob", "cy", "di")) + "</div></main></body>"
    nested = "<body>" + card("urn:li:activity:1", "Ann Lee", more=card("urn:li:activity:9", "Old Author")) + "</body>"
    broken = "<body>" + card("urn:li:activity:4", "Eve Fox", BODY + ' <a href="http://[bad">x</a><a href="https://example.org/y">y</a>') + "</body>"
    got = posts_of(spark, cards, headed, plain, nested, broken, "<p>nothing here", "", None)
    assert [(p.tier, p.urn, p.author) for p in got[0]] == [("cards", "urn:li:activity:1", "Ann Lee"), ("cards", "urn:li:activity:2", "Bob Ray")]
    assert BODY in got[0][0].raw_text and "comment" not in got[0][0].raw_text and got[0][1].links == ["https://example.org/x"]
    assert [(p.tier, p.author_links) for p in got[1]] == [("headings", 1)] * 3
    assert [p.tier for p in got[2]] == ["structure"] * 4
    assert [p.urn for p in got[3]] == ["urn:li:activity:1"]
    assert [p.links for p in got[4]] == [["https://example.org/y"]]  # an address that can't be read ends nothing
    assert not any(got[5:])


def made_page(rng):
    """A page of random structure out of the parts that discovery looks at."""
    names = ["feed-shared-update-v2", "comments", "update-components-text", "update-components-actor__title", "update-components-actor__meta", "actor__name x", "break-words", "update-components-image", "update-components-mini-update-v2", "visually-hidden", "plain", "feed-shared-actor__name", "social-counts"]
    people = ["ann-lee", "bob-ray-4b2", "cy"]
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta of the and".split()) for _ in range(n))

    def part(depth):
        kind = rng.random()
        if depth > 5 or kind < 0.25:
            return words(rng.choice((1, 3, 12, 30)))
        if kind < 0.4:
            who = rng.choice(people)
            return f'<a href="/in/{who}"{rng.choice(["", " class=actor", " aria-label=\"View Dan Poe’s profile\""])}>{rng.choice([who.title(), "", "<img alt=\"Fay Orr\">", "<span aria-hidden=true>Gil Ash</span>"])}</a>'
        if kind < 0.46:
            return f'<a href="{rng.choice(["https://example.org/a", "/rel", "mailto:x", "https://www.linkedin.com/x"])}">{words(1)}</a>'
        if kind < 0.52:
            return f"<button {rng.choice(['', 'aria-label=\"See more\"', 'aria-expanded=true class=inline-show-more-text__button'])}>{rng.choice(['Like', ' comment ', 'More'])}</button>"
        if kind < 0.56:
            return f"<h2>{words(2)}</h2>"
        if kind < 0.6:
            return f"<div>{rng.choice(['Ann', 'Bob'])} likes this</div>"
        tag = rng.choice(["div", "div", "div", "span", "p", "article", "main", "li", "section"])
        own = rng.choice(["", "", f' class="{rng.choice(names)}"', f' class="{rng.choice(names)}"', f' data-urn="urn:li:{rng.choice(["activity", "comment", "member"])}:{rng.randrange(99)}"', ' data-id="urn:li:share:7"', " role=article", " hidden"])
        return f"<{tag}{own}>" + "".join(part(depth + 1) for _ in range(rng.randint(1, 5))) + (f"</{tag}>" if rng.random() < 0.95 else "")

    if rng.random() < 0.2:  # cards that open with a heading
        return "<html><body><main>" + "".join(f'<div><h2>{words(2)}</h2><a href="/in/{rng.choice(people)}">{words(1)}</a><p>{words(30)}</p>{rng.choice(["", words(9), "<button>Send</button>"])}</div>' for _ in range(rng.randint(1, 4))) + "</main></body></html>"
    return f"<html><body>{''.join(part(0) for _ in range(rng.randint(1, 6)))}</body></html>"


def test_posts_equal_a_plain_model(spark):
    """All columns of find_posts and read_pages on random pages, against a model that reads a page at a time."""
    import random

    import pages_model

    rng = random.Random(8)
    htmls = [made_page(rng) for _ in range(250)]
    got = posts_of(spark, *htmls)
    tiers = set()
    for html, found in zip(htmls, got, strict=True):
        want = pages_model.posts_of(html, "https://www.linkedin.com/feed/")
        assert [{k: r[k] for k in want[0]} for r in found] == want if want else not found, html
        tiers |= {p["tier"] for p in want}
    assert tiers == {"cards", "headings", "structure", "heuristics"}
    df = spark.createDataFrame([(i, "https://www.linkedin.com/feed/", h) for i, h in enumerate(htmls[:60])], "page_id long, url string, html string")
    for r in pages.read_pages(df).collect():
        page = pages_model.Page(htmls[r.page_id])
        body = next(k for k in range(1, len(page.nodes)) if page.nodes[k].tag == "body")
        assert (r.text, r.links, r.tier) == (page.block_text(body), page.links(body, "https://www.linkedin.com/feed/"), page.posts()[0])


def test_author_report(spark):
    title = '<span class="update-components-actor__title"><span aria-hidden="true">Follow</span></span>'
    html = "<body>" + card("urn:li:activity:1", "Ann Lee").replace("<div><p>", title + "<div><p>", 1) + "</body>"
    rows = pages.author_report(spark.createDataFrame([(7, "https://www.linkedin.com/feed/", html), (8, None, None)], "page_id long, url string, html string")).collect()
    told = {r.source: (r.raw, r.name, r.chosen) for r in rows}
    assert {r.page_id for r in rows} == {7} and set(told) <= set(pages.AUTHOR_SOURCES)
    assert told["titled span"] == ("Follow", None, False)
    assert told["text of the link"] == ("Ann Lee", "Ann Lee", True) and told["address of the link"][1:] == ("Ann Lee", False)


def test_block_text(spark):
    html = "<body><p>one</p>two<br>three<span class='x visually-hidden'>no</span><div hidden>no</div><button>no</button><ul><li>a<li>b</ul></body>"
    got = pages.read_pages(spark.createDataFrame([(1, None, html), (2, None, None)], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text.split() for r in got} == {1: ["one", "two", "three", "a", "b"], 2: []}


SCENES = {
    "late": ([("u1", None), ("u1", None), ("u1", "u1")], ["post"]),
    "never": ([("u1", None)] * 9, ["skipped"]),
    "never, no urn": ([(None, None)] * 8 + [(None, "hash:1")], ["skipped"]),
    "recycled": ([("u1", "u1"), ("u2", "u2")], ["post", "post"]),
    "unchanged": ([("u1", "u1")] * 10, ["post"]),
    "expanded without urn": ([(None, "hash:1"), (None, "hash:2")], ["post"]),
    "recovers with another urn": ([("u1", None)] * 7 + [("u2", "u2")], ["skipped", "post"]),
}


def test_element_scenes():
    for name, (seen, want) in SCENES.items():
        e = feed.Element()
        out = [e.see(urn, post, bool(post) and not post.startswith("hash:")) for urn, post in seen]
        assert [x for x in out if x] == want, name


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s1", name, tick, urn, post, bool(post) and not post.startswith("hash:"), "t") for name, (seen, _) in SCENES.items() for tick, (urn, post) in enumerate(seen)]
    df = spark.createDataFrame(rows, feed.EVENT)
    for k in range(3):  # three batches, by tick
        df.where(F.col("tick").between(4 * k, 4 * k + 3)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(feed.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    feed.run_to_end(feed.readings(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("tick").collect():
        got.setdefault(r.element_id, []).append(r.kind)
    assert got == {name: want for name, (_, want) in SCENES.items()}


def test_emit_once_and_gates(spark):
    df = spark.createDataFrame([("s", "a"), ("s", "a"), ("t", "a")], "session_id string, post_id string")
    assert feed.emit_once(df, "session_id", "post_id").count() == 2
    paths = spark.createDataFrame([("/feed/",), ("/in/ann",), ("/jobs/",), ("/",), ("/messaging",)], "path string")
    assert {r.path for r in feed.on_feed(paths).collect()} == {"/feed/", "/in/ann", "/"}


def test_no_shuffle_in_scoring(spark, tmp_path):
    spark.createDataFrame([("a", "b")], "text string, other string").write.parquet(f"{tmp_path}/t")
    plan = scoring.score(spark.read.parquet(f"{tmp_path}/t").select("text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<text:string>" in plan


def test_entry_without_llm():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {"score_documents", "top_signals", "page_posts"} <= names.keys() and __spark_entry__.oracle_sql().keys() <= names.keys()
