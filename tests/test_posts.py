"""Samples over all kinds of posts, extraction, the cache and the stream around scoring."""

import duckdb
import pytest
from pyspark.sql import functions as F

from prosegauge import queries
from prosegauge.functions import lexicons as L
from prosegauge.operators.features import features
from prosegauge.oracles import feature_ctes, rounded, score_ctes
from prosegauge.functions import lexicons as L
from prosegauge.operators import diagnostics, evaluation, extraction, scoring
from prosegauge.sources import samples, stores
from prosegauge.streaming import feed


@pytest.fixture(scope="module")
def scored(spark):
    return scoring.score(samples.posts(spark), "text", "links").cache()


def test_every_feature_speaks(scored):
    rows = scored.collect()
    assert all(0 <= r[k] <= 1 for r in rows for k in L.KEYS)
    assert evaluation.silent_features(scored).count() == 0
    mean = lambda label, *keys: sum(r[k] for r in rows if r.label == label for k in keys) / sum(r.label == label for r in rows)
    assert mean("red", "ctaPhrases", "closingHook") > mean("green", "ctaPhrases", "closingHook") + 0.3
    assert mean("red", "hookOpeners", "hyperbole", "llmTells") > mean("green", "hookOpeners", "hyperbole", "llmTells") + 0.3
    assert mean("green", "numberDensity", "entityDensity") > mean("red", "numberDensity", "entityDensity") + 0.3
    told = evaluation.accuracy(scored.where("label != 'short'")).first()
    assert told.inversions == 0 and told.least_red > told.most_green


def _source():
    rows = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (i, kind, text)) + f", {n})" for i, kind, text, n in samples.SAMPLES)
    return f"SELECT post_id AS id, text AS t, kind, n_links FROM (VALUES {rows}) AS v(post_id, kind, text, n_links)"


def test_sample_features_against_sql(spark):
    """All features of our own posts, links included: each of them fires somewhere."""
    got = features(samples.posts(spark), "text", "links").select("post_id", *map(queries.r6, L.KEYS))
    want = duckdb.connect().sql(f"SELECT {', '.join(got.columns)} FROM (WITH {feature_ctes(_source(), 'n_links')} SELECT id AS post_id, {rounded(L.KEYS)} FROM f)").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_sample_verdicts_against_sql(spark):
    out = scoring.score(samples.posts(spark), "text", "links")
    got = out.select("post_id", "kind", queries.r6("score"), "verdict", F.array_join(F.transform("signals", lambda s: s["key"]), "|").alias("reasons"))
    why = f"""WITH {score_ctes(_source(), 'n_links')}, why AS (SELECT id, string_agg(key, '|' ORDER BY position) AS reasons FROM reasons WHERE position <= 6 GROUP BY id)
    SELECT s.id AS post_id, src.kind, {rounded(['score'])}, verdict, coalesce(reasons, '') AS reasons FROM scored s JOIN source src ON src.id = s.id LEFT JOIN why ON why.id = s.id"""
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.connect().sql(f"SELECT {', '.join(got.columns)} FROM ({why})").fetchall())


def test_verdicts_without_reasons(spark, scored):
    bare = scoring.score(samples.posts(spark), "text", "links", reasons=False)
    assert "signals" not in bare.columns
    assert sorted((r.post_id, r.score, r.verdict) for r in bare.collect()) == sorted((r.post_id, r.score, r.verdict) for r in scored.collect())


def test_hidden_tail_columns(spark):
    whole = "The start of a text that goes on and on, far past the fold, to its very end."
    cases = [("The start of a text …see more", whole, True), (whole, whole, False), ("Another start", whole, False), ("", "x", True), ("", "", False), (None, None, False), (None, whole, True)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, rendered string, markup string, want boolean")
    for r in extraction.best_text(df, "rendered", "markup").collect():
        assert r.recovered == r.want, r
        assert r.raw_text == (r.markup or "" if r.want or not r.rendered else r.rendered)
    t = diagnostics.truncation(df).first()
    assert (t.posts, t.cut_short, t.recovered, t.needs_expanding) == (7, 1, 3, 0)


BODY = "A post that says something at some length, so that it passes for the body of a post in the feed."


def test_extraction_from_pages(spark):
    card = lambda urn, text: f'<div data-urn="{urn}"><a href="/in/ann-lee">Ann Lee</a><div><p>{text}</p></div><div><button>Like</button></div></div>'
    html = "<body>" + card("urn:li:activity:1", f"  {BODY} …see more") + card("urn:li:share:2", BODY.replace("A post", "Another one") + " <a href='https://example.org/a'>x</a>") + card("urn:li:activity:3", "short") + "</body>"
    df = spark.createDataFrame([(1, "https://x.test/", html), (2, None, None)], "page_id long, url string, html string")
    got = {r.post_id: r for r in extraction.extract_posts(df).collect()}
    assert set(got) == {"urn:li:activity:1", "urn:li:share:2"}
    one, two = got["urn:li:activity:1"], got["urn:li:share:2"]
    assert (one.text, one.truncated, one.author, one.id_is_stable) == (BODY, True, "Ann Lee", True) and (two.truncated, two.links) == (False, ["https://example.org/a"])
    check = {r.page_id: (r.tier, r.posts, r.healthy) for r in diagnostics.self_check(df).collect()}
    assert check == {1: ("cards", 3, True), 2: (None, 0, False)}
    raw = spark.createDataFrame([(None, "a", None), ("x", "b", None), (BODY, "c", None), (BODY, "c", None)], "raw_text string, author string, urn string")
    found = extraction.posts_from_raw(raw).collect()
    assert len(found) == 2 and len({r.post_id for r in found}) == 1 and not found[0].id_is_stable
    assert extraction.posts_from_raw(raw.limit(0)).count() == 0


def test_cache_is_added_to(spark, tmp_path, scored):
    path = f"{tmp_path}/cache"
    stores.write_cache(scored.limit(5), path, batch="a")
    stores.write_cache(scored.limit(5), path, batch="a")  # run again after a failure
    stores.write_cache(scored.withColumn("score", F.lit(0.5)).limit(5), path, batch="b")
    stores.write_cache(scored.limit(2), path, version="other")
    assert stores.cache_size(spark, path) == 5 and {r.score for r in stores.read_cache(spark, path).collect()} == {0.5}
    stores.compact_cache(spark, path)
    assert stores.cache_size(spark, path) == 5 and {r.score for r in stores.read_cache(spark, path).collect()} == {0.5}
    stores.clear_cache(spark, path)
    assert stores.cache_size(spark, path) == 0 and stores.cache_size(spark, path, "other") == 2


def test_stream_of_posts_through_the_cache(spark, tmp_path, scored):
    posts = samples.posts(spark).select("post_id", (F.length("post_id") % 2 == 0).alias("id_is_stable"), "text", "links")
    stores.write_cache(scored.where("post_id like 'red%'").withColumn("score", F.lit(0.123)), f"{tmp_path}/cache")
    for k in range(2):  # each post twice, in two files
        posts.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = feed.score_posts(stream, f"{tmp_path}/cache", f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    assert feed.counters(query)["seen"] == 2 * len(samples.SAMPLES)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(out) == 2 * len(samples.SAMPLES)
    want = {r.post_id: r.score for r in scored.collect()}
    for r in out:
        known = r.post_id.startswith("red") and r.id_is_stable
        assert r.score == (0.123 if known else want[r.post_id]) and r.cached == (r.id_is_stable if r.epoch else known)


def test_panel(spark):
    rows = [("s", "a", "red", 1), ("s", "b", "green", 2), ("s", "a", "green", 3), ("s", "c", "red", 4), ("t", "a", "yellow", 1)]
    got = sorted(tuple(r) for r in feed.panel(spark.createDataFrame(rows, "session_id string, post_id string, verdict string, at int"), "at").collect())
    assert got == [("s", "a", "red", 3, 1, 0, 0, 1), ("s", "b", "green", 2, 2, 1, 0, 1), ("s", "c", "red", 1, 3, 1, 0, 2), ("t", "a", "yellow", 1, 1, 0, 1, 0)]
