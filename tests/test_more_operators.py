"""Embeddings, selectors, sessions, the label log and the bucketed cache."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosegauge.operators import pages, selectors, similar
from prosegauge.sources import stores
from prosegauge.streaming import feed, sessions

# --- embeddings


def some_vectors():
    rng = np.random.default_rng(3)
    rows = [rng.standard_normal(16) for _ in range(300)]
    centre = rng.standard_normal(16)
    rows += [centre + 0.08 * rng.standard_normal(16) for _ in range(150)]  # one dense group
    for k in range(60):  # chains and pairs near the threshold
        rows.append(rows[k] + 0.42 * rng.standard_normal(16) * np.linalg.norm(rows[k]) / 4)
    rows += [rows[5]] * 40  # copies
    return [(i, [float(x) for x in v], "x") for i, v in enumerate(rows)] + [(900, None, "x"), (None, [1.0] * 16, "x"), (901, [0.0] * 16, "x"), (902, [1.0, None] * 8, "x"), (903, [1.0, 2.0], "x"), (904, [2.0, 4.0], "x")]


def exact_classes(rows, threshold=0.9):
    kept = [(i, np.array(v)) for i, v, _ in rows if i is not None and v is not None and None not in v]
    vecs = [v / (np.linalg.norm(v) or 1) for _, v in kept]
    at = list(range(len(kept)))

    def root(k):
        while at[k] != k:
            k = at[k]
        return k

    pairs = 0
    for a in range(len(kept)):
        for b in range(a):
            if len(vecs[a]) == len(vecs[b]) and (vecs[a] @ vecs[b] >= threshold or not vecs[a].any() and not vecs[b].any()):
                pairs += 1
                at[max(root(a), root(b))] = min(root(a), root(b))
    return {kept[k][0]: kept[root(k)][0] for k in range(len(kept))}, pairs


@pytest.mark.parametrize("crowd", [similar.CROWD, 20])
def test_embedding_classes(spark, crowd):
    rows = some_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string").repartition(3)
    got = {r.vec_id: r for r in similar.embedding_classes(df, recall=0.9999 if crowd > 20 else 0.98, crowd=crowd).collect()}
    want, _ = exact_classes(rows)
    assert got.keys() == want.keys()
    if crowd > 20:
        assert {i: r.component_id for i, r in got.items()} == want
    else:  # thinned cells may lose a link, never make one
        assert all(want[r.component_id] == want[i] for i, r in got.items())
        assert sum(r.component_id == want[i] for i, r in got.items()) >= 0.95 * len(got)
    assert got[5].n_copies == 41 and got[901].component_id == 901 and got[904].component_id == 903
    assert similar.embedding_classes(df.limit(0)).count() == 0


def test_embedding_search_and_recall(spark):
    rows = some_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)
    got = {r.query_id: r for r in similar.neighbours(df.where("vec_id % 7 = 0"), df, block=64).collect()}
    kept = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v, _ in rows if i is not None and v is not None and None not in v}
    for q, v in kept.items():
        if q % 7 == 0:
            cos = {i: float(v @ w) for i, w in kept.items() if i != q and len(w) == len(v)}
            assert got[q].n_near == sum(c >= 0.9 for c in cos.values()), q
            assert abs(got[q].nearest - max(cos.values(), default=0)) < 1e-5
    one = similar.measured_recall(df, every=7).first()
    assert one.n_pairs == sum(r.n_near for r in got.values()) and one.n_pairs >= one.n_found >= 0.9 * one.n_pairs > 0
    assert similar.tables_for(8) < similar.tables_for(16) and similar.bits_for(10**9) == 24


# --- selectors

HTML = '<body><nav><ul><li><a href="/x" class="b a">1</a><li><a>2</a></ul></nav><div id=m data-k="u:v, w>x"><p>t<span class=c>s</span></p><DIV><p aria-label="See More">q</p></DIV></div></body>'


def test_selectors(spark):
    nodes = pages.node_table(spark.createDataFrame([(1, None, HTML), (2, None, None)], "page_id long, url string, html string"))
    tags = {r.node: r.tag for r in nodes.collect()}
    cases = {"a": 2, "a[href]": 1, "a.a": 1, ".a.b": 1, "nav a": 2, "nav > a": 0, "li > a": 2, "ul>li": 2, "#m p": 2, "#m > p": 1, "div div p": 1, "div span, nav li": 3, "[data-k='u:v, w>x']": 1, "[data-k^=u]": 0, "p[aria-label*='see more' i]": 1, "p[aria-label*='see more']": 0, "a[class~=a]": 1, "*": len([t for t in tags.values() if t not in ("#text", "#page")]), "div#m[id$=m] > div": 1}
    kept = set(pages.ATTRIBUTES)
    for selector, n in cases.items():
        if "data-k" not in selector:
            assert selectors.matching(nodes, selector).count() == n, selector
    assert "data-k" not in kept  # attributes that no operator asks for are not in the table
    for bad in ("", "a >", "> a", "a[", "a..b", "a:hover", "a > > b"):
        with pytest.raises(ValueError):
            for one in selectors.alternatives(bad):
                for _, step in selectors.steps(one):
                    selectors.compile_step(step)


def test_registry_compiles_and_is_probed(spark):
    for some in selectors.REGISTRY.values():
        for selector in some:
            for one in selectors.alternatives(selector):
                assert [selectors.compile_step(s) for _, s in selectors.steps(one)]
    df = spark.createDataFrame([(1, HTML), (2, HTML + "<article><article>x</article></article>")], "page_id long, html string")
    got = {r.selector: r for r in selectors.probe(df, ["article", "li > a", "h6"]).collect()}
    assert (got["article"].n_pages, got["article"].n_nodes, got["article"].nested) == (1, 2, 1)
    assert got["li > a"].parents == ["li"] and got["h6"].n_nodes == 0


# --- sessions

SCENES = {
    "retries until a post comes": [(None, None), (None, None), (None, "p1")],
    "gives up after six": [(None, None)] * 8 + [("u1", "p2")],
    "same post again": [("u", "p1"), ("u", "p1"), (None, "p1")],
    "recycled": [("u1", "p1"), ("u2", "p2"), ("u1", "p1")],
    "failed urn stays failed": [("u", None)] * 7 + [("u", "p1"), ("v", "p1")],
}
WANT = {
    "retries until a post comes": ["retrying", "retrying", "post"],
    "gives up after six": ["retrying"] * 5 + ["skipped", "given_up", "given_up", "post"],
    "same post again": ["post", "duplicate", "duplicate"],
    "recycled": ["post", "post", "post"],
    "failed urn stays failed": ["retrying"] * 5 + ["skipped", "given_up", "given_up", "post"],
}


def test_sessions_with_state(spark, tmp_path):
    """Scenes over several micro-batches, a reset between, and counters of the whole."""
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    rows = [("s", name, tick, urn, post, True, "t", None) for name, events in SCENES.items() for tick, (urn, post) in enumerate(events)]
    rows += [("r", "e", 0, "u", "p1", True, "t", None), ("r", "e", 1, "u", "p1", True, "t", None), ("r", None, 2, None, None, None, None, "reset"), ("r", "e", 3, "u", "p1", True, "t", None)]
    rows += [("r", "shift", 0, None, "p1", False, "t", None), ("r", "shift", 1, None, "p9", False, "longer", None)]
    for part in range(3):  # each file is a micro-batch
        some = [r for r in rows if r[2] // 3 == part]
        spark.createDataFrame(some, sessions.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(sessions.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    feed.run_to_end(sessions.outcomes(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    out = spark.read.schema(sessions.OUT).parquet(f"{tmp_path}/out")
    got = collections.defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: r.tick):
        got[r.session_id, r.element_id].append(r.outcome)
    assert {n: got["s", n] for n in WANT} == WANT
    assert got["r", "e"] == ["post", "duplicate", "post"] and got["r", None] == ["reset"]
    assert got["r", "shift"] == ["post", "duplicate"]
    counts = sessions.counted(out, "session_id").where("session_id = 's'").first()
    flat = collections.Counter(x for v in WANT.values() for x in v)
    assert {o: counts[o] for o in sessions.OUTCOMES} == {o: flat[o] for o in sessions.OUTCOMES} and counts.seen == sum(flat.values())
    assert sessions.posts(out).count() == flat["post"] + 3
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


# --- label log and cache


def test_label_log(spark, tmp_path):
    path = f"{tmp_path}/labels"
    label = lambda i, rating, at: (i, "t", rating, "red", "red", 0.5, at, "v")
    frame = lambda *rows: spark.createDataFrame(list(rows), stores.LABEL)
    ratings = lambda: {r.postId: r.rating for r in stores.read_labels(spark, path).collect()}
    stores.save_labels(frame(label("a", 1, "2026-01-05T00:00:00Z"), label("b", 2, "2026-01-05T00:00:00Z"), label("c", 3, None)), path)
    batches = stores._batches(spark, path)
    stores.save_labels(frame(label("a", 5, "2026-01-01T00:00:00Z"), label("c", 4, None)), path)  # an older rating of a
    assert set(batches) < set(stores._batches(spark, path)) and ratings() == {"a": 1, "b": 2, "c": 4}
    stores.remove_labels(spark, path, spark.createDataFrame([("a",)], "id string"))
    assert ratings() == {"b": 2, "c": 4}
    stores.save_labels(frame(label("a", 2, "2026-01-01T00:00:00Z")), path)
    spark.createDataFrame([("lost",)], "x string").write.text(f"{path}/batch=lost")  # a batch that never finished
    import os

    os.remove(f"{path}/batch=lost/_SUCCESS")
    stores.compact_labels(spark, path)
    assert len(stores._batches(spark, path)) == 1 and ratings() == {"a": 2, "b": 2, "c": 4}
    stores.clear_labels(spark, path)
    assert ratings() == {}
    stores.save_labels(frame(label("z", 3, None)), path)
    assert ratings() == {"z": 3}


def bytes_read(df):
    """Bytes of the files that the scans of a query have read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves, total = [plan], 0
    while leaves:
        node = leaves.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            leaves.append(node.executedPlan())
        elif "QueryStage" in name:
            leaves.append(node.plan())
        else:
            if name.startswith("Scan"):
                total += node.metrics().apply("filesSize").value()
            kids = node.children()
            leaves += [kids.apply(k) for k in range(kids.size())]
    return total


def test_cache_lookup_reads_its_buckets(spark, tmp_path):
    """What a lookup of three posts reads doesn't grow with the rest of the cache."""
    path = f"{tmp_path}/cache"
    verdicts = lambda a, b: spark.range(a, b).select(F.concat(F.lit("p"), "id").alias("post_id"), F.lit("red").alias("verdict"), F.rand(1).alias("score"), F.lit(0.5).alias("confidence"), F.array().cast("array<struct<key:string,label:string,weight:double>>").alias("signals"), F.lit(False).alias("uncertain"))
    stores.write_cache(verdicts(0, 40_000), path, batch="a")
    ids = spark.createDataFrame([("p5",), ("p77",), ("nowhere",), (None,)], "post_id string")
    some = stores.read_cache(spark, path, ids=ids)
    assert {r.post_id for r in some.collect()} == {"p5", "p77"}
    part, whole = bytes_read(stores.read_cache(spark, path, ids=ids)), bytes_read(stores.read_cache(spark, path))
    assert 0 < part < whole / 10
    many = stores.read_cache(spark, path, ids=verdicts(0, 500).select("post_id"))
    assert many.count() == 500
    stores.write_cache(verdicts(0, 10).withColumn("score", F.lit(2.0)), path, batch="b")
    stores.compact_cache(spark, path)
    assert len(stores._batches(spark, f"{path}/scorer_version={stores.L.SCORER_VERSION}")) == 1
    assert stores.cache_size(spark, path) == 40_000 and stores.read_cache(spark, path, ids=ids).where("post_id = 'p5'").first().score == 2.0


def test_feed_shows_what_meets_the_viewport(spark):
    rows = [(1, -500, -201, 800), (2, -500, -200, 800), (3, 900, 1000, 800), (4, 1001, 1100, 800), (5, None, 10, 800)]
    df = spark.createDataFrame(rows, "id int, top int, bottom int, viewport_height int")
    assert {r.id for r in feed.visible(df).collect()} == {2, 3}


def test_containment_needs_no_pairs():
    """A stack reads 200,000 nested and flat nodes at once; only asked tops are on it."""
    import pyarrow as pa

    n = 200_000
    batch = pa.RecordBatch.from_pydict({"_page": [1] * (2 * n), "node": list(range(2 * n)), "depth": [0] * (2 * n), "until": [2 * n] * n + [None] * n}, pa.schema([("_page", pa.int64()), ("node", pa.int32()), ("depth", pa.int32()), ("until", pa.int32())]))
    out = pa.Table.from_batches(pages._stacked(iter([batch]), None, 1, False))
    assert out.num_rows == n and set(out["top"].to_pylist()) == {n - 1}


def test_counters_outlive_recent_progress(spark, tmp_path):
    import time

    listener = feed.Counters()
    spark.streams.addListener(listener)
    rows = [("p1", True, "a"), ("p2", False, ""), ("p3", True, None)]
    for part in range(3):
        spark.createDataFrame(rows[: part + 1], "post_id string, id_is_stable boolean, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("post_id string, id_is_stable boolean, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = stream.observe("feed", F.count(F.lit(1)).alias("seen"), F.count_if(~F.col("id_is_stable")).alias("unstable"))
    query = seen.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    for _ in range(50):  # the listener is told a little later
        if listener.sums.get(str(query.id), {}).get("seen") == 6:
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert listener.sums[str(query.id)] == {"seen": 6, "unstable": 2}


def test_medians_from_sketches_of_batches(spark):
    """Batches are reduced to sketches and merged; the quantile's rank is within two in a hundred of the exact one."""
    from prosegauge.operators import evaluation

    rows = spark.range(20_000).select((F.col("id") % 7).alias("batch"), (F.col("id") % 2).alias("kind"), (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 7).alias("ms"))
    sketches = evaluation.sketched(rows, "ms", "batch", "kind")
    assert sketches.count() == 14
    for r in evaluation.merged_quantiles(sketches, (0.5, 0.9), "kind").collect():
        assert r.n == 10_000
        for q, value in ((0.5, r.q50), (0.9, r.q90)):
            assert abs(rows.where((F.col("kind") == r.kind) & (F.col("ms") <= value)).count() / r.n - q) < 0.02


def test_batches_of_arrow_are_bounded():
    """What a Python worker makes at once is bounded by bytes or rows, not by the batch that Spark hands over."""
    import numpy as np
    import pyarrow as pa

    from prosegauge.operators import content, similar

    rng = np.random.default_rng(1)
    vectors = similar.unit(rng.standard_normal((700, 8)))
    vectors[650] = vectors[3]  # the smaller id is named where two are equally near
    vectors[20] = vectors[3]
    block = lambda rows: (np.array(rows).tolist(), vectors[rows].tobytes())
    (q, qv), (i, v) = block(list(range(600))), block(list(range(700)))
    batch = pa.RecordBatch.from_arrays([pa.array([q], pa.list_(pa.int64())), pa.array([qv], pa.binary()), pa.array([i], pa.list_(pa.int64())), pa.array([v], pa.binary())], ["q_ids", "q_vecs", "ids", "vecs"])
    out = list(similar._searched(iter([batch]), 0.9))
    assert max(b.num_rows for b in out) <= 256 and sum(b.num_rows for b in out) == 600
    got = {r["query_id"]: r for b in out for r in b.to_pylist()}
    assert got[3]["nearest_id"] == 20 and got[20]["nearest_id"] == 3
    texts = ["a", None, "é", ""] * 300
    composed = list(content.nfc.func(iter([pa.array(texts), pa.array(["plain"]), pa.array([], pa.string())])))
    assert composed[0].to_pylist() == ["a", None, "é", ""] * 300 and composed[1].to_pylist() == ["plain"] and len(composed[2]) == 0
