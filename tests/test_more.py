"""SQL names, diagnostics, fitting."""

from pyspark.sql import functions as F

from prosegauge.functions import lexicons as L
from prosegauge.functions import sql
from prosegauge.operators import diagnostics, fitting
from prosegauge.plans.spec import RULES

BODY = "A post that says something at some length, so that it passes for the body of a post in the feed."


def test_sql_functions(spark):
    assert "saturate" in sql.register(spark)
    r = spark.sql("SELECT utf16_length('a😀') a, emoji_count('❤️') b, saturate(2D, 2D) c, clamp01(7D) d, safe_ratio(1D, 0D) e, rating_verdict(4) f, score_verdict(0.1D) g, word_count('It''s a well-known fact') h, wide_trim('\u00a0 x \n') i").first()
    assert (r.a, r.b, round(r.c, 3), r.d, r.e, r.f, r.g, r.h, r.i) == (3, 2, 0.632, 1, 0, "red", "green", 4, "x")


def test_diagnostics(spark):
    card = f'<div data-urn="urn:li:activity:1"><a href="/in/ann-lee">Ann Lee</a><div><p>{BODY}</p></div></div>'
    item = f'<div><a href="/in/bob">Bob</a><p>{BODY}</p></div>'
    pages = spark.createDataFrame([(1, "", f"<body>{card}</body>"), (2, "", f"<body><main><div>{item * 3}</div></main></body>"), (3, "", None)], "page_id long, url string, html string")
    tiers = {r.tier: (r.pages, r.posts) for r in diagnostics.tier_counts(pages).collect()}
    assert tiers == {"cards": (1, 1), "structure": (1, 3)}
    assert [(r.page_id, r["items"]) for r in diagnostics.shapes(pages).where("rank = 1").collect()] == [(2, 3)]
    h = diagnostics.health(pages).first()
    assert (h.pages, h.with_posts, h.posts, h.verdict) == (3, 2, 4, "working")
    assert diagnostics.health(pages.limit(0)).first().verdict == "no pages"


def test_fit(spark):
    n = 120
    label = F.when(F.col("id") % 3 == 0, "red").when(F.col("id") % 3 == 1, "green").otherwise("yellow")
    value = lambda k: F.when((F.col("id") % 3 == 0) & F.lit(k == "ctaPhrases"), 0.8).when((F.col("id") % 3 == 1) & F.lit(k == "numberDensity"), 0.8).otherwise(0.1)
    judged = spark.range(n).select("id", label.alias("label"), F.lit(60).alias("word_count"), *(value(k).alias(k) for k in L.KEYS)).cache()
    spec = fitting.as_spec(fitting.fit_multinomial(judged))
    assert spec.weights["ctaPhrases"] > 0 > spec.weights["numberDensity"]
    assert fitting.wrong_signs(RULES) == []
    assert fitting.may_adopt(judged, RULES)
    old = spark.createDataFrame([("i", "2024-01-01T00:00:00Z", "rules-2"), ("i", "2026-01-01T00:00:00Z", "rules-2"), ("i", "2026-01-02T00:00:00Z", "rules-2"), ("i", "2026-01-02T00:00:00Z", "rules-1")], "install string, at string, scorerVersion string")
    assert fitting.retained(old, "2026-06-01T00:00:00Z", most=1).count() == 1


def test_folds_in_one_pass(spark):
    """Newton's weights against MLlib's on the rows of each fold's complement, and the folds of the built-in cross-validation."""
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    value = lambda k, i: F.abs(F.sin(F.col("id") * (i + 1) * 0.7)) * (0.5 + 0.5 * F.lit(i % 3)) + F.when((F.col("id") % 3 == 0) & F.lit(i < 4), 0.3).otherwise(0.0)
    label = F.when(F.col("id") % 3 == 0, "red").when(F.col("id") % 3 == 1, "green").when(F.col("id") % 9 != 8, "yellow")
    judged = spark.range(400).select("id", label.alias("label"), *(value(k, i).alias(k) for i, k in enumerate(L.KEYS))).cache()
    fold = fitting.fold_of("id", 3)
    rows = fitting.fold_rows(judged, fold).cache()
    weights = fitting.fit_folds(rows, 3)
    for k in range(2):
        train = rows.where(F.col("fold") != k).select(array_to_vector(F.slice("vector", 1, len(L.KEYS))).alias("v"), "target")
        model = LogisticRegression(featuresCol="v", labelCol="target", regParam=0.05, elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=300).fit(train)
        assert np.allclose(model.coefficients.toArray(), weights[k][:-1], atol=2e-3) and abs(model.intercept - weights[k][-1]) < 5e-3
    out = fitting.out_of_fold(judged, weights, "id", fold).collect()
    assert len(out) == judged.where("label is not null").count() and all(0 < r.probability < 1 for r in out)
    assert np.mean([r.probability for r in out if r.label == "red"]) > np.mean([r.probability for r in out if r.label != "red"]) + 0.2
    none = fitting.fit_folds(rows.limit(0), 3)
    assert not none.any()
    model, means = fitting.cross_validated(judged.where("id < 150"), grid=(0.01, 0.5), folds=2)
    assert len(means) == 2 and all(0 <= m <= 1 for m in means) and model.numClasses == 3


def test_searches_of_the_text_are_made_once(spark):
    """A saturated value, the lower-cased text and the linked posts stand in the plan once."""
    from prosegauge.functions import lexicons as L
    from prosegauge.operators.features import features, matched_phrases
    from prosegauge.queries import linked_features

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    docs = spark.createDataFrame([("Many words.",)], "text string")
    assert plan(features(docs).select("numberDensity")).count(L.POINTER) == 0
    assert plan(features(docs).select("pointerEmoji")).count(L.POINTER) == 1
    assert plan(matched_phrases(docs)).count("lower(") == 1
    folder = "/root/testdata/sf0.001"
    assert plan(linked_features(spark, folder)).count("n_chars") <= 1 and plan(linked_features(spark, folder)).count("Join") == 1


def test_searches_are_only_left_out_where_nothing_is_found(spark):
    from prosegauge.functions import text as T
    from prosegauge.functions import lexicons as L
    from prosegauge.operators.features import ANTITHESIS_PARTS, PRESCRIPTIVE_PARTS
    from pyspark.sql import functions as F

    texts = ["It's not about luck. It's work", "ITS NOT x!its", "not just a, but b", "Not only y. it's", "STOP it. Start", "Don't wait. Do", "dont wait! be", "This isn't it. This is", "your plan isn't bad. It's",
             "You SHOULD, you must, you need to, you have to, you ought to", "never say, ALWAYS do", "stop doing", "Start saying", "Here's how to; here is how to", "", "İt's not a. it's", "plain"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for patterns, parts in ((L.ANTITHESIS, ANTITHESIS_PARTS), (L.PRESCRIPTIVE, PRESCRIPTIVE_PARTS)):
        for p, some in zip(patterns, parts, strict=True):
            found = F.regexp_count("t", F.lit(T.pattern(p)))
            assert all(r.a == r.b for r in rows.select(found.alias("a"), T.where_any(F.lower("t"), some, found, 0).alias("b")).collect())
    phrases = [*L.ENGAGEMENT_CTA, *L.CORPORATE_FILLER]
    texts = spark.createDataFrame([(" ".join(phrases[a:b]),) for a in range(0, len(phrases), 7) for b in range(a, len(phrases) + 1, 5)], "t string")
    plain = sum((F.contains("t", F.lit(p)).cast("int") for p in phrases), F.lit(0))
    assert all(r.a == r.b == r.c for r in texts.select(plain.alias("a"), T.count_phrases(F.col("t"), phrases).alias("b"), F.size(T.matching_phrases(F.col("t"), phrases)).alias("c")).collect())
