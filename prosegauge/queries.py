"""The query catalogue: each takes (spark, sf_dir) and reads whole tables; ORACLES has the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lexicons as L
from .functions import text as T
from .operators import content, evaluation, extraction, fitting, pages, scoring, selectors, similar
from .operators.features import features, matched_phrases
from .plans.lineage import checkpoint_folder, cut
from .sources import stores
from .streaming import feed, sessions
from .oracles import DOCUMENTS, _TRIM, _units, feature_ctes, rounded, score_ctes

Query = Callable[[SparkSession, str], DataFrame]
GROUPS = {g: [f[0] for f in L.FEATURES if f[1] == g] for g in ("structural", "linguistic", "informational", "engagementBait")}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


# ---- text and features -------------------------------------------------------------------------------


def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.analyze(documents(spark, sf_dir).select("doc_id", "text"))
    size = lambda c: F.size(c).cast("bigint")
    return out.select(
        "doc_id", size("_lines").alias("n_lines"), size("_sentences").alias("n_sentences"), size("_words").alias("n_words"),
        T.utf16_length(F.col("_text")).cast("bigint").alias("n_units"), F.round(T.mean_line_length(F.col("_lines")), 6).alias("mean_line_length"), F.round(T.mean_sentence_words(F.col("_sentences")), 6).alias("mean_sentence_words"),
    )


TEXT_STATS_SQL = f"""WITH {feature_ctes(DOCUMENTS)}
SELECT id AS doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ss) AS BIGINT) AS n_sentences, CAST(len(ws) AS BIGINT) AS n_words, CAST({_units("t")} AS BIGINT) AS n_units,
  round(coalesce(list_avg(list_transform(ls, lambda x: {_units("x")})), 0), 6) AS mean_line_length,
  round(coalesce(list_avg(list_transform(ss, lambda x: len(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}]+')))), 0), 6) AS mean_sentence_words FROM bare"""


def _group(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return features(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", *map(r6, GROUPS[name]))

    return query


def _group_sql(name: str) -> str:
    return f"WITH {feature_ctes(DOCUMENTS)} SELECT id AS doc_id, {rounded(GROUPS[name])} FROM f"


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matched_phrases(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.array_join("matched_phrases", "|").alias("matched"))


def _matched_sql() -> str:
    names = [*L.HOOK_OPENERS, *L.HYPERBOLE, *L.CORPORATE_FILLER, *L.LLM_TELLS, *L.ENGAGEMENT_CTA, *L.AUTHORITY_BAIT]
    array = "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"
    return f"SELECT doc_id, coalesce(array_to_string(list_filter({array}, lambda p: contains(lower(coalesce(text, '')), p)), '|'), '') AS matched FROM documents"


# ---- scores --------------------------------------------------------------------------------------------


def scored(spark: SparkSession, sf_dir: str, reasons: bool = True) -> DataFrame:
    return scoring.score(documents(spark, sf_dir), reasons=reasons)


def score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, False).select("doc_id", "word_count", r6("score"), "verdict", r6("confidence"), "uncertain")


SCORE_SQL = f"WITH {score_ctes()} SELECT id AS doc_id, word_count, {rounded(['score'])}, verdict, {rounded(['confidence'])}, uncertain FROM scored"


def top_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(spark, sf_dir).select("doc_id", F.posexplode_outer("signals").alias("position", "s")).where("position is not null")
    return out.select("doc_id", (F.col("position") + 1).cast("bigint").alias("position"), "s.key", "s.label", F.round("s.weight", 6).alias("weight"))


TOP_SQL = f"WITH {score_ctes()} SELECT id AS doc_id, position, key, label, round(weight, 6) AS weight FROM reasons WHERE position <= 6"


def feature_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.posexplode_outer(scoring.feature_signals()).alias("position", "s")).where("position is not null")
    return out.select("doc_id", (F.col("position") + 1).cast("bigint").alias("position"), "s.key", F.round("s.weight", 6).alias("weight"))


def _feature_signals_sql() -> str:
    from .plans.spec import RULES

    parts = " UNION ALL ".join(f"SELECT id, {i} AS place, '{k}' AS key, {'-' if d == 'quality' else ''}{k} AS weight, {k} * {RULES.informativeness(k)!r} AS rank FROM f WHERE {k} >= 0.42" for i, (k, _, d, *_) in enumerate(L.FEATURES) if d != "neutral")
    return f"""WITH {feature_ctes(DOCUMENTS)}, parts AS ({parts}), placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank DESC, place) AS position FROM parts)
SELECT id AS doc_id, position, key, round(weight, 6) AS weight FROM placed WHERE position <= 5"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", "verdict", scoring.verdict_label(F.col("verdict")).alias("verdict_label"), scoring.summary().alias("summary"))


SUMMARY_SQL = f"""WITH {score_ctes()}, top AS (SELECT id, label, weight FROM reasons WHERE position = 1),
substance AS (SELECT id, arg_min(label, position) AS label FROM reasons WHERE position <= 6 AND weight < 0 GROUP BY id)
SELECT s.id AS doc_id, verdict, CASE verdict WHEN 'green' THEN 'Good read' WHEN 'yellow' THEN 'Useful, but generic' ELSE 'Low value' END AS verdict_label,
  CASE WHEN top.id IS NULL THEN 'No strong signals' WHEN verdict = 'green' THEN coalesce(substance.label, 'Specific and concrete') WHEN top.weight > 0 THEN top.label ELSE 'Mixed signals' END AS summary
FROM scored s LEFT JOIN top ON top.id = s.id LEFT JOIN substance ON substance.id = s.id"""


def verdict_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.verdict_counts(scored(spark, sf_dir, False), "lang").select("lang", "verdict", "n", r6("mean_score"))


BY_LANG_SQL = f"WITH {score_ctes()} SELECT lang, verdict, count(*) AS n, round(avg(score), 6) AS mean_score FROM scored JOIN documents ON doc_id = id GROUP BY lang, verdict"


def score_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(read(spark, sf_dir, "benchmark").select("item_id", "text"), reasons=False).select("item_id", r6("score"), "verdict")


def score_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.score(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), reasons=False)
    return out.groupBy("role", "verdict").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


# ---- content ---------------------------------------------------------------------------------------------


def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.normalize(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "text", "truncated")


_FLAT = r"[\t\x0b\x0c \x{00a0}]+"
NORMAL_CTE = rf"""composed AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\x{{00AD}}\x{{200B}}-\x{{200F}}\x{{2028}}\x{{2029}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{2064}}\x{{FEFF}}]', '', 'g'), '\r\n?', chr(10), 'g'), '{_FLAT}', ' ', 'g'), ' ?\n ?', chr(10), 'g') AS x FROM documents
), normal AS (
  SELECT doc_id, {_TRIM.format("regexp_replace(x, '\\n{3,}', chr(10) || chr(10), 'g')")} AS x FROM composed
), cut AS (
  SELECT doc_id, x, rtrim(regexp_replace(x, '(?i)(?:…|\.\.\.)\s*(?:see\s+)?more\s*$', '')) AS text FROM normal
)"""
NORMAL_SQL = f"WITH {NORMAL_CTE} SELECT doc_id, text, length(text) <> length(x) AS truncated FROM cut"


def content_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = content.content_filter(content.normalize(documents(spark, sf_dir).select("doc_id", "text")))
    return out.select("doc_id", T.utf16_length(F.col("text")).cast("bigint").alias("n_units"))


def _not_a_post() -> str:
    return " OR ".join("regexp_matches(text, '" + p.format(s=r"\s", b=r"\b", e=r"\b", p="").replace("'", "''") + "')" for p in L.NOT_A_POST)


CONTENT_SQL = rf"""WITH {NORMAL_CTE} SELECT doc_id, length(text) AS n_units FROM cut WHERE length(text) BETWEEN 12 AND 6000 AND NOT ({_not_a_post()})
AND NOT (NOT contains(text, chr(10)) AND len(string_split(text, '|')) >= 3 AND NOT regexp_matches(text, '[.!?]\s')
  AND len(list_filter(string_split(text, '|'), lambda p: len(string_split_regex(trim(p), '\s+')) > 8)) = 0)"""


def post_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.post_id(documents(spark, sf_dir).select("doc_id", "text", "source"), "text", "source").select("doc_id", "post_id", "id_is_stable")


def _id_cte(author: str) -> str:
    return f"""input AS (SELECT doc_id, {author} || chr(0) || substr(coalesce(text, ''), 1, 200) AS x FROM documents),
hashed AS (SELECT doc_id, list_reduce(list_transform(string_split(x, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, u: (xor(h, u) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) AS h FROM input),
digits AS (SELECT doc_id, h, list_reverse(list_transform(range(7), lambda k: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((h // CAST(pow(36, k) AS BIGINT)) % 36 AS INTEGER) + 1, 1))) AS d FROM hashed)"""


POST_ID_SQL = f"WITH {_id_cte('source')} SELECT doc_id, 'hash:' || coalesce(nullif(ltrim(array_to_string(d, ''), '0'), ''), '0') AS post_id, false AS id_is_stable FROM digits"


def dedup_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.distinct_posts(content.post_id(documents(spark, sf_dir).select("doc_id", "text")).select("post_id", "doc_id"), "doc_id").select("post_id", "doc_id")


DEDUP_SQL = f"WITH {_id_cte(chr(39) * 2)} SELECT 'hash:' || coalesce(nullif(ltrim(array_to_string(d, ''), '0'), ''), '0') AS post_id, min(doc_id) AS doc_id FROM digits GROUP BY ALL"


# ---- labels and evaluation -------------------------------------------------------------------------------


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings for documents; how quality and toxic become a rating is this library's convention."""
    q, t = F.col("quality"), F.col("toxic")
    rating = F.when((q == 1) & (t == 0), 1).when((q == 1) & (t == 1), 3).when((q == 0) & (t == 0), 4).when((q == 0) & (t == 1), 5)
    return read(spark, sf_dir, "labels").select("doc_id", rating.alias("rating"))


_RATING_SQL = "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality = 1 AND toxic = 1 THEN 3 WHEN quality = 0 AND toxic = 0 THEN 4 WHEN quality = 0 AND toxic = 1 THEN 5 END AS rating FROM labels"
_JUDGED_CTE = f"{score_ctes()}, rated_labels AS ({_RATING_SQL}), judged AS (SELECT s.*, rating, CASE WHEN rating <= 2 THEN 'green' WHEN rating = 3 THEN 'yellow' WHEN rating >= 4 THEN 'red' END AS label FROM scored s JOIN rated_labels ON doc_id = id)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    rows = documents(spark, sf_dir).select("doc_id", "text").join(labels, "doc_id")
    return scoring.score(rows, reasons=False).withColumn("label", evaluation.rating_to_verdict(F.col("rating")))


def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.label_stats(_judged(spark, sf_dir).select("rating", F.col("verdict").alias("predicted")))
    return out.withColumn("agreement", F.round("agreement", 6))


LABEL_STATS_SQL = f"""WITH {_JUDGED_CTE} SELECT count(*) AS total, count(*) FILTER (label = 'green') AS green, count(*) FILTER (label = 'yellow') AS yellow, count(*) FILTER (label = 'red') AS red,
{", ".join(f"count(*) FILTER (rating = {r}) AS rating_{r}" for r in range(1, 6))}, count(*) FILTER (label <> verdict) AS disagreements,
round((count(*) - count(*) FILTER (label <> verdict)) / nullif(count(*), 0), 6) AS agreement FROM judged"""


def label_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.label_shares(_labels(spark, sf_dir)).select("rating", "label", "hint", "n", r6("percent"), r6("height"), r6("progress"))


def _label_shares_sql() -> str:
    scale = ", ".join(f"({r}, '{a}', '{b}')" for r, a, b in L.RATINGS)
    return f"""WITH scale(rating, label, hint) AS (VALUES {scale}), counted AS (SELECT rating, count(*) AS n FROM ({_RATING_SQL}) GROUP BY rating),
j AS (SELECT scale.*, coalesce(n, 0) AS n FROM scale LEFT JOIN counted USING (rating))
SELECT rating, label, hint, n, round(100 * coalesce(n / nullif(sum(n) OVER (), 0), 0), 6) AS percent, round(coalesce(n / nullif(max(n) OVER (), 0), 0), 6) AS height, round(least(1.0, (sum(n) OVER ()) / 400), 6) AS progress FROM j"""


def fire_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.fire_rates(features(documents(spark, sf_dir).select("doc_id", "text"))).select("key", r6("rate"), r6("mean"))


FIRE_SQL = f"WITH {feature_ctes(DOCUMENTS)} " + " UNION ALL ".join(f"SELECT '{k}' AS key, round(avg(CASE WHEN {k} >= 0.42 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg({k}), 6) AS mean FROM f" for k in L.KEYS)


def silent_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.silent_features(features(documents(spark, sf_dir).select("doc_id", "text")))


SILENT_SQL = f"WITH {feature_ctes(DOCUMENTS)} SELECT key FROM (" + " UNION ALL ".join(f"SELECT '{f[0]}' AS key, count(*) FILTER ({f[0]} >= 0.42) AS n FROM f" for f in L.FEATURES if f[2] != "neutral") + ") WHERE n = 0"


def class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.class_means(_judged(spark, sf_dir), "label").select("label", "n", *map(r6, L.KEYS))


CLASS_SQL = f"WITH {_JUDGED_CTE} SELECT label, count(*) AS n, {', '.join(f'round(avg({k}), 6) AS {k}' for k in L.KEYS)} FROM judged GROUP BY label"


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.accuracy(_judged(spark, sf_dir)).select("n", r6("exact"), "inversions", r6("least_red"), r6("most_green"))


ACCURACY_SQL = f"""WITH {_JUDGED_CTE} SELECT count(*) AS n, round(avg(CASE WHEN label = verdict THEN 1.0 ELSE 0.0 END), 6) AS exact,
count(*) FILTER ((label = 'red' AND verdict = 'green') OR (label = 'green' AND verdict = 'red')) AS inversions,
round(min(score) FILTER (label = 'red'), 6) AS least_red, round(max(score) FILTER (label = 'green'), 6) AS most_green FROM judged"""


def feature_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.feature_correlation(features(documents(spark, sf_dir).select("doc_id", "text")), "lineUniformity", "sentenceUniformity").select(r6("r"))


CORR_SQL = f"WITH {feature_ctes(DOCUMENTS)} SELECT round(corr(lineUniformity, sentenceUniformity), 6) AS r FROM f"
BIASES = [0.95, 1.0, 1.05, 1.1, 1.15, 1.2, 1.25]


def bias_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.bias_sweep(_judged(spark, sf_dir), BIASES).select("bias", "n", r6("exact"))


def _bias_sql() -> str:
    from .plans.spec import RULES

    lg = lambda x: f"(1 / (1 + exp(-{RULES.steepness} * (({x}) - bias))))"
    grid = ", ".join(f"({b}::DOUBLE)" for b in BIASES)
    return f"""WITH {_JUDGED_CTE}, grid(bias) AS (VALUES {grid}), tried AS (SELECT bias, label, CASE WHEN word_count < 25 AND NOT (ctaPhrases > 0.5 AND closingHook > 0.5)
  THEN {lg('0.0')} + ({lg('total')} - {lg('0.0')}) * word_count / 25.0 ELSE {lg('total')} END AS s FROM judged, grid)
SELECT bias, count(*) AS n, round(avg(CASE WHEN label = CASE WHEN s >= 0.6 THEN 'red' WHEN s <= 0.28 THEN 'green' ELSE 'yellow' END THEN 1.0 ELSE 0.0 END), 6) AS exact FROM tried GROUP BY bias"""


# ---- pages, stores, streams ------------------------------------------------------------------------------


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.read_pages(read(spark, sf_dir, "pages"))
    text = content.normalized(content.nfc(F.col("text")))
    return out.select("page_id", "tier", F.size("links").cast("bigint").alias("n_links"), F.length(text).cast("bigint").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.read_pages(read(spark, sf_dir, "pages")).select("page_id", F.posexplode_outer("links").alias("position", "link")).where("position is not null")


def page_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.find_posts(read(spark, sf_dir, "pages"))
    return out.select("page_id", "post_index", "tier", "urn", "author", F.size("links").cast("bigint").alias("n_links"), "has_media", "is_reshare", "text_length")


def label_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels, then a second rating of the toxic ones at a later time."""
    one = _labels(spark, sf_dir).select(F.col("doc_id").cast("string").alias("postId"), "rating", F.lit("2026-01-01T00:00:00Z").alias("at"))
    two = one.where("rating in (3, 5)").select("postId", F.lit(5).alias("rating"), F.lit("2026-01-02T00:00:00Z").alias("at"))
    return stores.upserted(one, two, "postId", F.to_timestamp("at"))


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.json_lines(_labels(spark, sf_dir).select(F.col("doc_id").cast("string").alias("postId"), "rating", F.lit(None).cast("string").alias("note")))


def cached_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored with half the verdicts already stored."""
    posts = content.post_id(documents(spark, sf_dir).select("text")).groupBy("post_id").agg(F.min("text").alias("text"))
    folder = shared_folder(spark, "cache")
    stores.write_cache(scoring.score(posts.where(F.crc32("post_id") % 2 == 0)), folder)
    return stores.score_with_cache(posts, stores.read_cache(spark, folder)).select("post_id", r6("score"), "verdict")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post ids of all documents as a stream, each given out once."""
    folder = shared_folder(spark, "stream")
    source = f"{sf_dir}/document[s].parquet"
    schema = read(spark, sf_dir, "documents").schema
    posts = content.post_id(spark.readStream.schema(schema).parquet(source), "text").select("post_id")
    feed.run_to_end(feed.emit_once(posts, "post_id"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw posts whose urn, where there is one, is their number: normalised, filtered, identified."""
    raw = documents(spark, sf_dir).select("doc_id", F.col("text").alias("raw_text"), F.col("source").alias("author"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("urn:li:activity:"), "doc_id")).alias("urn"))
    return extraction.posts_from_raw(raw).select("doc_id", "post_id", "id_is_stable", "truncated", F.sha2("text", 256).alias("text_sha256"))


EXTRACTED_SQL = rf"""WITH {NORMAL_CTE}, kept AS (SELECT cut.doc_id, cut.text, cut.x, source FROM cut JOIN documents USING (doc_id) WHERE length(cut.text) BETWEEN 12 AND 6000 AND NOT ({_not_a_post().replace("(text, '", "(cut.text, '")})
  AND NOT (NOT contains(cut.text, chr(10)) AND len(string_split(cut.text, '|')) >= 3 AND NOT regexp_matches(cut.text, '[.!?]\s')
  AND len(list_filter(string_split(cut.text, '|'), lambda p: len(string_split_regex(trim(p), '\s+')) > 8)) = 0)),
input AS (SELECT doc_id, text, x AS whole, coalesce(source, '') || chr(0) || substr(text, 1, 200) AS k FROM kept),
hashed AS (SELECT doc_id, text, whole, list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, u: (xor(h, u) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) AS h FROM input),
digits AS (SELECT *, list_reverse(list_transform(range(7), lambda k: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((h // CAST(pow(36, k) AS BIGINT)) % 36 AS INTEGER) + 1, 1))) AS d FROM hashed)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'urn:li:activity:' || doc_id ELSE 'hash:' || coalesce(nullif(ltrim(array_to_string(d, ''), '0'), ''), '0') END AS post_id,
  doc_id % 3 = 0 AS id_is_stable, length(text) <> length(whole) AS truncated, sha256(text) AS text_sha256 FROM digits"""


def linked_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts with the addresses of the page of the same number, made absolute."""
    hrefs = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))
    links = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.array_distinct(F.transform(hrefs, lambda h: F.concat(F.lit("https://example.org/"), h))).alias("links"))
    return documents(spark, sf_dir).join(links, "doc_id", "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))


def linked_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The informational features and the verdict of posts that carry links, in one pass: features come with the score."""
    out = scoring.score(linked_posts(spark, sf_dir).where("doc_id is not null"), "text", "links", reasons=False)
    return out.select("doc_id", *map(r6, GROUPS["informational"]), r6("score"), "verdict")


_LINKED = """SELECT d.doc_id AS id, d.text AS t, coalesce(len(list_distinct(regexp_extract_all(p.html, 'href="/([^"]*)"', 1))), 0) AS n_links FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id"""
LINKED_SQL = f"WITH {score_ctes(_LINKED, 'n_links')} SELECT a.*, round(scored.score, 6) AS score, scored.verdict FROM (SELECT id AS doc_id, {rounded(GROUPS['informational'])} FROM f) a JOIN scored ON scored.id = a.doc_id"


# ---- selectors, sessions, label log, embeddings -----------------------------------------------------------

PROBED = ["a[href^='/']", "p", "nav a", "nav > ul > li > a", "div.ad", "article p", "footer *, h1", "main"]


def selector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What some selectors find in the pages."""
    return selectors.probe(read(spark, sf_dir, "pages"), PROBED).select("selector", "n_pages", "n_nodes")


def _selector_sql() -> str:
    bare = r"regexp_replace(coalesce(html, ''), '<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'gs')"
    inside = lambda tag: f"regexp_extract(h, '<{tag}[ >].*?</{tag}>', 0, 's')"
    count = lambda text, pattern: f"len(regexp_extract_all({text}, '{pattern}'))"
    parts = {
        "a[href^='/']": count("h", '<a [^>]*href="/'), "p": count("h", "<p[ >]"), "nav a": count(inside("nav"), "<a[ >]"), "nav > ul > li > a": count(inside("nav"), "<a[ >]"), "div.ad": count("h", '<div class="ad"'),
        "article p": count(inside("article"), "<p[ >]"), "footer *, h1": f"{count(inside('footer'), '<[a-z]')} - {count('h', '<footer[ >]')} + {count('h', '<h1[ >]')}", "main": count("h", "<main[ >]"),
    }
    rows = " UNION ALL ".join(f"""SELECT '{s.replace("'", "''")}' AS selector, {n} AS n FROM bare""" for s, n in parts.items())
    return f"WITH bare AS (SELECT {bare} AS h FROM pages), found AS ({rows}) SELECT selector, count(*) FILTER (WHERE n > 0) AS n_pages, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_nodes FROM found GROUP BY selector"


def feed_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events as readings of a feed: a user's session, seven elements, failures where an event is an error, a reset where it is a signup of high value."""
    e = read(spark, sf_dir, "events") if events is None else events
    fails = (F.col("event_type") == "error") | (F.col("value") < 20)
    return e.select(
        F.col("user_id").cast("string").alias("session_id"), (F.col("event_id") % 7).cast("string").alias("element_id"), F.col("event_id").cast("long").alias("tick"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("urn:"), F.floor(F.col("value") / 40).cast("string"))).alias("urn"),
        F.when(~fails, F.concat(F.lit("post:"), F.floor(F.col("value") / 40).cast("string"))).alias("post_id"), (F.col("event_type") != "click").alias("id_is_stable"),
        F.lit(None).cast("string").alias("text"), F.when((F.col("event_type") == "signup") & (F.col("value") > 150), "reset").alias("kind"),
    )


def feed_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every event, read as a stream with state by session."""
    folder = shared_folder(spark, "sessions")
    stream = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    feed.run_to_end(sessions.outcomes(feed_events(spark, sf_dir, stream)), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(sessions.OUT).parquet(f"{folder}/out").select("session_id", "element_id", "tick", "outcome", "post_id")


def feed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many readings had each outcome, by session."""
    return sessions.counted(feed_replay(spark, sf_dir), "session_id")


#: The element's rules as a recursion over its readings: f failures, fu the failed urn, l the last id.
FEED_SQL = """WITH RECURSIVE event AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(event_id % 7 AS VARCHAR) AS element_id, event_id AS tick,
    CASE WHEN event_type = 'view' THEN 'urn:' || CAST(floor(value / 40) AS BIGINT) END AS urn,
    CASE WHEN NOT (event_type = 'error' OR value < 20) THEN 'post:' || CAST(floor(value / 40) AS BIGINT) END AS post_id,
    event_type <> 'click' AS stable, event_type = 'signup' AND value > 150 AS reset FROM events
), reading AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, era, element_id ORDER BY tick) AS pos
  FROM (SELECT *, count(*) FILTER (WHERE reset) OVER (PARTITION BY session_id ORDER BY tick) AS era FROM event) WHERE NOT reset
), step AS (
  SELECT session_id, era, element_id, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS tick, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS post_id, 0 AS f, CAST(NULL AS VARCHAR) AS fu, CAST(NULL AS VARCHAR) AS l
  FROM reading WHERE pos = 1
  UNION ALL
  SELECT session_id, era, element_id, pos, tick,
    CASE WHEN same THEN CASE WHEN f0 >= 6 THEN 'given_up' ELSE 'duplicate' END WHEN spent THEN 'given_up' WHEN post_id IS NULL THEN CASE WHEN f1 + 1 = 6 THEN 'skipped' ELSE 'retrying' END
      WHEN again THEN 'duplicate' ELSE 'post' END,
    post_id, CASE WHEN same OR spent THEN f0 WHEN post_id IS NULL THEN f1 + 1 ELSE 0 END,
    CASE WHEN same OR spent THEN fu0 WHEN post_id IS NULL THEN coalesce(urn, fu1) END,
    CASE WHEN same OR spent OR post_id IS NULL OR again THEN l0 ELSE post_id END
  FROM (
    SELECT r.session_id, r.era, r.element_id, r.pos, r.tick, r.post_id, r.urn, s.f AS f0, s.fu AS fu0, s.l AS l0,
      coalesce(r.urn = s.l, false) AS same, s.f >= 6 AND (r.urn IS NULL OR coalesce(r.urn = s.fu, false)) AS spent,
      CASE WHEN s.f >= 6 THEN 0 ELSE s.f END AS f1, CASE WHEN s.f >= 6 THEN NULL ELSE s.fu END AS fu1, coalesce(r.post_id = s.l, false) OR (s.l IS NOT NULL AND NOT r.stable) AS again
    FROM step s JOIN reading r ON r.session_id = s.session_id AND r.era = s.era AND r.element_id = s.element_id AND r.pos = s.pos + 1)
), told AS (
  SELECT session_id, element_id, tick, outcome, post_id FROM step WHERE pos > 0
  UNION ALL SELECT session_id, element_id, tick, 'reset', NULL FROM event WHERE reset
)"""
FEED_COUNTERS_SQL = FEED_SQL + " SELECT session_id, count(*) AS seen, " + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in sessions.OUTCOMES) + " FROM told GROUP BY session_id"


def label_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels written, some taken back, some of these rated again, the log compacted, others rated at an earlier time."""
    path = shared_folder(spark, "labels")
    one = _labels(spark, sf_dir).where("rating is not null").select(F.col("doc_id").cast("string").alias("postId"), "rating", F.lit("2026-01-02T00:00:00Z").alias("at"))
    number = F.col("postId").cast("long")
    stores.save_labels(one, path)
    stores.remove_labels(spark, path, one.where(number % 3 == 0).select("postId"))
    stores.save_labels(one.where(number % 6 == 0).withColumn("rating", F.lit(2)), path)
    stores.compact_labels(spark, path)
    stores.save_labels(one.where(number % 5 == 0).withColumns({"rating": F.lit(4), "at": F.lit("2026-01-01T00:00:00Z")}), path)
    return stores.read_labels(spark, path).select("postId", "rating", "at")


LABEL_LOG_SQL = f"""WITH one AS (SELECT doc_id, rating FROM ({_RATING_SQL}) WHERE rating IS NOT NULL)
SELECT CAST(doc_id AS VARCHAR) AS postId, CASE WHEN doc_id % 6 = 0 THEN 2 WHEN doc_id % 3 = 0 THEN 4 ELSE rating END AS rating,
  CASE WHEN doc_id % 3 = 0 AND doc_id % 6 <> 0 THEN '2026-01-01T00:00:00Z' ELSE '2026-01-02T00:00:00Z' END AS at
FROM one WHERE doc_id % 3 <> 0 OR doc_id % 6 = 0 OR doc_id % 5 = 0"""


FOLDS = 5


def fold_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each fold's model, the gradient of its first step: by feature, over all labelled rows outside the fold."""
    rows = fitting.fold_rows(_judged(spark, sf_dir), F.pmod(F.col("doc_id"), F.lit(FOLDS)))
    sums = fitting.fold_sums(rows, np.zeros((FOLDS, len(L.KEYS) + 1)))
    names = F.array(*map(F.lit, [*L.KEYS, "bias"]))
    each = sums.select("model", F.col("n").cast("long").alias("n"), F.posexplode("gradient").alias("at", "gradient"))
    return each.select("model", "n", F.get(names, F.col("at")).alias("feature"), (F.round("gradient", 4) + 0.0).alias("gradient"))


def _fold_sql() -> str:
    one = " UNION ALL ".join(f"SELECT {k} AS model, '{f}' AS feature, count(*) AS n, sum((0.5 - CASE WHEN label = 'red' THEN 1 ELSE 0 END) * {f if f != 'bias' else '1.0'}) AS g FROM judged WHERE label IS NOT NULL AND id % {FOLDS} <> {k}" for k in range(FOLDS) for f in [*L.KEYS, "bias"])
    return f"WITH {_JUDGED_CTE} SELECT model, n, feature, round(g, 4) + CAST(0 AS DOUBLE) AS gradient FROM ({one})"


def out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The odds of a low rating for every labelled document, by the model of the folds that it isn't in."""
    judged = cut(_judged(spark, sf_dir).select("doc_id", "label", *L.KEYS))
    fold = F.pmod(F.col("doc_id"), F.lit(FOLDS))
    weights = fitting.fit_folds(cut(fitting.fold_rows(judged, fold)), FOLDS)
    return fitting.out_of_fold(judged, weights, "doc_id", fold).select("doc_id", "fold", "label", r6("probability"))


def embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 50: rows of cosine 0.9 or more, and the nearest, against all rows."""
    vectors = read(spark, sf_dir, "embeddings")
    out = similar.neighbours(vectors.where("vec_id % 50 = 0"), vectors)
    return out.select("query_id", "n_near", "nearest_id", F.round("nearest", 4).alias("nearest"))


_COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
NEIGHBOURS_SQL = f"""SELECT a.vec_id AS query_id, count(*) FILTER (WHERE {_COSINE} >= 0.9) AS n_near, arg_max(b.vec_id, {_COSINE}) AS nearest_id, round(max({_COSINE}), 4) AS nearest
FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY a.vec_id"""


def embedding_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.embedding_classes(read(spark, sf_dir, "embeddings"))


CLASSES_SQL = f"""WITH RECURSIVE link AS (SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND {_COSINE} >= 0.9),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT reach.u, link.v FROM reach JOIN link ON link.u = reach.v)
SELECT r.u AS vec_id, min(r.v) AS component_id, any_value(n.n) AS n_copies FROM reach r JOIN embeddings e ON e.vec_id = r.u JOIN (SELECT embedding, count(*) AS n FROM embeddings GROUP BY 1) n ON n.embedding = e.embedding GROUP BY r.u"""


def embedding_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cell index finds of the links of the vectors whose id is divisible by 50, against all rows."""
    return similar.measured_recall(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "text_stats": text_stats,
    "structural_features": _group("structural"),
    "linguistic_features": _group("linguistic"),
    "informational_features": _group("informational"),
    "bait_features": _group("engagementBait"),
    "matched_phrases": matched,
    "score_documents": score_documents,
    "top_signals": top_signals,
    "feature_signals": feature_signals,
    "summaries": summaries,
    "verdict_by_lang": verdict_by_lang,
    "score_benchmark": score_benchmark,
    "score_conversations": score_conversations,
    "normalize_documents": normalize_documents,
    "content_filter": content_filter,
    "post_ids": post_ids,
    "dedup_posts": dedup_posts,
    "label_stats": label_stats,
    "label_shares": label_shares,
    "fire_rates": fire_rates,
    "silent_features": silent_features,
    "class_means": class_means,
    "accuracy": accuracy,
    "feature_corr": feature_corr,
    "bias_sweep": bias_sweep,
    "page_blocks": page_blocks,
    "page_links": page_links,
    "page_posts": page_posts,
    "label_upsert": label_upsert,
    "label_lines": label_lines,
    "cached_scores": cached_scores,
    "stream_dedup": stream_dedup,
    "extracted_posts": extracted,
    "linked_features": linked_features,
    "selector_counts": selector_counts,
    "feed_replay": feed_replay,
    "feed_counters": feed_counters,
    "label_log": label_log,
    "embedding_neighbours": embedding_neighbours,
    "embedding_classes": embedding_classes,
    "embedding_recall": embedding_recall,
    "fold_gradients": fold_gradients,
    "out_of_fold": out_of_fold,
}

ORACLES: dict[str, str] = {
    "text_stats": TEXT_STATS_SQL,
    "structural_features": _group_sql("structural"),
    "linguistic_features": _group_sql("linguistic"),
    "informational_features": _group_sql("informational"),
    "bait_features": _group_sql("engagementBait"),
    "matched_phrases": _matched_sql(),
    "score_documents": SCORE_SQL,
    "top_signals": TOP_SQL,
    "feature_signals": _feature_signals_sql(),
    "summaries": SUMMARY_SQL,
    "verdict_by_lang": BY_LANG_SQL,
    "score_benchmark": f"WITH {score_ctes('SELECT item_id AS id, text AS t FROM benchmark')} SELECT id AS item_id, {rounded(['score'])}, verdict FROM scored",
    "score_conversations": f"WITH {score_ctes('SELECT conv_id * 100000 + turn AS id, text AS t FROM conversations')} SELECT role, verdict, count(*) AS n, round(avg(score), 6) AS mean_score FROM scored JOIN conversations ON conv_id * 100000 + turn = id GROUP BY role, verdict",
    "normalize_documents": NORMAL_SQL,
    "content_filter": CONTENT_SQL,
    "post_ids": POST_ID_SQL,
    "dedup_posts": DEDUP_SQL,
    "label_stats": LABEL_STATS_SQL,
    "label_shares": _label_shares_sql(),
    "fire_rates": FIRE_SQL,
    "silent_features": SILENT_SQL,
    "class_means": CLASS_SQL,
    "accuracy": ACCURACY_SQL,
    "feature_corr": CORR_SQL,
    "bias_sweep": _bias_sql(),
    "label_upsert": f"SELECT CAST(doc_id AS VARCHAR) AS postId, CASE WHEN rating IN (3, 5) THEN 5 ELSE rating END AS rating, CASE WHEN rating IN (3, 5) THEN '2026-01-02T00:00:00Z' ELSE '2026-01-01T00:00:00Z' END AS at FROM ({_RATING_SQL})",
    "label_lines": f"""SELECT '{{"postId":"' || doc_id || '","rating":' || coalesce(CAST(rating AS VARCHAR), 'null') || ',"note":null}}' AS line FROM ({_RATING_SQL})""",
    "cached_scores": f"WITH {_id_cte(chr(39) * 2)}, ids AS (SELECT 'hash:' || coalesce(nullif(ltrim(array_to_string(d, ''), '0'), ''), '0') AS post_id, min(text) AS text FROM digits JOIN documents USING (doc_id) GROUP BY 1), {score_ctes('SELECT post_id AS id, text AS t FROM ids')} SELECT id AS post_id, {rounded(['score'])}, verdict FROM scored",
    "extracted_posts": EXTRACTED_SQL,
    "linked_features": LINKED_SQL,
    "selector_counts": _selector_sql(),
    "feed_replay": FEED_SQL + " SELECT * FROM told",
    "feed_counters": FEED_COUNTERS_SQL,
    "label_log": LABEL_LOG_SQL,
    "embedding_neighbours": NEIGHBOURS_SQL,
    "embedding_classes": CLASSES_SQL,
    "fold_gradients": _fold_sql(),
    "stream_dedup": f"WITH {_id_cte(chr(39) * 2)} SELECT DISTINCT 'hash:' || coalesce(nullif(ltrim(array_to_string(d, ''), '0'), ''), '0') AS post_id FROM digits",
}
