"""The 27 features of a post's text, as Column expressions over one staged projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

#: What a text, lower-cased, contains at least if a pattern of the lists matches it.
ANTITHESIS_PARTS = [["s not "], ["not just ", "not only "], ["stop "], ["don't ", "dont "], ["this isn"], [" isn"]]
PRESCRIPTIVE_PARTS = [["you should", "you must", "you need to", "you have to", "you ought to"], ["never ", "always "], ["stop "], ["start "], ["here's how to", "here is how to"]]
#: Places that can't start a name are passed over before the pattern looks behind them.
CAPITALS = "(?=[A-Z])" + T.pattern(L.CAPITALS)
SHOUTED = r"(?:^|[^\p{L}])(?:\p{Lu}{5,}|" + "|".join(L.SHOUTED_WORDS) + r")(?:[^\p{L}]|\z)"


def _shouts(line: Column) -> Column:
    loud_end = line.rlike(r"[!?]{2}[^\p{L}\p{N}]*\z")
    return loud_end | T.is_shouted(line) | (line.rlike(r"\p{Lu}{3}") & line.rlike(r"\p{Ll}") & line.rlike(SHOUTED))


def _line_facts(lines: Column) -> Column:
    return F.transform(
        lines,
        lambda x: F.struct(
            T.utf16_length(x).cast("double").alias("n"),
            T.starts_with_bullet(x).alias("bullet"),
            (F.regexp_count(x, F.lit("[.!?]")) <= 1).alias("single"),
            _shouts(x).alias("shouts"),
        ),
    )


def _entities(sentence: Column) -> Column:
    """Named things in a sentence; its opening word counts only if it is more than a capitalised word."""
    runs = F.regexp_extract_all(sentence, F.lit(CAPITALS), F.lit(0))
    named = F.filter(runs, lambda r: ~F.startswith(sentence, r) | T.trim(r).rlike(T.SPACE) | r.rlike(r"[A-Z]{2,}|\d"))
    return F.when(T.is_shouted(sentence), 0).otherwise(F.size(named))


def _sentence_facts(sentences: Column) -> Column:
    return F.transform(sentences, lambda x: F.struct(T.plain_word_count(x).cast("double").alias("n"), _entities(x).alias("entities")))


def _numbers(raw: Column) -> Column:
    bare = F.transform(F.filter(raw, lambda x: x.rlike(r"\d")), lambda x: F.regexp_replace(T.trim(x), rf"^{T.SPACE}*\d{{1,2}}[.)]{T.SPACE}+", ""))
    return F.aggregate(F.transform(bare, lambda x: F.regexp_count(x, F.lit(T.pattern(L.NUMBER)))), F.lit(0), lambda s, x: s + x)


def _tricolon(counts: Column) -> Column:
    def step(s: Column, c: Column) -> Column:
        short = (c >= 1) & (c <= 7)
        run = F.when(short & ((s["run"] == 0) | (F.abs(c - s["last"]) <= 3)), s["run"] + 1).when(short, 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(s["best"], run).alias("best"), c.alias("last"))

    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0.0).alias("last"))
    best = F.aggregate(counts, start, step, lambda s: s["best"])
    return T.bind(best, lambda b: F.when(b < 3, 0.0).otherwise(T.clamp01(0.6 + (b - 3) * 0.2)))


def _hook(text: Column, raw: Column, lines: Column) -> Column:
    at = F.array_position(F.transform(raw, lambda x: T.trim(x) != ""), True)
    blank_next = F.coalesce(T.trim(F.get(raw, at.cast("int"))) == "", F.lit(False))
    first = F.get(lines, 0)
    n = T.utf16_length(first)
    score = 0.5 + F.when(n <= 60, 0.2).otherwise(0.0) + F.when(n <= 30, 0.2).otherwise(0.0) + F.when(first.rlike(r"[?:.]\z") | (T.count_emoji(first) > 0), 0.1).otherwise(0.0)
    return F.when((F.size(lines) >= 2) & blank_next, T.clamp01(score)).otherwise(0.0)


def _closing(lines: Column, lower: Column) -> Column:
    tail = F.array_join(F.slice(lines, F.greatest(F.size(lines) - 1, F.lit(1)), 2), " ")
    asks = lambda low: F.when(low.rlike(rf"[?]{T.SPACE}*\z"), 0.4).otherwise(0.0) + F.when(T.count_phrases(low, L.ENGAGEMENT_CTA) > 0, 0.5).otherwise(0.0)
    score = (
        T.bind(F.lower(tail), asks)
        + T.bind(tail, lambda x: F.when(T.count_emoji(x) > 0, 0.1).otherwise(0.0))
        + F.when(F.contains(lower, F.lit("#")) & lower.rlike(rf"(?:#\w++{T.SPACE}*+){{3}}\z"), 0.2).otherwise(0.0)
    )
    return F.when(F.size(lines) == 0, 0.0).otherwise(F.least(score, F.lit(1.0)))


def _share(facts: Column, name: str) -> Column:
    return T.ratio(F.size(F.filter(facts, lambda x: x[name])).cast("double"), F.size(facts))


def features(df: DataFrame, text_col: str = "text", links_col: str | None = None) -> DataFrame:
    """df with the 27 features (doubles in [0, 1]) and word_count (int).

    Null text counts as empty: every feature is 0. links_col is an array of links (null: none).
    Repeated rows are computed alike; columns of df with a feature's name are replaced; an empty
    table stays empty. Nothing is shuffled.
    """
    staged = T.analyze(df, text_col).withColumns({"_line": _line_facts(F.col("_lines")), "_sentence": _sentence_facts(F.col("_sentences")), "word_count": F.size("_words")})
    line_n, sentence_n = F.transform("_line", lambda x: x["n"]), F.transform("_sentence", lambda x: x["n"])
    lower, text, lines = F.col("_lower"), F.col("_text"), F.col("_lines")
    some_lines = F.size(lines) > 0
    w = F.greatest(F.col("word_count"), F.lit(1))
    per = lambda n, scale: T.saturate(n * 100.0 / w, scale)
    phrases = lambda names, scale: T.saturate(T.count_phrases(lower, names), scale)
    even = lambda values, scale: F.when(F.size(values) >= 3, T.clamp01(1 - T.saturate(T.std_dev(values), scale))).otherwise(0.0)
    count = lambda p: F.regexp_count(text, F.lit(p))
    first = F.size(F.filter("_words", lambda x: x.isin("i", "my", "me", "mine")))
    second = F.size(F.filter("_words", lambda x: x.isin("you", "your", "yours")))
    total = sum((T.where_any(lower, parts, count(T.pattern(p)), 0) for p, parts in zip(L.PRESCRIPTIVE, PRESCRIPTIVE_PARTS, strict=True)), F.lit(0))
    found = sum((T.where_any(lower, parts, text.rlike(T.pattern(p)), False).cast("int") for p, parts in zip(L.ANTITHESIS, ANTITHESIS_PARTS, strict=True)), F.lit(0))
    links = F.coalesce(F.size(F.col(links_col)), F.lit(0)) if links_col else F.lit(0)
    values = {
        "bulletLineRatio": _share(F.col("_line"), "bullet"),
        "emojiDensity": F.when(some_lines, T.saturate(T.count_emoji(text) * 100.0 / F.greatest(T.utf16_length(text), F.lit(1)), 1.5)).otherwise(0.0),
        "oneSentencePerLineRatio": _share(F.col("_line"), "single"),
        "shortLineRatio": T.ratio(F.size(F.filter("_line", lambda x: x["n"] < 40)).cast("double"), F.size("_line")),
        "hookPattern": _hook(text, F.col("_raw"), lines),
        "lineUniformity": even(line_n, 30),
        "shoutingRatio": _share(F.col("_line"), "shouts"),
        "hookOpeners": phrases(L.HOOK_OPENERS, 1.5),
        "hyperbole": phrases(L.HYPERBOLE, 1.5),
        "corporateFiller": phrases(L.CORPORATE_FILLER, 1.5),
        "llmTells": phrases(L.LLM_TELLS, 1.5),
        "emDashDensity": per(count("—"), 1.2),
        "antithesis": T.saturate(found, 1.2),
        "tricolon": _tricolon(sentence_n),
        "sentenceUniformity": even(sentence_n, 6),
        "numberDensity": per(_numbers(F.col("_raw")), 2.5),
        "entityDensity": per(F.aggregate("_sentence", F.lit(0), lambda s, x: s + x["entities"]), 4),
        "citationDensity": T.saturate(links, 1),
        "vagueness": phrases(L.VAGUE_QUANTIFIERS, 2),
        "firstPersonRatio": first / F.greatest(first + second, F.lit(1)),
        "prescriptiveness": per(total, 2),
        "ctaPhrases": phrases(L.ENGAGEMENT_CTA, 1.5),
        "authorityBait": phrases(L.AUTHORITY_BAIT, 1),
        "questionDensity": per(count(r"\?"), 3),
        "closingHook": _closing(lines, lower),
        "pointerEmoji": T.saturate(F.when(T.beyond_ascii(text), count(L.POINTER)).otherwise(0), 1),
        "hashtagDensity": T.saturate(count(r"#[\p{L}\p{N}_]+"), 3),
    }
    own = [c for c in df.columns if c not in values and c != "word_count"]
    return staged.select(*own, *(v.cast("double").alias(k) for k, v in values.items()), "word_count")


def feature_vector() -> Column:
    """The features in contract order as an array; missing values are 0."""
    return F.array(*(F.coalesce(F.col(k), F.lit(0.0)) for k in L.KEYS))


def matched_phrases(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with matched_phrases: the phrases found, list by list (vague quantifiers are left out)."""
    low = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    lists = [L.HOOK_OPENERS, L.HYPERBOLE, L.CORPORATE_FILLER, L.LLM_TELLS, L.ENGAGEMENT_CTA, L.AUTHORITY_BAIT]
    return df.withColumn("matched_phrases", T.bind(low, lambda x: F.concat(*(T.matching_phrases(x, p) for p in lists))))
