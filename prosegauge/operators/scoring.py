"""Score, verdict, confidence and ranked reasons from the features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import bind
from ..plans.spec import RULES, ScoringSpec
from .features import features

SIGNALS = "array<struct<key:string,label:string,weight:double>>"
_LABEL = {f[0]: f[3] for f in L.FEATURES}
_DIRECTION = {f[0]: f[2] for f in L.FEATURES}


Get = Callable[[str], Column]


def weighted_sum(spec: ScoringSpec = RULES, of: Get = F.col) -> Column:
    """Sum of the contributions in vector order."""
    out = F.lit(0.0)
    for k in L.KEYS:
        if spec.weights.get(k, 0):
            out = out + of(k) * spec.weights[k]
    return out


def logistic(total: Column, spec: ScoringSpec = RULES) -> Column:
    return 1 / (1 + F.exp(-spec.steepness * (total - spec.bias)))


def damped(score: Column, spec: ScoringSpec = RULES, of: Get = F.col) -> Column:
    """Short posts are drawn to the score of no evidence, unless they are bait beyond doubt."""
    overt = (of("ctaPhrases") > 0.5) & (of("closingHook") > 0.5)
    base = logistic(F.lit(0.0), spec)
    return F.when((of("word_count") < spec.least_words) & ~overt, base + (score - base) * (of("word_count") / spec.least_words)).otherwise(score)


def verdict(score: Column, spec: ScoringSpec = RULES) -> Column:
    return F.when(score >= spec.red, "red").when(score <= spec.green, "green").otherwise("yellow")


def confidence(score: Column, spec: ScoringSpec = RULES) -> Column:
    return F.least(F.lit(1.0), F.least(F.abs(score - spec.green), F.abs(score - spec.red)) / 0.25)


def uncertain(score: Column, spec: ScoringSpec = RULES) -> Column:
    return (F.abs(score - spec.green) < spec.margin) | (F.abs(score - spec.red) < spec.margin)


def _ranked(entries: list[Column], most: int) -> Column:
    """The first entries by (late, -rank, place), without those that are null; as key, label, weight."""
    kept = F.array_sort(F.filter(F.array(*entries), lambda e: e.isNotNull()))
    return F.transform(F.slice(kept, 1, most), lambda e: F.struct(e["key"].alias("key"), e["label"].alias("label"), e["weight"].alias("weight")))


def _entry(keep: Column, late: Column, rank: Column, place: int, key: str, weight: Column) -> Column:
    return F.when(keep, F.struct(late.alias("late"), (-rank).alias("rank"), F.lit(place).alias("place"), F.lit(key).alias("key"), F.lit(_LABEL[key]).alias("label"), weight.alias("weight")))


def signals(of: Get, said: Column, spec: ScoringSpec = RULES, most: int = 6) -> Column:
    """Contributions, those that explain the verdict first, the largest and most telling first."""
    out = []
    for i, k in enumerate(L.KEYS):
        w = spec.weights.get(k, 0.0)
        if w:
            part = of(k) * w
            leads = F.signum(part) == F.when(said == "green", -1.0).otherwise(1.0)
            out.append(_entry(of(k) != 0, F.when(leads, 0).otherwise(1), F.abs(part) * spec.informativeness(k), i, k, part))
    return _ranked(out, most)


def feature_signals(spec: ScoringSpec = RULES, floor: float = 0.42, most: int = 5) -> Column:
    """Unweighted reasons: features at or above the floor by value times informativeness; substance is negative."""

    def told(row: Column) -> Column:
        out = []
        for i, k in enumerate(L.KEYS):
            if _DIRECTION[k] != "neutral":
                v = row[k]
                out.append(_entry(v >= floor, F.lit(0), v * spec.informativeness(k), i, k, -v if _DIRECTION[k] == "quality" else v))
        return _ranked(out, most)

    return bind(F.struct(*L.KEYS), told)


def verdict_label(of: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, label in L.VERDICT_LABELS.items():
        out = F.when(of == k, label).otherwise(out)
    return out


def summary() -> Column:
    """One line of reason, from verdict and signals."""
    top = F.get(F.col("signals"), 0)
    substance = F.get(F.filter("signals", lambda s: s["weight"] < 0), 0)["label"]
    return (
        F.when(F.size("signals") == 0, "No strong signals")
        .when(F.col("verdict") == "green", F.coalesce(substance, F.lit("Specific and concrete")))
        .otherwise(F.when(top["weight"] > 0, top["label"]).otherwise("Mixed signals"))
    )


def classify(scored_features: DataFrame, spec: ScoringSpec = RULES, reasons: bool = True) -> DataFrame:
    """A table with the 27 features and word_count, with score, verdict, confidence, uncertain, signals, source.

    reasons=False leaves signals out: they are most of the work beyond the features, and stand in one
    expression with the verdict, where a reader who doesn't want them can't prune them.
    """

    def judge(row: Column) -> Column:
        of = lambda k: row[k]

        def told(total: Column) -> Column:
            why = lambda v: [signals(of, v, spec).alias("signals")] if reasons else []
            return bind(verdict(total, spec), lambda v: F.struct(total.alias("score"), v.alias("verdict"), confidence(total, spec).alias("confidence"), uncertain(total, spec).alias("uncertain"), *why(v)))

        return bind(damped(bind(weighted_sum(spec, of), lambda t: logistic(t, spec)), spec, of), told)

    # one expression that holds each feature once: filters on what comes out can be pushed down without repeating it many times
    own = [c for c in scored_features.columns if c not in ("score", "verdict", "confidence", "uncertain", "signals", "source")]
    return scored_features.withColumn("_judged", bind(F.struct(*L.KEYS, "word_count"), judge)).select(*own, "_judged.*", F.lit("rules").alias("source"))


def score(df: DataFrame, text_col: str = "text", links_col: str | None = None, spec: ScoringSpec = RULES, reasons: bool = True) -> DataFrame:
    """df with features, score and (unless reasons=False) signals. Null and empty texts have no words and score the damped base; see features()."""
    return classify(features(df, text_col, links_col), spec, reasons)
