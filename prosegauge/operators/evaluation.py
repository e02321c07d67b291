"""Aggregates over scored and labelled posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..plans.spec import RULES, ScoringSpec

ORDINAL = {"green": 0, "yellow": 1, "red": 2}


def rating_to_verdict(rating: Column) -> Column:
    """1 and 2 are green, 4 and 5 red, 3 yellow; null or outside the scale: null."""
    return F.when(rating.between(1, 2), "green").when(rating == 3, "yellow").when(rating.between(4, 5), "red")


def ordinal(verdict: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, n in ORDINAL.items():
        out = F.when(verdict == k, n).otherwise(out)
    return out


def label_stats(labels: DataFrame) -> DataFrame:
    """One row: total, counts by class (from the rating, not the stored label) and by rating, disagreements, agreement (null if none)."""
    v = rating_to_verdict(F.col("rating"))
    wrong = F.count_if(v != F.col("predicted"))
    total = F.count("*")
    return labels.agg(
        total.alias("total"),
        *(F.count_if(v == k).alias(k) for k in ORDINAL),
        *(F.count_if(F.col("rating") == r).alias(f"rating_{r}") for r, _, _ in L.RATINGS),
        wrong.alias("disagreements"),
        ((total - wrong) / F.nullif(total, F.lit(0))).alias("agreement"),
    )


def label_shares(labels: DataFrame, goal: int = 400) -> DataFrame:
    """A row for each rating on the scale: count, share in percent, height against the tallest, progress to the goal."""
    spark = labels.sparkSession
    scale = spark.createDataFrame(L.RATINGS, "rating int, label string, hint string")
    counted = labels.groupBy("rating").agg(F.count("*").alias("n"))
    out = scale.join(counted, "rating", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = out.agg(F.sum("n").alias("_all"), F.max("n").alias("_most")).withColumn("_k", F.lit(1))
    out = out.withColumn("_k", F.lit(1)).join(F.broadcast(sums), "_k")  # one row
    part = lambda d: F.when(d == 0, 0.0).otherwise(F.col("n") / F.nullif(d, F.lit(0)))
    return out.select("rating", "label", "hint", "n", (100 * part(F.col("_all"))).alias("percent"), part(F.col("_most")).alias("height"), F.least(F.lit(1.0), F.col("_all") / goal).alias("progress"))


def unpivoted(features: DataFrame, *keep: str) -> DataFrame:
    """keep columns, key, value: a row for each feature."""
    return features.unpivot(list(keep), L.KEYS, "key", "value")


def fire_rates(features: DataFrame, floor: float = 0.42) -> DataFrame:
    """key, rate (share of rows at or above the floor), mean. One pass over wide rows; only one row is turned."""
    wide = features.agg(*(F.avg((F.col(k) >= floor).cast("double")).alias(f"r_{k}") for k in L.KEYS), *(F.avg(k).alias(f"m_{k}") for k in L.KEYS))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"r_{k}").alias("rate"), F.col(f"m_{k}").alias("mean")) for k in L.KEYS))).alias("x")).select("x.*")


def silent_features(features: DataFrame, floor: float = 0.42) -> DataFrame:
    """Features, neutral ones aside, that no row reaches the floor in."""
    told = [f[0] for f in L.FEATURES if f[2] != "neutral"]
    return fire_rates(features, floor).where(F.col("key").isin(told) & (F.coalesce("rate", F.lit(0.0)) == 0)).select("key")


def class_means(features: DataFrame, by: str) -> DataFrame:
    """Mean of every feature for each class."""
    return features.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(k).alias(k) for k in L.KEYS))


def accuracy(judged: DataFrame) -> DataFrame:
    """One row over columns label, verdict, score: share exact, count of inversions (green for red or red for green), worst red and best green scores."""
    gap = F.abs(ordinal(F.col("label")) - ordinal(F.col("verdict")))
    return judged.agg(
        F.count("*").alias("n"),
        F.avg((gap == 0).cast("double")).alias("exact"),
        F.count_if(gap == 2).alias("inversions"),
        F.min(F.when(F.col("label") == "red", F.col("score"))).alias("least_red"),
        F.max(F.when(F.col("label") == "green", F.col("score"))).alias("most_green"),
    )


def feature_correlation(features: DataFrame, a: str, b: str) -> DataFrame:
    return features.agg(F.corr(a, b).alias("r"))


def bias_sweep(judged: DataFrame, biases: list[float], spec: ScoringSpec = RULES) -> DataFrame:
    """bias, n, exact for each bias of a fixed grid, over features and label: one pass, one row turned."""
    from dataclasses import replace

    from .scoring import damped, logistic, verdict, weighted_sum

    hits = []
    for i, b in enumerate(biases):
        s = replace(spec, bias=b)
        hits.append(F.avg((verdict(damped(logistic(weighted_sum(s), s), s), s) == F.col("label")).cast("double")).alias(f"b{i}"))
    wide = judged.agg(F.count("*").alias("n"), *hits)
    return wide.select("n", F.explode(F.array(*(F.struct(F.lit(float(b)).alias("bias"), F.col(f"b{i}").alias("exact")) for i, b in enumerate(biases)))).alias("x")).select("x.bias", "n", "x.exact")


def verdict_counts(scored: DataFrame, *by: str) -> DataFrame:
    """Running tally: rows and mean score for each verdict (and group)."""
    return scored.groupBy(*by, "verdict").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


def median(values: str) -> Column:
    """Median rounded half up, 0 for no rows."""
    return F.coalesce(F.floor(F.percentile(values, 0.5) + 0.5), F.lit(0))


#: Items that a quantile sketch keeps at its base; its rank error is about 1.33 % at 200.
SKETCH = 200


def sketched(rows: DataFrame, value: str, *by: str, size: int = SKETCH) -> DataFrame:
    """by, sketch: a mergeable quantile sketch of a column, so that a batch's numbers can be kept without its rows."""
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("sketch"))


def merged_quantiles(sketches: DataFrame, shares: tuple[float, ...] = (0.5,), *by: str) -> DataFrame:
    """by, n, and q50 (or other hundredths) of all batches together, from their sketches alone."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("_s"))
    named = [F.kll_sketch_get_quantile_double("_s", F.lit(float(q))).alias(f"q{round(100 * q)}") for q in shares]
    return merged.select(*by, F.kll_sketch_get_n_double("_s").alias("n"), *named)
