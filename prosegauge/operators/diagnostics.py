"""What a set of pages looks like to post discovery: tiers, shapes, truncation, authors, a verdict on the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import median
from .extraction import best_text
from .pages import described, find_posts, list_candidates, list_items, node_table, ranked_lists, scopes

def tier_counts(pages: DataFrame, samples: int = 5) -> DataFrame:
    """For each discovery tier: pages, posts, posts without body or author, and a few sample ids."""
    posts = find_posts(pages)
    return posts.groupBy("tier").agg(
        F.countDistinct("page_id").alias("pages"),
        F.count("*").alias("posts"),
        F.count_if(F.col("raw_text").isNull()).alias("without_body"),
        F.count_if(F.col("author").isNull()).alias("without_author"),
        F.count_if("can_expand").alias("can_expand"),
        median("text_length").alias("median_length"),
        F.slice(F.array_sort(F.collect_set(F.when(F.col("post_index") == 0, F.col("page_id")))), 1, samples).alias("sample"),
    )


def shapes(pages: DataFrame, most: int = 6) -> DataFrame:
    """page_id, rank, items, total_chars, top_share, depth: the best list candidates of each page, `most` of them."""
    nodes = node_table(pages)
    e = described(nodes)
    ranked = ranked_lists(list_candidates(list_items(e, scopes(e)), e)).where(F.col("rank") <= most)
    return ranked.join(nodes.where("node = 0").select("_page", "page_id"), "_page").select("page_id", "rank", "items", "total_chars", "top_share", "depth")


def health(pages: DataFrame) -> DataFrame:
    """One row: pages, pages with posts, posts, posts with text, and a sentence on the first stage that fails."""
    posts = find_posts(pages)
    seen = pages.agg(F.count("*").alias("pages")).withColumn("_k", F.lit(1))
    found = posts.agg(F.countDistinct("page_id").alias("with_posts"), F.count("*").alias("posts"), F.count_if(F.col("raw_text").isNotNull()).alias("readable"), F.count_if(F.col("author").isNotNull()).alias("signed")).withColumn("_k", F.lit(1))
    said = (
        F.when(F.col("pages") == 0, "no pages")
        .when(F.col("posts") == 0, "no posts found: discovery fails or the pages have none")
        .when(F.col("readable") == 0, "posts found, none with a body: reading fails")
        .when(F.col("signed") == 0, "posts read, none with an author: author resolution fails")
        .otherwise("working")
    )
    return seen.join(F.broadcast(found), "_k").drop("_k").withColumn("verdict", said)  # one row each


def truncation(posts: DataFrame, rendered_col: str = "rendered", markup_col: str = "markup") -> DataFrame:
    """One row on how posts are cut short: posts, those whose text ends in "see more", those whose markup holds the tail, the median of hidden characters."""
    read = best_text(posts, rendered_col, markup_col)
    cut = F.coalesce(F.col(rendered_col).rlike(r"(?i)(?:…|\.\.\.)\s*(?:see\s*)?more\s*\z"), F.lit(False))
    return read.agg(F.count("*").alias("posts"), F.count_if(cut).alias("cut_short"), F.count_if("recovered").alias("recovered"), F.count_if(cut & ~F.col("recovered")).alias("needs_expanding"), median("hidden_chars").alias("median_hidden"))


def self_check(pages: DataFrame) -> DataFrame:
    """page_id, tier, posts, healthy: whether discovery found posts by cards, headings or a list rather than by guesses."""
    found = find_posts(pages).groupBy("page_id").agg(F.first("tier").alias("tier"), F.count("*").alias("posts"))
    return pages.select("page_id").distinct().join(found, "page_id", "left").select("page_id", "tier", F.coalesce("posts", F.lit(0)).alias("posts"), F.coalesce(F.col("tier").isin("cards", "headings", "structure"), F.lit(False)).alias("healthy"))
