"""From pages to posts ready to be scored: discovery, choice of text, normalisation, filters, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .content import content_filter, normalize, post_id
from .pages import LEAST_GAIN, find_posts

_MORE = rf"(?i)(?:…|\.\.\.)\s*(?:see\s*)?more\s*\z"


def squashed(x: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return T.trim(F.regexp_replace(x, f"{T.SPACE}+", " "))


def hidden_char_count(rendered: Column, markup: Column) -> Column:
    """By how many characters the markup's text is longer than what was rendered."""
    return T.utf16_length(squashed(markup)) - T.utf16_length(squashed(rendered))


def recovers_hidden_tail(rendered: Column, markup: Column, least_gain: int = LEAST_GAIN) -> Column:
    """Whether markup holds more of the text than what was rendered, from the same beginning."""
    whole, seen = squashed(F.coalesce(markup, F.lit(""))), T.trim(F.regexp_replace(squashed(F.coalesce(rendered, F.lit(""))), _MORE, ""))
    return F.when(seen == "", whole != "").otherwise((T.utf16_length(whole) - T.utf16_length(seen) >= least_gain) & whole.startswith(seen))


def best_text(df: DataFrame, rendered_col: str, markup_col: str) -> DataFrame:
    """df with raw_text (the markup's text where it has more, or where nothing was rendered), hidden_chars and recovered."""
    a, b = F.coalesce(F.col(rendered_col), F.lit("")), F.coalesce(F.col(markup_col), F.lit(""))
    more = recovers_hidden_tail(a, b)
    return df.withColumns({"raw_text": F.when(more | (T.trim(a) == ""), b).otherwise(a), "hidden_chars": hidden_char_count(a, b), "recovered": more})


def posts_from_raw(raw: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Raw posts (raw_text; author, urn if there are) as posts: text, truncated, post_id, id_is_stable; those that are no posts go.

    A row without a body goes; text is normalised and freed of its "see more"; posts shorter or longer than a
    post can be, bylines and page furniture go. Repeated rows stay; an empty table stays empty.
    """
    rest = raw.where(F.col(text_col).isNotNull()).withColumn("text", F.col(text_col))
    kept = content_filter(normalize(rest))
    has = lambda c: c if c in raw.columns else None
    return post_id(kept, "text", has("author"), has("urn"))


def extract_posts(pages: DataFrame) -> DataFrame:
    """page_id, url, post_id, id_is_stable, text, raw_text, author, truncated, links, has_media, is_reshare of every post on the pages."""
    posts = posts_from_raw(find_posts(pages))
    return posts.select("page_id", "url", "post_id", "id_is_stable", "text", "raw_text", "author", "truncated", "links", "has_media", "is_reshare")
