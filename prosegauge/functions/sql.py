"""SQL names for the text primitives, for queries written as SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import lexicons as L
from .text import SPACES


WORD = r"[\p{L}\p{N}]++(?:['’\-][\p{L}\p{N}]++)*+"


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"


#: name -> (parameters, result, body)
FUNCTIONS = {
    "utf16_length": ("x STRING", "INT", "CAST(octet_length(encode(x, 'UTF-16BE')) / 2 AS INT)"),
    "wide_trim": ("x STRING", "STRING", f"btrim(x, {_text(SPACES)})"),
    "emoji_count": ("x STRING", "INT", f"regexp_count(x, {_text(L.EMOJI)})"),
    "word_count": ("x STRING", "INT", f"regexp_count(lower(x), {_text(WORD)})"),
    "saturate": ("v DOUBLE, scale DOUBLE", "DOUBLE", "CASE WHEN v <= 0 THEN 0D ELSE 1 - exp(-v / scale) END"),
    "clamp01": ("v DOUBLE", "DOUBLE", "least(greatest(v, 0D), 1D)"),
    "safe_ratio": ("n DOUBLE, d DOUBLE", "DOUBLE", "CASE WHEN d = 0 THEN 0D ELSE n / nullif(d, 0D) END"),
    "rating_verdict": ("rating INT", "STRING", "CASE WHEN rating BETWEEN 1 AND 2 THEN 'green' WHEN rating = 3 THEN 'yellow' WHEN rating BETWEEN 4 AND 5 THEN 'red' END"),
    "score_verdict": ("score DOUBLE", "STRING", "CASE WHEN score >= 0.6D THEN 'red' WHEN score <= 0.28D THEN 'green' ELSE 'yellow' END"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session; returns their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
