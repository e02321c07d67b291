"""Normalisation, content filters and post ids."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import StringType

from ..functions import lexicons as L
from ..functions import text as T

LEAST, MOST = 12, 6000
_FLAT = "[" + T.SPACES.replace("\n", "").replace("\r", "") + "]"


@arrow_udf(StringType())
def nfc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Unicode composition, for which Spark has no function. Texts become Python's some at a time, and only where one isn't ASCII."""
    for texts in batches:
        plain = pc.fill_null(pc.string_is_ascii(texts), True)
        out = []
        for at in range(0, len(texts), 256):
            part = texts.slice(at, 256)
            if not pc.all(plain.slice(at, 256)).as_py():
                part = pa.array([x if x is None else unicodedata.normalize("NFC", x) for x in part.to_pylist()], texts.type)
            out.append(part)
        yield pa.concat_arrays(out) if out else texts


def normalized(composed: Column) -> Column:
    """A text already composed: invisible signs out, line ends as \\n, runs of blanks one space, at most one empty line, lines trimmed."""
    x = F.regexp_replace(composed, L.INVISIBLE, "")
    x = F.regexp_replace(x, "\r\n?", "\n")
    x = F.regexp_replace(x, f"{_FLAT}+", " ")
    x = F.regexp_replace(x, " ?\n ?", "\n")
    return T.trim(F.regexp_replace(x, "\n{3,}", "\n\n"))


def strip_see_more(x: Column) -> Column:
    """The text without a trailing "… see more"."""
    return F.rtrim(F.regexp_replace(x, rf"(?i)(?:…|\.\.\.){T.SPACE}*(?:see{T.SPACE}+)?more{T.SPACE}*\z", ""), F.lit(T.SPACES))


def normalize(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with text_col normalised and truncated (whether a "see more" was cut off). Null text stays null, truncated then false.

    Composition alone runs in Python, in Arrow batches; ASCII texts pass through it untouched.
    """
    raw = F.col(text_col).cast("string")
    out = df.withColumn("_n", normalized(nfc(raw)))
    out = out.withColumn("_s", strip_see_more(F.col("_n")))
    return out.withColumns({text_col: F.col("_s"), "truncated": F.coalesce(F.length("_s") != F.length("_n"), F.lit(False))}).drop("_n", "_s")


def looks_like_byline(x: Column) -> Column:
    """One line of three or more short segments between bars, without a sentence."""
    parts = F.split(x, r"\|")
    brief = F.forall(parts, lambda p: F.size(F.split(T.trim(p), f"{T.SPACE}+")) <= 8)
    return ~F.contains(x, F.lit("\n")) & (F.size(parts) >= 3) & ~x.rlike(rf"[.!?]{T.SPACE}") & brief


def is_post_content(x: Column) -> Column:
    out = ~looks_like_byline(x)
    for p in L.NOT_A_POST:
        out = out & ~x.rlike(T.pattern(p))
    return out


def content_filter(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text is 12 to 6,000 UTF-16 units long and looks like a post; null texts go."""
    x = F.col(text_col)
    n = T.utf16_length(x)
    return df.where(n.between(LEAST, MOST) & is_post_content(x))


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, in base 36."""
    units = F.encode(x, "UTF-16BE")
    unit = lambda h, i: F.conv(F.substring(h, i * 4 + 1, 4), 16, 10).cast("bigint")

    def fold(h: Column) -> Column:
        n = (F.length(h) / 4).cast("int")
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(2166136261).cast("bigint"), lambda s, i: (s.bitwiseXOR(unit(h, i)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))

    return F.lower(F.conv(T.bind(F.hex(units), fold).cast("string"), 10, 36))


def first_units(x: Column, n: int = 200) -> Column:
    """The first n UTF-16 units; a pair cut in half keeps neither unit's meaning, as in the source."""
    return F.when(F.length(x) == T.utf16_length(x), F.substring(x, 1, n)).otherwise(F.decode(F.substring(F.encode(x, "UTF-16BE"), 1, 2 * n), "UTF-16BE"))


def post_id(df: DataFrame, text_col: str = "text", author_col: str | None = None, urn_col: str | None = None) -> DataFrame:
    """df with post_id and id_is_stable: the urn where there is one, else a hash of author and the text's beginning."""
    author = F.coalesce(F.col(author_col).cast("string"), F.lit("")) if author_col else F.lit("")
    hashed = F.concat(F.lit("hash:"), fnv1a(F.concat(author, F.lit("\0"), first_units(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))))
    urn = F.col(urn_col) if urn_col else F.lit(None).cast("string")
    return df.withColumns({"post_id": F.when(F.length(urn) > 0, urn).otherwise(hashed), "id_is_stable": F.coalesce(F.length(urn) > 0, F.lit(False))})


def distinct_posts(df: DataFrame, order_col: str) -> DataFrame:
    """One row for each post_id: the first by order_col. A map-side minimum, then one shuffle of what is left."""
    rest = [c for c in df.columns if c != "post_id"]
    return df.groupBy("post_id").agg(F.min_by(F.struct(*rest), F.col(order_col)).alias("_r")).select("post_id", "_r.*").select(df.columns)
