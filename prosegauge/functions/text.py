"""Text primitives as Column expressions: lines, sentences, words, saturation, white space as browsers see it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as L

#: White space in the sense of the feed's scripting language.
SPACES = " \t\n\x0b\x0c\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = "[" + SPACES + "]"
START, STOP = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def pattern(template: str) -> str:
    """A pattern of lexicons.py for Spark's regular expressions."""
    return template.format(s=SPACE, b=START, e=STOP, p="+")


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once a row even where its column is inlined into a lambda."""
    return F.get(F.transform(F.array(value), then), 0)


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def utf16_length(x: Column) -> Column:
    units = (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")
    return F.when(F.octet_length(x) == F.length(x), F.length(x)).otherwise(units)


def where_any(lower: Column, parts: list[str], value: Column, rest: object) -> Column:
    """value where the lower-cased text contains one of these parts, without which a costlier search finds nothing; else rest."""
    some = F.contains(lower, F.lit(parts[0]))
    for p in parts[1:]:
        some = some | F.contains(lower, F.lit(p))
    return F.when(some, value).otherwise(rest)


def beyond_ascii(x: Column) -> Column:
    return F.octet_length(x) > F.length(x)


def split_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), trim), lambda x: x != "")


def split_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, rf"(?<=[.!?]){SPACE}+|\n+"), trim), lambda x: x != "")


def split_words(lower: Column) -> Column:
    return F.regexp_extract_all(lower, F.lit(r"[\p{L}\p{N}]++(?:['’\-][\p{L}\p{N}]++)*+"), F.lit(0))


def plain_word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"[\p{L}\p{N}]++"))


def count_phrases(lower: Column, phrases: list[str]) -> Column:
    """How many different phrases the text contains. Those that have a part in common are looked for where it stands."""
    out, rest = F.lit(0), list(phrases)
    while rest:
        own, part = max(((sum(part in p for p in rest), part) for part in sorted({p[k : k + 5] for p in rest for k in range(len(p) - 4)})), default=(0, ""), key=lambda x: x[0])
        group = [p for p in rest if part in p] if own > 1 else rest
        found = F.lit(0)
        for p in group:
            found = found + F.contains(lower, F.lit(p)).cast("int")
        out = out + (F.when(F.contains(lower, F.lit(part)), found).otherwise(0) if own > 1 else found)
        rest = [p for p in rest if p not in group]
    return out


def matching_phrases(lower: Column, phrases: list[str]) -> Column:
    """The phrases that the text contains, in the list's order. The list is only gone through where one is found."""
    listed = F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(lower, p))
    return F.when(count_phrases(lower, phrases) > 0, listed).otherwise(F.array().cast("array<string>"))


def count_emoji(x: Column) -> Column:
    return F.when(beyond_ascii(x), F.regexp_count(x, F.lit(L.EMOJI))).otherwise(0)


def starts_with_bullet(line: Column) -> Column:
    bare = [g for g in L.BULLET_GLYPHS if g not in L.SPACED_GLYPHS]
    return line.rlike("^(?:" + "|".join(bare) + "|[" + "".join(f"\\{g}" if g in "-*" else g for g in L.SPACED_GLYPHS) + "] )")


def mean(values: Column) -> Column:
    return bind(values, lambda v: F.when(F.size(v) == 0, 0.0).otherwise(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)))


def std_dev(values: Column) -> Column:
    """Population standard deviation of an array; 0 for fewer than two values."""

    def two_pass(v: Column) -> Column:
        return bind(F.struct(v.alias("v"), mean(v).alias("m")), lambda p: F.sqrt(F.aggregate(p["v"], F.lit(0.0), lambda s, x: s + (x - p["m"]) * (x - p["m"])) / F.size(p["v"])))

    return bind(values, lambda v: F.when(F.size(v) < 2, 0.0).otherwise(two_pass(v)))


def saturate(value: Column, scale: float) -> Column:
    """0 for no value, near 1 for a large one. The value, which may be a search of the text, is computed once."""
    return bind(value, lambda v: F.when(v <= 0, 0.0).otherwise(1 - F.exp(-v / scale)))


def clamp01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def ratio(n: Column, d: Column) -> Column:
    return F.when(d == 0, 0.0).otherwise(n / F.nullif(d, F.lit(0)))


def is_shouted(x: Column) -> Column:
    """Whether the letters of a text are four or more, none of them small. Most texts have an a to z, which tells at once."""
    return F.when(x.rlike("[a-z]"), False).otherwise(bind(F.regexp_replace(x, r"[^\p{L}]", ""), lambda letters: (utf16_length(letters) >= 4) & (letters == F.upper(letters))))


def analyze(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with _text, _lower, _raw, _lines, _sentences, _words. Null text counts as empty; names with an underscore are ours."""
    out = df.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    out = out.withColumn("_lower", F.lower("_text"))
    return out.withColumns({"_raw": F.split("_text", "\n"), "_lines": split_lines(F.col("_text")), "_sentences": split_sentences(F.col("_text")), "_words": split_words(F.col("_lower"))})


def mean_line_length(lines: Column) -> Column:
    return mean(F.transform(lines, lambda x: utf16_length(x).cast("double")))


def mean_sentence_words(sentences: Column) -> Column:
    return mean(F.transform(sentences, lambda x: plain_word_count(x).cast("double")))
