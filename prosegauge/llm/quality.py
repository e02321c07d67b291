"""Quality rules with cross-document line frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, bind, cut, join_by_key, row_key, table, window_hashes, word_hashes, words

SYMBOLS = r"[#*$%&|<>]"


def repeated_window_words(windows: Column, width: int = 5) -> Column:
    """Words in windows that stand twice or more in the text, each word once.

    windows: the hashes of all runs of `width` words, in order. They are sorted with their
    places; equal neighbours give the places of repeats, whose cover is then counted.
    """

    def placed(w: Column) -> Column:
        return F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(at: Column) -> Column:
        same = F.filter(at, lambda x, k: (x["h"] == F.get(at, k - 1)["h"]) | (x["h"] == F.get(at, k + 1)["h"]))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def cover(at: Column) -> Column:
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(at, start, lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(width), p - s["last"])).alias("n")), lambda s: s["n"])

    return bind(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(bind(placed(w), lambda a: cover(places(a)))))


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, _row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of every row of docs, which has a key _row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    staged = docs.select(F.col(id_col).alias("doc_id"), "_row", text.alias("_text"))
    staged = staged.select("doc_id", "_row", "_text", words(F.col("_text")).alias("_words"), F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    staged = staged.withColumn("_hashes", word_hashes(F.col("_words"))).withColumn("_windows", window_hashes(F.col("_hashes")))
    counts = staged.select(
        "doc_id",
        "_row",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_window_words(F.col("_windows")).alias("n_repeat_words"),
    )
    return counts.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, white space as one space, no white space at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), f"{SPACE_CLASS}+", " "), "[0-9]", "0"))


def common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = 0.02, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(_row, at, host, line, n: the lines of each row of docs, which has a key _row; host, line, _n: those above their host's limit).

    A host's limit is `share` of its rows, `least` at least; a line is above it if more documents
    of the host have it. Null hosts are one host. Documents are distinct doc_ids, as in OP9_SQL, so
    rows that share one count once; rows without one make no line frequent, but lose those that are.
    """
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    bare = docs.select("_row", F.col(id_col).alias("doc_id"), host.alias("host"), F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n").alias("_lines"))
    worded = lambda part: F.transform(F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")), part)
    lines = bare.select("_row", "host", F.posexplode(worded(lambda x: F.struct(F.xxhash64(normal_line(x)).alias("line"), F.size(words(x)).alias("n")))).alias("at", "x")).select("_row", "at", "host", "x.line", "x.n")
    once = bare.where("doc_id is not null").select("host", "doc_id", F.explode(F.array_distinct(worded(lambda x: F.xxhash64(normal_line(x))))).alias("line"))
    sizes = docs.groupBy(host.alias("host")).agg(F.count("*").alias("_docs"))
    seen = once.distinct().groupBy("host", "line").agg(F.count("*").alias("_n")).where(F.col("_n") > least)
    above = seen.join(sizes, "host").where(F.col("_n") > F.greatest(F.lit(float(least)), share * F.col("_docs"))).select("host", "line", "_n")
    return lines, above


def quality_rules(docs: DataFrame, share: float = 0.02, least: int = 10, remains: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Base rules, lines removed for their frequency in the host, and the verdict on every row.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_removed_words. kept: not base_failed, and at least `remains` of the words stand in
    lines that stay. Null and blank texts have no words and fail the base rules. Every row is judged
    by its own lines: rows that share a doc_id, repeated rows and rows without a doc_id alike. Lines
    are compared by a 64-bit hash of their normal form, texts of any length are read whole; an empty
    table gives an empty result; columns beyond id, text and host are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("source"))
    keyed = docs.withColumn("_row", row_key(F.col("doc_id"), F.col("source"), F.col("text")))
    base = base_rules(keyed)
    lines, above = common_lines(keyed, share=share, least=least)
    gone = join_by_key(lines, cut(above), ["host", "line"], "left_semi")
    # rows alike in everything have one key: their lines count once by place
    removed = gone.select("_row", "at", "n").distinct().groupBy("_row").agg(F.sum("n").alias("_removed"))
    out = base.join(removed, "_row", "left").withColumn("n_removed_words", F.coalesce("_removed", F.lit(0)))
    stays = F.col("n_words") - F.col("n_removed_words") >= remains * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & stays).alias("kept"), "n_removed_words")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), grams AS (
  SELECT r, i, array_to_string(ws[i:i+4], ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(5)) AS k) GROUP BY r
), lines AS (
  SELECT r, doc_id, host, unnest(ls) AS raw FROM w
), norm AS (
  SELECT r, doc_id, host, regexp_replace(regexp_replace(lower(trim(raw, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g') AS line,
         len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS n FROM lines
), sizes AS (SELECT host, count(*) AS docs FROM d GROUP BY host
), above AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT doc_id) AS c FROM norm GROUP BY host, line) JOIN sizes USING (host)
  WHERE c > greatest(10, 0.02 * docs)
), gone AS (
  SELECT r, sum(n) AS n FROM norm JOIN above USING (host, line) GROUP BY r
), base AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_removed_words >= 0.5 * n_words AS kept,
       n_removed_words
FROM base
"""
