"""Benchmark decontamination: MinHash containment search with a signature for each size of item.

A document that holds a share t of an item's m distinct shingles lacks at most m - ceil(t * m) of
them, so any one more than that, taken together, cannot all be missing. The item's signature is
therefore its smallest hashes (a bottom-k MinHash), with k set by the size partition the item falls
into, and a document is a candidate when one of them is among its own shingle hashes. Unlike bands
of a fixed signature, this finds every case, however long the document. Candidates are verified by
exact shingle containment. An item of fewer words than a shingle has is one shingle of its own length.
DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, window_hashes, window_texts, word_hashes, words

#: Bytes up to which a side is broadcast.
SMALL = 32 << 20
#: Parts that a larger side is repeated for, so that a shingle of very many documents is not one task.
SALTS = 16


def _met(rows: DataFrame, items: DataFrame, on: str, n_bytes: int) -> DataFrame:
    """Inner join of many rows (with doc_id) and fewer items; the items are broadcast if they are small, else repeated beside salted rows."""
    if n_bytes <= SMALL:
        return rows.join(F.broadcast(items), on)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(items.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [on, "_salt"]).drop("_salt")


def _every(parts: Column, widths: list[int], make: Callable[[Column, int], Column]) -> Column:
    return F.concat(*(make(parts, w) for w in widths))


def item_shingles(items: DataFrame, width: int = 5, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, m, width, shingle, h: the distinct shingles of each item; items that share an id are one item, whatever their lengths."""
    tokens = words(F.lower(F.col(text_col).cast("string")))
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), tokens.alias("_w")).where(F.size("_w") > 0)
    rows = rows.withColumn("_hw", word_hashes(F.col("_w"))).withColumn("width", F.least(F.size("_w"), F.lit(width)))

    def of_width(parts: Column, make: Callable[[Column, int], Column]) -> Column:
        out = make(parts, width)
        for k in range(1, width):
            out = F.when(F.col("width") == k, make(parts, k)).otherwise(out)
        return out

    rows = rows.select("item_id", "width", of_width(F.col("_w"), window_texts).alias("shingle"), of_width(F.col("_hw"), window_hashes).alias("h"))
    each = rows.select("item_id", "width", F.explode(F.arrays_zip("shingle", "h")).alias("x"))
    each = each.select("item_id", "width", "x.shingle", "x.h").distinct()
    sizes = each.groupBy("item_id").agg(F.count("*").alias("m"))
    return each.join(sizes, "item_id")


def signatures(shingles: DataFrame, share: float = 0.8) -> DataFrame:
    """item_id, m, h: each item's smallest hashes, as many as its size partition asks for.

    Partitions are sizes from one power of two to the next; each takes what its largest item needs.
    """
    lacks = F.col("m") - F.ceil(F.lit(share) * F.col("m") - 1e-9)
    part = F.floor(F.log2("m"))
    sized = shingles.select("item_id", "m", "h").withColumn("_part", part)
    per_item = sized.groupBy("item_id").agg(F.first("m").alias("m"), F.first("_part").alias("_part"), F.array_sort(F.collect_set("h")).alias("_h"))
    needs = per_item.groupBy("_part").agg(F.max(lacks + 1).cast("int").alias("_k"))
    return per_item.join(needs, "_part").select("item_id", "m", F.explode(F.slice("_h", 1, F.col("_k"))).alias("h"))


def contaminated(docs: DataFrame, items: DataFrame, share: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: every pair with at least `share` of the item in the document.

    Words are lower-cased runs without white space, shingles are `width` words (five), counted
    once each; an item of fewer words is one shingle, and is held by a document that has these words in a row.
    Null and empty texts match nothing; texts of any length are read whole; rows that share a doc_id
    count as one document, repeated rows change nothing; empty tables give an empty result; further columns are ignored.
    """
    shingles = cut(item_shingles(items, width))
    signed = cut(signatures(shingles, share))
    n_signed = signed.count() * 32
    n_shingles = shingles.agg(F.coalesce(F.sum(F.octet_length("shingle") + 32), F.lit(0))).first()[0]
    widths = sorted(r[0] for r in shingles.select("width").distinct().collect()) or [width]  # no more than `width` numbers
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("_t"))
    hashed = rows.select("doc_id", words(F.col("_t")).alias("_w")).select("doc_id", word_hashes(F.col("_w")).alias("_hw"))
    hashed = hashed.select("doc_id", _every(F.col("_hw"), widths, window_hashes).alias("_h"))
    probes = hashed.select("doc_id", F.explode("_h").alias("h"))
    pairs = cut(_met(probes, signed, "h", n_signed).select("doc_id", "item_id").distinct())
    found = cut(pairs.select("doc_id").distinct())
    near = rows.join(_small(found), "doc_id", "left_semi").select("doc_id", words(F.col("_t")).alias("_w"))
    held = near.select("doc_id", F.explode(F.array_distinct(_every(F.col("_w"), widths, window_texts))).alias("shingle"))
    shared = _met(held, shingles.select("item_id", "m", "shingle"), "shingle", n_shingles).select("doc_id", "item_id", "m", "shingle").distinct()
    counted = shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.first("m").alias("n_item"))
    sure = counted.join(pairs, ["doc_id", "item_id"], "left_semi").where(F.col("n_shared") >= F.ceil(F.lit(share) * F.col("n_item") - 1e-9))
    return sure.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def _small(ids: DataFrame) -> DataFrame:
    """A table of ids (eight bytes each), broadcast if it is small."""
    return F.broadcast(ids) if ids.count() * 16 <= SMALL else ids


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = 0.8) -> DataFrame:
    """The rows of docs, all their columns, that hold no item; rows with a null doc_id stay."""
    bad = cut(contaminated(docs, items, share).select("doc_id").distinct())
    return docs.join(_small(bad), "doc_id", "left_anti").select(docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM benchmark
), it AS (
  SELECT DISTINCT item_id, array_to_string(ws[i:i+k-1], ' ') AS g
  FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT *, least(5, len(ws)) AS k FROM iw WHERE len(ws) > 0 AND item_id IS NOT NULL))
), sizes AS (SELECT item_id, count(*) AS m FROM it GROUP BY item_id
), widths AS (SELECT DISTINCT least(5, len(ws)) AS k FROM iw WHERE len(ws) > 0
), dw AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL
), dg AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+k-1], ' ') AS g
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, widths WHERE len(ws) >= k)
), hits AS (
  SELECT doc_id, item_id, count(*) AS n FROM dg JOIN it USING (g) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n AS n_shared, m AS n_item, n / m AS containment
FROM hits JOIN sizes USING (item_id) WHERE n >= ceil(0.8 * m - 1e-9)
"""
