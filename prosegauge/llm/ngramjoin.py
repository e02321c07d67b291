"""Jaccard join of word n-gram sets, heavy and light.

Two sets of n and t items reach a Jaccard of `percent` if they share need(n, t) of them. Small sets are
light: each enumerates all its subsets of those fixed sizes, and linked ones have one in common. Large
sets are heavy: they scan inverted lists, in which a set stands under the few rarest of its items that a
partner can't all lack. The boundary is the size at which both together cost least, as counted from
the sets at hand; it changes no row.

Before either, sets are screened: of the items with the smallest hashes, a linked pair shares a known
number, so a set that meets others in fewer is linked to none and its other items are never shuffled.
What meets is verified by exact Jaccard; classes come from components, so a group of near copies costs
links in its own order of size and not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, join_by_key, only, partitions, sweep, table
from .hashing import PRIME, mix, slices
from .setring import _bytes, _marks, _meetings, _roots, _sets, shingle_sets

WIDTH = 4
PERCENT = 85
#: Sizes at which a set would have more subsets than this are heavy at any cost: it bounds a row's work.
SUBSETS = 20_000


def need(n: int, t: int, percent: int = PERCENT) -> int:
    """How many items sets of n and t items share at least if they are linked."""
    return -(-percent * (n + t) // (100 + percent))


def spare(n: int | Column, percent: int = PERCENT) -> int | Column:
    """How many items of a set of n a partner of any size can lack at most."""
    return n * (100 - percent) // 100 if isinstance(n, int) else F.floor(n * (100 - percent) / 100)


@cache
def subset_sizes(n: int, percent: int = PERCENT) -> tuple[int, ...]:
    """The sizes of the subsets that a set of n items shares with its partners, one for each partner's size or fewer."""
    return tuple(sorted({need(n, t, percent) for t in range(-(-percent * n // 100), 100 * n // percent + 1)} & set(range(1, n + 1))))


def n_subsets(n: int, percent: int = PERCENT) -> int:
    return sum(comb(n, c) for c in subset_sizes(n, percent))


def light_sizes(percent: int = PERCENT, subsets: int = SUBSETS) -> list[int]:
    """The sizes, from 1 on, at which sets can be light."""
    out = []
    while n_subsets(len(out) + 1, percent) <= subsets:
        out.append(len(out) + 1)
    return out


@cache
def _left_out(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64).reshape(comb(n, k), k)


def subset_keys(items: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """A key for each of the subsets that a light set enumerates: the sum of all hashes less those left out."""
    n = len(items)
    hashed = mix(items ^ PRIME)
    total = np.add.reduce(hashed, dtype=np.uint64)
    salt = np.arange(n + 1, dtype=np.uint64) * PRIME
    return np.concatenate([mix(total - hashed[_left_out(n, n - c)].sum(axis=1, dtype=np.uint64) + salt[c]) for c in subset_sizes(n, percent)])


def _named(batches: Iterator[pa.RecordBatch], width: int, clashing: frozenset[int]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = shingle_sets(_bytes(batch.column("text")), width)
        node, other = _marks(sets, clashing)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(node), pa.array(other), pa.array([len(x) for x in sets], pa.int64())], ["doc_id", "node", "other", "n"])


def _screened(batches: Iterator[pa.RecordBatch], width: int, percent: int, clashing: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """key, node, need: the items with the smallest hashes of each set that this task hasn't had before, and how many of them a linked set shares at least.

    Of the first spare + k of one set and of the other, linked sets share k.
    """
    more, had = lambda n: spare(n, percent) + 1, set()
    for batch in slices(batches, "text"):
        sets = shingle_sets(_bytes(batch.column("text")), width)
        node, _ = _marks(sets, clashing)
        fresh = [k for k, n in enumerate(node.tolist()) if len(sets[k]) and n not in had and not had.add(n)]
        keys = [sets[k][: spare(len(sets[k]), percent) + more(len(sets[k]))] for k in fresh]
        if keys:
            sizes = [len(k) for k in keys]
            least = np.array([more(-(-percent * len(sets[k]) // 100)) for k in fresh], np.int32)
            columns = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(node[fresh], sizes)), pa.array(np.repeat(least, sizes))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "node", "need"])


def _enumerated(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, items in zip(batch.column("node").to_pylist(), batch.column("items"), strict=True):
            keys = subset_keys(items.values.to_numpy().view(np.uint64), percent).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), node))], ["key", "node"])


def list_entries(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """key, node, n, _n (sets that have the item): the places of each set in the inverted lists.

    A set's items are ordered by how many sets have them, and of these it stands in the lists of the
    first spare + 1: a partner lacks at most spare of them. Items of one set alone come first and
    need no list; a set with more of them than a partner can lack has no partner.
    """
    items = sets.select("node", F.size("items").cast("long").alias("n"), F.explode("items").alias("key"))
    shared = cut(items.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1"))
    held = join_by_key(items, shared.withColumn("among", F.col("_n")), ["key"], "inner")
    order = Window.partitionBy("node").orderBy("among", "key")
    ranked = held.select("*", F.row_number().over(order).alias("rank"), F.count("*").over(Window.partitionBy("node")).alias("known"))
    alone = F.col("n") - F.col("known")
    return ranked.where((alone <= spare(F.col("n"), percent)) & (F.col("rank") + alone <= spare(F.col("n"), percent) + 1)).select("key", "node", "n", F.col("among").alias("_n"))


def boundary(sizes: dict[int, tuple[int, int]], percent: int = PERCENT, subsets: int = SUBSETS) -> int:
    """The size up to which sets are light. sizes: n -> (sets of that size, entries that their scans read)."""
    able = light_sizes(percent, subsets)

    def cost(edge: int) -> int:
        light = sum(sets * n_subsets(n, percent) for n, (sets, _) in sizes.items() if n <= edge)
        return light + sum(scan for n, (_, scan) in sizes.items() if 100 * n // percent > edge)

    return min([0, *able], key=cost)


def ngram_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH, edge: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the size of its set of `width`-word shingles, and the smallest doc_id reachable over links of Jaccard `percent` or more.

    Words are lower-cased (A-Z) runs without white space; fewer words than `width` are one shingle; null,
    empty and blank texts have none and are linked with nothing. Texts of any length are read whole.
    Equal sets are one node, known by 128 bits. Repeated rows are kept; rows with a null doc_id are
    kept, in the class of their equals, and name nothing. An empty table gives an empty result;
    further columns are ignored, whatever their names. edge: the largest light size, by cost if None;
    sizes beyond light_sizes() are heavy.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    clashing: frozenset[int] = frozenset()
    while True:
        named = cut(rows.mapInArrow(partial(_named, width=width, clashing=clashing), "doc_id long, node long, other long, n long"))
        # different sets of one 64-bit hash: none below some billions of sets, a few beyond
        clash = named.groupBy("node").agg(F.min("other").alias("_a"), F.max("other").alias("_b")).where("_a != _b").select("node").collect()
        if not clash:
            break
        clashing |= frozenset(r[0] for r in clash)
    keyed = rows.mapInArrow(partial(_screened, width=width, percent=percent, clashing=clashing), "key long, node long, need int")
    dealt = keyed.repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key", "node")
    # a row that comes twice, at the end of a batch, lets a set through at worst
    seen = dealt.mapInArrow(_meetings, "key long, node long, need int")
    able = cut(seen.groupBy("node").agg(F.count("*").alias("met"), F.max("need").alias("need")).where("met >= need").select("node"))
    firsts = cut(named.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("_n")))
    # a set whose rows all lack an id is read from those rows
    chosen = cut(firsts.join(able, "node", "left_semi").select(F.coalesce("doc_id", F.lit(-1)).alias("_id")).distinct())
    texts = only(rows.withColumn("_id", F.coalesce("doc_id", F.lit(-1))), chosen, "_id").select("text")
    sets = texts.mapInArrow(partial(_sets, width=width, clashing=clashing), "node long, items array<long>")
    sets = cut(sets.join(able, "node", "left_semi").dropDuplicates(["node"]))

    sweep(docs.sparkSession)
    entries = cut(list_entries(sets, percent))
    small = light_sizes(percent)[-1]
    scans = entries.where(F.col("n") <= small).groupBy("n").agg(F.count_distinct("node").alias("sets"), F.sum("_n").alias("scan")).collect()
    edge = boundary({r.n: (r.sets, r.scan) for r in scans}, percent) if edge is None else min(edge, small)
    with_entries = entries.select("node").distinct()
    light = sets.where(F.size("items") <= edge).join(with_entries, "node", "left_semi").mapInArrow(partial(_enumerated, percent=percent), "key long, node long")
    heavy = entries.where(F.floor(100 * F.col("n") / percent) > edge).select("key", "node")
    met = cut(heavy.unionByName(light))

    reps = cut(met.groupBy("key").agg(F.min("node").alias("rep"), F.count("*").alias("_n")).where("_n > 1"))
    near = cut(join_by_key(met, reps, ["key"], "inner").where("node != rep").select("node", "rep").distinct())
    roots = _roots(near, sets, percent / 100)
    rooted = cut(firsts.join(roots, "node", "left").select("node", F.col("_n").alias("_rows"), "doc_id", F.coalesce("root", "node").alias("root")))
    least = cut(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("_n")))
    every = cut(join_by_key(rooted, least, ["root"], "inner").select("node", F.col("_rows").alias("_n"), "component_id"))
    linked = join_by_key(named.where("n > 0").select("doc_id", "node", "n"), every, ["node"], "inner")
    out = linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(named.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM worded
), items AS (
  SELECT r, len(s) AS n, unnest(s) AS x FROM sets
), pairs AS (
  SELECT a.r AS u, b.r AS v FROM items a JOIN items b ON a.x = b.x AND a.r <> b.r
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT r AS u, r AS v FROM sets
  UNION SELECT reach.u, pairs.v FROM reach JOIN pairs ON pairs.u = reach.v
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id
FROM sets s JOIN reach ON reach.u = s.r JOIN sets t ON t.r = reach.v GROUP BY s.r, s.doc_id, s.s
"""
