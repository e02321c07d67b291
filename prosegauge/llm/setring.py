"""Near-duplicates by shingle sets: pigeonring filtering where 64 bits are too few.

Two texts of Jaccard 0.8 differ in some ten bits of a 64-bit SimHash, up to eighteen or so, and no ring of
64 bits has segments to tell such a distance from chance. The same filter works on the vector that
the fingerprint is drawn from, the set of all shingles: its Hamming distance is the symmetric
difference, which Jaccard 0.8 holds within tau = (a + b) / 9. Shingles are dealt by hash to a ring of
more than tau segments, so a linked pair has a segment without a difference, and meets there.
Segments that are empty in both tell nothing; the ring is larger by some, and a set with too many
empty ones uses further rings until it has one that holds without them. Where two sets meet, the chain
along the ring is checked for the pair: the first k segments from a viable start differ in fewer than k
items. A linked pair has as many viable starts as it has more segments than differences (the cycle lemma), so
sets with fewer are pruned before any are compared. What is left is verified by exact Jaccard.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_by_key, only, partitions, sweep
from .components import connected_components
from .hashing import PRIME, distinct_sorted, mix, slices, word_hash_arrays

WIDTH = 5
SHARE = 0.8
#: An item turns over one of so many bits of its segment's sketch, so two sketches differ in no more bits than the segments in items.
BITS = 16
#: Keys of more sets are handed on without a check of their pairs; it bounds a key's work and changes no row.
MOST = 256


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of all runs of `width` lower-case words; a shorter text is one run, a blank one none."""
    tokens, ends = word_hash_arrays(texts)
    run = np.zeros(len(tokens), np.uint64)
    for k in range(width):  # windows that reach over an end are left out below
        run[: len(tokens) - k] = run[: len(tokens) - k] * PRIME + tokens[k:]
    run = mix(run)
    out, at = [], 0
    for end in ends.tolist():
        n = end - 1 - at
        if 0 < n < width:
            out.append(np.array([int.from_bytes(tokens[at : end - 1].tobytes(), "little") % ((1 << 61) - 1)], np.uint64))
        else:
            out.append(distinct_sorted(run[at : end - width]) if n else run[:0])
        at = end
    return out


class Rings:
    """Size classes and the ring of each: sets of classes k - 1 and k meet in ring k."""

    def __init__(self, share: float = SHARE):
        self.share = share
        self.bounds = [0, 1]

    def size_class(self, n: int) -> int:
        while self.bounds[-1] < n:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] / self.share)))
        return bisect_left(self.bounds, n)

    def bound(self, k: int) -> int:
        while len(self.bounds) <= k:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] / self.share)))
        return self.bounds[k]

    def tau(self, together: int) -> int:
        """The most that two linked sets of so many items together can differ in."""
        return int((1 - self.share) / (1 + self.share) * together + 1e-9)

    def keys(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(the segments of a set that can meet: one key for each that is not empty, in the rings of its size; the sketches of the two segments after each; from how many of them the chain to a linked set is viable at least).

        Of a set's segments, each with the empty ones after it, a linked pair has as many starts from which
        any k differ in fewer than k items as there are segments more than differing items, which are
        tau at most. The bound is the least over the sizes that a partner can have.
        """
        out, chains = [items[:0]], [np.zeros(0, np.uint32)]
        n = len(items)
        own = self.size_class(n) if n else 0
        held_in, sure = [0, 0], True
        for k in (own, own + 1) if own else ():
            tau = self.tau(2 * self.bound(k))
            if not tau:
                continue  # only equal sets are linked
            size = tau + 2 + -(-tau // 10)
            for turn in count():
                h = mix(items + np.uint64((k * 1009 + turn + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
                where = ((h >> np.uint64(32)) % np.uint64(size)).astype(np.int64)
                total = np.zeros(size, np.uint64)
                np.add.at(total, where, mix(h))
                held = np.flatnonzero(np.bincount(where, minlength=size))
                out.append(mix(total[held] + held.astype(np.uint64) * PRIME + np.uint64(k * 1009 + turn)))
                odd = np.bincount(where * BITS + (h % np.uint64(BITS)).astype(np.int64), minlength=size * BITS) & 1
                sketch = np.packbits(odd.astype(bool)).view(np.uint16).astype(np.uint32)
                chains.append(sketch[(held + 1) % size] << np.uint32(BITS) | sketch[(held + 2) % size])
                if len(held) > tau:
                    break
                sure = False
            held_in[k - own] = len(held)
        if not sure or not own:
            return np.concatenate(out), np.concatenate(chains), 1
        below, above = self.bound(own - 1), int(n / self.share + 1e-9)
        same = self.tau(n + self.bound(own))
        needs = [max(0, held_in[0] - same) + max(0, held_in[1] - same)]
        if above > self.bound(own):
            needs.append(held_in[1] - self.tau(n + above))
        if below >= self.share * n - 1e-9:
            needs.append(held_in[0] - self.tau(n + below))
        return np.concatenate(out), np.concatenate(chains), max(1, min(needs))


def viable(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether the chains of pairs that share a key can go on: one item at most differs in the next segment, and two in the next two."""
    differ = one ^ two
    return (np.bitwise_count(differ >> np.uint32(BITS)) <= 1) & (np.bitwise_count(differ) <= 2)


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _marks(sets: list[np.ndarray], clashing: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set; the first is made from both where it is known to stand for several sets."""
    one = np.array([int(np.bitwise_xor.reduce(mix(x))) if len(x) else 0 for x in sets], np.uint64)
    two = np.array([int(np.add.reduce(mix(x ^ PRIME), dtype=np.uint64)) if len(x) else 0 for x in sets], np.uint64)
    if clashing:
        one = np.where(np.isin(one.view(np.int64), list(clashing)), mix(one * PRIME + two), one)
    return one.view(np.int64), two.view(np.int64)


def _nodes(batches: Iterator[pa.RecordBatch], width: int, clashing: frozenset[int]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        node, other = _marks(shingle_sets(_bytes(batch.column("text")), width), clashing)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(node), pa.array(other)], ["doc_id", "node", "other"])


def _keyed(batches: Iterator[pa.RecordBatch], width: int, share: float, clashing: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """key, node, need (from how many keys the chain to a linked set is viable at least), chain of each set that this task has not had before: copies add nothing."""
    rings, had = Rings(share), set()
    for batch in slices(batches, "text"):
        sets = shingle_sets(_bytes(batch.column("text")), width)
        node, _ = _marks(sets, clashing)
        fresh = [k for k, n in enumerate(node.tolist()) if n not in had and not had.add(n)]
        keys = [rings.keys(sets[k]) for k in fresh]
        if keys:
            sizes = [len(k) for k, _, _ in keys]
            owner, need = np.repeat(node[fresh], sizes), np.repeat(np.array([n for _, _, n in keys], np.int32), sizes)
            key, chain = np.concatenate([k for k, _, _ in keys]).view(np.int64), np.concatenate([c for _, c, _ in keys]).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner), pa.array(need), pa.array(chain)], ["key", "node", "need", "chain"])


def _viable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, node, need, chain in order of key and node -> key, node, need of the sets that have a viable chain to another set of their key.

    The first and last key of a batch, which may go on in another, are handed on as they are.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node, need, chain = (batch.column(n).to_numpy() for n in ("key", "node", "need", "chain"))
        start = np.ones(len(key), bool)
        start[1:] = key[1:] != key[:-1]
        fresh = start.copy()
        fresh[1:] |= node[1:] != node[:-1]
        key, node, need, chain, start = key[fresh], node[fresh], need[fresh], chain[fresh].view(np.uint32), start[fresh]
        first = np.flatnonzero(start)
        sizes = np.diff(np.append(first, len(key)))
        stays = np.repeat(sizes > MOST, sizes)
        stays[: sizes[0]] = stays[first[-1] :] = True
        for size in np.unique(sizes[(sizes > 1) & (sizes <= MOST)]).tolist():
            rows = first[sizes == size][:, None] + np.arange(size)
            linked = viable(chain[rows][:, :, None], chain[rows][:, None, :])
            linked[:, np.arange(size), np.arange(size)] = False
            stays[rows] |= linked.any(axis=2)
        yield pa.RecordBatch.from_arrays([pa.array(key[stays]), pa.array(node[stays]), pa.array(need[stays])], ["key", "node", "need"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _meetings(_viable(batches))


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, node, need in order of key and node -> the same, for keys of several nodes. Only the key at hand is carried on."""
    carried: tuple[int, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node, need = (batch.column(n).to_numpy() for n in ("key", "node", "need"))
        if carried is not None:
            key, node, need = (np.concatenate(([c], x)) for c, x in zip(carried, (key, node, need), strict=True))
        start = np.ones(len(key), bool)
        start[1:] = key[1:] != key[:-1]
        repeat = ~start
        repeat[1:] &= node[1:] == node[:-1]
        run, first = np.cumsum(start) - 1, np.flatnonzero(start)
        met = np.flatnonzero(~start & ~repeat)
        met = np.concatenate((met, first[np.unique(run[met])]))
        carried = int(key[-1]), int(node[first[-1]]), int(need[first[-1]])
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(key[met]), pa.array(node[met]), pa.array(need[met].astype(np.int32))], ["key", "node", "need"])


def _sets(batches: Iterator[pa.RecordBatch], width: int, clashing: frozenset[int]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = shingle_sets(_bytes(batch.column("text")), width)
        yield pa.RecordBatch.from_arrays([pa.array(_marks(sets, clashing)[0]), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "items"])


def verified(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The pairs u, v whose sets have that Jaccard. A node that many pairs ask for is read by several tasks."""
    asked = cut(pairs.groupBy("v").agg(F.count("*").alias("_n")))
    sets = only(sets, cut(asked.select(F.col("v").alias("node")).union(pairs.select(F.col("u").alias("node"))).distinct()), "node")
    salts = F.ceil(F.col("_n") / 500).cast("int")
    dealt = join_by_key(pairs, asked.withColumn("salts", salts), ["v"], "inner").withColumn("salt", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int")).drop("salts")
    twos = asked.join(sets, asked.v == sets.node).select("v", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("items").alias("_v"))
    ones = sets.select(F.col("node").alias("u"), F.col("items").alias("_u"))
    both = F.size(F.array_intersect("_u", "_v"))
    return dealt.join(twos, ["v", "salt"]).join(ones, "u").where(both >= share * (F.size("_u") + F.size("_v") - both) - 1e-9).select("u", "v")


#: A star of fewer sets is told apart by its rep's own set, a larger one by what more than half of so many of its sets hold. Which set it is changes no row.
FEW, HELD = 8, 9
#: Bounds are multiples of (1 - share) / (1 + share); sums of doubles stay this near to them.
_EPS = 1e-6


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, sets (at most HELD) -> rep, pivot: the items that more than half of the sets hold."""
    for batch in batches:
        for rep, sets in zip(batch.column("rep").to_pylist(), batch.column("sets"), strict=True):
            items, n = np.unique(sets.values.flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([rep]), pa.array([items[2 * n > len(sets)]], pa.list_(pa.int64()))], ["rep", "pivot"])


def _deltas(near: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """rep, node, n (size of the set), g, delta: in what each set of a star, the rep's own among them, differs from the star's pivot.

    g is the size of delta less the set's part in what a linked pair may differ in.
    """
    members = cut(near.select("rep", "node").union(near.select("rep", F.col("rep").alias("node"))).distinct())
    counts = cut(members.groupBy("rep").agg(F.count("*").alias("_n")))
    members = cut(join_by_key(members, counts.withColumn("many", F.col("_n")), ["rep"], "inner"))
    few = members.where((F.col("many") < FEW) & (F.col("node") == F.col("rep"))).select("rep", "node")
    some = members.where(F.col("many") >= FEW).groupBy("rep", F.pmod(F.xxhash64("node"), F.lit(HELD)).alias("_k")).agg(F.min("node").alias("node")).select("rep", "node")
    held = few.union(some).join(sets, "node").groupBy("rep").agg(F.collect_list("items").alias("sets"))
    pivots = cut(held.mapInArrow(_pivots, "rep long, pivot array<long>"))
    sweep(near.sparkSession)
    # a pivot that many sets ask for is read by several tasks
    salts = F.ceil(F.col("_n") / 500).cast("int")
    pivots = pivots.join(counts, "rep").select("rep", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "pivot")
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("many") / 500)).cast("int"))
    both = dealt.join(sets, "node").join(pivots, ["rep", "salt"])
    out = both.select("rep", "node", F.size("items").alias("n"), F.concat(F.array_except("items", "pivot"), F.array_except("pivot", "items")).alias("delta"))
    return cut(out.select("rep", "node", "n", (F.size("delta") - F.col("n") * ((1 - share) / (1 + share))).alias("g"), "delta"))


def _roots(near: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """node, root: components of all links between nodes that share a key, hence a rep.

    near: node, rep. Two sets u, v are linked if they differ in (1 - share) / (1 + share) of their sizes
    together, which with their differences from any third set, the pivot of their star, reads
    g(u) + g(v) <= 2 |delta(u) & delta(v)|. So all sets with g(u) + g(v) <= 0 for the one with the
    least g, v, are linked to it, and need not be compared with each other; the others have links only where
    their deltas meet, in a number of items that is known for each pair. These are looked up by the rarest
    items of their deltas, as many as a partner can't all lack; what follows an item in that order
    bounds what two sets have in common from it on. What a whole group holds is in no delta, so a group of
    near copies costs what its members were changed in, not its pairs.
    """
    delta = _deltas(near, sets, share)
    best = cut(delta.groupBy("rep").agg(F.min(F.struct("g", "node")).alias("b"), F.count("*").alias("_n")).select("rep", F.col("b.g").alias("g0"), F.col("b.node").alias("v0"), "_n"))
    told = cut(join_by_key(delta.select("rep", "node", "n", "g", F.size("delta").alias("far")), best.withColumn("many", F.col("_n")), ["rep"], "inner"))
    links = cut(told.where((F.col("g") + F.col("g0") <= _EPS) & (F.col("node") != F.col("v0"))).select(F.col("node").alias("u"), F.col("v0").alias("v")).distinct())
    roots = cut(connected_components(links))
    sweep(near.sparkSession)

    told = cut(told.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    # of two sets in a star all is known
    unsettled = told.where("many > 2").groupBy("rep").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.count("*").alias("_n"))
    unsettled = cut(unsettled.where("_a != _b").select("rep", "_n"))
    lone = F.col("g") + F.col("g0") > _EPS
    # two that are both linked to v0 need no link; so a partner's g is -g0 at least, or g0 for a lone one's
    common = F.greatest(F.lit(1), F.ceil((F.col("g") + F.when(lone, F.col("g0")).otherwise(-F.col("g0"))) / 2 - _EPS), F.ceil(F.col("far") - F.col("n") * ((1 - share) / share) - _EPS))
    told = join_by_key(told, unsettled, ["rep"], "left_semi").select("rep", "node", "g", "root", lone.alias("lone"), common.alias("common"))
    sweep(near.sparkSession)
    items = join_by_key(delta, unsettled, ["rep"], "left_semi").select("rep", "node", F.explode("delta").alias("item"))
    shared = cut(items.groupBy("rep", "item").agg(F.count("*").alias("_n")).where("_n > 1"))
    known = join_by_key(items, shared.withColumn("among", F.col("_n")), ["rep", "item"], "inner")
    # from an item on, so many of a set's items are left that others of the star have too
    order = Window.partitionBy("rep", "node").orderBy(F.desc("among"), F.desc("item"))
    entries = cut(known.withColumn("left", F.row_number().over(order)).join(told, ["rep", "node"]).where("left >= common").drop("common"))

    sweep(near.sparkSession)
    salts = F.ceil(F.col("among") / 500).cast("int")
    ones = entries.where("lone").withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int"))
    twos = entries.select("rep", "item", *(F.col(x).alias(f"{x}_") for x in ("node", "g", "root", "left")), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    enough = (F.col("root") != F.col("root_")) & (2 * F.least("left", "left_") >= F.col("g") + F.col("g_") - _EPS)
    met = ones.join(twos, ["rep", "item", "salt"]).where(enough)
    pairs = cut(met.select(F.greatest("node", "node_").alias("u"), F.least("node", "node_").alias("v")).distinct())
    if not pairs.limit(1).count():
        return roots
    return connected_components(links.union(verified(pairs, sets, share)))


def set_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, width: int = WIDTH) -> DataFrame:
    """doc_id, component_id of every row: the smallest doc_id reachable over links of Jaccard `share` or more.

    Words are lower-cased (A-Z) runs without white space; texts of any length are read whole. Equal
    sets are one node, known by 128 bits. Null, empty and blank texts are one class. Null doc_id
    rows are kept, in the class of their equals, and name nothing; repeated rows are kept. An empty
    table gives an empty result; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    clashing: frozenset[int] = frozenset()
    while True:
        named = cut(rows.mapInArrow(partial(_nodes, width=width, clashing=clashing), "doc_id long, node long, other long"))
        # different sets of one 64-bit hash: none below some billions of sets, a few beyond
        clash = named.groupBy("node").agg(F.min("other").alias("_a"), F.max("other").alias("_b")).where("_a != _b").select("node").collect()
        if not clash:
            break
        clashing |= frozenset(r[0] for r in clash)
    keyed = rows.mapInArrow(partial(_keyed, width=width, share=share, clashing=clashing), "key long, node long, need int, chain int")
    dealt = keyed.repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key", "node")
    met = cut(dealt.mapInArrow(_chained, "key long, node long, need int"))
    sweep(docs.sparkSession)
    # a set with viable chains from too few of its keys is linked to none of those it meets
    able = cut(met.groupBy("node").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").select("node"))
    met = cut(only(met, able, "node").select("key", "node").distinct())
    reps = cut(met.groupBy("key").agg(F.min("node").alias("rep"), F.count("*").alias("_n")).where("_n > 1"))
    near = cut(join_by_key(met, reps, ["key"], "inner").where("node != rep").select("node", "rep").distinct())
    del met, able, reps
    sweep(docs.sparkSession)
    asked = cut(near.select("node").union(near.select("rep")).distinct())
    firsts = cut(named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("_n")))
    # a set whose rows all lack an id is read from those rows
    chosen = cut(firsts.join(asked, "node", "left_semi").select(F.coalesce("doc_id", F.lit(-1)).alias("_id")).distinct())
    texts = only(rows.withColumn("_id", F.coalesce("doc_id", F.lit(-1))), chosen, "_id").select("text")
    sets = texts.mapInArrow(partial(_sets, width=width, clashing=clashing), "node long, items array<long>")
    sets = cut(sets.join(asked, "node", "left_semi").dropDuplicates(["node"]))
    del asked, chosen, texts
    sweep(docs.sparkSession)
    roots = _roots(near, sets, share)
    del near, sets
    sweep(docs.sparkSession)
    rooted = cut(firsts.join(roots, "node", "left").select("node", F.col("_n").alias("_rows"), "doc_id", F.coalesce("root", "node").alias("root")))
    least = cut(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("_n")))
    every = cut(join_by_key(rooted, least, ["root"], "inner").select("node", F.col("_rows").alias("_n"), "component_id"))
    return join_by_key(named.select("doc_id", "node"), every, ["node"], "inner").select("doc_id", "component_id")
