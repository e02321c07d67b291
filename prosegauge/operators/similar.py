"""Near-duplicates of posts by embedding: cells of random hyperplanes, several tables of them, and an exact check.

Vectors on the same side of some hyperplanes share a cell; two of cosine c agree on one with odds
1 - acos(c) / pi, so the number of tables follows from the recall that is asked for, and the number of
hyperplanes from how many vectors there are. In a cell a search from vector to vector gives star
edges, never all pairs. Crowded cells are thinned first - what is linked to the cell's first vector
leaves with that link - and then dealt out by further hyperplanes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

THRESHOLD = 0.9
RECALL = 0.98
#: Vectors for which a cell is made; and for which it counts as crowded.
CELL, CROWD = 64, 2048
#: Rows of a block in the exact search.
BLOCK = 2048
SEED = 11
NODE = "node long, vec binary"


def unit(vector: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of no length stay as they are."""
    size = np.linalg.norm(vector, axis=1, keepdims=True)
    return (vector / np.where(size > 0, size, 1)).astype(np.float32)


def agreement(cosine: float) -> float:
    """The odds that two vectors of this cosine lie on the same side of a random hyperplane."""
    return 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi


def tables_for(bits: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """How many tables of so many hyperplanes find a pair at the threshold with the odds asked for."""
    one = agreement(threshold) ** bits
    return 1 if one >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - one)))


def bits_for(n: int, cell: int = CELL) -> int:
    return max(1, min(40, math.ceil(math.log2(max(2, n / cell)))))


def _planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables * bits, dim)).astype(np.float32)


def cells(vectors: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """The cell of each vector in each table: the table in the high bits, sides below."""
    sides = (vectors @ _planes(vectors.shape[1], bits, tables, seed).T > 0).reshape(len(vectors), tables, bits)
    return (sides @ (1 << np.arange(bits, dtype=np.int64))) + (np.arange(tables, dtype=np.int64) << 44)


def unit_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vec (32-bit numbers of length 1, as bytes), dim; rows without id, without vector, or with a null in it are left out."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                packed = [unit(np.array([v], np.float64))[0].tobytes() for v in part.column("v").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int32())], ["vec_id", "vec", "dim"])

    return rows.mapInArrow(pack, "vec_id long, vec binary, dim int")


def _keyed(batches: Iterator[pa.RecordBatch], bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    """node, vec (and key) -> key, node, vec: a row for each table; a key that is there is refined."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            if not part.num_rows:
                continue
            raw = part.column("vec").to_pylist()
            found = np.empty((len(raw), tables), np.int64)
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):  # vectors of different lengths never meet
                own = np.flatnonzero(sizes == size)
                matrix = np.frombuffer(b"".join(raw[k] for k in own), np.float32).reshape(len(own), -1)
                found[own] = cells(matrix, bits, tables, seed) * 1_000_003 + size
            if "key" in part.schema.names:
                found = found * np.int64(0x9E3779B1) ^ part.column("key").to_numpy()[:, None]
            index = pa.array(np.repeat(np.arange(len(raw)), tables))
            yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1)), part.column("node").take(index), part.column("vec").take(index)], ["key", "node", "vec"])


def linked(vectors: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Star edges of the links among some vectors: a search that takes each vector once."""
    out: list[tuple[int, int]] = []
    rest = np.arange(len(vectors))
    while len(rest) > 1:
        root, todo, rest = int(rest[0]), [int(rest[0])], rest[1:]
        while todo and len(rest):
            near = vectors[rest] @ vectors[todo.pop()] >= threshold
            out += [(root, int(k)) for k in rest[near]]
            todo += rest[near].tolist()
            rest = rest[~near]
    return out


def _linked(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """key, node, vec in order of key -> u, v. Only the cell at hand is held, and no cell is crowded."""
    key, nodes, vecs = None, [], []

    def done() -> list[tuple[int, int]]:
        return [(nodes[a], nodes[b]) for a, b in linked(np.frombuffer(b"".join(vecs), np.float32).reshape(len(vecs), -1), threshold)] if len(nodes) > 1 else []

    def give(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], ["u", "v"])

    for batch in batches:
        out = []
        for k, node, vec in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "vec")), strict=True):
            if k != key:
                out += done()
                key, nodes, vecs = k, [], []
            if not nodes or nodes[-1] != node:
                nodes.append(node)
                vecs.append(vec)
        yield give(out)
    yield give(done())


def _to_rep(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """key, node, vec, rep, rep_vec -> key, node, vec, rep, near."""
    for batch in batches:
        near = [float(np.frombuffer(a, np.float32) @ np.frombuffer(b, np.float32)) >= threshold for a, b in zip(batch.column("vec").to_pylist(), batch.column("rep_vec").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "node", "vec", "rep")), pa.array(near, pa.bool_())], ["key", "node", "vec", "rep", "near"])


def cell_links(nodes: DataFrame, n: int, threshold: float = THRESHOLD, recall: float = RECALL, crowd: int = CROWD) -> DataFrame:
    """u, v: links between distinct vectors (node, vec) that share a cell, as star edges."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits, seed, out = bits_for(n), SEED, None
    keyed = cut(nodes.mapInArrow(partial(_keyed, bits=bits, tables=tables_for(bits, threshold, recall), seed=seed), f"key long, {NODE}"))
    while True:
        crowded = cut(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("rep")).where(F.col("n") > crowd))
        calm = keyed.join(F.broadcast(crowded.select("key")), "key", "left_anti")  # one row for each `crowd` vectors of a table at most
        found = calm.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(partial(_linked, threshold=threshold), "u long, v long")
        out = found if out is None else out.union(found)
        if not crowded.limit(1).count():
            return out
        reps = crowded.join(nodes.withColumnRenamed("node", "rep"), "rep").select("key", "rep", F.col("vec").alias("rep_vec"))
        told = cut(keyed.join(F.broadcast(reps), "key").mapInArrow(partial(_to_rep, threshold=threshold), f"key long, {NODE}, rep long, near boolean"))
        out = out.union(told.where("near and node != rep").select(F.col("rep").alias("u"), F.col("node").alias("v")))
        seed += 1
        rest = told.where("not near").select("key", "node", "vec")
        keyed = cut(rest.mapInArrow(partial(_keyed, bits=4, tables=tables_for(4, threshold, recall), seed=seed), f"key long, {NODE}").distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node with an edge u, v: the smallest it can reach. A round lets each node take the least root among its neighbours and that one's own root."""
    both = cut(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).distinct())
    roots = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("root")))
    while True:
        beside = both.join(roots.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("_near"))
        step = roots.join(beside, "node").select("node", F.least("root", "_near").alias("_to"), F.col("root").alias("_was"))
        over = step.join(roots.select(F.col("node").alias("_to"), F.col("root").alias("_over")), "_to")
        moved = cut(over.select("node", F.least("_to", "_over").alias("root"), "_was"))
        changed = moved.where("root != _was").limit(1).count()
        roots = moved.select("node", "root")
        if not changed:
            return roots


def embedding_classes(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, crowd: int = CROWD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component_id (smallest id reachable by links of that cosine), n_copies (rows with the same unit vector) of each row.

    Equal vectors are one node, and rows get their class back by a join. Links are found with the recall
    asked for at the threshold, and nearer ones more surely; each is checked exactly. Vectors of different
    lengths are never linked; one of no length is linked to none but its equals. Rows without id or
    vector are left out; repeated rows are kept; an empty table gives an empty result.
    """
    rows = cut(unit_vectors(vectors, id_col, vector_col))
    nodes = cut(rows.groupBy("vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("n_copies")))
    links = cell_links(nodes.select("node", "vec"), nodes.count(), threshold, recall, crowd)
    named = nodes.join(components(links), "node", "left").select("vec", "n_copies", F.coalesce("root", "node").alias("component_id"))
    return rows.join(named, "vec").select("vec_id", "component_id", "n_copies")


# ---- search ------------------------------------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """vec_id, vec, dim -> blocks of rows of one length: dim, ids, vecs (joined bytes)."""
    held: dict[int, tuple[list[int], list[bytes]]] = {}

    def give(dim: int) -> pa.RecordBatch:
        ids, vecs = held.pop(dim)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([b"".join(vecs)], pa.binary())], ["dim", "ids", "vecs"])

    for batch in batches:
        for i, vec, dim in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "vec", "dim")), strict=True):
            ids, vecs = held.setdefault(dim, ([], []))
            ids.append(i)
            vecs.append(vec)
            if len(ids) == block:
                yield give(dim)
    for dim in list(held):
        yield give(dim)


def _searched(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """A block of queries beside a block of rows -> query_id, n_near, nearest_id, nearest (cosine); a row is no neighbour of itself."""
    names = ["query_id", "n_near", "nearest_id", "nearest"]
    for row in (batch.slice(k, 1) for batch in batches for k in range(batch.num_rows)):  # two blocks at a time
        for q_ids, q_vecs, ids, vecs in zip(*(row.column(c).to_pylist() for c in ("q_ids", "q_vecs", "ids", "vecs")), strict=True):
            q_ids, ids = np.array(q_ids, np.int64), np.array(ids, np.int64)
            one, two = (np.frombuffer(x, np.float32).reshape(len(n), -1).astype(np.float64) for x, n in ((q_vecs, q_ids), (vecs, ids)))
            for at in range(0, len(q_ids), 256):
                own = q_ids[at : at + 256]
                cosine = np.where(own[:, None] == ids[None, :], -2.0, one[at : at + 256] @ two.T)
                top = cosine.max(axis=1)
                best = np.where(cosine == top[:, None], ids, np.iinfo(np.int64).max).min(axis=1)  # of equals the smallest id
                keep = top > -2
                yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array((cosine >= threshold).sum(axis=1)[keep].astype(np.int64)), pa.array(best[keep]), pa.array(top[keep])], names)


def neighbours(queries: DataFrame, vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, n_near (other rows of that cosine or more), nearest_id, nearest: an exact search of a stated set of queries against all rows, block by block.

    A block of rows meets each block of queries once, so memory is two blocks and their products; nothing
    is broadcast. A query without any other row is left out. Of equally near rows the smallest id is named.
    """
    packed = lambda df: unit_vectors(df, id_col, vector_col).mapInArrow(partial(_blocks, block=block), "dim int, ids array<long>, vecs binary")
    asked = cut(packed(queries).select("dim", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))).withColumn("q", F.monotonically_increasing_id())
    asked = cut(asked)
    numbers = asked.groupBy("dim").agg(F.collect_list("q").alias("qs"))  # a number for each `block` queries
    dealt = packed(vectors).join(numbers, "dim").select("ids", "vecs", F.explode("qs").alias("q"))
    met = dealt.join(asked.select("q", "q_ids", "q_vecs"), "q").repartition(F.col("q"), F.xxhash64("ids"))
    best = met.select("q_ids", "q_vecs", "ids", "vecs").mapInArrow(partial(_searched, threshold=threshold), "query_id long, n_near long, nearest_id long, nearest double")
    order = F.struct(F.col("nearest"), (-F.col("nearest_id")).alias("_small"))
    return best.groupBy("query_id").agg(F.sum("n_near").alias("n_near"), F.max_by("nearest_id", order).alias("nearest_id"), F.max("nearest").alias("nearest"))


def _pairs_found(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [k for k, (a, b) in enumerate(zip(batch.column("q_vec").to_pylist(), batch.column("vec").to_pylist(), strict=True)) if len(a) == len(b) and float(np.frombuffer(a, np.float32).astype(float) @ np.frombuffer(b, np.float32)) >= threshold]
        yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(kept, pa.int64())), batch.column("vec_id").take(pa.array(kept, pa.int64()))], ["query_id", "vec_id"])


def indexed_neighbours(queries: DataFrame, vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, n_near by the cell index: as neighbours(), of the rows that share a cell with the query in some table, each checked exactly."""
    rows = cut(unit_vectors(vectors, id_col, vector_col))
    bits = bits_for(rows.count())
    keyed = lambda df: df.select(F.col("vec_id").alias("node"), "vec").mapInArrow(partial(_keyed, bits=bits, tables=tables_for(bits, threshold, recall), seed=SEED), f"key long, {NODE}")
    asked = keyed(unit_vectors(queries, id_col, vector_col)).select("key", F.col("node").alias("query_id"), F.col("vec").alias("q_vec"))
    met = keyed(rows).join(asked, "key").where("node != query_id").select("query_id", "q_vec", F.col("node").alias("vec_id"), "vec")
    found = met.mapInArrow(partial(_pairs_found, threshold=threshold), "query_id long, vec_id long").distinct()
    return found.groupBy("query_id").agg(F.count("*").alias("n_near"))


def measured_recall(vectors: DataFrame, every: int = 50, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row: n_queries (ids divisible by `every`), n_pairs (exact), n_found (by the index): what the index misses, against all rows."""
    queries = vectors.where(F.col(id_col) % every == 0)
    exact = neighbours(queries, vectors, threshold, id_col=id_col, vector_col=vector_col).select("query_id", F.col("n_near").alias("n_pairs"))
    found = indexed_neighbours(queries, vectors, threshold, recall, id_col, vector_col).select("query_id", F.col("n_near").alias("n_found"))
    return exact.join(found, "query_id", "left").agg(F.count("*").alias("n_queries"), F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum("n_found"), F.lit(0)).alias("n_found"))
