"""SimHash near-duplicates by pigeonring filtering.

Two fingerprints of 64 bits that differ in at most 4 bits, cut into a ring of 5 segments, have a
start from which every chain of l consecutive segments differs in at most l * 4 / 5 bits: none in
the first segment, one in the first two, two in the first three. Keys follow that chain: the first
segment whole and one untouched half of the second (with chain=3 also an untouched third of the
next), so only fingerprints that can pass meet; the rest of the chain is then checked before the
full Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, cut, join_by_key, partitions, table
from .components import connected_components

#: Ring segments as (first bit, bits).
RING = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
REACH = 4


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    tokens = text.translate(LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = len(tokens)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, tokens), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    starts, stops = (ends - sizes)[: n - width + 1].tolist(), ends[width - 1 :].tolist()
    hashed = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)
    ones = np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashed), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        prints = [fingerprint((t.as_buffer().to_pybytes() if t.is_valid else b""), width, seed) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "fp"])


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) of every row; null text counts as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_fingerprints, width=width, seed=seed), "doc_id long, fp long")


def _parts(segment: int, n: int) -> list[tuple[int, int]]:
    """A segment cut into n parts, as (first bit, bits)."""
    first, bits = RING[segment % 5]
    edges = [first + bits * k // n for k in range(n + 1)]
    return [(x, y - x) for x, y in zip(edges, edges[1:], strict=False)]


def _bits(first: int, bits: int) -> Column:
    return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))


def ring_keys(prints: DataFrame) -> DataFrame:
    """fp -> start (ring position), key, fp: one row per chain of two segments that must be untouched, whole and by half."""
    keys = [F.struct(F.lit(i).alias("start"), (F.lit((i * 2 + h) << 40) + F.shiftleft(_bits(*RING[i]), 8) + _bits(*half)).alias("key")) for i in range(5) for h, half in enumerate(_parts(i + 1, 2))]
    return prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.start", "k.key", "fp")


def longer_keys(keys: DataFrame, chain: int) -> DataFrame:
    """The same fingerprints with keys one segment longer: the segment at that place of the chain has an untouched one of its `chain` parts."""
    choice = F.lit(None).cast("array<bigint>")
    for i in range(5):
        own = F.array(*(F.xxhash64("key", F.lit(k), _bits(*part)) for k, part in enumerate(_parts(i + chain - 1, chain))))
        choice = F.when(F.col("start") == i, own).otherwise(choice)
    return keys.select("start", F.explode(choice).alias("key"), "fp")


def ring_links(distinct: DataFrame, most: int = 4096) -> DataFrame:
    """u, v: star edges of all links between distinct fingerprints.

    Buckets of more than `most` fingerprints are dealt anew by longer chains, up to the whole ring;
    no link is lost on the way, as a link's chain holds at every length.
    """
    parts = partitions(distinct.sparkSession)
    out, keys = None, ring_keys(distinct)
    for chain in (3, 4, 5, None):
        crowded = None
        if chain is not None:
            crowded = cut(keys.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > most))
            if not crowded.limit(1).count():
                crowded = None
        rest = keys if crowded is None else keys.join(crowded, "key", "left_anti")
        found = rest.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_links, "u long, v long")
        out = found if out is None else out.union(found)
        if crowded is None:
            return out
        keys = cut(longer_keys(join_by_key(keys, crowded, ["key"], "left_semi"), chain))
    return out


def _near(one: np.ndarray, many: np.ndarray, start: int) -> np.ndarray:
    """Which of many lie within reach of one: chain after chain, then the whole distance."""
    x = one ^ many
    left = np.arange(len(x))
    spent = np.zeros(len(x), np.uint8)
    for step in range(4):
        first, bits = RING[(start + step) % 5]
        spent = spent + np.bitwise_count((x >> np.uint64(first)) & np.uint64((1 << bits) - 1))
        keep = spent <= (step + 1) * REACH // 5
        x, left, spent = x[keep], left[keep], spent[keep]
    return left[np.bitwise_count(x) <= REACH]


def _linked(prints: np.ndarray, start: int) -> Iterator[tuple[int, int]]:
    """Star edges of the links in one bucket: a search that visits each fingerprint once."""
    rest = np.arange(len(prints))
    while len(rest) > 1:
        root, todo, rest = rest[0], [rest[0]], rest[1:]
        while todo and len(rest):
            near = _near(prints[todo.pop()], prints[rest], start)
            if len(near):
                todo += rest[near].tolist()
                for k in rest[near]:
                    yield root, k
                rest = np.delete(rest, near)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key in; edges out. Only the bucket at hand is held."""
    held: list[np.ndarray] = []
    last = None

    def flush(key: int, start: int, parts: list[np.ndarray], out: list) -> None:
        prints = np.unique(np.concatenate(parts))
        if len(prints) > 1:
            out += [(prints[a], prints[b]) for a, b in _linked(prints, start)]

    def give(out: list) -> pa.RecordBatch:
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        start, key = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        prints = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = np.flatnonzero(np.diff(key)) + 1
        out: list = []
        edges = [0, *cuts.tolist(), len(key)]
        for a, b in zip(edges, edges[1:], strict=False):
            if last is not None and last[0] != key[a]:
                if sum(map(len, held)) > 1:
                    flush(*last, held, out)
                held = []
            last = (key[a], int(start[a]))
            held.append(prints[a:b].copy())
        if out:
            yield give(out)
    out = []
    if last is not None and sum(map(len, held)) > 1:
        flush(*last, held, out)
    if out:
        yield give(out)


def simhash_components(prints: DataFrame, most: int = 4096) -> DataFrame:
    """doc_id, fp -> doc_id, fp, component_id: the smallest doc_id reachable over links of at most 4 bits.

    Equal fingerprints are one node, so a group of copies is one row in the search; rows get
    their class back by a join that doesn't gather a group in one task. A bucket gives at most one
    edge per member. Ties: none. Repeated rows (one doc_id twice) are kept. Null doc_id rows are kept
    and name nothing.
    """
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("_n")))
    roots = connected_components(ring_links(distinct.select("fp"), most))
    near = distinct.join(roots, distinct.fp == roots.node).select("fp", "root", "first_id")
    named = cut(near.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("_n")))
    labelled = join_by_key(near, named, ["root"], "inner").select("fp", "component_id")
    every = cut(distinct.join(labelled, "fp", "left").select("fp", "_n", F.coalesce("component_id", "first_id").alias("component_id")))
    return join_by_key(prints, every, ["fp"], "inner").select("doc_id", "fp", "component_id")


def simhash_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint and near-duplicate class.

    Returns doc_id, fingerprint (16 hex digits), component_id. Empty and null texts have
    fingerprint zero and link like any other; texts of any length are read whole; an empty
    table gives an empty result; further columns of docs are ignored, whatever their names.
    """
    prints = cut(simhash_fingerprints(docs, id_col, text_col))
    out = simhash_components(prints)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_duplicates(table(spark, sf_dir, "documents"))
