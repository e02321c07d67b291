"""The prefix trie of conversations: which turns they share, and what sharing saves.

A node of the trie is a distinct sequence of first turns; its owner is the smallest conversation that
starts with it. If a conversation owns a depth it owns all deeper ones, so each has a first owned depth,
found by binary search: in each round every conversation asks the table of least owners by prefix
digest about one depth, all in one join. What a conversation owns is a chain of nodes, and a chain
hangs on the node before its first one. These chains form a tree with one row a conversation; its
sums go up from chain to chain, one level a round, and a round reads only chains that were handed
something. Within a chain, a running sum from its end upwards gives the numbers of each node.

Turns meet by 128-bit digests; texts are read once, for their digest and length, and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, partitions, table

#: Conversations of one hundred ids start with turns of the first of them.
GROUP = 100
#: Ids in a block of the text that a node's digest is taken of.
BLOCK = 4096


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1, by turn, null first), mark (128 bits of role and text), chars (code points of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(role, F.lit("\x1f"), text)).alias("mark"), F.length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "mark")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), F.unhex("mark").alias("mark"), "chars")


def rebuilt(turns: DataFrame, heads: Column, group: int = GROUP) -> DataFrame:
    """conv_id, depth, mark, chars: the first `heads` turns of conversation conv_id - conv_id % group, then a conversation's own turns after as many; one row of depth 0 for each conversation."""
    own = turns.withColumn("h", heads)
    convs = own.groupBy("conv_id").agg(F.first("h").alias("h"))
    # a head is a handful of turns, so it travels as one row
    first = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") <= 16)).groupBy(F.col("conv_id").alias("base"))
    first = first.agg(F.array_sort(F.collect_list(F.struct("pos", "mark", "chars"))).alias("head"))
    based = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(first, "base", "left")
    based = based.select("conv_id", "h", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<pos:bigint,mark:binary,chars:bigint>>")).alias("head"))
    based = cut(based)
    tops = based.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("mark"), F.lit(0).cast("long").alias("chars"))
    heads_of = based.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.mark", "t.chars")
    missing = based.select(F.col("conv_id"), (F.col("h") - F.size("head")).alias("less"))
    tails = own.where("pos > h").join(missing, "conv_id").select("conv_id", (F.col("pos") - F.col("less")).alias("depth"), "mark", "chars")
    return tops.unionByName(heads_of).unionByName(tails)


def prefixes(rows: DataFrame) -> DataFrame:
    """rows with a, b: 128 bits of the sequence of turns up to each depth. Each turn's hash holds its place, so their xor stands for the sequence."""
    upto = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    digest = [F.bit_xor(F.xxhash64(F.lit(k), "depth", "mark")).over(upto).alias(name) for k, name in ((1, "a"), (2, "b"))]
    return rows.select("conv_id", "depth", "chars", *digest)


def least_owners(prefix: DataFrame) -> DataFrame:
    """a, b, owner (the smallest conversation with that prefix), _n (how many have it)."""
    return prefix.groupBy("a", "b").agg(F.min("conv_id").alias("owner"), F.count("*").alias("_n"))


def first_owned(prefix: DataFrame, owners: DataFrame) -> DataFrame:
    """conv_id, size (its turns), first (the first depth it owns, size + 1 if none), at (the owner of the depth before; null for the conversation that owns the root)."""
    marks = F.array_sort(F.collect_list(F.struct("depth", "a", "b"))).alias("marks")
    convs = cut(prefix.groupBy("conv_id").agg(marks, F.max("depth").alias("size")))
    # depths from low to high are open; the one after the last counts as owned
    state = convs.select("conv_id", F.lit(0).cast("long").alias("low"), (F.col("size") + 1).alias("high"))

    longest, n = convs.agg(F.max("size"), F.count("*")).first()
    longest = longest or 0
    # prefixes of so many conversations that one would be a large task: at most eight for each depth and partition
    crowd = max(8, n // (8 * partitions(prefix.sparkSession)))
    hot, cold = F.broadcast(cut(owners.where(F.col("_n") > crowd).select("a", "b", "owner"))), owners.where(F.col("_n") <= crowd).select("a", "b", "owner")

    def asked(depths: DataFrame) -> DataFrame:
        probes = convs.join(depths, "conv_id").select("conv_id", F.get("marks", F.col("depth").cast("int")).alias("m")).select("conv_id", "m.a", "m.b")
        rare = probes.join(hot, ["a", "b"], "left_anti").join(cold, ["a", "b"])
        return probes.join(hot, ["a", "b"]).select("conv_id", "owner").union(rare.select("conv_id", "owner"))

    middle = F.floor((F.col("low") + F.col("high")) / 2)
    for _ in range(int(longest + 1).bit_length()):
        found = asked(state.where("low < high").select("conv_id", middle.alias("depth")))
        owned = F.col("owner") == F.col("conv_id")
        moved = state.join(found, "conv_id", "left").select(
            "conv_id",
            F.when(owned | F.col("owner").isNull(), F.col("low")).otherwise(middle + 1).cast("long").alias("low"),
            F.when(owned, middle).otherwise(F.col("high")).cast("long").alias("high"),
        )
        state = cut(moved)
    before = asked(state.where("low > 0").select("conv_id", (F.col("low") - 1).alias("depth"))).withColumnRenamed("owner", "at")
    ends = convs.select("conv_id", "size").join(state.select("conv_id", F.col("low").alias("first")), "conv_id")
    return cut(ends.join(before, "conv_id", "left"))


def summed_up(chains: DataFrame, names: list[str]) -> DataFrame:
    """conv_id and the named columns of chains (conv_id, up), summed over each chain and all that hang on it, however deep.

    up is the chain that a chain hangs on, null for the root. A round hands what chains were handed in the
    one before to the chains above, so there are as many rounds as chains nest, and at most as
    many as the longest conversation has turns.
    """
    ups = chains.where("up is not null").select("conv_id", "up")
    handed = lambda rows: cut(rows.groupBy(F.col("up").alias("conv_id")).agg(*(F.sum(n).cast("long").alias(n) for n in names)))
    total, wave = chains.select("conv_id", *names), handed(chains.where("up is not null"))
    while wave.limit(1).count():
        total = total.unionByName(wave)
        wave = handed(wave.join(ups, "conv_id"))
    return total.groupBy("conv_id").agg(*(F.sum(n).cast("long").alias(n) for n in names))


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """owner, depth, conv_id in that order -> owner, depth, first, ids (comma-joined), n: runs of at most `block` ids."""
    held: list[str] = []
    at: tuple[int, int, int] | None = None
    for batch in batches:
        out = []
        for owner, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "conv_id")), strict=True):
            if at is not None and (at[:2] != (owner, depth) or len(held) == block):
                out.append((*at, ",".join(held), len(held)))
                at = None
            if at is None:
                at, held = (owner, depth, conv), []
            held.append(str(conv))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["owner", "depth", "first", "ids", "n"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, ",".join(held), len(held))], ["owner", "depth", "first", "ids", "n"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order -> owner, depth, n_ends, ends_sha256. Only the hash at hand is held, never a node's ids."""
    at, n, digest = None, 0, hashlib.sha256()
    give = lambda out: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["owner", "depth", "n_ends", "ends_sha256"])
    for batch in batches:
        out = []
        for owner, depth, ids, count in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ids", "n")), strict=True):
            if at != (owner, depth):
                if at is not None:
                    out.append((*at, n, digest.hexdigest()))
                at, n, digest = (owner, depth), 0, hashlib.sha256()
            elif n:
                digest.update(b",")
            digest.update(ids.encode())
            n += count
        if out:
            yield give(out)
    if at is not None:
        yield give([(*at, n, digest.hexdigest())])


def end_digests(ends: DataFrame, block: int = BLOCK) -> DataFrame:
    """owner, depth, conv_id (which conversations end at which node) -> owner, depth, n_ends, ends_sha256 (of the ids in order, comma-joined).

    A node at which very many end is parted by id for the sort, and its ids become blocks there; one
    task then hashes only blocks, one after the other, as SHA-256 must.
    """
    parts = partitions(ends.sparkSession)
    ordered = ends.repartitionByRange(parts, "owner", "depth", "conv_id").sortWithinPartitions("owner", "depth", "conv_id")
    blocks = ordered.mapInArrow(partial(_blocks, block=block), "owner long, depth long, first long, ids string, n long")
    dealt = blocks.repartition(parts, "owner", "depth").sortWithinPartitions("owner", "depth", "first")
    return dealt.mapInArrow(_digests, "owner long, depth long, n_ends long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, heads: Column | None = None, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations.

    Returns conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members),
    n_children, n_leaves (childless nodes of the subtree), saved_tokens (over the subtree, members but
    one times code points of the last text), ends_sha256 (ids of the conversations that end there).
    heads: how many turns are taken from the first conversation of the group of `group` ids, at most
    16; by default crc32 of the decimal id, modulo 6.

    Null roles and texts are empty; a null turn comes first; rows alike in conv_id and turn are ordered
    by a digest of role and text, and repeated rows are turns of their own. Rows without conv_id are left
    out. Texts of any length count as a whole. An empty table gives an empty result; further columns are
    ignored, whatever their names.
    """
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6 if heads is None else heads
    turns = cut(turn_rows(conversations))
    prefix = cut(prefixes(rebuilt(turns, heads, group)))
    chains = first_owned(prefix, cut(least_owners(prefix)))
    owns = F.col("first") <= F.col("size")
    ends = end_digests(chains.select(F.when(owns, F.col("conv_id")).otherwise(F.col("at")).alias("owner"), F.col("size").alias("depth"), "conv_id"), block)
    owned = cut(chains.where(owns).select("conv_id", "first", "size", F.col("at").alias("up")))
    nodes = prefix.join(owned, "conv_id").where("depth >= first").select("conv_id", "depth", "chars", "first", "size", "up")
    nodes = cut(nodes.join(ends.withColumnRenamed("owner", "conv_id"), ["conv_id", "depth"], "left").withColumn("n_ends", F.coalesce("n_ends", F.lit(0))))
    # members: ends of a chain and of all chains below it
    members = summed_up(cut(nodes.groupBy("conv_id").agg(F.first("up").alias("up"), F.sum("n_ends").alias("members"))), ["members"])
    hung = owned.join(members, "conv_id").where("up is not null").groupBy(F.col("up").alias("conv_id"), (F.col("first") - 1).alias("depth"))
    hung = hung.agg(F.sum("members").alias("_members"), F.count("*").alias("_chains"))
    upward = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    told = nodes.join(hung, ["conv_id", "depth"], "left").withColumn("n_convs", F.sum(F.col("n_ends") + zero("_members")).over(upward))
    told = cut(told.select("*", (zero("_chains") + (F.col("depth") < F.col("size")).cast("long")).alias("n_children"), ((F.col("n_convs") - 1) * F.col("chars")).alias("own")).drop("_members", "_chains"))
    leaf = (F.col("n_children") == 0).cast("long")
    totals = summed_up(cut(told.groupBy("conv_id").agg(F.first("up").alias("up"), F.sum(leaf).alias("leaves"), F.sum("own").alias("saved"))), ["leaves", "saved"])
    below = owned.join(totals, "conv_id").where("up is not null").groupBy(F.col("up").alias("conv_id"), (F.col("first") - 1).alias("depth"))
    below = below.agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    every = told.join(below, ["conv_id", "depth"], "left")
    return every.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("up")).alias("parent_conv_id"), "n_convs", "n_children",
        F.sum(leaf + zero("_leaves")).over(upward).alias("n_leaves"), F.sum(F.col("own") + zero("_saved")).over(upward).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(31) || coalesce(text, ''))) AS pos,
    md5(coalesce(role, '') || chr(31) || coalesce(text, '')) AS mark, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, xor(4294967295, list_reduce(
      list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda crc, byte: list_reduce(range(8), lambda x, step: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(crc, byte)),
      4294967295)) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), heads AS (
  SELECT c.conv_id, t.pos AS depth, t.mark, t.chars FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos <= c.h
), counted AS (
  SELECT c.conv_id, c.h, count(x.depth) AS held FROM convs c LEFT JOIN heads x USING (conv_id) GROUP BY ALL
), rebuilt AS (
  SELECT conv_id, 0 AS depth, '' AS mark, 0 AS chars FROM convs
  UNION ALL SELECT * FROM heads
  UNION ALL SELECT t.conv_id, t.pos - c.h + c.held, t.mark, t.chars FROM turns t JOIN counted c USING (conv_id) WHERE t.pos > c.h
), prefix AS (
  SELECT conv_id, depth, chars, string_agg(mark, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path, max(depth) OVER (PARTITION BY conv_id) AS size
  FROM rebuilt
), node AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = size) AS ends
  FROM prefix GROUP BY path, depth
), child AS (
  SELECT substr(path, 1, 32 * (depth - 1)) AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n_children, 0) AS n_children
  FROM node n LEFT JOIN node p ON n.depth = p.depth + 1 AND p.path = substr(n.path, 1, 32 * p.depth) LEFT JOIN child c ON c.path = n.path
), subtree AS (
  SELECT substr(path, 1, 32 * d) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM linked, range(depth + 1) r(d) GROUP BY ALL
)
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
  sha256(coalesce(n.ends, '')) AS ends_sha256
FROM linked n JOIN subtree s USING (path)
"""
