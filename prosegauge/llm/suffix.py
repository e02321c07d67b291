"""Removal of strings that repeat across documents, by merging Burrows-Wheeler transforms.

Strings of `length` bytes meet by their minimizer, the smallest hash among their k-grams: equal
strings have equal minimizers, so the windows of a text fall into short runs (segments) that can be
dealt out by it, and a minimizer seen in one document alone needs no further look. In each range of
minimizers, equal segments are one; those that share a minimizer with a different segment are split
into shards, each shard's Burrows-Wheeler transform is built, and the transforms are merged by refining
their interleave: a stable sort of the interleave by the symbols before each suffix sorts it two
symbols deeper, without comparing suffixes again. Where a boundary first shows gives the common
prefix of the neighbours; neighbours that share `length` bytes or more form the repeated intervals.

A minimizer that very many different segments share (a passage that stands between other words in each
of a great many documents) would make one range large. Its windows are dealt out one by one, each
by a hash of its own, so equal ones still meet and no range holds more than its share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces_of, table
from .hashing import distinct_sorted, pack_hashes, range_cuts, unpack_hashes

LENGTH = 50
_PRIME = 0x9E3779B97F4A7C15
_FAR = np.int64((1 << 63) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_PRIME))


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k bytes along the last axis, doubling their size step by step."""
    h, size = _BYTE[b], 1
    for bit in bin(k)[3:]:
        n = h.shape[-1] - size
        h = h[..., :n] * np.uint64(pow(_PRIME, size, 1 << 64)) + h[..., size : size + n]
        size *= 2
        if bit == "1":
            n = h.shape[-1] - 1
            h = h[..., :n] * np.uint64(_PRIME) + _BYTE[b[..., size : size + n]]
            size += 1
    return h


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        n = h.shape[-1] - size
        h = np.minimum(h[..., :n], h[..., size:])
        size *= 2
    if w - size:
        n = h.shape[-1] - (w - size)
        h = np.minimum(h[..., :n], h[..., w - size :])
    return h


def gram_size(length: int) -> int:
    return max(1, length // 2 - 1)


def minimizers(b: np.ndarray, length: int) -> np.ndarray:
    """The smallest k-gram hash of each window of `length` bytes, mixed: minima alone crowd near zero and would be dealt unevenly."""
    k = gram_size(length)
    return _mix(sliding_min(gram_hashes(b, k), length - k + 1) + np.uint64(_PRIME))


_BLOCK = 1 << 17
_NONE = np.zeros(0, np.int64)


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """(pieces, their rows, where they start in their texts), about a block at a time; long texts in pieces that overlap by less than a window."""
    held: tuple[list[bytes], list[int], list[int]] = ([], [], [])
    size = 0
    for row, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), _BLOCK):
            piece = text[at : at + _BLOCK + length - 1]
            for part, x in zip(held, (piece, row, at), strict=True):
                part.append(x)
            size += len(piece)
            if size >= _BLOCK:
                yield held
                held, size = ([], [], []), 0
    if size:
        yield held


def runs(texts: list[bytes], length: int) -> list[np.ndarray]:
    """[row, minimizer, identity, first window, windows] of the texts' segments: neighbours alike in minimizer, a bounded number of them.

    Segments that are equal have the same identity; others hardly ever.
    """
    k = gram_size(length)
    most = length - k + 1
    out: list[list[np.ndarray]] = [[_NONE, _NONE.astype(np.uint64), _NONE.astype(np.uint64), _NONE, _NONE]]
    for parts, rows, froms in _pieces(texts, length):
        b = np.frombuffer(b"".join(parts), np.uint8)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        begin = np.cumsum(size) - size
        stop = begin + size - length + 1
        grams = gram_hashes(b, k)
        m = sliding_min(grams, most)
        new = np.empty(len(m), bool)
        new[0] = True
        np.not_equal(m[1:], m[:-1], out=new[1:])
        new[begin] = True
        cut = np.flatnonzero(new)
        which = np.searchsorted(begin, cut, "right") - 1
        n = np.minimum(np.append(cut[1:], len(m)), stop[which]) - cut  # windows that reach into the next piece are none
        cut, which, n = cut[n > 0], which[n > 0], n[n > 0]
        if n.max() > most:
            pieces = -(-n // most)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            cut, n, which = np.repeat(cut, pieces) + nth * most, np.minimum(np.repeat(n, pieces) - nth * most, most), np.repeat(which, pieces)
        mark = (grams[cut] * np.uint64(_PRIME) + grams[cut + n + length - 1 - k]) * np.uint64(_PRIME) + n.astype(np.uint64)
        out.append([np.array(rows, np.int64)[which], _mix(m[cut] + np.uint64(_PRIME)), mark, cut - begin[which] + np.array(froms, np.int64)[which], n])
    return [np.concatenate(x) for x in zip(*out, strict=True)]


# ---- Burrows-Wheeler transforms ----------------------------------------------------------------


class Shard:
    """The transform of a set of strings: for each suffix in order, the two symbols before it (the
    string is read as a ring closed by its end mark, the smallest symbol), its string and place."""

    def __init__(self, strings: list[bytes]):
        order = sorted(range(len(strings)), key=strings.__getitem__)
        sizes = np.array([len(strings[i]) + 1 for i in order], np.int64)
        # UTF-8 has no byte 255, so one more than each byte fits a byte and leaves 0 to the end mark
        symbols = (np.frombuffer(b"\xff".join([*map(strings.__getitem__, order), b""]), np.uint8) + np.uint8(1)).astype(np.uint16)
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        ring = np.repeat(sizes, sizes)
        place = np.arange(len(symbols)) - start
        before = symbols[start + (place - 2) % ring] * np.uint16(256) + symbols[start + (place - 1) % ring]
        # the strings stand in order, so a stable sort puts equal suffixes in the order of their strings
        ranked = np.argsort(_suffix_ranks(symbols, ring - place), kind="stable")
        self.before, self.place = before[ranked], place[ranked]
        self.which = np.repeat(np.array(order, np.int64), sizes)[ranked]


def _suffix_ranks(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes, equal ones alike, by doubling their compared part; left: symbols up to the end mark, that one too."""
    n = len(symbols)
    rank = np.zeros(n, np.int64)
    for k in range(4):
        rank <<= 8
        rank[: n - k] |= np.where(left[: n - k] > k, symbols[k:], 0)
    _, rank = np.unique(rank, return_inverse=True)
    size, known = 4, int(rank.max()) + 1
    while size < int(left.max()):
        pair = (rank + 1) * (n + 1)
        pair[: n - size] += np.where(left[: n - size] > size, rank[size:] + 1, 0)
        _, rank = np.unique(pair, return_inverse=True)
        if int(rank.max()) + 1 == known:
            break
        size, known = size * 2, int(rank.max()) + 1
    return rank


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank in the merged order of each suffix, shard by shard; common prefix of each place with the one before).

    Prefixes are counted in steps of two symbols up to depth; `depth` stands for that or more.
    """
    before = np.concatenate([s.before for s in shards])
    owner = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) <= 256 else np.uint32), [len(s.before) for s in shards])
    n = len(before)
    prefix = np.full(n, depth, np.int32)
    prefix[0] = 0
    block = np.zeros(n, np.int32)
    symbols = np.empty_like(before)
    for step in range(0, depth, 2):
        symbols[np.argsort(owner, kind="stable")] = before
        order = np.argsort(symbols, kind="stable")
        owner, block, sorted_symbols = owner[order], block[order], symbols[order]
        new = np.flatnonzero((sorted_symbols[1:] != sorted_symbols[:-1]) | (block[1:] != block[:-1])) + 1
        prefix[new] = np.minimum(prefix[new], step)
        block[:] = 0
        block[new] = 1
        np.cumsum(block, out=block)
    return np.argsort(owner, kind="stable"), prefix


def shared_least(strings: list[bytes], own: np.ndarray, length: int, shard_bytes: int = 1 << 17) -> list[np.ndarray]:
    """For each window of each string (all different), the least `own` value of the strings that hold it."""
    shards, ids, held, size = [], [], [], 0
    for i, s in enumerate(strings):
        held.append(i)
        size += len(s) + 1
        if size >= shard_bytes or i == len(strings) - 1:
            shards.append(Shard([strings[k] for k in held]))
            ids.append(np.array(held, np.int64))
            held, size = [], 0
    rank, prefix = merge(shards, length)
    which = np.concatenate([i[s.which] for i, s in zip(ids, shards, strict=True)])
    place = np.concatenate([s.place for s in shards])
    interval = np.cumsum(prefix < length)[rank] - 1
    sizes = np.fromiter(map(len, strings), np.int64, len(strings)) - length + 1
    whole = place < sizes[which]
    least = np.full(int(interval.max()) + 1, _FAR)
    np.minimum.at(least, interval[whole], own[which[whole]])
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(int(offsets[-1]), np.int64)
    out[offsets[which[whole]] + place[whole]] = least[interval[whole]]
    return np.split(out, offsets[1:-1])


# ---- dealing out ---------------------------------------------------------------------------------


#: Different segments of one minimizer from which on its windows are dealt out one by one.
CROWD = 20_000


def _zip(x: np.ndarray | bytes) -> bytes:
    return zlib.compress(x if isinstance(x, bytes) else x.tobytes(), 1)


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


class _Chunk:
    """The segments of a chunk's texts, row by row. Rows without an id take no part.

    A chunk is read more than once, and a shuffle hands its rows out in any order: they are put in
    order by id and text, as answers about different segments of one key go by the segments' order.
    """

    def __init__(self, docs: pa.Table, length: int):
        self.length = length
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.texts = [t or b"" for t in docs.column("text").to_pylist()]
        self.ids = docs.column("doc_id").to_pylist()
        self.row, self.value, self.mark, self.start, self.windows = runs([t if i is not None else b"" for t, i in zip(self.texts, self.ids, strict=True)], length)
        self.distinct, self.inverse = np.unique(self.value, return_inverse=True)
        self.id = np.array([0 if i is None else i for i in self.ids], np.int64)

    def spread(self) -> np.ndarray:
        """Of each distinct minimizer: whether it stands in rows of different ids."""
        low, high = np.full(len(self.distinct), _FAR), np.full(len(self.distinct), -_FAR)
        own = self.id[self.row]
        np.minimum.at(low, self.inverse, own)
        np.maximum.at(high, self.inverse, own)
        return low != high

    def kinds(self) -> np.ndarray:
        """Of each distinct minimizer: how many different segments it has here."""
        each = distinct_sorted(self.inverse.astype(np.uint64) << np.uint64(32) | _mix(self.mark) >> np.uint64(32))
        return np.bincount((each >> np.uint64(32)).astype(np.int64), minlength=len(self.distinct))

    def candidates(self, flags: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray, list[tuple[int, int, int]]]:
        """(row, first window, windows, segment) of each run that may repeat; the distinct segments in the order of their keys; their least ids; cuts by range."""
        hit, crowded = np.zeros(len(self.distinct), bool), np.zeros(len(self.distinct), bool)
        at_range = {k: (a, b) for k, a, b in range_cuts(self.distinct, buckets)}
        for k, data, more in zip(*(flags.column(n).to_pylist() for n in ("bucket", "data", "crowded")), strict=True):
            a, b = at_range[k]
            hit[a:b] = _bits(data, b - a)
            crowded[a:b] = _bits(more, b - a)
        chosen = np.flatnonzero(hit[self.inverse])
        alone = crowded[self.inverse[chosen]]
        # runs of crowded minimizers window by window
        one = chosen[alone]
        n = self.windows[one]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        rest = chosen[~alone]
        row = np.concatenate((self.row[rest], np.repeat(self.row[one], n)))
        start = np.concatenate((self.start[rest], np.repeat(self.start[one], n) + nth))
        windows = np.concatenate((self.windows[rest], np.ones(len(nth), np.int64)))
        length, texts = self.length, self.texts
        own = [int.from_bytes(blake2b(texts[r][a : a + length], digest_size=8).digest(), "little") for r, a in zip(row[len(rest) :].tolist(), start[len(rest) :].tolist(), strict=True)]
        key = np.concatenate((self.value[rest], np.array(own, np.uint64)))
        order = np.argsort(key, kind="stable")
        row, start, windows, key = row[order], start[order], windows[order], key[order]
        at: dict[bytes, int] = {}
        segments: list[bytes] = []
        place, spots = np.empty(len(row), np.int64), []
        for first in range(0, len(row), 20_000):
            part = slice(first, first + 20_000)
            for k, (r, a, m) in enumerate(zip(row[part].tolist(), start[part].tolist(), windows[part].tolist(), strict=True), first):
                s = texts[r][a : a + m + length - 1]
                if (seen := at.get(s)) is None:
                    seen = at[s] = len(segments)
                    segments.append(s)
                    spots.append(k)
                place[k] = seen
        least = np.full(len(segments), _FAR)
        np.minimum.at(least, place, self.id[row])
        return row, start, windows, place, segments, least, range_cuts(key[np.array(spots, np.int64)], buckets)


_ASK = "bucket long, chunk long, data binary, marks binary, kinds binary"
_TOLD = "bucket long, chunk long, data binary, crowded binary"
_REPLY = "bucket long, chunk long, data binary"
_SEGMENTS = "bucket long, chunk long, sizes binary, data binary, least binary"


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [(name, pa.int64() if kind == "long" else pa.binary()) for name, kind in (f.split() for f in schema.split(", "))]
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(fields)})


def _ask(docs: pa.Table, buckets: int, length: int) -> pa.Table:
    chunk = _Chunk(docs, length)
    spread, kinds, number = chunk.spread(), np.minimum(chunk.kinds(), 65535).astype(np.uint16), docs.column("chunk")[0].as_py()
    return _rows(_ASK, [(k, number, pack_hashes(chunk.distinct[a:b]), np.packbits(spread[a:b]).tobytes(), _zip(kinds[a:b])) for k, a, b in range_cuts(chunk.distinct, buckets)])


def _answer(asked: pa.Table, crowd: int) -> pa.Table:
    """Which minimizers of a range stand in more than one document (two chunks, or one that says so), and which have very many segments."""
    values = [unpack_hashes(x) for x in asked.column("data").to_pylist()]
    marks = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(v)) for m, v in zip(asked.column("marks").to_pylist(), values, strict=True)]
    kinds = [np.frombuffer(zlib.decompress(x), np.uint16) for x in asked.column("kinds").to_pylist()]
    distinct, inverse = np.unique(np.concatenate(values), return_inverse=True)
    weight = np.bincount(inverse, 1 + np.concatenate(marks), len(distinct))
    crowded = np.bincount(inverse, np.concatenate(kinds), len(distinct)) > crowd
    edges = np.cumsum([len(v) for v in values])[:-1]
    told = zip(np.split((weight > 1)[inverse], edges), np.split(crowded[inverse], edges), strict=True)
    return _rows(_TOLD, [(k, c, np.packbits(t).tobytes(), np.packbits(m).tobytes()) for k, c, (t, m) in zip(asked.column("bucket").to_pylist(), asked.column("chunk").to_pylist(), told, strict=True)])


def _send(docs: pa.Table, flags: pa.Table, buckets: int, length: int) -> pa.Table:
    if not docs.num_rows:
        return _rows(_SEGMENTS, [])
    *_, segments, least, cuts = _Chunk(docs, length).candidates(flags, buckets)
    number = docs.column("chunk")[0].as_py()
    sizes = np.fromiter(map(len, segments), np.uint32, len(segments))
    return _rows(_SEGMENTS, [(k, number, _zip(sizes[a:b]), _zip(b"".join(segments[a:b])), _zip(least[a:b])) for k, a, b in cuts])


def _match(asked: pa.Table, length: int, at_once: int = 1 << 20) -> pa.Table:
    """For each window of each segment that was sent, the least id over all documents that hold it."""
    at: dict[bytes, int] = {}
    strings: list[bytes] = []
    places: list[np.ndarray] = []
    lows: list[np.ndarray] = []
    for sizes, data, low in zip(*(asked.column(n).to_pylist() for n in ("sizes", "data", "least")), strict=True):
        ends = np.cumsum(np.frombuffer(zlib.decompress(sizes), np.uint32)).tolist()
        joined, begin, own = zlib.decompress(data), 0, []
        for end in ends:
            s = joined[begin:end]
            begin = end
            if (k := at.get(s)) is None:
                k = at[s] = len(strings)
                strings.append(s)
            own.append(k)
        places.append(np.array(own, np.int64))
        lows.append(np.frombuffer(zlib.decompress(low), np.int64))
    del at
    least = np.full(len(strings), _FAR)
    np.minimum.at(least, np.concatenate(places), np.concatenate(lows))
    value = np.empty(len(strings), np.uint64)
    for a in range(0, len(strings), 20_000):
        first = np.frombuffer(b"".join(s[:length] for s in strings[a : a + 20_000]), np.uint8).reshape(-1, length)
        value[a : a + 20_000] = minimizers(first, length)[:, 0]
    windows = np.fromiter(map(len, strings), np.int64, len(strings)) - length + 1
    offsets = np.concatenate(([0], np.cumsum(windows)))
    out = np.repeat(least, windows)
    # groups of different segments that share a minimizer, some groups at a time
    order = np.argsort(value, kind="stable")
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(value[order])) + 1, [len(order)]))
    group: list[int] = []
    size = 0

    def settle() -> None:
        if group:
            for k, low in zip(group, shared_least([strings[k] for k in group], least[np.array(group)], length), strict=True):
                out[offsets[k] : offsets[k + 1]] = low

    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a > 1 and windows[order[a:b]].max() > 1:  # single windows, all different, share nothing
            group += order[a:b].tolist()
            size += sum(len(strings[k]) for k in order[a:b])
            if size >= at_once:
                settle()
                group, size = [], 0
    settle()
    rows = []
    for bucket, chunk, own in zip(asked.column("bucket").to_pylist(), asked.column("chunk").to_pylist(), places, strict=True):
        n = windows[own]
        index = np.repeat(offsets[own] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        rows.append((bucket, chunk, _zip(out[index])))
    return _rows(_REPLY, rows)


_COVERED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cover(docs: pa.Table, told: pa.Table, buckets: int, length: int) -> pa.Table:
    """Bytes covered by windows that a smaller id holds too, row by row."""
    chunk = _Chunk(docs, length)
    kind, at = told.column("kind").to_numpy(), told.column("bucket").to_numpy()
    rows, starts, windows, place, segments, _, _ = chunk.candidates(told.take(np.flatnonzero(kind == 0)), buckets)
    lows = told.take(np.flatnonzero(kind == 1)[np.argsort(at[kind == 1], kind="stable")]).column("data").to_pylist()
    low = np.concatenate([np.frombuffer(zlib.decompress(x), np.int64) for x in lows]) if lows else np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)) - length + 1)))
    del segments, told, lows
    hits: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
    by_row = np.argsort(rows, kind="stable")
    for first in range(0, len(by_row), 50_000):
        some = by_row[first : first + 50_000]
        n = windows[some]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        row = np.repeat(rows[some], n)
        gone = low[np.repeat(offsets[place[some]], n) + nth] < chunk.id[row]
        hits.append((row[gone].astype(np.int32), (np.repeat(starts[some], n) + nth)[gone]))
    row, window = np.concatenate([r for r, _ in hits]), np.concatenate([w for _, w in hits])
    del hits, low, place
    cuts = np.searchsorted(row, np.arange(len(chunk.texts) + 1))
    removed, spans, kept = [], [], []
    for k, text in enumerate(chunk.texts):
        w = window[cuts[k] : cuts[k + 1]]
        if not len(w):
            removed.append(0)
            spans.append(0)
            kept.append(text)
            continue
        edge = np.zeros(len(text) + 1, np.int32)
        edge[w] += 1
        edge[w + length] -= 1
        covered = np.cumsum(edge[:-1]) > 0
        removed.append(int(covered.sum()))
        spans.append(int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()))
        kept.append(np.frombuffer(text, np.uint8)[~covered].tobytes())
    return pa.table(
        {
            "doc_id": pa.array(chunk.ids, pa.int64()), "n_bytes": pa.array(list(map(len, chunk.texts)), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary()),
        }
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", chunk_mb: int = 7, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row.

    Texts are UTF-8 bytes, null counts as empty. A byte goes if a string of `length` bytes over it
    also starts in a document with a smaller doc_id, as the input stands; within one document, and
    between rows that share a doc_id, nothing goes. Rows with a null doc_id neither lose bytes
    nor make others lose any. Texts shorter than `length` stay whole, longer ones are read whole, however
    long; repeated rows are treated alike; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    chunks = pieces_of(rows, "text", chunk_mb)
    buckets = 2 * chunks
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))

    def ask(texts: pa.Table) -> pa.Table:
        return _ask(texts, buckets, length)

    def answer(asked: pa.Table) -> pa.Table:
        return _answer(asked, crowd)

    def send(texts: pa.Table, flags: pa.Table) -> pa.Table:
        return _send(texts, flags, buckets, length)

    def match(sent: pa.Table) -> pa.Table:
        return _match(sent, length)

    def cover(texts: pa.Table, told: pa.Table) -> pa.Table:
        return _cover(texts, told, buckets, length)

    flags = rows.groupBy("chunk").applyInArrow(ask, _ASK).groupBy("bucket").applyInArrow(answer, _TOLD)
    sent = rows.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(send, _SEGMENTS)
    lows = sent.groupBy("bucket").applyInArrow(match, _REPLY)
    told = flags.withColumn("kind", F.lit(0)).union(lows.withColumn("crowded", F.lit(None).cast("binary")).withColumn("kind", F.lit(1)))
    return rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(cover, _COVERED)


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT doc_id, i, b[i:i + 49] AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d WHERE octet_length(b) >= 50)
), least AS (
  SELECT s, min(doc_id) AS m FROM w GROUP BY s
), hit AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w JOIN least USING (s) WHERE m < doc_id
), numbered AS (
  SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit
), spans AS (
  SELECT doc_id, r, min(i) AS a, max(i) + 49 AS z FROM numbered GROUP BY doc_id, r
), sums AS (
  SELECT doc_id, count(*) AS n_spans, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, max(z) AS z FROM spans GROUP BY doc_id
), pieces AS (
  SELECT doc_id, a AS spot, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS f, a - 1 AS t FROM spans
  UNION ALL SELECT doc_id, octet_length(b) + 1, z + 1, octet_length(b) FROM sums JOIN d USING (doc_id)
), kept AS (
  SELECT doc_id, string_agg(CASE WHEN f <= t THEN hex(b[f:t]) ELSE '' END, '' ORDER BY spot) AS h FROM pieces JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  CASE WHEN h IS NULL THEN sha256(b) ELSE sha256(unhex(h)) END AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
