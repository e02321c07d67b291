"""Word hashes of many texts at once, in numpy, and hashes packed for the way."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

from .common import LOWER

PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * PRIME)
END = mix(np.array([0xE0F], np.uint64))[0]


def _powers(n: int, at: dict[str, np.ndarray] = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  one table per process
    if "up" not in at or len(at["up"]) < n:
        size = max(n, _BLOCK + 4096)
        for name, base in (("up", PRIME), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            at[name] = np.cumprod(steps, dtype=np.uint64)
    return at["up"][:n], at["down"][:n]


def _block_words(data: bytes) -> np.ndarray:
    """Hashes of the words in a block that starts and ends between words."""
    b = np.frombuffer(data, np.uint8)
    inside = np.empty(len(b) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[b], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[:-1], out=total[1:])
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def word_hash_arrays(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words with an end after each text, places just past those ends)."""
    parts: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    which: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal held, which, size
        if held:
            joined = b"\n".join(held).translate(LOWER)
            hashed = _block_words(joined)
            # words before each text's start: from the starts of words in the joined block
            b = np.frombuffer(joined, np.uint8)
            inside = ~_SPACE[b]
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            ends = np.cumsum([len(t) + 1 for t in held]) - 1
            upto = np.concatenate(([0], np.cumsum(first)))[np.minimum(ends, len(b))]
            n = np.diff(np.concatenate(([0], upto)))
            for k, own in zip(which, np.split(hashed, upto[:-1]), strict=True):
                parts.append((k, own))
            np.add.at(counts, which, n)
        held, which, size = [], [], 0

    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            stop = min(len(text), at + _BLOCK)
            while stop < len(text) and not _SPACE[text[stop]]:
                stop += 1
            if size + stop - at > _BLOCK:
                flush()
            held.append(text[at:stop])
            which.append(k)
            size += stop - at
            at = stop
    flush()
    ends = np.cumsum(counts + 1)
    out = np.empty(int(ends[-1]) if len(texts) else 0, np.uint64)
    at = ends - 1 - counts
    for k, own in parts:
        out[at[k] : at[k] + len(own)] = own
        at[k] += len(own)
    out[ends - 1] = END
    return out, ends



def slices(batches: Iterator[pa.RecordBatch], column: str | int, mb: int = 4) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `mb` MB of that column (or one row)."""
    for batch in batches:
        held = batch.column(column % batch.num_columns if isinstance(column, int) else column)
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(held), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (mb << 20), "right")))
            yield batch.slice(at, stop - at)
            at = stop


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    """As np.unique, by sorting."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def pack_hashes(values: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte plane by byte plane: the middle planes are noise, the others nearly all alike."""
    steps = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    noise, rest = planes[1:5].tobytes(), planes[[0, 5, 6, 7]].tobytes()
    return len(noise).to_bytes(8, "little") + noise + zlib.compress(rest, 1)


def unpack_hashes(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.empty((8, n // 4), np.uint8)
    planes[1:5] = np.frombuffer(data, np.uint8, n, 8).reshape(4, -1)
    planes[[0, 5, 6, 7]] = np.frombuffer(zlib.decompress(data[8 + n :]), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


def range_cuts(values: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, first, last) of the ranges of hash space that sorted values fall into; empty ranges cost nothing."""
    if not len(values):
        return []
    which = ((values >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    edges = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(values)]
    return [(int(which[a]), a, b) for a, b in zip(edges, edges[1:], strict=False)]
