"""Language-model scoring with a weighted backoff automaton.

States are the histories seen in training: the empty one (the root), words, pairs of words. A
state's arcs are the words seen after it, each with its weight and the state it leads to (the longest
history that the read words end in); its failure arc leads to the history without its first word.
The root has an arc for every word. With Dirichlet smoothing of strength K over the shorter
history's distribution, the arc of w at state h weighs (c(hw) + K p(w | h')) / (c(h) + K), and the
failure arc K / (c(h) + K), so the weights out of a state sum to one. A text is read once from left
to right: the state is carried from word to word, failure arcs are followed until the state has
the word's arc, and log-weights add up.

The automaton grows with the corpus and is never gathered in one place. Texts are dealt into chunks,
and a chunk builds the part that its own texts can reach: it asks for the counts of its own distinct
n-grams. Requests and training counts go, sorted and packed, to ranges of the n-gram space, are
summed there, and the sums return in the order asked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces_of, table
from .hashing import END, PRIME, mix, pack_hashes, range_cuts, slices, unpack_hashes, word_hash_arrays

K = 32.0
BEGIN = mix(np.array([0xB0F], np.uint64))[0]
_KEPT = ~np.uint64(0xFF)


# ---- packing: texts and counts on their way --------------------------------------------------------


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts below 255 as one byte each, the others after them."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return zlib.compress(len(small).to_bytes(8, "little") + small.tobytes() + counts[small == 255].astype(np.int64).tobytes(), 1)


def _unpack_counts(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    n = int.from_bytes(raw[:8], "little")
    counts = np.frombuffer(raw, np.uint8, n, 8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw[8 + n :], np.int64)
    return counts


def _chunked(batches: Iterator[pa.RecordBatch], chunks: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text, held_out, chunk -> a row for each chunk with its rows of the batch, the texts compressed."""
    for batch in batches:
        chunk = batch.column("chunk").to_numpy()
        order = np.argsort(chunk, kind="stable")
        edges = [0, *(np.flatnonzero(np.diff(chunk[order])) + 1).tolist(), len(order)]
        rows: list[tuple] = []
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            own = batch.take(pa.array(order[a:b]))
            texts = [t or b"" for t in own.column("text").cast(pa.binary()).to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            rows.append((int(chunk[order[a]]), own.column("doc_id").to_pylist(), own.column("held_out").to_pylist(), sizes.tolist(), zstandard.compress(b"".join(texts), 3)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.bool_())), pa.array([r[3] for r in rows], pa.list_(pa.int64())), pa.array([r[4] for r in rows], pa.binary())],
            ["chunk", "ids", "held", "sizes", "data"],
        )


_CHUNK = "chunk long, ids array<long>, held array<boolean>, sizes array<long>, data binary"


def _texts(chunk: pa.Table) -> tuple[list, np.ndarray, list[bytes]]:
    """(ids, held_out, texts) of a chunk's rows."""
    ids: list = []
    held: list[bool] = []
    texts: list[bytes] = []
    for own, out, sizes, data in zip(*(chunk.column(n).to_pylist() for n in ("ids", "held", "sizes", "data")), strict=True):
        ids += own
        held += out
        raw, at = zstandard.decompress(data), 0
        for n in sizes:
            texts.append(raw[at : at + n])
            at += n
    return ids, np.array(held, bool), texts


# ---- n-grams and their counts ---------------------------------------------------------------------


class Grams:
    """The distinct words, pairs and triples of some texts, each level sorted by hash, and where they stand.

    Every text begins with BEGIN before its first word and ends with END; a triple is a pair and the word after it.
    Pairs and triples are most of what is sent, so of their hashes 56 bits are kept.
    """

    def __init__(self, texts: list[bytes]):
        self.tokens, self.ends = word_hash_arrays(texts)
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = BEGIN
        pair = mix(before * PRIME + self.tokens * np.uint64(0xC2B2AE3D27D4EB4F)) & _KEPT
        before[1:] = pair[:-1]
        triple = mix(before * PRIME + self.tokens * np.uint64(0x165667B19E3779F9)) & _KEPT
        del before
        self.has_triple = np.ones(len(pair), bool)
        self.has_triple[self.starts] = False  # the first word has no pair before it
        levels = (self.tokens, pair, triple[self.has_triple])
        self.distinct, self.places = zip(*(np.unique(x, return_inverse=True) for x in levels), strict=True)

    def counts(self, train: np.ndarray) -> list[np.ndarray]:
        """How often each distinct n-gram stands in the texts marked in train."""
        marked = np.repeat(train, self.ends - self.starts)
        marks = (marked, marked, marked[self.has_triple])
        return [np.bincount(p[m], minlength=len(d)) for d, p, m in zip(self.distinct, self.places, marks, strict=True)]


_REQUEST = "bucket long, chunk long, grams binary, counts binary"
_REQUEST_ARROW = {"bucket": pa.int64(), "chunk": pa.int64(), "grams": pa.binary(), "counts": pa.binary()}


def _requests(chunk: int, levels: list[tuple[int, np.ndarray, np.ndarray]], ranges: int) -> pa.Table:
    """A row for each level and range that is not empty."""
    rows = [(3 * k + level, chunk, pack_hashes(grams[a:b]), _pack_counts(counts[a:b])) for level, grams, counts in levels for k, a, b in range_cuts(grams, ranges)]
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(_REQUEST_ARROW.items())})


def _ask(chunk: pa.Table, ranges: int) -> pa.Table:
    """A chunk's requests: its distinct n-grams, with their counts in its training texts."""
    _, held, texts = _texts(chunk)
    grams = Grams(texts)
    return _requests(chunk.column("chunk")[0].as_py(), list(zip(range(3), grams.distinct, grams.counts(~held), strict=True)), ranges)


def _words_only(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Distinct training words of each batch with their counts, by range."""
    for batch in slices(batches, "text", 16):
        tokens, _ = word_hash_arrays([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
        distinct, counts = np.unique(tokens, return_counts=True)
        yield from _requests(0, [(0, distinct, counts)], ranges).to_batches()


def _sum(asked: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """(corpus counts of the distinct n-grams asked for; for each request, which of them it asked)."""
    grams = [unpack_hashes(x) for x in asked.column("grams").to_pylist()]
    counts = [_unpack_counts(x) for x in asked.column("counts").to_pylist()]
    distinct, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    return np.bincount(inverse, np.concatenate(counts), len(distinct)).astype(np.int64), np.split(inverse, np.cumsum([len(g) for g in grams])[:-1])


def _totals(asked: pa.Table) -> pa.Table:
    counts, _ = _sum(asked)
    return pa.table({"n": pa.array([int(counts.sum())], pa.int64()), "v": pa.array([int((counts > 0).sum())], pa.int64())})


def _answer(asked: pa.Table) -> pa.Table:
    """For each chunk that asked, the corpus counts of its n-grams in this range, in its own order."""
    counts, places = _sum(asked)
    return pa.table({"bucket": asked.column("bucket"), "chunk": asked.column("chunk"), "counts": pa.array([_pack_counts(counts[p]) for p in places], pa.binary())})


# ---- the automaton -------------------------------------------------------------------------------


class Automaton:
    """The part of the backoff automaton that some texts can reach.

    States: 0 is the root, then BEGIN, then the words, then the pairs seen in training. Arcs are
    sorted by (state, word); weight and target lie beside them. Words are numbers of the texts' own
    distinct words.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], n: int, v: int, strength: float):
        one, two, three = counts
        words, pairs, _ = grams.distinct
        self.n_words = len(words)
        word, pair = grams.places[0], grams.places[1]
        # what each distinct pair and triple is made of, from any place where it stands
        previous = np.empty_like(word)
        previous[1:] = word[:-1]
        previous[grams.starts] = -1
        head, tail = np.empty(len(pairs), np.int64), np.empty(len(pairs), np.int64)
        head[pair], tail[pair] = previous, word
        at = np.flatnonzero(grams.has_triple)
        first, last = np.empty(len(grams.distinct[2]), np.int64), np.empty(len(grams.distinct[2]), np.int64)
        first[grams.places[2]], last[grams.places[2]] = pair[at - 1], pair[at]
        end = int(np.searchsorted(words, END)) if len(words) else 0
        begun = int(one[end]) if len(words) else 0  # training texts begin as often as they end

        n_states = 2 + len(words) + len(pairs)
        state_of_word = np.where(one > 0, 2 + np.arange(len(words)), 0)
        state_of_pair = np.where(two > 0, 2 + len(words) + np.arange(len(pairs)), 0)
        self.begin = 1 if begun else 0
        seen = np.concatenate(([0, begun], one, two)).astype(np.float64)
        self.fail_weight = np.log10(strength / (seen + strength))
        self.fail = np.concatenate(([0, 0], np.zeros(len(words), np.int64), state_of_word[tail]))

        p1 = (one + 1) / (n + v + 1)
        seen_before = np.where(head >= 0, one[head], begun)
        p2 = (two + strength * p1[tail]) / (seen_before + strength)
        p3 = (three + strength * p2[last]) / (two[first] + strength)
        kept2, kept3 = two > 0, three > 0
        state = np.concatenate((np.zeros(len(words), np.int64), np.where(head >= 0, 2 + head, 1)[kept2], (2 + len(words) + first)[kept3]))
        symbol = np.concatenate((np.arange(len(words)), tail[kept2], tail[last][kept3]))
        weight = np.log10(np.concatenate((p1, p2[kept2], p3[kept3])))
        target = np.concatenate((state_of_word, state_of_pair[kept2], state_of_pair[last][kept3]))
        key = state * max(1, self.n_words) + symbol
        order = np.argsort(key, kind="stable")
        self.key, self.weight, self.target = key[order], weight[order], target[order]
        assert n_states == len(self.fail)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, log-weights) of reading one word in each of many states."""
        score = np.zeros(len(state))
        nxt = np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            want = state[left] * self.n_words + word[left]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            found = self.key[at] == want
            hit, arc = left[found], at[found]
            score[hit] += self.weight[arc]
            nxt[hit] = self.target[arc]
            left = left[~found]
            score[left] += self.fail_weight[state[left]]
            state[left] = self.fail[state[left]]
        return nxt, score

    def read(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 512) -> np.ndarray:
        """The log-weight of each text, all read side by side, a word of each at a time.

        A state depends on the last two words alone, so a long text is read as several lanes (of two words or more): each
        begins two words early, without counting these, and is in the right state when its own begin.
        """
        pieces = -(-(ends - starts) // lane)
        text = np.repeat(np.arange(len(starts)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[text] + nth * lane
        stop = np.minimum(begin + lane, ends[text])
        at = np.where(nth > 0, begin - 2, begin)
        state = np.where(nth > 0, 0, self.begin)
        order = np.argsort(at - stop, kind="stable")  # the longest first
        at, stop, begin, state = at[order], stop[order], begin[order], state[order]
        total = np.zeros(len(at))
        running = len(at)
        while running:
            nxt, score = self.step(state[:running].copy(), words[at[:running]])
            total[:running] += np.where(at[:running] >= begin[:running], score, 0)
            state[:running] = nxt
            at[:running] += 1
            while running and at[running - 1] >= stop[running - 1]:
                running -= 1
        out = np.zeros(len(starts))
        np.add.at(out, text[order], total)
        return out


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(chunk: pa.Table, answers: pa.Table, n: int, v: int, strength: float) -> pa.Table:
    """One traversal of the automaton for each text of a chunk."""
    ids, held, texts = _texts(chunk)
    grams = Grams(texts)
    del texts
    bucket = answers.column("bucket").to_numpy()
    data = answers.column("counts")
    counts = []
    for level in range(3):
        at = np.flatnonzero(bucket % 3 == level)
        told = [_unpack_counts(data[int(i)].as_py()) for i in at[np.argsort(bucket[at], kind="stable")]]
        counts.append(np.concatenate(told) if told else np.zeros(0, np.int64))
    words = counts[0][grams.places[0]]
    total = lambda x: np.add.reduceat(x, grams.starts) if len(grams.starts) else x[:0]
    score = Automaton(grams, counts, n, v, strength).read(grams.places[0], grams.starts, grams.ends)
    return pa.table(
        {
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held), "n_tokens": pa.array(grams.ends - grams.starts),
            "n_known": pa.array(total((words > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(ids), n)),
            "base_score": pa.array(total(np.log10((words + 1) / (n + v + 1)))), "score": pa.array(score),
        }
    )


def score_texts(docs: DataFrame, folds: int = 7, fold: int = 2, strength: float = K, id_col: str = "doc_id", text_col: str = "text", chunk_mb: int = 6) -> DataFrame:
    """Log10 probability of every text under the automaton of the training texts.

    Training texts are those whose crc32(doc_id as text) mod `folds` is not `fold`. Null texts are
    empty: one end. Repeated rows are scored each, and count each in training. A null doc_id has
    the checksum of the empty string. Texts of any length are read whole, a text longer than chunk_mb as a chunk
    of its own size. An empty table gives an empty result; with no training text
    at all every word is unseen. Other columns are ignored. Words are compared by 64-bit hashes, longer n-grams by 56 bits.
    """
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), held_out.alias("held_out"))
    chunks = pieces_of(rows, "text", chunk_mb)
    words = rows.where(~F.col("held_out")).select("text").mapInArrow(partial(_words_only, ranges=chunks), _REQUEST)
    n, v = words.groupBy("bucket").applyInArrow(_totals, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def ask(chunk: pa.Table) -> pa.Table:
        return _ask(chunk, chunks)

    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        return _score(chunk, answers, n, v, strength)

    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).mapInArrow(partial(_chunked, chunks=chunks), _CHUNK)
    answers = dealt.groupBy("chunk").applyInArrow(ask, _REQUEST).groupBy("bucket").applyInArrow(_answer, "bucket long, chunk long, counts binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, _SCORED)


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
