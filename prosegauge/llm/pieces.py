"""Encoding and decoding with a SentencePiece vocabulary by shared-prefix Viterbi.

Distinct marked words are sorted, which lays them out as a depth-first walk of their trie: from one
word to the next only the part after the common prefix is new, and the forward scores of that
prefix are reused. A unigram vocabulary takes the best sum of piece scores. A vocabulary of merges
(BPE) has no such sum: there a piece may only follow a piece it can stand beside, which leaves
exactly one path to each prefix, the one that merging gives.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from .common import map_rows, table, unused
from .hashing import slices

MARK = "▁"
#: Numbers from here on stand for signs that are no piece.
_SIGN = 1 << 21
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of each field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[at]
            out |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return out, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else (8 if kind == 1 else 4, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, kind, value


class Pieces:
    """A vocabulary file: pieces, scores, and what the encoder has to know of them."""

    def __init__(self, data: bytes):
        self.texts: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model_type, self.dummy, self.squeeze = 1, True, True
        for number, _, value in _fields(data):
            if number == 1:
                piece: dict[int, bytes | int] = {n: v for n, _, v in _fields(value)}
                self.texts.append(piece.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(piece.get(3, 1))
            elif number == 2:
                self.model_type = {n: v for n, _, v in _fields(value)}.get(3, 1)
            elif number == 3:
                spec = {n: v for n, _, v in _fields(value)}
                self.dummy, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2):
                    raise ValueError("vocabularies with a table of character rewrites are not supported")
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k in (1, 4, 5)}
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == 6}
        self.unknown = self.kinds.index(2) if 2 in self.kinds else 0
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("pieces that span a space between words are not supported")
        self.merges = self.model_type == 2
        self.pairs: dict[int, bool] = {}
        self.courses: dict[int, tuple[list[float], list[str], list[str]] | None] = {}
        #: Lengths of the pieces that end in two given signs, the longest first.
        ends: dict[str, set[int]] = {}
        for t in self.ids:
            if len(t) > 1:
                ends.setdefault(t[-2:], set()).add(len(t))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.raw = [bytes([int(t[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else t.replace(MARK, " ").encode() for t, k in zip(self.texts, self.kinds, strict=True)]
        # white space that no piece holds parts words too: nothing merges across it
        held = set("".join(self.ids))
        bars = "".join(c for c in "\n\r\t" if c not in held)
        self.parts = re.compile(f"{MARK}*[^{MARK}{bars}]+|{MARK}+" + (f"|[{bars}]" if bars else ""))

    def marked(self, text: str) -> list[str]:
        """The text's words, each with the marks (spaces) before it."""
        if self.squeeze:
            text = " ".join(text.split(" ")).strip(" ")
            text = re.sub(" +", " ", text)
        if not text:
            return []
        return self.parts.findall((MARK if self.dummy else "") + text.replace(" ", MARK))

    def _spelt(self, i: int) -> str:
        return self.texts[i] if i < _SIGN else chr(i - _SIGN)

    def _course(self, i: int) -> tuple[list[float], list[str], list[str]] | None:
        """How piece i comes about from its signs: the score of each merge, and the first and last part before each and at the end."""
        if i in self.courses:
            return self.courses[i]
        whole = self._spelt(i)
        parts, gains, firsts, lasts = list(whole), [], [whole[0]], [whole[-1]]
        while len(parts) > 1:
            best, where = None, -1
            for k in range(len(parts) - 1):
                if (m := self.ids.get(parts[k] + parts[k + 1])) is not None and (best is None or self.scores[m] > best):
                    best, where = self.scores[m], k
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
            gains.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        self.courses[i] = (gains, firsts, lasts) if len(parts) == 1 else None
        return self.courses[i]

    def beside(self, a: int, b: int) -> bool:
        """Whether merging the signs of pieces a and b gives the two again.

        Each piece's own merges go on in their order; the best-scored next one, the leftmost of
        equals, is due. The two stay apart if a merge across their border is never due.
        """
        key = a << 24 | b
        if (got := self.pairs.get(key)) is None:
            one, two = self._course(a), self._course(b)
            got = one is not None and two is not None
            x = y = 0
            while got:
                left = one[0][x] if x < len(one[0]) else None
                right = two[0][y] if y < len(two[0]) else None
                m = self.ids.get(one[2][x] + two[1][y])
                across = None if m is None else self.scores[m]
                if left is not None and (across is None or left >= across) and (right is None or left >= right):
                    x += 1
                elif across is not None and (right is None or across >= right):
                    got = False
                elif right is not None:
                    y += 1
                else:
                    break
            if len(self.pairs) < 400_000:
                self.pairs[key] = got
        return got

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids (32-bit, as bytes) of each distinct word, by a depth-first walk of the sorted words' trie."""
        out: dict[str, bytes] = {}
        before = ""
        # state j: the last piece of the path to prefix j, where it starts, and the path's forward score
        last, starts, forward = [-1], [-1], [0.0]
        ids, scores, lengths, merges, beside, pairs = self.ids, self.scores, self.lengths, self.merges, self.beside, self.pairs
        for word in sorted(words):
            common = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                common += 1
            del last[common + 1 :], starts[common + 1 :], forward[common + 1 :]
            for j in range(common + 1, len(word) + 1):
                best, piece, start = None, -1, -1
                for n in (*lengths.get(word[j - 2 : j], ()), 1) if j > 1 else (1,):
                    if n > j:
                        continue
                    k = j - n
                    if (i := ids.get(word[k:j])) is None:
                        if n > 1:
                            continue
                        i, gain = _SIGN + ord(word[k]), -1e4
                    else:
                        gain = scores[i]
                    if merges:
                        if k and not (pairs[key] if (key := last[k] << 24 | i) in pairs else beside(last[k], i)):
                            continue
                        best, piece, start = forward[k] + gain, i, k
                        break
                    if best is None or forward[k] + gain > best:
                        best, piece, start = forward[k] + gain, i, k
                last.append(piece)
                starts.append(start)
                forward.append(best)
            path, j = [], len(word)
            while j:
                if (i := last[j]) < _SIGN:
                    path.append(i)
                elif self.bytes:
                    path += [self.bytes[b] for b in reversed(chr(i - _SIGN).encode())]
                else:
                    path.append(self.unknown)
                j = starts[j]
            out[word] = array("i", path[::-1]).tobytes()
            before = word
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw[1:] if self.dummy and raw.startswith(b" ") else raw

    def decode(self, ids: list[int]) -> str:
        """Text of a sequence of ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode(errors="replace")


#: One vocabulary per worker process and file.
_LOADED: dict[int, Pieces] = {}


def _pieces(held: object) -> Pieces:
    data = held.value
    if (key := hash(data)) not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(data)
    return _LOADED[key]


def _encode(batches: Iterator[pa.RecordBatch], held: object, decoded: bool = False, mb: int = 3, memo_most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Rows, of which the last column is the text, with their ids. Words are settled in batches of `mb` MB of text (or one text); the most frequent ones, which come early, are kept."""
    vocabulary = _pieces(held)
    memo: dict[str, bytes] = {}
    for batch in slices(batches, -1, mb):
        marked = [vocabulary.marked(t.as_py()) if t.is_valid else [] for t in batch.column(batch.num_columns - 1)]
        distinct = {w for words in marked for w in words}
        fresh = vocabulary.encode_words([w for w in distinct if w not in memo])
        now = {w: fresh[w] if w in fresh else memo[w] for w in distinct}
        if len(memo) < memo_most:
            memo |= fresh
        data = [b"".join(map(now.__getitem__, words)) for words in marked]
        del marked, distinct, fresh, now
        ends = np.cumsum([0, *(len(x) // 4 for x in data)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(data), np.int32)))
        names, columns = batch.schema.names[:-1], batch.columns[:-1]
        if decoded:
            columns.append(pa.array([vocabulary.decode(np.frombuffer(x, np.int32).tolist()) for x in data], pa.string()))
            names = [*names, "decoded"]
        yield pa.RecordBatch.from_arrays([*columns, lists], [*names, "ids"])


def _decode(batches: Iterator[pa.RecordBatch], held: object) -> Iterator[pa.RecordBatch]:
    """Rows, of which the last column is the ids, with their text."""
    vocabulary = _pieces(held)
    for batch in batches:
        texts = [None if ids is None else vocabulary.decode(ids) for ids in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "decoded"])


def load_vocabulary(df: DataFrame, path: str = TOKENIZER) -> object:
    """The vocabulary file, read on the driver and broadcast (its size is fixed)."""
    with open(path, "rb") as f:
        data = f.read()
    Pieces(data)
    return df.sparkSession.sparkContext.broadcast(data)


def encode_pieces(docs: DataFrame, path: str = TOKENIZER, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """docs with a column ids (array of int): the whole text's pieces; null and empty texts have none.

    With decoded, also a column decoded: the text that the ids give again. Texts of any length are
    encoded whole; a text of many MB is a batch of its own. Repeated rows are encoded alike; an empty
    table gives an empty result; columns of docs named ids (or decoded) are replaced, all others
    stay, whatever their names.
    """
    rows = docs.drop("ids", "decoded") if decoded else docs.drop("ids")
    held, text = load_vocabulary(docs, path), unused(rows, "_text")
    more = [*[StructField("decoded", StringType())] * decoded, StructField("ids", ArrayType(IntegerType()))]
    return map_rows(rows.withColumn(text, F.col(text_col).cast("string")), partial(_encode, held=held, decoded=decoded), *more)


def decode_pieces(df: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """df (with a column ids) and a column decoded: the text of the ids; null ids give null.

    A column of df named decoded is replaced, all others stay. Ids of any number are decoded whole; repeated
    rows alike; an empty table gives an empty result.
    """
    held, rows = load_vocabulary(df, path), df.drop("decoded")
    ids = unused(rows, "_ids")
    return map_rows(rows.withColumn(ids, F.col("ids")), partial(_decode, held=held), StructField("decoded", StringType()))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_pieces(docs, decoded=True)
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), digest.alias("ids_sha256"), same.alias("round_trip"))
