"""Fill-in-middle rows by a table-driven byte automaton.

One automaton reads UTF-8 bytes: continuation bytes belong to the code point before them, a unit
begins at a letter that follows no letter and at any other code point, and three bytes make a
sentinel. Its table gives the next state of each state and class of bytes. After three bytes the state
is the same wherever the automaton began, so many lanes of bytes are read side by side, each
started three bytes early. The first pass counts how often each text takes each transition, and the
units that begin in each lane; a second pass reads those lanes again in which a cut falls, and finds
its byte. The automaton's lanes, not the texts, are in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .hashing import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Rows whose third draw is this or more, of 100, stay plain.
TURNED = 90
#: Of the others, those whose fourth draw is below this, of 100, put the suffix first.
SUFFIX_FIRST = 20

#: Classes of bytes. 0xFF is in no UTF-8 text: it stands between texts.
LETTER, NAME, OPEN, CLOSE, CONTINUED, OTHER, END = range(7)
#: States: elsewhere, in a word, after "<", after "<" and a sentinel's letter.
AWAY, WORD, OPENED, NAMED = range(4)
CLASSES, STATES = 7, 4
#: Bytes after which the state no longer depends on where the automaton began.
FORGETS = 3
LANE = 256


def _classes() -> np.ndarray:
    of = np.full(256, OTHER, np.uint8)
    for b in range(256):
        if chr(b).isascii() and chr(b).isalpha():
            of[b] = NAME if chr(b) in "PSM" else LETTER
        elif 0x80 <= b < 0xC0:
            of[b] = CONTINUED
    of[ord("<")], of[ord(">")], of[0xFF] = OPEN, CLOSE, END
    return of


def _steps() -> np.ndarray:
    """Next state by state and class."""
    to = np.full((STATES, CLASSES), AWAY, np.uint8)
    to[:, [LETTER, NAME]] = WORD
    to[:, OPEN] = OPENED
    to[OPENED, NAME] = NAMED
    return to


CLASS_OF, STEP = _classes(), _steps()
NEXT = STEP.reshape(-1)
#: Which transitions begin a unit, begin a code point, end a sentinel.
UNIT, POINT, SENTINEL = (np.zeros((STATES, CLASSES), bool) for _ in range(3))
UNIT[:, [OPEN, CLOSE, OTHER]] = True
UNIT[np.ix_([AWAY, OPENED], [LETTER, NAME])] = True
POINT[:, [LETTER, NAME, OPEN, CLOSE, OTHER]] = True
SENTINEL[NAMED, CLOSE] = True
UNIT, POINT, SENTINEL = UNIT.reshape(-1), POINT.reshape(-1), SENTINEL.reshape(-1)


def transitions(data: np.ndarray, starts: np.ndarray, width: int = LANE) -> np.ndarray:
    """The transitions taken in lanes of `width` bytes, one row a lane; past the end, END from AWAY."""
    at = starts[:, None] + np.arange(-FORGETS, width)
    inside = (at >= 0) & (at < len(data))
    kinds = np.where(inside, CLASS_OF[data[np.where(inside, at, 0)]] if len(data) else END, END).astype(np.uint8).T
    state = np.zeros(len(starts), np.uint8)
    out = np.empty((width, len(starts)), np.uint8)
    for k, kind in enumerate(np.ascontiguousarray(kinds)):
        taken = state * np.uint8(CLASSES) + kind
        state = NEXT[taken]
        if k >= FORGETS:
            out[k - FORGETS] = taken
    return out.T


class Scan:
    """Both passes over some texts: counted transitions of each text, then the bytes of its cuts."""

    def __init__(self, texts: list[bytes], lanes: int = 4096):
        self.data = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
        self.ends = np.cumsum([len(t) + 1 for t in texts]) - 1  # of the byte between texts
        starts = np.arange(0, len(self.data), LANE)
        self.counts = np.zeros((len(texts), STATES * CLASSES), np.int64)
        begun = np.zeros(len(starts) + 1, np.int64)
        before_end = np.zeros(len(texts), np.int64)
        size = STATES * CLASSES
        for k in range(0, len(starts), lanes):
            part = starts[k : k + lanes]
            taken = transitions(self.data, part)
            begins = UNIT[taken]
            begun[k + 1 : k + 1 + len(part)] = begins.sum(axis=1)
            first, stop = part[0], min(len(self.data), part[-1] + LANE)
            flat, flat_begins = taken.reshape(-1)[: stop - first], begins.reshape(-1)[: stop - first]
            own = np.searchsorted(self.ends, [first, stop - 1])
            inner = self.ends[own[0] : own[1] + 1]
            inner = inner[inner < stop]
            owner = np.repeat(np.arange(len(inner) + 1), np.diff(np.concatenate(([first], inner + 1, [stop]))))
            counted = np.bincount(owner * size + flat, minlength=(len(inner) + 1) * size).reshape(-1, size)
            upto = min(len(texts), own[0] + len(counted)) - own[0]
            self.counts[own[0] : own[0] + upto] += counted[:upto]
            so_far = np.cumsum(flat_begins)
            before_end[own[0] : own[0] + len(inner)] = so_far[inner - first]
            before_end[own[0] : own[0] + len(inner)] += int(begun[: k + 1].sum())
        self.begun = np.cumsum(begun)
        self.first = np.concatenate(([0], before_end[:-1])) if len(texts) else before_end
        self.units = self.counts @ UNIT
        self.sentinels = self.counts @ SENTINEL

    def places(self, text: np.ndarray, unit: np.ndarray, lanes: int = 4096) -> np.ndarray:
        """The byte, counted from its text's start, at which each text's unit with that number begins; its end for the number of its units."""
        where = np.where(text > 0, self.ends[text - 1] + 1, 0)
        out = self.ends[text] - where
        asked = np.flatnonzero(unit < self.units[text])
        for k in range(0, len(asked), lanes):
            some = asked[k : k + lanes]
            number = self.first[text[some]] + unit[some]  # among all units of the scan
            lane = np.searchsorted(self.begun, number, "right") - 1
            begins = UNIT[transitions(self.data, lane * LANE)]
            within = np.cumsum(begins, axis=1) == (number - self.begun[lane] + 1)[:, None]
            out[some] = lane * LANE + within.argmax(axis=1) - where[some]
        return out


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that follow from a document's id alone; a null id counts as no digits."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4))


def turned(ids: list[int | None], texts: list[bytes], scan: Scan) -> tuple[list[str], list[bytes], list[int | None], list[int | None]]:
    """(forms, outputs, code points of prefixes, of middles)."""
    drawn = np.array([draws(i) for i in ids], np.int64).reshape(-1, 4)
    n = scan.units
    one, two = drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1)
    plain = (n == 0) | (scan.sentinels > 0) | (drawn[:, 2] % 100 >= TURNED)
    late = drawn[:, 3] % 100 < SUFFIX_FIRST
    which = np.flatnonzero(~plain)
    a = scan.places(which, np.minimum(one, two)[which]).tolist()
    b = scan.places(which, np.maximum(one, two)[which]).tolist()
    forms, outputs = ["plain"] * len(ids), list(texts)
    prefix_chars: list[int | None] = [None] * len(ids)
    middle_chars: list[int | None] = [None] * len(ids)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    for k, x, y in zip(which.tolist(), a, b, strict=True):
        prefix, middle, suffix = texts[k][:x], texts[k][x:y], texts[k][y:]
        forms[k] = "spm" if late[k] else "psm"
        outputs[k] = b"".join((s, suffix, p, prefix, m, middle) if late[k] else (p, prefix, s, suffix, m, middle))
        prefix_chars[k], middle_chars[k] = len(prefix.decode()), len(middle.decode())
    return forms, outputs, prefix_chars, middle_chars


def _turned(batches: Iterator[pa.RecordBatch], mb: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", mb):
        ids, texts = batch.column("doc_id").to_pylist(), [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        scan = Scan(texts)
        forms, outputs, prefix_chars, middle_chars = turned(ids, texts, scan)
        columns = [batch.column("doc_id"), pa.array(scan.units), pa.array(forms), pa.array(prefix_chars, pa.int64()), pa.array(middle_chars, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mb: int = 4) -> DataFrame:
    """Every row of docs as a training row with its middle moved to the end.

    Returns doc_id, n (units: words of letters, single other characters), form (plain, psm or spm),
    prefix_chars, middle_chars (code points; null if plain), output. Cuts and form follow from doc_id and
    n alone, so a rerun or a lost executor changes nothing, and rows alike in id and text give the
    same row each. A null text counts as empty and is plain; texts with a sentinel are plain; texts of any
    length are read whole, in batches of `mb` MB or one text. A null id draws as one of no digits. An empty
    table gives an empty result; further columns are ignored, whatever their names. No shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_turned, mb=mb), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from.

    No sentinel stands in a text that was turned, and none can arise where one is put beside a text: it
    begins with the only "<" it has and ends with its only ">". Its first place is therefore its only one.
    """
    left = F.split(F.substr(output, F.lit(len(PREFIX) + 1)), F.when(form == "psm", SUFFIX).otherwise(PREFIX))
    right = F.split(F.get(left, 1), MIDDLE)
    psm = F.concat(F.get(left, 0), F.get(right, 1), F.get(right, 0))
    spm = F.concat(F.get(right, 0), F.get(right, 1), F.get(left, 0))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    kept = [F.col(c) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")]
    return out.select(*kept, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
  FROM documents
), numbered AS (
  SELECT doc_id, text, units, len(units) AS n,
    CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4
  FROM drawn
), placed AS (
  SELECT doc_id, text, units, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbered
), parted AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix
  FROM placed
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parted
"""
