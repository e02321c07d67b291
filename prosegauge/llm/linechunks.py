"""Line dedup by content-defined chunks of lines.

A hash rolls over the hashes of neighbouring lines with words; where it falls below a mark a chunk
ends, so boundaries depend on the lines beside them alone and a shifted passage is cut at the same
places. A line of many words is a chunk by itself. Chunks that stand at more than one place are
anchors: from each, the run of lines that holds it grows line by line to both sides, over the whole chunk
beside it. Runs of several lines (or of one long line) that stand at an earlier place too are
removed after their bytes have been compared, so a repeated passage goes from its first line to
its last and not only by whole chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, cut, join_by_key, join_few, only, row_key, table, unused
from .hashing import slices

#: A line of so many words is a passage by itself; several lines are one from RUN_WORDS words on.
LINE_WORDS, RUN_WORDS = 20, 10
#: A line of so many words is a chunk by itself.
LONG = 10
#: Of 100 rolling hashes, how many end a chunk.
ENDS = 67


class Lines:
    """The lines with words of a text: their places among all lines, numbers of words, hashes, and the chunks."""

    def __init__(self, text: bytes, ends: int = ENDS, window: int = 2):
        self.all = text.split(b"\n")
        words = [len(x.split()) for x in self.all]
        self.at = [i for i, n in enumerate(words) if n]
        self.words = [words[i] for i in self.at]
        self.hashes = np.array([xxhash.xxh64_intdigest(x) for x in self.all], np.uint64)
        own = self.hashes[self.at]
        last = len(self.at) - 1
        self.cuts = [0]  # first line of each chunk, and the end
        for k in range(last + 1):
            roll = xxhash.xxh64_intdigest(own[max(0, k + 1 - window) : k + 1].tobytes())
            if k == last or roll % 100 < ends or self.words[k] >= LONG or self.words[k + 1] >= LONG:
                self.cuts.append(k + 1)

    def run(self, first: int, last: int) -> tuple[int, int, int]:
        """(start, n, h) of a run of lines with words, and what lies between them; h is a hash of their hashes."""
        start, stop = self.at[first], self.at[last] + 1
        h = xxhash.xxh64_intdigest(self.hashes[start:stop].tobytes(), stop - start)
        return start, stop - start, h - (1 << 64) if h >> 63 else h

    def chunks(self) -> list[tuple[int, int, int]]:
        return [self.run(a, b - 1) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def passage(self, first: int, last: int, least: int, line_words: int, run_words: int) -> bool:
        n = last - first + 1
        return self.words[first] >= line_words if n == 1 else n >= least and sum(self.words[first : last + 1]) >= run_words

    def grown(self, anchors: set[int], least: int, line_words: int, run_words: int) -> list[tuple[int, int, int]]:
        """The runs around anchors (starts of chunks): to either side, over the chunk beside it and on until there are run_words words."""
        found: set[tuple[int, int]] = set()
        end = len(self.at)
        for k, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            if self.at[a] not in anchors:
                continue
            found.add((a, b - 1))
            words, stop = sum(self.words[a:b]), self.cuts[min(k + 2, len(self.cuts) - 1)]
            for j in range(b, end):
                if j >= stop and words >= run_words:
                    break
                words += self.words[j]
                found.add((a, j))
            words, stop = sum(self.words[a:b]), self.cuts[max(k - 1, 0)]
            for j in range(a - 1, -1, -1):
                if j < stop and words >= run_words:
                    break
                words += self.words[j]
                found.add((j, b - 1))
        return [self.run(a, b) for a, b in sorted(found) if self.passage(a, b, least, line_words, run_words)]


PLACED = "_row binary, doc_id {}, start int, n int, h long"


def _table(batch: pa.RecordBatch, found: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
    owner = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
    start, n, h = (np.array([u[i] for x in found for u in x], t) for i, t in enumerate((np.int32, np.int32, np.int64)))
    return pa.RecordBatch.from_arrays([batch.column("_row").take(owner), batch.column("doc_id").take(owner), pa.array(start), pa.array(n), pa.array(h)], ["_row", "doc_id", "start", "n", "h"])


def _chunked(batches: Iterator[pa.RecordBatch], ends: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_text"):
        yield _table(batch, [Lines(t, ends).chunks() for t in batch.column("_text").cast(pa.binary()).to_pylist()])


def _grown(batches: Iterator[pa.RecordBatch], ends: int, least: int, line_words: int, run_words: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_text"):
        texts, anchors = batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("_anchors").to_pylist()
        yield _table(batch, [Lines(t, ends).grown(set(a), least, line_words, run_words) for t, a in zip(texts, anchors, strict=True)])


def _repeated(placed: DataFrame) -> DataFrame:
    """Those of some places whose hash stands at another place too."""
    spot = F.xxhash64("_row", "start")
    again = placed.groupBy("h").agg(F.min(spot).alias("_least"), F.max(spot).alias("_most"), F.count("*").alias("_n")).where("_least != _most")
    return join_by_key(placed, cut(again.select("h", "_n")), ["h"], "left_semi").distinct()


def runs(docs: DataFrame, ends: int, least: int, line_words: int, run_words: int) -> DataFrame:
    """_row, doc_id, start, n, h: the runs of lines that hold a chunk which stands at more than one place."""
    kind = PLACED.format(docs.schema["doc_id"].dataType.simpleString())
    chunks = cut(docs.select("_row", "doc_id", "_text").mapInArrow(partial(_chunked, ends=ends), kind).drop("doc_id", "n"))
    anchors = cut(_repeated(chunks).groupBy("_row").agg(F.collect_set("start").alias("_anchors")))
    texts = only(docs.select("_row", "doc_id", "_text"), anchors.select("_row"), "_row").join(anchors, "_row")
    return cut(texts.mapInArrow(partial(_grown, ends=ends, least=least, line_words=line_words, run_words=run_words), kind))


def _body(lines: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, n), "\n")


def repeated_runs(docs: DataFrame, ends: int = ENDS, least: int = 2, line_words: int = LINE_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """_row, start, n: the runs of lines that stand at an earlier place too.

    docs: _row (a key of the row), doc_id, _text. Places are ordered by doc_id, row and line; the
    first place keeps the run. Runs meet by hash, and the bytes of those that meet are then
    compared: where one hash covers different bytes, each text is a group of its own. A place that
    overlaps the first one of its text stays.
    """
    placed = runs(docs, ends, least, line_words, run_words)
    place = F.struct("doc_id", "_row", "start")
    apart = (F.struct("_row", "start") != F.struct("_first._row", "_first.start")) & ((F.col("_row") != F.col("_first._row")) | (F.col("start") >= F.col("_first.start") + F.col("n")))
    met = cut(_repeated(placed).drop("doc_id"))
    per_row = met.groupBy("_row").agg(F.collect_list(F.struct("start", "n", "h")).alias("_met"))
    held = only(docs.select("_row", "doc_id", "_text"), cut(met.select("_row").distinct()), "_row")
    texts = held.select("_row", "doc_id", F.split("_text", "\n").alias("_lines")).join(per_row, "_row")
    read = texts.select("_row", "doc_id", F.explode(F.transform("_met", lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), c["h"].alias("h"), _body(F.col("_lines"), c["start"], c["n"]).alias("body")))).alias("c"))
    read = read.select("_row", "doc_id", "c.*")
    bodies = read.groupBy("h", "body").agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
    alike = cut(bodies.groupBy("h").agg(F.count("*").alias("_bodies"), F.first("_first").alias("_first"), F.sum("_n").alias("_n")))
    sure = join_by_key(met, alike.where("_bodies = 1").select("h", "_first", "_n"), ["h"], "inner").where(apart).select("_row", "start", "n")
    mixed = read.join(alike.where("_bodies > 1").select("h"), "h", "left_semi")
    firsts = mixed.groupBy("h", "body").agg(F.min(place).alias("_first"))
    rest = mixed.join(firsts, ["h", "body"]).where(apart).select("_row", "start", "n")
    return sure.union(rest) if alike.where("_bodies > 1").limit(1).count() else sure


def dedup_lines(docs: DataFrame, ends: int = ENDS, least: int = 2, id_col: str = "doc_id", text_col: str = "text", line_words: int = LINE_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """Every row of docs with its repeated runs of lines removed, all its columns, and n_removed_lines.

    A run is of `least` lines with words and run_words words or more, or one line of line_words words. It is found
    if it holds a whole chunk: always where one of its lines has LONG words, else with the odds of `ends`
    in 100 at each line that a chunk ends there.

    Null texts stay null, empty ones empty; texts of any length are read whole. Rows alike in id and
    text are one place and are treated alike. Ties in doc_id are ordered by a hash of the text. A text
    that loses all its lines is empty. An empty table gives an empty result. A column named
    n_removed_lines is replaced; all others stay, whatever their names.
    """
    text, row, lost = F.col(text_col).cast("string"), unused(docs, "_row"), unused(docs, "_gone")
    keyed = docs.withColumn(row, row_key(F.col(id_col), text))
    bare = keyed.where(text.isNotNull()).select(F.col(row).alias("_row"), F.col(id_col).alias("doc_id"), text.alias("_text"))
    gone = cut(repeated_runs(bare, ends, least, line_words, run_words).groupBy(F.col("_row").alias(row)).agg(F.collect_list(F.struct("start", "n")).alias(lost)))
    joined = join_few(keyed, gone, row)
    places = F.flatten(F.transform(lost, lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1)))
    stays = bind(F.split(text, "\n"), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places), lambda i: F.get(lines, i)), "\n"))
    removed = F.when(F.col(lost).isNull(), 0).otherwise(F.size(F.array_distinct(places))).cast("bigint")
    kept = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(stays)
    columns = [kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != "n_removed_lines"]
    return joined.select(*columns, removed.alias("n_removed_lines"))


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_removed_lines", F.length(kept).cast("bigint").alias("n_kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))
