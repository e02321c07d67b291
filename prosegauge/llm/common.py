"""What the operators of this subpackage share: tables, words, checkpoints, native shingle hashes."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..plans.lineage import checkpoint_folder

#: The six bytes that part words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = rb"[^\x20\x09-\x0D]+"
#: bytes.translate table that lowers A-Z alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names."""
    checkpoint_folder(spark)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_rows(df: DataFrame, function: Callable, *more: StructField) -> DataFrame:
    """df.mapInArrow(function) for columns of any name: all columns of df but the last, which is handed in alone, and `more` come out.

    Names go by number on the way (c0, c1, ...), as the call itself can't take some signs.
    """
    given = [StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(df.schema)]
    out = df.toDF(*(f.name for f in given)).mapInArrow(function, StructType([*given[:-1], *more]))
    return out.toDF(*df.columns[:-1], *(f.name for f in more))


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the shared checkpoint folder."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def sweep(spark: SparkSession) -> None:
    """Let go of what past rounds of a loop have left: plans on the driver, and the shuffle and checkpoint files of rows that nothing refers to any more.

    Spark deletes such files when the driver's collector meets their owners, which in a job of many small
    steps may be half an hour later (spark.cleaner.periodicGC.interval).
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces_of(rows: DataFrame, text_col: str, mb: int) -> int:
    """Into how many chunks of about `mb` MB of text to deal rows; at least one for each shuffle partition.

    The bytes are summed in a pass of its own: Catalyst's estimate knows nothing of rows that come
    from no file, and multiplies sizes at joins.
    """
    size = rows.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    return max(partitions(rows.sparkSession), size // (mb << 20))


def row_key(*parts: Column) -> Column:
    """A 128-bit key of a row from its columns; nulls differ from empty strings."""
    marked = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")).cast("binary") for p in parts]
    return F.unhex(F.md5(F.concat(*(x for p in marked for x in (p, F.lit(b"\x1f"))))))


#: Bytes up to which a table of ids is broadcast.
SMALL = 32 << 20


def only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ids (16 bytes a row or less): ids are broadcast while they are small, else shuffled with the rows."""
    return rows.join(F.broadcast(ids) if ids.count() * 32 <= SMALL else ids, key, "left_semi")


def join_few(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """rows left joined with a table that has some of their keys (16 bytes each): while those keys are small enough to broadcast, only the rows that have one are shuffled."""
    ids = cut(few.select(key))
    if ids.count() * 32 > SMALL:
        return rows.join(few, key, "left")
    return rows.join(F.broadcast(ids), key, "left_semi").join(few, key).unionByName(rows.join(F.broadcast(ids), key, "left_anti"), allowMissingColumns=True)


def join_by_key(rows: DataFrame, narrow: DataFrame, keys: list[str], how: str, rows_a_key: str = "_n") -> DataFrame:
    """rows joined with a table of one narrow row a key, of which rows_a_key says how many of rows carry it.

    A key with more than a quarter of a shuffle partition's even share would make one task large.
    There are at most four such keys a partition, whatever the size of the data, so these are
    broadcast; all others are shuffled. rows are read twice, narrow three times: cut them.
    how: inner, left or left_semi.
    """
    parts = partitions(rows.sparkSession)
    total = narrow.agg(F.coalesce(F.sum(rows_a_key), F.lit(0))).first()[0]
    above = F.col(rows_a_key) > max(1, total // (4 * parts))
    hot, cold = narrow.where(above).drop(rows_a_key), narrow.where(~above).drop(rows_a_key)
    if not hot.limit(1).count():
        return rows.join(cold, keys, how)
    first = rows.join(F.broadcast(hot), keys, "left_semi" if how == "left_semi" else "inner")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return first.unionByName(rest.join(cold, keys, how))


def words(text: Column) -> Column:
    """Words of a text, as an array; none for a null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return bind(bare, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"{SPACE_CLASS}+")))


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once a row even where the optimizer inlines its column into a lambda."""
    return F.get(F.transform(F.array(value), then), 0)


def word_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def windows(parts: Column, width: int, make: Callable[[list[Column]], Column], kind: str) -> Column:
    """make() of each run of `width` neighbours in an array; none if it is shorter."""
    run = lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - width), lambda i: make([F.get(a, i + k) for k in range(width)]))
    return bind(parts, lambda a: F.when(F.size(a) < width, F.array().cast(f"array<{kind}>")).otherwise(run(a)))


def window_hashes(hashed: Column, width: int = 5) -> Column:
    """64-bit hashes of all runs of `width` words, from the words' hashes."""
    return windows(hashed, width, lambda xs: F.xxhash64(*xs), "bigint")


def window_texts(tokens: Column, width: int = 5) -> Column:
    """All runs of `width` words, joined by a space."""
    return windows(tokens, width, lambda xs: F.concat_ws(" ", *xs), "string")
