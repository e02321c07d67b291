"""Label store (JSON lines), verdict cache, exports.

Both are folders of batches and only ever added to, so writers don't meet and a lost job leaves what
was there; readers settle what holds. A label log has upserts and removals with the time they were
written. A cache batch is laid out in buckets by a hash of the post's id, sorted and with Bloom
filters, so that looking up some posts reads their buckets alone. Compaction writes one batch in place of those
it has read, and may run while others write.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L

LABEL = "postId string, text string, rating int, label string, predicted string, score double, at string, scorerVersion string"
LABEL_COLUMNS = [c.strip().split()[0] for c in LABEL.split(",")]
VERDICT = "scorer_version string, post_id string, verdict string, score double, confidence double, signals array<struct<key:string,label:string,weight:double>>, uncertain boolean"
VERDICT_COLUMNS = ["scorer_version", "post_id", "verdict", "score", "confidence", "signals", "uncertain"]


#: Buckets of a cache batch, and ids up to which a lookup names them to the scan.
BUCKETS, NAMED = 64, 200
_LOG = f"{LABEL}, _written long, _removed boolean"


def _path(spark: SparkSession, path: str):
    """(path, its file system) in Hadoop's terms."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _batches(spark: SparkSession, path: str) -> list[str]:
    """The finished batches in a folder, as paths."""
    where, fs = _path(spark, path)
    names = [str(s.getPath().getName()) for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(f"{path}/{n}" for n in names if n.startswith("batch=") and fs.exists(_path(spark, f"{path}/{n}/_SUCCESS")[0]))


def _drop(spark: SparkSession, batches: list[str]) -> None:
    for name in batches:
        where, fs = _path(spark, name)
        fs.delete(where, True)


# ---- labels --------------------------------------------------------------------------------------------


def _log(rows: DataFrame, path: str, removed: bool = False) -> None:
    """Append rows (LABEL; of removals the postId alone, or null for all) to the log at path."""
    columns = [F.col(c).cast(k).alias(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in LABEL.split(", "))]
    out = rows.select(*columns, F.unix_micros(F.current_timestamp()).alias("_written"), F.lit(removed).alias("_removed"))
    out.write.option("ignoreNullFields", "false").json(f"{path}/batch={uuid.uuid4().hex}")


def _settled(log: DataFrame) -> DataFrame:
    """The rows of a log that hold: of each post the last label that no later removal strikes out, with the time it was written."""
    struck = log.where("_removed").groupBy("postId").agg(F.max("_written").alias("_gone"))
    cleared = struck.where("postId is null").agg(F.max("_gone")).first()[0] or 0
    upserts = log.where(~F.col("_removed") & F.col("postId").isNotNull() & (F.col("_written") > cleared)).join(struck.where("postId is not null"), "postId", "left")
    live = upserts.where(F.col("_gone").isNull() | (F.col("_written") > F.col("_gone")))
    rest = [*(c for c in LABEL_COLUMNS if c != "postId"), "_written"]
    last = live.groupBy("postId").agg(F.max_by(F.struct(*rest), F.struct(F.to_timestamp("at"), "_written", F.xxhash64(*rest))).alias("_r"))
    return last.select("postId", "_r.*")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The labels of a store, one a post: of several the last by its time `at`, then the one written last. No store: no rows. A line that can't be read is no label."""
    found = _batches(spark, path)
    if not found:
        return spark.createDataFrame([], LABEL)
    return _settled(spark.read.schema(_LOG).json(found)).select(LABEL_COLUMNS)


def upserted(old: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """One row for each key: the last by order, new rows after old ones of the same order. An aggregate with map-side combine, no window."""
    columns = old.columns
    both = old.withColumn("_new", F.lit(0)).union(new.select(columns).withColumn("_new", F.lit(1))).withColumn("_at", order)
    rest = [c for c in columns if c != key]
    last = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_at", "_new", F.xxhash64(*rest))).alias("_row"))
    return last.select(key, "_row.*").select(columns)


def save_labels(new: DataFrame, path: str) -> None:
    """Add labels; a post that has one gets the later one. Nothing that is there is read or rewritten, and two who write at once lose nothing."""
    _log(new, path)


def remove_labels(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Take back the labels that posts have now; a label that is written later counts again."""
    _log(ids.select(F.col(ids.columns[0]).alias("postId")).where("postId is not null"), path, True)


def clear_labels(spark: SparkSession, path: str) -> None:
    """Take back all labels that are there now."""
    _log(spark.range(1).select(F.lit(None).cast("string").alias("postId")), path, True)


def compact_labels(spark: SparkSession, path: str) -> None:
    """One batch in place of those that are there now. What others write meanwhile stays a batch of its own; a compaction that is lost half way leaves rows twice, which changes nothing."""
    found = _batches(spark, path)
    if len(found) > 1:
        log = spark.read.schema(_LOG).json(found)
        kept = _settled(log).select(*LABEL_COLUMNS, "_written", F.lit(False).alias("_removed"))
        gone = log.where("_removed").groupBy("postId").agg(F.max("_written").alias("_written"))  # a batch that is being written may be older than a removal
        both = kept.unionByName(gone.withColumn("_removed", F.lit(True)), allowMissingColumns=True)
        both.write.option("ignoreNullFields", "false").json(f"{path}/batch={uuid.uuid4().hex}")
        _drop(spark, found)


def json_lines(df: DataFrame) -> DataFrame:
    """One column, line: each row as JSON, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))


def export_labels(spark: SparkSession, path: str, target: str, files: int | None = None) -> None:
    """The store as JSON lines under target; files=1 for one file where the store is known to be small."""
    out = json_lines(read_labels(spark, path)).withColumnRenamed("line", "value")
    (out.coalesce(files) if files else out).write.mode("overwrite").text(target)


def labelled(scored: DataFrame, ratings: DataFrame) -> DataFrame:
    """Labels in the store's form, from scored posts (post_id, text, verdict, score) and ratings (post_id, rating, at)."""
    from ..operators.evaluation import rating_to_verdict

    out = scored.join(ratings, "post_id")
    return out.select(
        F.col("post_id").alias("postId"), "text", "rating", rating_to_verdict(F.col("rating")).alias("label"), F.col("verdict").alias("predicted"), "score", "at", F.lit(L.SCORER_VERSION).alias("scorerVersion")
    )


# ---- verdict cache ---------------------------------------------------------------------------------------


def _bucket() -> Column:
    return F.pmod(F.xxhash64("post_id"), F.lit(BUCKETS)).cast("int")


def read_cache(spark: SparkSession, path: str, version: str = L.SCORER_VERSION, ids: DataFrame | None = None) -> DataFrame:
    """Cached verdicts of one scorer version: of each post the one written last.

    ids: the posts to look up (a column post_id). Then only the buckets that they are in are read, and of
    few ids only the row groups whose Bloom filters know them.
    """
    folder = f"{path}/scorer_version={version}"
    found = _batches(spark, folder)
    if not found:
        return spark.createDataFrame([], VERDICT)
    rows = spark.read.schema(f"{VERDICT.split(', ', 1)[1]}, written timestamp, batch string, bucket int").option("basePath", folder).parquet(*found)
    if ids is not None:
        wanted = ids.select("post_id").where("post_id is not null").distinct()
        rows = rows.where(F.col("bucket").isin([r[0] for r in wanted.select(_bucket()).distinct().collect()]))  # BUCKETS numbers at most
        few = wanted.limit(NAMED + 1).collect()
        rows = rows.where(F.col("post_id").isin([r[0] for r in few])) if len(few) <= NAMED else rows.join(wanted, "post_id", "left_semi")
    rest = VERDICT_COLUMNS[2:]
    last = rows.groupBy("post_id").agg(F.max_by(F.struct(*rest), F.struct("written", F.xxhash64("verdict", "score"))).alias("_v"))
    return last.select(F.lit(version).alias("scorer_version"), "post_id", "_v.*").select(VERDICT_COLUMNS)


def _write_batch(rows: DataFrame, folder: str, batch: str) -> None:
    """Rows by bucket, each sorted by post_id: one file a bucket, or more where a bucket is large."""
    laid = rows.withColumn("bucket", _bucket()).repartition(F.col("bucket")).sortWithinPartitions("bucket", "post_id")
    writer = laid.write.mode("overwrite").partitionBy("bucket").option("maxRecordsPerFile", 1_000_000)
    writer.option("parquet.bloom.filter.enabled#post_id", "true").option("parquet.bloom.filter.expected.ndv#post_id", "100000").parquet(f"{folder}/batch={batch}")


def write_cache(scored: DataFrame, path: str, version: str = L.SCORER_VERSION, batch: str | None = None) -> None:
    """Add verdicts of posts with stable ids (id_is_stable; absent: all) as one more batch; nothing that is there is read or rewritten.

    Writers don't meet: each batch has a folder of its own, and one that is written again by its name
    (a micro-batch after a failure) replaces itself.
    """
    stable = scored.where("id_is_stable") if "id_is_stable" in scored.columns else scored
    new = stable.where("post_id is not null").select(VERDICT_COLUMNS[1:]).dropDuplicates(["post_id"]).withColumn("written", F.current_timestamp())
    _write_batch(new, f"{path}/scorer_version={version}", batch or uuid.uuid4().hex)


def compact_cache(spark: SparkSession, path: str, version: str = L.SCORER_VERSION) -> None:
    """One batch in place of those that are there now, the last verdict of each post. Others may write meanwhile; a compaction that is lost half way leaves verdicts twice, which changes nothing."""
    folder = f"{path}/scorer_version={version}"
    found = _batches(spark, folder)
    if len(found) > 1:
        rows = spark.read.schema(f"{VERDICT.split(', ', 1)[1]}, written timestamp, batch string, bucket int").option("basePath", folder).parquet(*found)
        rest = [*VERDICT_COLUMNS[2:], "written"]
        last = rows.groupBy("post_id").agg(F.max_by(F.struct(*rest), F.struct("written", F.xxhash64("verdict", "score"))).alias("_v"))
        _write_batch(last.select("post_id", "_v.*"), folder, uuid.uuid4().hex)
        _drop(spark, found)


def cache_size(spark: SparkSession, path: str, version: str = L.SCORER_VERSION) -> int:
    return read_cache(spark, path, version).count()


def clear_cache(spark: SparkSession, path: str, version: str = L.SCORER_VERSION) -> None:
    """Drop one version's verdicts; other versions stay."""
    where, fs = _path(spark, f"{path}/scorer_version={version}")
    fs.delete(where, True)


def score_with_cache(posts: DataFrame, cached: DataFrame) -> DataFrame:
    """post_id, verdict, score, confidence, signals, uncertain, cached: from the cache where it has the post, else scored now."""
    from ..operators.scoring import score

    columns = VERDICT_COLUMNS[1:]
    known = posts.select("post_id").join(cached, "post_id").select(*columns, F.lit(True).alias("cached"))
    fresh = score(posts.join(cached.select("post_id"), "post_id", "left_anti"), links_col="links" if "links" in posts.columns else None).select(*columns, F.lit(False).alias("cached"))
    return known.union(fresh)
