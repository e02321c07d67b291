"""A feed as a stream: elements are read again and again until a post comes out, each post is given out once.

Events: session_id, element_id, tick (long), urn, post_id (null: extraction failed), id_is_stable,
text. State is kept for each element of a session; a new session starts afresh.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Tries for one element, and the paths that have a feed.
MOST_TRIES = 6
FEED_PATHS = r"^/(?:feed/?|in/|company/|posts/|\z)"

EVENT = "session_id string, element_id string, tick long, urn string, post_id string, id_is_stable boolean, text string"
OUT = "session_id string, element_id string, tick long, kind string, post_id string, text string"
_STATE = "failures int, failed_urn string, last_id string"


@dataclass
class Element:
    """What is remembered of an element."""

    failures: int = 0
    failed_urn: str | None = None
    last_id: str | None = None

    def see(self, urn: str | None, post_id: str | None, stable: bool) -> str | None:
        """Take one reading; "post" if it is to be given out, "skipped" when the last try has failed."""
        if urn is not None and urn == self.last_id:
            return None  # the same post still stands here
        if self.failures >= MOST_TRIES:
            if urn is None or urn == self.failed_urn:
                return None
            self.failures, self.failed_urn = 0, None
        if post_id is None:
            self.failures += 1
            self.failed_urn = self.failed_urn if urn is None else urn
            return "skipped" if self.failures == MOST_TRIES else None
        self.failures, self.failed_urn = 0, None
        if post_id == self.last_id or self.last_id is not None and not stable:
            return None  # expanded or shifted text of the same post, not another one
        self.last_id = post_id
        return "post"


def read_element(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    element = Element(*state.get) if state.exists else Element()
    rows = pd.concat(frames).sort_values("tick", kind="stable")
    out = []
    none = lambda x: None if x is None or x != x else x
    for r in rows.itertuples(index=False):
        kind = element.see(none(r.urn), none(r.post_id), bool(r.id_is_stable))
        if kind:
            out.append((*key, r.tick, kind, none(r.post_id), none(r.text)))
    state.update((element.failures, element.failed_urn, element.last_id))
    yield pd.DataFrame(out, columns=["session_id", "element_id", "tick", "kind", "post_id", "text"])


def readings(events: DataFrame) -> DataFrame:
    """Posts and skips of a stream of events; the same post may come from several elements."""
    return events.groupBy("session_id", "element_id").applyInPandasWithState(read_element, OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def emit_once(posts: DataFrame, *keys: str) -> DataFrame:
    """Each key once for the life of the query (state grows with the keys)."""
    return posts.dropDuplicates(list(keys))


def emit_once_within(posts: DataFrame, time_col: str, delay: str, *keys: str) -> DataFrame:
    """As emit_once with bounded state: repeats are known for `delay` of event time. An extension."""
    return posts.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))


def on_feed(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Rows whose page path can have a feed."""
    return df.where(F.col(path_col).rlike(FEED_PATHS))


def visible(df: DataFrame, top: str = "top", bottom: str = "bottom", height: str = "viewport_height", margin: int = 200) -> DataFrame:
    """Rows whose box meets the viewport, widened by a margin."""
    return df.where((F.col(bottom) >= -margin) & (F.col(top) <= F.col(height) + margin))


def run_to_end(out: DataFrame, path: str, checkpoint: str) -> None:
    """Drive a stream over all that is there now into Parquet."""
    query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def tally(scored: DataFrame) -> DataFrame:
    """Running counts by verdict, for complete output mode."""
    return scored.groupBy("verdict").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


def handle_batch(batch: DataFrame, epoch: int, cache: str, target: str) -> None:
    """One micro-batch of posts (post_id, id_is_stable, text, links): known verdicts from the cache, others scored and added to it, all to the target.

    A micro-batch that is run again after a failure writes the same folders again.
    """
    from ..sources import stores

    spark = batch.sparkSession
    posts = batch.dropDuplicates(["post_id"]).persist()  # read by several jobs, counted once
    try:
        known = stores.read_cache(spark, cache, ids=posts.where("id_is_stable"))
        told = stores.score_with_cache(posts, known).join(posts.select("post_id", "id_is_stable"), "post_id")
        told.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")
    finally:
        posts.unpersist()
    done = spark.read.schema(told.schema).parquet(f"{target}/epoch={epoch}")
    stores.write_cache(done.where("not cached"), cache, batch=f"epoch-{epoch}")


def score_posts(posts: DataFrame, cache: str, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Score a stream of posts through the cache; every: how often to look for new ones (None: once, over all there is).

    The counters `feed` (seen, unstable, without_text) are observed on the way in; see counters().
    """
    seen = posts.observe("feed", F.count(F.lit(1)).alias("seen"), F.count_if(~F.col("id_is_stable")).alias("unstable"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("without_text"))
    writer = seen.writeStream.foreachBatch(lambda batch, epoch: handle_batch(batch, epoch, cache, target)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def counters(query: StreamingQuery) -> dict[str, int]:
    """The sums of a query's observed counters over its recent progress (Spark forgets all but the last hundred steps; Counters keeps the whole)."""
    out: dict[str, int] = {}
    for step in query.recentProgress:
        for row in step.observedMetrics.values():
            for name, n in row.asDict().items():
                out[name] = out.get(name, 0) + n
    return out


class Counters(StreamingQueryListener):
    """The sums of observed counters of every query since spark.streams.addListener(), by the query's id: they outlive recentProgress and restarts of the query."""

    def __init__(self) -> None:
        self.sums: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        self.sums.setdefault(str(event.id), {})

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        own = self.sums.setdefault(str(event.progress.id), {})
        for row in event.progress.observedMetrics.values():
            for name, n in row.asDict().items():
                own[name] = own.get(name, 0) + (n or 0)

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        pass


def panel(scored: DataFrame, order_col: str, session_col: str = "session_id") -> DataFrame:
    """The list that a reader of the feed sees: of each session's posts the first reading, the newest first, with the tally so far by verdict.

    scored: session, post_id, verdict, order_col. Returns session, post_id, verdict, place (1: newest), listed, green, yellow, red.
    """
    rest = [c for c in scored.columns if c not in (session_col, "post_id")]
    first = scored.groupBy(session_col, "post_id").agg(F.min_by(F.struct(*rest), order_col).alias("_r")).select(session_col, "post_id", "_r.*")
    ahead = Window.partitionBy(session_col).orderBy(order_col, "post_id").rowsBetween(Window.unboundedPreceding, 0)
    tallied = [F.count_if(F.col("verdict") == v).over(ahead).alias(v) for v in ("green", "yellow", "red")]
    newest = Window.partitionBy(session_col).orderBy(F.desc(order_col), F.desc("post_id"))
    return first.select(session_col, "post_id", "verdict", F.row_number().over(newest).alias("place"), F.count("*").over(ahead).alias("listed"), *tallied)


def score_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> None:
    """Score all posts (post_id, text) of a folder as a stream, each post once."""
    from ..operators.scoring import score

    posts = spark.readStream.schema(schema).parquet(source)
    run_to_end(score(emit_once(posts, "post_id")).select("post_id", "score", "verdict"), target, checkpoint)
