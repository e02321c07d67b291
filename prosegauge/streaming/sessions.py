"""Reading a feed with state by session: readings of elements, retries, recycling, resets and counters.

Each session has a map of its elements, kept in the state store with a time to live, so a reader that
goes away is forgotten; a reset event forgets them at once. Every reading comes out as a row with what became of
it, so posts and counters are one stream.

Events: session_id, element_id, tick (long; the order within a session), urn, post_id (null:
extraction failed), id_is_stable, text, and kind ("reset": a new page; null or else: a reading).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .feed import MOST_TRIES, Element

EVENT = "session_id string, element_id string, tick long, urn string, post_id string, id_is_stable boolean, text string, kind string"
OUT = "session_id string, element_id string, tick long, outcome string, post_id string, text string"
#: What becomes of a reading: a post; the same post still there or read again; a failure that is tried again; the last failure; one after that; a reset.
OUTCOMES = ("post", "duplicate", "retrying", "skipped", "given_up", "reset")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def outcome(element: Element, urn: str | None, post_id: str | None, stable: bool) -> str:
    """Take one reading into account and say what became of it."""
    failed = element.failures
    kind = element.see(urn, post_id, stable)
    if kind is not None:
        return kind
    if post_id is None and element.failures != failed:
        return "retrying"
    spent = element.failures >= MOST_TRIES and failed >= MOST_TRIES
    return "given_up" if spent else "duplicate"


class SessionReader(StatefulProcessor):
    """The elements of each session, as a map from element to what is remembered of it."""

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.elements = handle.getMapState("elements", "element_id string", "failures int, failed_urn string, last_id string", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(rows).sort_values("tick", kind="stable")
        known = {k[0]: Element(*v) for k, v in self.elements.iterator()} if self.elements.exists() else {}
        before = {k: (e.failures, e.failed_urn, e.last_id) for k, e in known.items()}
        plain = lambda x: None if x is None or x != x else x
        out = []
        for r in events.itertuples(index=False):
            if plain(r.kind) == "reset":
                known = {}
                out.append((key[0], plain(r.element_id), r.tick, "reset", None, None))
                continue
            element = known.setdefault(r.element_id, Element())
            said = outcome(element, plain(r.urn), plain(r.post_id), bool(plain(r.id_is_stable)))
            out.append((key[0], r.element_id, r.tick, said, plain(r.post_id), plain(r.text)))
        for name in before.keys() - known.keys():
            self.elements.removeKey((name,))
        for name, e in known.items():
            if before.get(name) != (now := (e.failures, e.failed_urn, e.last_id)) or self.keep_ms:
                self.elements.updateValue((name,), now)
        yield pd.DataFrame(out, columns=["session_id", "element_id", "tick", "outcome", "post_id", "text"])

    def close(self) -> None:
        pass


def outcomes(events: DataFrame, keep: str | None = None) -> DataFrame:
    """What becomes of every event of a stream. keep: for how long an element is remembered after its last reading ("30 minutes"; None: for ever).

    With keep, state grows old without events, so the query always has a next batch: start it with a
    processing-time trigger, as a run over what is there now would not end.

    A session is read by one task, an element at a time, in the order of ticks within a micro-batch. Null
    session ids are one session; rows without element_id are left out unless they reset.
    """
    use_store(events.sparkSession)
    ms = None if keep is None else int(pd.Timedelta(keep).total_seconds() * 1000)
    columns = [F.col(c.split()[0]) for c in EVENT.split(", ")]
    rows = events.select(*columns).where("element_id is not null or kind = 'reset'")
    return rows.groupBy("session_id").transformWithStateInPandas(SessionReader(ms), OUT, "append", "none" if ms is None else "processingTime")


def use_store(spark: SparkSession) -> None:
    """State of this kind needs the store on disk; streams that are started from here on use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def posts(read: DataFrame) -> DataFrame:
    return read.where("outcome = 'post'").drop("outcome")


def counted(read: DataFrame, *keys: str) -> DataFrame:
    """How many readings had each outcome, by keys: one row with a column for each, of a batch or (complete or update mode) a stream."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return read.groupBy(*keys).agg(F.count("*").alias("seen"), *counts)
