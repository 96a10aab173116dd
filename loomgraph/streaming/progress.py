"""Learner progress kept live from an event stream.

The state is one row per learner, project and region, kept by Spark's state
store and changed by ``transformWithState``. Every fold is a maximum over
moments, so events may arrive late, twice or out of order, and a repeated batch
changes nothing. The store holds as many rows as there are keys, however many
batches have passed; reading it reads those rows and not the batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

KEYS = ["learner_id", "project", "region"]
# Moments are (microseconds, event_id); a pass carries its signature behind its moment.
VALUE = "visited_ts bigint, visited_id bigint, passed_ts bigint, passed_id bigint, signature string, cleared_ts bigint, cleared_id bigint"
STATE = "learner_id bigint, project string, region string, " + VALUE
_NAMES = [part.split()[0] for part in STATE.split(", ")]
_VARIABLE = "progress"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# The store that keeps state variables by name.
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed(events: DataFrame) -> DataFrame:
    """The events that change progress, by key; a reset has an empty region."""
    kept = events.where(F.col("type").isin("visit", "pass_check", "reset"))
    return kept.select(
        "learner_id", "project", F.when(F.col("type") == "reset", "").otherwise(F.coalesce("region", F.lit(""))).alias("region"),
        "type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event_id", "signature")


class Progress(StatefulProcessor):
    """Keeps the latest visit, pass and reset of its key, and gives the key's row when it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState(_VARIABLE, VALUE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = tuple(self._state.get()) if self._state.exists() else (None,) * 7
        before = held
        visited, passed, cleared = held[0:2], held[2:5], held[5:7]
        for row in rows:
            moment = (row.ts, row.event_id)
            if row.type == "visit":
                visited = _later(visited, moment)
            elif row.type == "pass_check":
                passed = _later(passed, (*moment, row.signature))
            else:
                cleared = _later(cleared, moment)
        after = (*visited, *passed, *cleared)
        if after != before:
            self._state.update(after)
            yield Row(**dict(zip(_NAMES, (*key, *after), strict=True)))

    def close(self) -> None:
        pass


def _later(held: tuple, new: tuple) -> tuple:
    return new if held[0] is None or new[:2] > held[:2] else held


def changes(events: DataFrame) -> DataFrame:
    """The stream of changed rows: ``STATE`` after every batch that changed a key."""
    return keyed(events).groupBy(*KEYS).transformWithState(Progress(), STATE, "update", "none")


def run(events: DataFrame, checkpoint: str, trigger: dict | None = None, sink: str = "noop") -> StreamingQuery:
    """Start the query on a stream of log events; ``trigger`` is what ``trigger()`` takes, by default all there is and then an end."""
    conf = events.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKSDB)
    try:
        writer = changes(events).writeStream.format(sink).outputMode("update").option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        if before is None:
            conf.unset(_PROVIDER)
        else:
            conf.set(_PROVIDER, before)


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The rows of the state store after the last finished batch."""
    stored = spark.read.format("statestore").option("stateVarName", _VARIABLE).load(checkpoint)
    return stored.select(*[F.col("key")[n].alias(n) for n in KEYS], *[F.col("value")[n].alias(n) for n in _NAMES[len(KEYS) :]])


def view(state: DataFrame, signatures: DataFrame, regions: DataFrame) -> DataFrame:
    """Visited and understood per learner and region, after resets."""
    visited, passed, cleared = (F.struct(F.col(f"{n}_ts").alias("ts"), F.col(f"{n}_id").alias("event_id")) for n in ("visited", "passed", "cleared"))
    resets = state.where(F.col("cleared_ts").isNotNull()).groupBy("learner_id", "project").agg(F.max(cleared).alias("last"))
    current = signatures.select("project", "region", F.col("signature").alias("current"))
    rows = state.where(F.col("region") != "").join(resets, ["learner_id", "project"], "left").join(
        regions.select("project", "region"), ["project", "region"], "left_semi").join(current, ["project", "region"], "left")
    fresh = F.col("last").isNull()
    seen = F.col("visited_ts").isNotNull() & (fresh | (visited > F.col("last")))
    proved = F.col("passed_ts").isNotNull() & (fresh | (passed > F.col("last"))) & (F.col("signature") == F.col("current"))
    return rows.select(*KEYS, F.coalesce(seen, F.lit(False)).alias("visited"), F.coalesce(proved, F.lit(False)).alias("understood")).where(
        F.col("visited") | F.col("understood"))
