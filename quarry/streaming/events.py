"""Streams: watching trees, debounce, per-session counters and running totals, pattern detection by batch."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import memory
from ..schema import CHANGE_EVENTS
from ..sources import scan

# --- fixed values: debounce per path
DEBOUNCE = "300 milliseconds"
# --- end of fixed values


def watch_tree(spark: SparkSession, root: str, extensions) -> DataFrame:
    """(path, length, modified, content) of files as they appear or are replaced. Deletions are not delivered by a file
    source: compare a scan with the index instead (``operators.dml.vanished``)."""
    glob = "*.{" + ",".join(extensions) + "}"
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rows = raw.select("path", "length", F.col("modificationTime").alias("modified"), "content").filter(~F.col("path").rlike(scan.IGNORE_PATTERN))
    return scan.as_text(scan.within_size(rows))


def debounced(events: DataFrame, watermark: str = "1 second", gap: str = DEBOUNCE) -> DataFrame:
    """Of file events (path, type, ts) that follow each other within the gap, the last one. Late events are dropped
    after the watermark."""
    g = events.withWatermark("ts", watermark).groupBy("path", F.session_window("ts", gap).alias("w"))
    return g.agg(F.max_by("type", "ts").alias("type"), F.max("ts").alias("ts")).select("path", "type", "ts")


def reindex_stream(changes: DataFrame, index: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Index every micro-batch of changed files with ``index(files, batch_id)``."""
    w = changes.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


_COUNTED = "session_id string, event_type string, key string, n long, timestamp timestamp"


def _count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n = state.get[0] if state.exists else 0
    out = []
    for t in sorted(t for df in batches for t in df["timestamp"]):
        n += 1
        out.append((*key, n, t))
    state.update((n,))
    yield pd.DataFrame(out, columns=["session_id", "event_type", "key", "n", "timestamp"])


def counted_events(events: DataFrame) -> DataFrame:
    """Accesses, failed searches and tool errors with their running count per session and key: the key is the file
    (with its symbol), the query, or the tool and file. State is one number per key."""
    place = F.coalesce("file_path", F.lit(""))
    key = (
        F.when(F.col("event_type") == "accessed", F.when(F.col("symbol_name").isNotNull(), F.concat(place, F.lit("::"), "symbol_name")).otherwise(place))
        .when(F.col("event_type") == "failed_search", F.col("extra")["query"])
        .otherwise(F.concat_ws("|", F.col("extra")["tool"], place))
    )
    rows = events.filter(F.col("event_type").isin("accessed", "failed_search", "tool_error"))
    rows = rows.select("session_id", "event_type", F.coalesce(key, F.lit("")).alias("key"), "timestamp")
    return rows.groupBy("session_id", "event_type", "key").applyInPandasWithState(_count, _COUNTED, "n long", "append", GroupStateTimeout.NoTimeout)


def threshold_alerts(counted: DataFrame) -> DataFrame:
    """Counted events that reach their threshold: each key once."""
    at = F.when(F.col("event_type") == "accessed", memory.REDUNDANT_AT).otherwise(memory.REPEATED_AT)
    name = F.when(F.col("event_type") == "accessed", "redundant_access").when(F.col("event_type") == "failed_search", "repeated_failed_search").otherwise("tool_error_loop")
    return counted.filter(F.col("n") == at).select("session_id", name.alias("pattern"), "key", "n", "timestamp")


def _total(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    used, without = state.get if state.exists else (0, 0)
    out = []
    # a group comes in several Arrow batches, in any order: what a trigger holds of it is sorted as a whole
    for row in pd.concat(batches, ignore_index=True).sort_values(["timestamp", "id"]).itertuples(index=False):
        used, without = used + row.tokens_used, without + row.tokens_without_index
        percent = math.floor((without - used) / without * 1000 + 0.5) / 10 if without > 0 else 0.0
        out.append((key[0], row.id, row.timestamp, used, without - used, percent))
    state.update((used, without))
    yield pd.DataFrame(out, columns=["session_id", "id", "timestamp", "cumulative_actual", "cumulative_savings", "cumulative_percent"])


def running_totals(log: DataFrame) -> DataFrame:
    """Log rows (id, session_id, timestamp, tokens_used, tokens_without_index) with running totals per session: rows of
    a trigger in order of time and id, after those of the triggers before. State is two numbers per session."""
    rows = log.select("id", "session_id", "timestamp", "tokens_used", "tokens_without_index")
    schema = "session_id string, id long, timestamp timestamp, cumulative_actual long, cumulative_savings long, cumulative_percent double"
    return rows.groupBy("session_id").applyInPandasWithState(_total, schema, "used long, without_index long", "append", GroupStateTimeout.NoTimeout)


_DEAD_END = "session_id string, file_path string, symbol_name string, timestamp timestamp"


def _dead_end(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    added, done = state.get if state.exists else (False, False)
    out = []
    for row in pd.concat(batches, ignore_index=True).sort_values(["timestamp", "id"]).itertuples(index=False):
        if row.event_type == "symbol_removed" and added and not done:
            done = True
            out.append((*key, row.timestamp))
        added = added or row.event_type == "symbol_added"
    state.update((added, done))
    yield pd.DataFrame(out, columns=["session_id", "file_path", "symbol_name", "timestamp"])


def dead_ends(events: DataFrame) -> DataFrame:
    """The first removal of a symbol that the session had added, once per session, file and symbol. State is two marks."""
    rows = events.filter(F.col("event_type").isin("symbol_added", "symbol_removed")).select("id", "session_id", "file_path", "symbol_name", "event_type", "timestamp")
    return rows.groupBy("session_id", "file_path", "symbol_name").applyInPandasWithState(_dead_end, _DEAD_END, "added boolean, done boolean", "append", GroupStateTimeout.NoTimeout)


def thrashing(events: DataFrame, least: int = memory.THRASH_EVENTS, minutes: int = memory.THRASH_MINUTES, types: tuple[str, ...] = CHANGE_EVENTS) -> DataFrame:
    """Bursts of changes to a file of a session; after one is reported the next waits for ``minutes``. State is the
    changes of the last minutes and the last report."""
    span = minutes * 60_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, last = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        rows = pd.concat(batches, ignore_index=True).sort_values(["at", "id"])
        times = [*recent, *rows["at"].tolist()]
        out = []
        for at in rows["at"].drop_duplicates().tolist():
            n = sum(at - span <= t <= at for t in times)
            if n >= least and (last is None or at - last >= span):
                last = at
                out.append((*key, n, pd.Timestamp(at, unit="us")))
        newest = max(times)
        state.update(([t for t in times if t >= newest - span], last))
        yield pd.DataFrame(out, columns=["session_id", "file_path", "change_count", "timestamp"])

    rows = events.filter(F.col("event_type").isin(*types)).select("id", "session_id", "file_path", F.unix_micros("timestamp").alias("at"))
    shape = "session_id string, file_path string, change_count long, timestamp timestamp"
    return rows.groupBy("session_id", "file_path").applyInPandasWithState(run, shape, "recent array<long>, last long", "append", GroupStateTimeout.NoTimeout)


def push(rows: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Give every micro-batch to a callable: the place of a socket push."""
    return rows.writeStream.outputMode(mode).foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
