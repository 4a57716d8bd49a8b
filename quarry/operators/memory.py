"""Session memory: snapshot diffs, events and observations, and the patterns found in event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..schema import ANTI_PATTERN_EVENTS, CHANGE_EVENTS
from .dml import last_per_key

# --- fixed values: thresholds of the patterns, and the texts of observations
THRASH_EVENTS, THRASH_MINUTES, REDUNDANT_AT, REPEATED_AT = 4, 5, 5, 3
DEAD_END = "Dead-end: `%s` was added then removed in this session — possible false start"
DEAD_END_EXTRA = "Added then removed `%s`"
THRASHING = "File thrashing: `%s` changed %d× in %d minutes"
REDUNDANT = "Redundant access: %s accessed %d+ times — context may not be retained between calls"
FAILED_SEARCH = "Repeated failed search: `%s` returned no results %d times — symbol may be renamed or in an unindexed file"
ERROR_LOOP = "Tool error loop: `%s` failed %d times%s — file may be unindexed, deleted, or unreadable"
BLIND_SPOT = "`%s` exists on disk but is not indexed — consider running reindex"
STALE_WARNING = " linked to code that has since changed — re-evaluate before relying on them"
# --- end of fixed values

_EVENT = ("session_id", "event_type", "file_path", "symbol_name", "extra", "timestamp")


def _extra(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def snapshot_of(symbols: DataFrame) -> DataFrame:
    """(file_path, symbol_name, kind, signature, signature_hash): per file and name the last symbol."""
    rows = symbols.select(F.col("path").alias("file_path"), F.col("name").alias("symbol_name"), "kind", "signature", "ord")
    best = last_per_key(rows, ["file_path", "symbol_name"], F.col("ord"))
    return best.select("file_path", "symbol_name", "kind", "signature", scalars.signature_hash(F.col("signature")).alias("signature_hash"), "ord")


def diff(old: DataFrame, new: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Changes between two snapshots: file_path, symbol_name, type (removed, sig_changed, added), kind, old_signature,
    new_signature, description. A file without an earlier snapshot has no changes; ``files`` (file_path) names the files
    that were looked at now, others are left alone. A change of kind alone is none."""
    if files is not None:
        old = old.join(files, "file_path", "left_semi")
        new = new.join(files, "file_path", "left_semi")
    known = old.select("file_path").distinct()
    key = ["file_path", "symbol_name"]
    a = old.select(*key, F.col("kind").alias("old_kind"), F.col("signature").alias("old_signature"), F.col("signature_hash").alias("old_hash"))
    b = new.join(known, "file_path", "left_semi").select(*key, F.col("kind").alias("new_kind"), F.col("signature").alias("new_signature"), F.col("signature_hash").alias("new_hash"))
    both = a.join(b, key, "full_outer")
    kind = (
        F.when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash").isNull(), "added").when(F.col("old_hash") != F.col("new_hash"), "sig_changed")
    )
    what = F.coalesce("new_kind", "old_kind")
    tail = F.when(F.col("type") == "sig_changed", "signature changed").otherwise(F.col("type"))
    return both.withColumn("type", kind).filter("type IS NOT NULL").select(
        *key, "type", what.alias("kind"), "old_signature", "new_signature", F.format_string("%s `%s` %s", what, "symbol_name", tail).alias("description")
    )


def updated_snapshots(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """Snapshots after a look at ``files``: theirs are replaced, others stay."""
    columns = ["file_path", "symbol_name", "kind", "signature", "signature_hash"]
    return old.join(files, "file_path", "left_anti").select(*columns).unionByName(new.join(files, "file_path", "left_semi").select(*columns))


def events_of_changes(changes: DataFrame, session_id: Column, timestamp: Column) -> DataFrame:
    name = F.when(F.col("type") == "added", "symbol_added").when(F.col("type") == "removed", "symbol_removed").otherwise("sig_changed")
    return changes.select(
        session_id.alias("session_id"), name.alias("event_type"), "file_path", "symbol_name", _extra(description=F.col("description")).alias("extra"), timestamp.alias("timestamp")
    )


def observations_of_changes(change_events: DataFrame, accessed: DataFrame) -> DataFrame:
    """Observations for changes in files that the session has accessed, as a whole or a symbol of them. accessed:
    session_id, file_path; accesses without a file (usage searches) do not count."""
    by_file = accessed.filter("file_path IS NOT NULL").select("session_id", "file_path")
    return change_events.join(by_file, ["session_id", "file_path"], "left_semi").select(
        "session_id", F.col("event_type").alias("type"), "file_path", "symbol_name", F.col("extra")["description"].alias("observation"), F.lit(False).alias("stale"), F.col("timestamp").alias("created_at")
    )


def observe_calls(calls: DataFrame) -> DataFrame:
    """Tool calls -> events. calls: session_id, tool, file, target, symbol, query, error, found, exists, timestamp, where
    found tells whether there was a result (a row), file for get_symbol is the file of the result."""
    tool, err = F.col("tool"), F.coalesce("error", F.lit(False))
    found = F.coalesce("found", F.lit(False))
    kind = (
        F.when(err, "tool_error")
        .when(tool.isin("get_symbol", "get_file_summary") & found, "accessed")
        .when(tool.isin("get_symbol", "get_file_summary") & F.col("file").isNotNull() & F.coalesce("exists", F.lit(False)), "index_blind_spot")
        .when(tool.isin("get_context", "find_usages"), "accessed")
        .when((tool == "search_symbols") & ~found, "failed_search")
    )
    nth = F.row_number().over(Window.partitionBy("session_id", "_kind", "query").orderBy("timestamp", "_ord"))
    rows = calls.withColumn("_kind", kind).filter("_kind IS NOT NULL").withColumn("_ord", F.monotonically_increasing_id())
    rows = rows.withColumn("attempt", F.when(F.col("_kind") == "failed_search", nth))
    place = F.when(err, F.coalesce("file", "target")).when(tool.isin("find_usages", "search_symbols"), F.lit(None)).otherwise(F.col("file"))
    symbol = F.when(tool.isin("get_symbol", "find_usages") & ~err, F.col("symbol"))
    extra = (
        F.when(F.col("_kind") == "tool_error", _extra(tool=tool))
        .when(F.col("_kind") == "failed_search", _extra(query=F.col("query"), attempt=F.col("attempt")))
        .when(F.col("_kind") == "index_blind_spot", _extra(tool=tool))
    )
    return rows.select("session_id", F.col("_kind").alias("event_type"), place.alias("file_path"), symbol.alias("symbol_name"), extra.alias("extra"), "timestamp")


# --- patterns


def _nth(events: DataFrame, keys: list[str | Column], n: int) -> DataFrame:
    order = Window.partitionBy("session_id", *keys).orderBy("timestamp", "id")
    return events.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == n).drop("_n")


def redundant_access(events: DataFrame, at: int = REDUNDANT_AT) -> DataFrame:
    """The at-th access of the same file, or file and symbol, in a session."""
    hit = _nth(events.filter((F.col("event_type") == "accessed") & F.col("file_path").isNotNull()), ["file_path", "symbol_name"], at)
    what = F.when(F.col("symbol_name").isNotNull(), F.format_string("`%s` in `%s`", "symbol_name", "file_path")).otherwise(F.format_string("`%s`", "file_path"))
    return _found(hit, "redundant_access", _extra(count=F.lit(at)), F.format_string(REDUNDANT, what, F.lit(at)))


def _found(rows: DataFrame, event: str, extra: Column, text: Column, kind: str = "anti_pattern") -> DataFrame:
    return rows.select(
        "session_id", F.lit(event).alias("event_type"), "file_path", "symbol_name", extra.alias("extra"), "timestamp", F.lit(kind).alias("type"), text.alias("observation")
    )


def repeated_failed_search(events: DataFrame, at: int = REPEATED_AT) -> DataFrame:
    rows = events.filter(F.col("event_type") == "failed_search").withColumn("_q", F.col("extra")["query"])
    hit = _nth(rows, ["_q"], at)
    return _found(hit, "failed_search", _extra(query=F.col("_q")), F.format_string(FAILED_SEARCH, "_q", F.lit(at)))


def tool_error_loop(events: DataFrame, at: int = REPEATED_AT) -> DataFrame:
    rows = events.filter(F.col("event_type") == "tool_error").withColumn("_t", F.col("extra")["tool"])
    hit = _nth(rows, ["_t", "file_path"], at)
    where = F.when(F.col("file_path").isNotNull(), F.format_string(" on `%s`", "file_path")).otherwise("")
    return _found(hit, "tool_error", _extra(tool=F.col("_t")), F.format_string(ERROR_LOOP, "_t", F.lit(at), where), "environment")


def dead_ends(events: DataFrame) -> DataFrame:
    """The first removal of a symbol that the session had added, once per session, file and symbol."""
    key = ["session_id", "file_path", "symbol_name"]
    at = F.struct("timestamp", "id")
    added = events.filter(F.col("event_type") == "symbol_added").groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.min(at).alias("_added"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    removed = events.filter(F.col("event_type") == "symbol_removed").join(added, same).filter(at > F.col("_added"))
    rows = removed.groupBy(*key).agg(F.min(at).alias("hit")).select(*key, F.col("hit.timestamp").alias("timestamp"))
    return _found(rows, "dead_end", _extra(description=F.format_string(DEAD_END_EXTRA, "symbol_name")), F.format_string(DEAD_END, "symbol_name"))


def change_windows(events: DataFrame, minutes: int = THRASH_MINUTES, types: tuple[str, ...] = CHANGE_EVENTS) -> DataFrame:
    """Change events with the number of changes of their file and session in the minutes up to them."""
    rows = events.filter(F.col("event_type").isin(*types))
    w = Window.partitionBy("session_id", "file_path").orderBy(F.unix_micros(F.col("timestamp").cast("timestamp"))).rangeBetween(-minutes * 60_000_000, 0)
    return rows.withColumn("recent", F.count(F.lit(1)).over(w))


def thrashing(events: DataFrame, least: int = THRASH_EVENTS, minutes: int = THRASH_MINUTES, types: tuple[str, ...] = CHANGE_EVENTS) -> DataFrame:
    """Bursts of changes to a file; after one is reported the next waits for ``minutes``.

    Whether a row reports depends on the last report, so the candidates are read in order of session, file and time;
    only the last report is held."""
    hot = change_windows(events, minutes, types).filter(F.col("recent") >= least)
    wait = pd.Timedelta(minutes=minutes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        was, last = None, None  # the key and its last report, carried over batches
        for df in batches:
            keep = []
            for key, t in zip(zip(df["session_id"], df["file_path"], strict=True), df["timestamp"], strict=True):
                if key != was:
                    was, last = key, None
                keep.append(last is None or t - last >= wait)
                last = t if keep[-1] else last
            yield df[keep]

    kept = hot.select("id", "session_id", "file_path", "timestamp", "recent").repartition("session_id", "file_path").sortWithinPartitions("session_id", "file_path", "timestamp", "id")
    kept = kept.mapInPandas(run, kept.schema).withColumn("symbol_name", F.lit(None).cast("string"))
    return _found(
        kept, "thrash_detected", _extra(change_count=F.col("recent"), window_minutes=F.lit(minutes)), F.format_string(THRASHING, "file_path", "recent", F.lit(minutes))
    )


def patterns(events: DataFrame) -> DataFrame:
    out = redundant_access(events)
    for f in (repeated_failed_search, tool_error_loop, dead_ends, thrashing):
        out = out.unionByName(f(events))
    return out


def anti_pattern_events(events: DataFrame, session_id: str | None = None) -> DataFrame:
    rows = events.filter(F.col("event_type").isin(*ANTI_PATTERN_EVENTS))
    rows = rows if session_id is None else rows.filter(F.col("session_id") == session_id)
    return rows.orderBy(F.desc("timestamp"), F.desc("id"))


def last_event(events: DataFrame, event_type: str) -> DataFrame:
    """The latest event of a type per session and file."""
    rows = events.filter(F.col("event_type") == event_type)
    return rows.groupBy("session_id", "file_path").agg(F.max(F.struct("timestamp", "id")).alias("v")).select("session_id", "file_path", "v.timestamp", "v.id")


def prior_sessions(observations: DataFrame, session_id: str) -> DataFrame:
    return observations.filter(F.col("session_id") != session_id).agg(F.count_distinct("session_id").alias("prior_sessions"))


def stale_warning(count: Column) -> Column:
    return F.when(count > 0, F.concat(count.cast("string"), F.when(count > 1, " observations").otherwise(" observation"), F.lit(STALE_WARNING)))
