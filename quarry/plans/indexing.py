"""Indexing: a scan against the current tables gives the next tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars
from ..operators import dml, graph, memory, parse
from ..sources.store import Store

# --- fixed values: what a summariser is given, and how many calls run at once
SUMMARY_CHARS, SUMMARY_CALLS = 4000, 3
# --- end of fixed values


def summarised(files: DataFrame, summarise: Callable[[str, str], str | None] | None) -> DataFrame:
    """files (path, content) with summary, from an injected callable; null without one, or where it fails."""
    if summarise is None:
        return files.withColumn("summary", F.lit(None).cast("string"))

    def run(batches):
        for df in batches:
            out = []
            for path, text in zip(df["path"], df["content"], strict=True):
                try:
                    out.append(summarise(path, (text or "")[:SUMMARY_CHARS]))
                except Exception:  # a failed call leaves the summary open
                    out.append(None)
            yield pd.DataFrame({"path": df["path"], "summary": pd.Series(out, dtype=object)})

    found = files.select("path", "content").repartition(SUMMARY_CALLS).mapInPandas(run, "path string, summary string")
    return files.join(found, "path", "left")


def index_files(
    tables: dict[str, DataFrame], scanned: DataFrame, whole: bool = True, force: bool = False, summarise=None, session_id: str | None = None, held: list[DataFrame] | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, status): the tables after indexing the scanned files (path, content). Unchanged files are skipped by hash;
    with ``whole``, files that the scan lacks are deleted. Only changed files are parsed; the imports of all files are kept
    in a table, and edges are resolved from it for the whole project at once. What is persisted on the way is added to ``held``, to be
    released when the tables are written. With a session, changes of symbols become events and make older observations stale."""
    rows = parse.changed_files(parse.file_rows(scanned), tables["files"])
    rows = rows.withColumn("status", F.when((F.col("status") == "skipped") & F.lit(force), "updated").otherwise(F.col("status"))).persist()
    todo = summarised(rows.filter("status <> 'skipped'"), summarise).persist()
    out = dict(tables)
    if whole:
        out = dml.delete_files(out, dml.vanished(out["files"], rows))
    new_files = todo.select("path", "language", "summary", F.current_timestamp().alias("last_indexed"), "hash", "raw_token_estimate")
    out["files"] = dml.merge(out["files"], new_files, "files").persist()
    # parsed once: symbols and imports of changed files, and of all scanned files where no imports were kept before
    had = "imports" in tables and (tables["imports"].limit(1).count() > 0 or tables["files"].limit(1).count() == 0)
    code = (todo if had else rows).filter(~scalars.is_document_language(F.col("language")))
    parsed = parse.parse(code).persist()
    if held is not None:
        held += [rows, todo, out["files"], parsed]
    ids = out["files"].select("path", F.col("id").alias("file_id"))
    touched = todo.select("path")
    found = parse.symbols(parsed.join(touched, "path", "left_semi"))
    gone = ids.join(touched, "path", "left_semi").select("file_id")
    kept = dml.delete_where(out["symbols"], gone, {"file_id": "file_id"})
    new_symbols = found.join(ids, "path").drop("path")
    out["symbols"] = kept.unionByName(dml.schema_like(dml.with_ids(new_symbols, out["symbols"], ["file_id", "ord"]), out["symbols"]))
    chunks = parse.document_chunks(todo.select("path", "content")).join(ids, "path").drop("path")
    kept = dml.delete_where(out["documents"], gone, {"file_id": "file_id"})
    out["documents"] = kept.unionByName(dml.schema_like(dml.with_ids(chunks, out["documents"], ["file_id", "chunk_index"]), out["documents"]))
    edge = ["from_file", "to_file", "symbol_name"]
    read = parse.imports(parsed).join(ids, "path").drop("path")
    none = schema.empty(rows.sparkSession, "imports")
    kept = dml.delete_where(out["imports"], gone, {"file_id": "file_id"}) if had else none
    out["imports"] = kept.unionByName(dml.schema_like(dml.with_ids(read, out["imports"] if had else none, ["file_id", "ord", "symbol_name"]), none))
    edges = graph.resolve(out["imports"].join(ids, "file_id").select("path", "source", "symbol_name"), out["files"])
    # an edge that stays keeps its id
    old = out["dependencies"]
    edges = edges.join(old.select(*edge, "id"), edge, "left")
    fresh = dml.with_ids(edges.filter("id IS NULL"), old, edge)
    left = old.limit(0) if had else dml.delete_where(old, rows.join(ids, "path").select("file_id"), {"from_file": "file_id"})
    out["dependencies"] = left.unionByName(dml.schema_like(edges.filter("id IS NOT NULL"), old)).unionByName(dml.schema_like(fresh, old))
    # snapshots and what their changes mean
    looked = touched.withColumnRenamed("path", "file_path")
    new_snap = memory.snapshot_of(found)
    changes = memory.diff(out["ast_snapshots"], new_snap, looked)
    if session_id is not None:
        events = memory.events_of_changes(changes, F.lit(session_id), F.current_timestamp())
        out["session_observations"] = dml.mark_stale(out["session_observations"], changes.filter("type <> 'added'"))
        accessed = out["session_events"].filter("event_type = 'accessed'")
        notes = memory.observations_of_changes(events, accessed)
        out["session_observations"] = dml.append(out["session_observations"], notes, ["file_path", "type", "symbol_name"])
        out["session_events"] = dml.append(out["session_events"], events, ["file_path", "event_type", "symbol_name"])
    snaps = memory.updated_snapshots(out["ast_snapshots"], new_snap, looked).withColumn("captured_at", F.current_timestamp())
    out["ast_snapshots"] = dml.schema_like(dml.with_ids(snaps, out["ast_snapshots"].limit(0), ["file_path", "symbol_name"]), out["ast_snapshots"])
    return out, rows.groupBy("status").count().withColumnRenamed("count", "n")


def index_project(store: Store, scanned: DataFrame, **options) -> DataFrame:
    """Index into a store and commit all tables as one version."""
    from ..schema import TABLES

    tables = {t: store.table(t) for t in TABLES}
    held: list[DataFrame] = []
    out, status = index_files(tables, scanned, held=held, **options)
    status = status.sparkSession.createDataFrame(status.collect(), "status string, n long")
    store.commit(**{t: df for t, df in out.items() if df is not tables[t]})
    for df in held:
        df.unpersist()
    return status
