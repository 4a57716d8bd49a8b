"""Token accounting: the log, running totals, session statistics, and estimates of the cost without an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

# --- fixed values: multipliers per tool, and what the estimator assumes
MULTIPLIERS = {
    "search_symbols": 10, "get_symbol": 15, "get_context": 5, "get_file_summary": 8, "find_usages": 10, "get_dependencies": 10,
    "get_project_overview": 5, "get_api_endpoints": 8, "search_docs": 8, "get_doc_chunk": 3,
}
NULL_IS_FREE = ("get_symbol", "get_context", "get_file_summary", "get_doc_chunk")
FILE_TOOLS = {"get_symbol": (50, 10), "get_context": (150, 5), "get_file_summary": (100, 8)}
BREAK_EVEN_FILES, BREAK_EVEN_LINES = 40, 150
# --- end of fixed values


def logged_estimate(tool: Column, used: Column, found: Column) -> Column:
    """Tokens without the index, as a call is logged: the tool's multiple of what was used, at least what was used."""
    table = F.create_map(*[F.lit(x) for kv in MULTIPLIERS.items() for x in kv])
    times = F.coalesce(F.try_element_at(table, tool), F.lit(0))
    return F.greatest(F.when(tool.isin(*NULL_IS_FREE) & ~found, F.lit(0)).otherwise(used * times), used)


def log_calls(calls: DataFrame) -> DataFrame:
    """Log rows of tool calls (session_id, tool_name, output, found, query, timestamp); reindex is not logged."""
    used = scalars.estimate_tokens(F.col("output"))
    return calls.filter("tool_name <> 'reindex'").select(
        "timestamp", "session_id", "tool_name", used.alias("tokens_used"), logged_estimate(F.col("tool_name"), used, F.col("found")).alias("tokens_without_index"), "query"
    )


def running_totals(log: DataFrame, order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    """Log rows with the cumulative tokens, savings and percent of their session."""
    w = Window.partitionBy("session_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    saved = F.col("tokens_without_index") - F.col("tokens_used")
    out = log.withColumns(
        {"cumulative_actual": F.sum("tokens_used").over(w), "cumulative_savings": F.sum(saved).over(w), "_all": F.sum("tokens_without_index").over(w)}
    )
    return out.withColumn("cumulative_percent", scalars.percent(F.col("cumulative_savings"), F.col("_all"))).drop("_all")


def session_stats(log: DataFrame) -> DataFrame:
    """Per session: calls, tokens used and without the index, saved, and percent with one decimal."""
    g = log.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("total_used"), F.coalesce(F.sum("tokens_without_index"), F.lit(0)).alias("total_without")
    )
    saved = F.col("total_without") - F.col("total_used")
    return g.withColumn("total_saved", saved).withColumn("savings_percent", scalars.percent(F.col("total_saved"), F.col("total_without")))


def with_totals(sessions: DataFrame, log: DataFrame) -> DataFrame:
    """Sessions with their totals and last activity, by aggregation."""
    saved = F.sum(F.col("tokens_without_index") - F.col("tokens_used"))
    g = log.groupBy("session_id").agg(F.sum("tokens_used").alias("total_tokens"), saved.alias("total_savings"), F.max("timestamp").alias("last_activity_at"))
    out = sessions.join(g, sessions["id"] == g["session_id"], "left").drop("session_id")
    return out.withColumns({"total_tokens": F.coalesce("total_tokens", F.lit(0)), "total_savings": F.coalesce("total_savings", F.lit(0))})


def recommendation(files: DataFrame) -> DataFrame:
    """One row: is the index worthwhile for a project of this size?"""
    g = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("raw_token_estimate"), F.lit(0)).alias("tokens"))
    lines = F.when(F.col("files") > 0, scalars.js_round(F.col("tokens") / F.col("files") * 4 / 50)).otherwise(F.lit(0)).cast("long")
    g = g.withColumn("avg_lines", lines)
    worth = (F.col("files") >= BREAK_EVEN_FILES) | (F.col("avg_lines") >= BREAK_EVEN_LINES)
    size = F.format_string("%d files, avg ~%d lines/file", "files", "avg_lines")
    return g.withColumn("worthwhile", worth).withColumn(
        "reason",
        F.when(F.col("worthwhile"), F.concat(size, F.lit(" — index tools save tokens"))).otherwise(
            F.concat(F.lit("Small project ("), size, F.lit(") — direct reads may be more efficient than index overhead"))
        ),
    )


# --- estimator


def estimate_search(files: DataFrame, query: str | None) -> DataFrame:
    """Tokens to read all files whose path holds the query (all without one); none: three average files."""
    hit = F.lower("path").contains((query or "").lower()) if query else F.lit(True)
    g = files.agg(F.sum(F.when(hit, F.col("raw_token_estimate"))).alias("s"), F.count(F.when(hit, 1)).alias("n"), F.avg("raw_token_estimate").alias("a"))
    return g.select(F.when(F.col("n") > 0, F.col("s")).otherwise(scalars.js_round(F.coalesce("a", F.lit(0.0)) * 3)).cast("long").alias("tokens"))


def estimate_file(files: DataFrame, tool: str, path: str, used: int | None = None) -> DataFrame:
    """Tokens of the host file, or a multiple of what was used where it is unknown."""
    default, times = FILE_TOOLS[tool]
    g = files.filter(F.col("path") == path).agg(F.max("raw_token_estimate").alias("t"))
    return g.select(F.coalesce("t", F.lit((default if used is None else used) * times)).cast("long").alias("tokens"))


def estimate_dependencies(files: DataFrame, dependencies: DataFrame, path: str, used: int | None = None) -> DataFrame:
    """A file and its direct imports, one term per edge."""
    own = files.filter(F.col("path") == path).select("id", F.col("raw_token_estimate").alias("own"))
    edges = dependencies.join(own.select(F.col("id").alias("from_file")), "from_file", "left_semi")
    their = edges.join(files.select(F.col("id").alias("to_file"), "raw_token_estimate"), "to_file").agg(F.coalesce(F.sum("raw_token_estimate"), F.lit(0)).alias("d"))
    g = own.agg(F.max("own").alias("own")).crossJoin(F.broadcast(their))  # one row each
    return g.select(F.coalesce(F.col("own") + F.col("d"), F.lit((80 if used is None else used) * 10)).cast("long").alias("tokens"))


def estimate_usages(files: DataFrame, count: int) -> DataFrame:
    return files.agg(scalars.js_round(F.coalesce(F.avg("raw_token_estimate"), F.lit(0.0)) * min(count, 5)).cast("long").alias("tokens"))


def estimate_overview(files: DataFrame) -> DataFrame:
    """Three tenths of every file, each rounded."""
    return files.agg(F.coalesce(F.sum(scalars.js_round(F.col("raw_token_estimate") * 0.3)), F.lit(0)).cast("long").alias("tokens"))


def estimate_other(used: int | None = None) -> int:
    return (50 if used is None else used) * 10
