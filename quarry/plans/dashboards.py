"""Dashboard queries over one or many projects, keyed by project."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import tokens


def project_stats(projects: DataFrame, files: DataFrame, symbols: DataFrame, sessions: DataFrame, log: DataFrame) -> DataFrame:
    """Per project: counts, last indexing, tokens saved (not below 0) and percent. All tables carry ``project``."""
    f = files.groupBy("project").agg(F.count(F.lit(1)).alias("file_count"), F.max("last_indexed").alias("last_indexed"))
    s = symbols.groupBy("project").agg(F.count(F.lit(1)).alias("symbol_count"))
    n = sessions.groupBy("project").agg(F.count(F.lit(1)).alias("session_count"))
    out = projects.select("project").join(f, "project", "left").join(s, "project", "left").join(n, "project", "left").join(savings(log), "project", "left")
    return out.na.fill(0, ["file_count", "symbol_count", "session_count", "tokens_saved", "tokens_actual", "savings_percent"])


def savings(log: DataFrame) -> DataFrame:
    """Per project: tokens_saved, tokens_actual, savings_percent (whole, not below 0)."""
    t = log.groupBy("project").agg(F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens_actual"), F.coalesce(F.sum("tokens_without_index"), F.lit(0)).alias("_est"))
    saved = F.col("_est") - F.col("tokens_actual")
    percent = F.when(F.col("_est") > 0, F.greatest(F.lit(0), scalars.js_round(saved / F.col("_est") * 100))).otherwise(F.lit(0)).cast("long")
    return t.select("project", F.greatest(F.lit(0), saved).cast("long").alias("tokens_saved"), "tokens_actual", percent.alias("savings_percent"))


def overview(stats: DataFrame) -> DataFrame:
    """Totals over projects, and the mean of their percents."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}")
    mean = scalars.js_round(F.coalesce(F.avg("savings_percent"), F.lit(0.0))).cast("long")
    return stats.agg(F.count(F.lit(1)).alias("total_projects"), *[total(c) for c in ("file_count", "symbol_count", "tokens_saved", "tokens_actual", "session_count")], mean.alias("avg_savings_percent"))


def project_detail(files: DataFrame, symbols: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    f = files.select("path", "language", "raw_token_estimate", "last_indexed").orderBy("path")
    s = symbols.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id")
    s = s.select("name", "kind", "signature", "start_line", "file_path", "id").orderBy("kind", "name", "id").limit(1000).drop("id")
    t = log.orderBy(F.desc("timestamp"), F.desc("id")).limit(200).select("tool_name", "tokens_used", "tokens_without_index", "timestamp", "query")
    return {"files": f, "symbols": s, "token_log": t}


def recent_sessions(sessions: DataFrame, log: DataFrame | None = None, each: int = 12, most: int = 12) -> DataFrame:
    """The latest sessions of every project, merged to the latest of all, with last activity."""
    order = Window.partitionBy("project").orderBy(F.desc("started_at"), "id")
    top = sessions.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= each).drop("_n")
    top = top.orderBy(F.desc("started_at"), "project", "id").limit(most)
    return top if log is None else tokens.with_totals(top, log)


def project_sessions(sessions: DataFrame, most: int = 50) -> DataFrame:
    return sessions.orderBy(F.desc("started_at"), "id").limit(most)


def search_table(rows: DataFrame, text: str, columns: tuple[str, ...], most: int = 500) -> DataFrame:
    """The dashboard's filter: rows in which one of the columns holds the text, ignoring case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(c).contains(text.lower())
    return rows.filter(hit).limit(most)


def page(rows: DataFrame, order: list, number: int, size: int = 6) -> DataFrame:
    return rows.orderBy(*order).offset(number * size).limit(size)


def latest(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The last n rows per key, oldest first: chart points and feeds."""
    w = Window.partitionBy(key).orderBy(F.desc("timestamp"), F.desc("id"))
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def history_totals(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("total_savings"), F.lit(0)).alias("savings"))
