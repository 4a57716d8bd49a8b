"""The engine's tables as views over generic tables (documents, conversations, events, lineitem, orders, pages)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import fts, parse, tokens
from ..sources.store import shared_folder

#: Multipliers by kind of event stand for those by tool.
TOOL_OF_EVENT = {"click": "get_symbol", "view": "search_symbols", "purchase": "get_context", "signup": "get_file_summary", "logout": "start_comparison"}


_saved: dict[tuple, str] = {}


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def text_index(self, diacritics: bool = False) -> tuple[DataFrame, DataFrame]:
        """(postings, lengths) of all texts: saved once per session in the order of its terms, then read with only the
        row groups that hold a query's terms."""
        key = (self.spark.sparkContext.applicationId, self.dir, diacritics)
        if key not in _saved:
            path = f"{shared_folder(self.spark)}/texts"
            fts.save_index(*fts.build_index(self.texts, ("content",), diacritics=diacritics), path)
            _saved[key] = path
        return fts.load_index(self.spark, _saved[key])

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def files(self) -> DataFrame:
        t = F.col("text")
        return self.raw("documents").select(
            F.col("doc_id").alias("id"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("lang").alias("language"),
            scalars.content_hash(t).alias("hash"), scalars.estimate_tokens(t).alias("raw_token_estimate"), F.col("source").alias("project"),
        )

    @property
    def texts(self) -> DataFrame:
        return self.raw("documents").select(
            F.col("doc_id").alias("id"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"), F.col("source").alias("project")
        )

    @property
    def context(self) -> DataFrame:
        return self.raw("conversations").select(
            (F.col("conv_id") * 10_000 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("session_id"), F.col("text").alias("content"), F.col("role").alias("tags")
        )

    @property
    def events(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), "event_type", F.get_json_object("props", "$.k").alias("file_path"), F.col("ts").alias("timestamp"), "value"
        )

    @property
    def token_log(self) -> DataFrame:
        table = F.create_map(*[F.lit(x) for k, v in TOOL_OF_EVENT.items() for x in (k, v)])
        tool = F.coalesce(F.try_element_at(table, F.col("event_type")), F.lit("reindex"))
        used = F.floor("value").cast("long")
        rows = self.events.select("id", "session_id", tool.alias("tool_name"), used.alias("tokens_used"), "timestamp", (F.col("session_id") % 7).alias("project"))
        return rows.withColumn("tokens_without_index", tokens.logged_estimate(F.col("tool_name"), F.col("tokens_used"), F.lit(True)))

    @property
    def sessions(self) -> DataFrame:
        g = self.events.groupBy(F.col("session_id").alias("id")).agg(F.min("timestamp").alias("started_at"))
        return g.withColumn("project", F.col("id") % 7)

    @property
    def dependencies(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_suppkey").alias("from_file"), F.col("l_partkey").alias("to_file"), F.col("l_linenumber").cast("string").alias("symbol_name"))

    @property
    def usages(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_partkey").alias("symbol_id"), F.col("l_orderkey").alias("used_in_file"), F.col("l_linenumber").alias("used_at_line"))


class Index(Views):
    """A whole index: a file per document, a symbol per part, an edge and a usage per line item, notes and events per
    event."""

    @staticmethod
    def path_of(k) -> Column:
        name = k.cast("string")
        return F.when(k % 10 == 0, F.concat(F.lit("src/"), name, F.lit("/index.ts"))).otherwise(F.concat(F.lit("src/"), name, F.lit(".txt")))

    @property
    def contents(self) -> DataFrame:
        return self.raw("documents").select(self.path_of(F.col("doc_id")).alias("path"), F.col("text").alias("content"))

    def contents_of_documents(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))

    def logged_calls(self) -> DataFrame:
        table = F.create_map(*[F.lit(x) for k, v in TOOL_OF_EVENT.items() for x in (k, v)])
        tool = F.coalesce(F.try_element_at(table, F.col("event_type")), F.lit("reindex"))
        calls = self.raw("events").select(
            F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("session_id"), tool.alias("tool_name"), F.col("props").alias("output"), F.lit(True).alias("found"), F.col("event_id").cast("string").alias("query")
        )
        return tokens.log_calls(calls)

    def tables(self) -> dict[str, DataFrame]:
        d, p, e = self.raw("documents"), self.raw("part"), self.raw("events")
        kind, size, key = F.lower("p_type"), F.col("p_size") % 4, F.col("p_partkey")
        symbols = p.select(
            key.alias("id"), (key % 200).alias("file_id"), F.when(size == 3, F.concat(F.lit("GET /"), kind, F.lit("/"), key.cast("string"))).otherwise(F.col("p_name")).alias("name"),
            F.when(size == 0, "function").when(size == 1, "class").when(size == 2, "method").otherwise("route").alias("kind"), F.concat("p_brand", F.lit("("), kind, F.lit(")")).alias("signature"),
            F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("a "), kind, F.lit(" part"))).alias("summary"), F.col("p_size").cast("int").alias("start_line"), (F.col("p_size") + 3).cast("int").alias("end_line"),
            (key % 2 == 0).alias("is_exported"), (key % 3 == 0).alias("is_async"), (key % 5 == 0).alias("has_try_catch"),
        )
        place = self.path_of(F.col("event_id") % 200)
        session = F.col("user_id").cast("string").alias("session_id")
        stale = F.col("value") > 60
        named = e.join(symbols.select(F.col("id").alias("_s"), "name"), F.col("event_id") % 200 == F.col("_s"), "left")
        observations = named.select(
            F.col("event_id").alias("id"), session, F.col("event_type").alias("type"), place.alias("file_path"), F.when(F.col("value") < 100, F.col("name")).alias("symbol_name"),
            F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("observation"), stale.alias("stale"), F.when(stale, "changed").alias("stale_reason"), F.col("ts").alias("created_at"),
        )
        event = F.col("event_type")
        what = F.when(event == "error", "tool_error").when(event == "view", "failed_search").when(event == "purchase", "accessed").when(event == "click", "sig_changed").otherwise("dead_end")
        extra = F.when(event == "signup", F.create_map(F.lit("description"), F.concat(F.lit("d"), F.col("event_id").cast("string"))))
        session_events = e.select(F.col("event_id").alias("id"), session, what.alias("event_type"), place.alias("file_path"), F.lit(None).cast("string").alias("symbol_name"), extra.alias("extra"), F.col("ts").alias("timestamp"))
        chunks = parse.line_chunks(d.select("doc_id", F.col("text").alias("content")), key="doc_id")
        documents = chunks.select((F.col("doc_id") * 100_000 + F.col("chunk_index")).alias("id"), F.col("doc_id").alias("file_id"), "chunk_index", "heading", "start_line", "end_line", "content", F.lit(None).cast("string").alias("summary"))
        files = d.select(
            F.col("doc_id").alias("id"), self.path_of(F.col("doc_id")).alias("path"), F.col("lang").alias("language"), F.concat(F.lit("about "), "source").alias("summary"), F.lit(None).cast("timestamp").alias("last_indexed"),
            scalars.content_hash(F.col("text")).alias("hash"), scalars.estimate_tokens(F.col("text")).alias("raw_token_estimate"),
        )
        sessions = e.groupBy(F.col("user_id").cast("string").alias("id")).agg(F.min("ts").cast("timestamp").alias("started_at")).withColumns({"mode": F.lit("indexed"), "label": F.lit("first")})
        log = self.token_log.withColumns({"session_id": F.col("session_id").cast("string"), "query": F.lit(None).cast("string")})
        return {
            "files": files, "symbols": symbols, "documents": documents, "session_observations": observations, "session_events": session_events, "sessions": sessions, "token_log": log,
            "dependencies": self.dependencies.select((F.col("from_file") % 200).alias("from_file"), (F.col("to_file") % 200).alias("to_file"), "symbol_name").distinct(),
            "usages": self.usages.select("symbol_id", (F.col("used_in_file") % 200).alias("used_in_file"), F.col("used_at_line").cast("int").alias("used_at_line")).distinct(),
            "context_entries": self.context.withColumn("created_at", F.lit(None).cast("timestamp")),
        }
