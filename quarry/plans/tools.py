"""The fifteen tools: validated arguments in, a lazy DataFrame out."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import dml, fts, graph, memory, parse, tokens
from ..sources import scan
from ..sources.store import Store

# --- fixed values: the arguments of each tool as (name, type, required), and the core tools
SCHEMAS = {
    "search_symbols": [("query", "text", True), ("limit", "positive", False), ("is_async", "bool", False), ("has_try_catch", "bool", False), ("snippet", "bool", False)],
    "get_symbol": [("name", "text", True), ("file", "string", False)],
    "get_context": [("file", "text", True), ("line", "positive", True), ("range", "positive", False)],
    "get_file_summary": [("file", "text", True)],
    "find_usages": [("symbol", "text", True)],
    "get_dependencies": [("target", "text", True), ("direction", ("imports", "imported_by", "both"), False)],
    "get_project_overview": [("mode", ("brief", "full"), False)],
    "get_api_endpoints": [],
    "reindex": [("target", "string", False)],
    "get_token_stats": [("session_id", "string", False)],
    "start_comparison": [("label", "text", True), ("mode", ("indexed", "baseline"), True)],
    "search_docs": [("query", "text", True), ("limit", "positive", False), ("type", ("docs", "context", "all"), False)],
    "get_doc_chunk": [("file", "text", True), ("chunk_index", "natural", False)],
    "save_context": [("content", "text", True), ("tags", "string", False)],
    "get_session_memory": [("session_id", "string", False), ("file", "string", False), ("symbol", "string", False), ("include_stale", "bool", False)],
}
CORE_TOOLS = ("search_symbols", "get_symbol", "get_context", "get_file_summary", "find_usages", "get_dependencies", "get_project_overview", "get_api_endpoints")
BASELINE_ERROR = "Index disabled for baseline measurement"
ENTRY_POINT = r"(^|/)(index|main|app)\.(ts|tsx|js)$"
# --- end of fixed values

SYMBOL_COLUMNS, DOCUMENT_COLUMNS, CONTEXT_COLUMNS = ("name", "summary", "signature"), ("content", "heading", "summary"), ("content", "tags")


class ToolError(ValueError):
    """Arguments are not valid, or the index is disabled."""


def validate(tool: str, args: dict) -> dict:
    """The arguments with names checked; raises ToolError."""
    if tool not in SCHEMAS:
        raise ToolError(f"unknown tool {tool}")
    out = {}
    for name, kind, required in SCHEMAS[tool]:
        v = args.get(name)
        if v is None:
            if required:
                raise ToolError(f"{tool}: {name} is required")
            continue
        whole = isinstance(v, int) and not isinstance(v, bool)
        ok = {
            "text": isinstance(v, str) and v != "", "string": isinstance(v, str), "bool": isinstance(v, bool),
            "positive": whole and v > 0, "natural": whole and v >= 0,
        }.get(kind) if isinstance(kind, str) else v in kind
        if not ok:
            raise ToolError(f"{tool}: {name} is not valid")
        out[name] = v
    return out


def exposed(core_only: bool = False) -> list[str]:
    return [t for t in SCHEMAS if not core_only or t in CORE_TOOLS]


@dataclass
class Project:
    """A project's tables, its full-text indexes and the texts of its files."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    texts: DataFrame | None = None  # path, content
    root: str = ""
    session_id: str = "default"
    baseline: bool = False
    federated: dict[str, Project] = field(default_factory=dict)
    store: Store | None = None  # where reindexing commits to
    index_dir: str | None = None  # saved full-text indexes, one folder per table
    _indexes: dict = field(default_factory=dict)

    @classmethod
    def open(cls, store: Store, root: str = "", **more) -> Project:
        from ..schema import TABLES

        return cls(store.spark, {t: store.table(t) for t in TABLES}, root=root, **{"store": store} | more)

    def __getitem__(self, table: str) -> DataFrame:
        return self.tables[table]

    def index(self, table: str, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
        if table not in self._indexes:
            if self.index_dir:
                self._indexes[table] = fts.load_index(self.spark, f"{self.index_dir}/{table}")
            else:
                p, n = fts.build_index(self[table], columns)
                self._indexes[table] = (p.persist(), n.persist())
        return self._indexes[table]

    def refreshed(self, table: str, before: DataFrame, columns: tuple[str, ...]) -> None:
        """Bring the full-text index of a table that changed up to date: only rows with new ids are tokenised."""
        if table not in self._indexes and self.index_dir is None:
            return  # it is built when it is asked for
        p, n = self._indexes.get(table) or fts.load_index(self.spark, f"{self.index_dir}/{table}")
        now = self[table]
        changed, removed = now.join(before.select("id"), "id", "left_anti"), before.select("id").join(now.select("id"), "id", "left_anti")
        self._indexes[table] = fts.refresh_index(p, n, changed, removed, columns)

    def save_indexes(self, index_dir: str) -> None:
        """Write the full-text indexes of all searched tables, and search there from now on."""
        for table, columns in (("symbols", SYMBOL_COLUMNS), ("documents", DOCUMENT_COLUMNS), ("context_entries", CONTEXT_COLUMNS)):
            fts.save_index(*fts.build_index(self[table], columns), f"{index_dir}/{table}")
        self.index_dir = index_dir
        self._indexes.clear()

    def call(self, tool: str, **args):
        if self.baseline and tool not in ("start_comparison", "get_token_stats"):
            raise ToolError(BASELINE_ERROR)
        return globals()[tool](self, **validate(tool, args))


def _top_symbols(p: Project, query: str, limit: int, is_async, has_try_catch) -> DataFrame:
    hits = fts.match(*p.index("symbols", SYMBOL_COLUMNS), query, SYMBOL_COLUMNS)
    rows = hits.join(p["symbols"], "id").join(p["files"].select(F.col("id").alias("file_id"), F.col("path").alias("file"), F.col("language")), "file_id")
    for name, v in (("is_async", is_async), ("has_try_catch", has_try_catch)):
        rows = rows if v is None else rows.filter(F.col(name) == v)
    return rows.orderBy("score", "id").limit(limit)


def search_symbols(p: Project, query: str, limit: int = 20, is_async=None, has_try_catch=None, snippet: bool = False) -> DataFrame:
    """Ranked symbols of the project, then of each federated one, to limit * (1 + federated) rows in all."""
    from pyspark.sql import Window

    shape = ["name", "kind", "signature", "file", "start_line", "is_async", "has_try_catch"]
    out = None
    for k, (label, q) in enumerate([(None, p), *p.federated.items()]):
        rows = _top_symbols(q, query, limit, is_async, has_try_catch)
        rows = rows.withColumns({"project": F.lit(label).cast("string"), "project_ord": F.lit(k), "rank": F.row_number().over(Window.partitionBy(F.lit(k)).orderBy("score", "id"))})
        text = F.lit(None).cast("string")
        if k == 0 and snippet:
            paths = [r.file for r in rows.select("file").distinct().collect()]  # at most limit rows
            rows = rows.join(_texts(q, paths).select(F.col("path").alias("file"), F.col("content").alias("_text")), "file", "left")
            text = scalars.line_slice(F.col("_text"), F.col("start_line"), 5)
        rows = rows.select("project_ord", "rank", "project", *shape, "score", text.alias("snippet"))
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("project_ord", "rank").limit(limit * (1 + len(p.federated)))


def _texts(p: Project, paths: list[str]) -> DataFrame:
    """(path, content) of named files: of the project's texts, or read from its tree."""
    if p.texts is not None:
        return p.texts.filter(F.col("path").isin(paths))
    return scan.as_text(scan.named_files(p.spark, p.root, paths)).select("path", "content")


def _symbol(p: Project, name: str, file: str | None) -> DataFrame:
    f = p["files"].select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    rows = p["symbols"].filter(F.col("name") == name).join(f, "file_id")
    rows = rows if file is None else rows.filter(F.col("file") == file)
    return rows.orderBy("file", "start_line", "id").limit(1)


def _memory_of(p: Project, keys: DataFrame, on: list[str]) -> DataFrame:
    """The three latest observations per key, with whether any is stale."""
    from pyspark.sql import Window

    o = p["session_observations"].withColumnRenamed("file_path", "file").join(keys, on, "left_semi")
    order = Window.partitionBy(*on).orderBy(F.desc("created_at"), F.desc("id"))
    o = o.withColumn("_n", F.row_number().over(order)).filter("_n <= 3")
    return o.groupBy(*on).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_n", "observation"))), lambda x: x["observation"]).alias("observations"), F.bool_or("stale").alias("has_stale")
    )


def get_symbol(p: Project, name: str, file: str | None = None) -> DataFrame:
    """One row, or none: the symbol, the paths its file imports (one entry per imported symbol), its observations."""
    s = _symbol(p, name, file)
    deps = p["dependencies"].join(s.select(F.col("file_id").alias("from_file")), "from_file", "left_semi")
    deps = deps.join(p["files"].select(F.col("id").alias("to_file"), F.col("path").alias("dep")), "to_file")
    deps = deps.groupBy(F.col("from_file").alias("file_id")).agg(F.array_sort(F.collect_list("dep")).alias("dependencies"))
    notes = _memory_of(p, s.select("file", F.col("name").alias("symbol_name")), ["file", "symbol_name"])
    out = s.join(deps, "file_id", "left").join(notes.withColumnRenamed("symbol_name", "name"), ["file", "name"], "left")
    none = F.array().cast("array<string>")
    return out.select(
        "name", "kind", "signature", "summary", "file", "start_line", "end_line", "is_exported", "is_async", "has_try_catch",
        F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("observations", none).alias("observations"), F.coalesce("has_stale", F.lit(False)).alias("has_stale"),
    )


def context_range(line, size: int, total):
    """(first, last) line of a window of ``size`` lines around a line, clipped to a file of ``total`` lines."""
    t = F.greatest(F.lit(1), line)
    start = F.greatest(F.lit(1), t - size // 2)
    end = F.least(total, start + size - 1)
    start = F.when(end - start < size - 1, F.greatest(F.lit(1), end - size + 1)).otherwise(start)
    return start, end


def get_context(p: Project, file: str, line: int, range: int = 30) -> DataFrame:
    """The code around a line; past the end of the file it is empty."""
    lines = F.split("content", "\n")
    # the window knows the file's end only if it lies within the lines it reads
    total = F.when(F.size(lines) <= max(1, line) + range, F.size(lines)).otherwise(F.lit(2**30))
    first, last = context_range(F.lit(line), range, total)
    t = _texts(p, [file]).withColumns({"start_line": first, "end_line": last})
    beyond = F.lit(max(1, line)) > F.size(lines)
    code = F.array_join(F.slice(lines, F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    return t.select(F.col("path").alias("file"), "start_line", "end_line", scalars.language_of(F.col("path")).alias("language"), F.when(beyond, F.lit("")).otherwise(code).alias("code"))


def get_file_summary(p: Project, file: str) -> DataFrame:
    f = p["files"].filter(F.col("path") == file)
    one = f.select(F.col("id").alias("file_id"))
    s = p["symbols"].join(one, "file_id", "left_semi")
    row = F.struct("start_line", "id", "name", "kind", "signature", "is_exported")
    listed = s.groupBy("file_id").agg(F.array_sort(F.collect_list(row)).alias("_all"))
    d = p["dependencies"].join(one.select(F.col("file_id").alias("from_file")), "from_file", "left_semi")
    d = d.join(p["files"].select(F.col("id").alias("to_file"), F.col("path").alias("dep")), "to_file")
    d = d.groupBy(F.col("from_file").alias("file_id")).agg(F.array_sort(F.collect_list("dep")).alias("imports"))
    notes = _memory_of(p, f.select(F.col("path").alias("file")), ["file"])
    out = f.withColumnRenamed("id", "file_id").join(listed, "file_id", "left").join(d, "file_id", "left").join(notes.withColumnRenamed("file", "path"), "path", "left")
    none = F.array().cast("array<string>")
    shown = F.transform("_all", lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), x["signature"].alias("signature"), x["start_line"].alias("start_line")))
    exports = F.transform(F.filter("_all", lambda x: x["is_exported"]), lambda x: x["name"])
    lines = scalars.js_round(F.col("raw_token_estimate") * 4 / 50).cast("long")
    return out.select(
        F.col("path").alias("file"), "language", "summary", shown.alias("symbols"), F.coalesce(exports, none).alias("exports"), F.coalesce("imports", none).alias("imports"),
        lines.alias("line_count"), F.coalesce("observations", none).alias("observations"), F.coalesce("has_stale", F.lit(False)).alias("has_stale"),
    )


def find_usages(p: Project, symbol: str) -> DataFrame:
    """Where the first symbol of that name is used: file, line, context (file:line); at most 200."""
    s = _symbol(p, symbol, None).select(F.col("id").alias("symbol_id"))
    u = p["usages"].join(s, "symbol_id", "left_semi").join(p["files"].select(F.col("id").alias("used_in_file"), F.col("path").alias("file")), "used_in_file")
    return u.select("file", F.col("used_at_line").alias("line"), F.concat_ws(":", "file", F.col("used_at_line").cast("string")).alias("context")).orderBy("file", "line").limit(200)


def get_dependencies(p: Project, target: str, direction: str = "both") -> DataFrame:
    """(direction, path) one hop from a file, one row per imported symbol."""
    me = p["files"].filter(F.col("path") == target).select(F.col("id").alias("me"))
    out = None
    for name, own, other in (("imports", "from_file", "to_file"), ("imported_by", "to_file", "from_file")):
        if direction in (name, "both"):
            d = p["dependencies"].join(me, F.col(own) == F.col("me"), "left_semi")
            rows = d.join(p["files"].select(F.col("id").alias(other), "path"), other).select(F.lit(name).alias("direction"), "path", "symbol_name")
            out = rows if out is None else out.unionByName(rows)
    return out.orderBy(F.desc("direction"), "path", "symbol_name")


def dominant_language(files: DataFrame) -> DataFrame:
    """The most frequent language; of equals, that of the first path."""
    g = files.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))
    return g.orderBy(F.desc("n"), "first").limit(1).select("language", "n")


def modules(p: Project, mode: str = "full") -> DataFrame:
    """(path, summary, symbol_count) per file; brief mode counts nothing."""
    if mode == "brief":
        return p["files"].select("path", F.lit(None).cast("string").alias("summary"), F.lit(0).cast("long").alias("symbol_count")).orderBy("path")
    n = p["symbols"].groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return p["files"].join(n, "id", "left").select("path", "summary", F.coalesce("n", F.lit(0)).alias("symbol_count")).orderBy("path")


def get_project_overview(p: Project, mode: str = "full") -> dict[str, DataFrame]:
    """stats (one row), entry_points, modules, recommendation, session_memory and the stats of federated projects. Only
    an empty project lacks the last ones."""
    stats = p["files"].agg(F.count(F.lit(1)).alias("total_files")).crossJoin(F.broadcast(p["symbols"].agg(F.count(F.lit(1)).alias("total_symbols"))))  # one row each
    language = dominant_language(p["files"]).agg(F.coalesce(F.max("language"), F.lit("unknown")).alias("language"))
    stats = stats.crossJoin(F.broadcast(language)).withColumn("root_path", F.lit(p.root))
    stats = stats.withColumn("total_symbols", F.when(F.col("total_files") > 0, F.col("total_symbols")).otherwise(F.lit(0)))
    o = p["session_observations"]
    seen = o.agg(
        F.count_distinct(F.when(F.col("session_id") != p.session_id, F.col("session_id"))).alias("prior_sessions"), F.count(F.when(F.col("stale"), 1)).alias("stale_observations")
    )
    labels = memory.anti_pattern_events(p["session_events"], p.session_id).limit(5).select(
        "timestamp", "id", F.concat("event_type", F.coalesce(F.concat(F.lit(":"), "file_path"), F.lit(""))).alias("label")
    )
    labels = labels.agg(F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "id", "label")), asc=False), lambda x: x["label"]).alias("active_anti_patterns"))
    seen = seen.crossJoin(F.broadcast(labels))
    some = (F.col("prior_sessions") > 0) | (F.col("stale_observations") > 0) | (F.size("active_anti_patterns") > 0)
    fed = None
    for name, q in p.federated.items():
        x = q["files"].agg(F.count(F.lit(1)).alias("total_files")).crossJoin(F.broadcast(q["symbols"].agg(F.count(F.lit(1)).alias("total_symbols")))).withColumn("project", F.lit(name))
        fed = x if fed is None else fed.unionByName(x)
    return {
        "stats": stats,
        "entry_points": p["files"].filter(F.col("path").rlike(ENTRY_POINT)).select("path").orderBy("path"),
        "modules": modules(p, mode),
        "recommendation": tokens.recommendation(p["files"]),
        "session_memory": seen.withColumn("hint", F.when(some, "call get_session_memory for details")),
        **({"federated": fed} if fed is not None else {}),
    }


def get_api_endpoints(p: Project) -> DataFrame:
    s = p["symbols"].filter("kind = 'route'").join(p["files"].select(F.col("id").alias("file_id"), F.col("path").alias("file")), "file_id")
    method, path = scalars.route_parts(F.col("name"), F.col("signature"))
    return s.select(method.alias("method"), path.alias("path"), "file", F.col("start_line").alias("line"), "is_async", "has_try_catch").orderBy("file", "line")


def get_token_stats(p: Project, session_id: str = "default") -> DataFrame:
    """One row, zeros for an unknown session."""
    log = p["token_log"].filter(F.col("session_id") == session_id)
    g = log.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("total_used"), F.coalesce(F.sum("tokens_without_index"), F.lit(0)).alias("total_without"))
    g = g.withColumn("total_saved", F.col("total_without") - F.col("total_used"))
    return g.select(F.lit(session_id).alias("session_id"), "calls", "total_used", "total_without", "total_saved", scalars.percent(F.col("total_saved"), F.col("total_without")).alias("savings_percent"))


def start_comparison(p: Project, label: str, mode: str) -> DataFrame:
    """A new session row; the project's sessions table gains it."""
    row = p.spark.createDataFrame([(str(uuid.uuid4()), mode, label)], "id string, mode string, label string").withColumn("started_at", F.current_timestamp())
    p.tables["sessions"] = p["sessions"].unionByName(dml.schema_like(row, p["sessions"]))
    return row


def search_docs(p: Project, query: str, limit: int = 20, type: str = "all") -> DataFrame:
    """Document chunks and context entries by rank; of all, seven tenths of the limit are documents."""
    from pyspark.sql import Window

    quota = {"docs": (limit, 0), "context": (0, limit), "all": (-(-7 * limit // 10), -(-3 * limit // 10))}[type]
    out = None
    for k, (kind, n) in enumerate((("doc", quota[0]), ("context", quota[1]))):
        if not n:
            continue
        table, columns = ("documents", DOCUMENT_COLUMNS) if kind == "doc" else ("context_entries", CONTEXT_COLUMNS)
        hits = fts.match(*p.index(table, columns), query, columns).join(p[table], "id")
        if kind == "doc":
            hits = hits.join(p["files"].select(F.col("id").alias("file_id"), F.col("path").alias("file")), "file_id")
            shape = ["file", "chunk_index", "heading", "start_line", "end_line"]
        else:
            shape = ["session_id", "tags", "created_at"]
        rows = hits.orderBy("score", "id").limit(n).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(k)).orderBy("score", "id")))
        rows = rows.select(F.lit(k).alias("ord"), "rank", F.lit(kind).alias("type"), "id", *shape, scalars.preview(F.col("content")).alias("preview"), "score")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.orderBy("ord", "rank").limit(limit)


def get_doc_chunk(p: Project, file: str, chunk_index: int | None = None) -> DataFrame:
    """A file's chunks, or one; total_chunks counts all."""
    from pyspark.sql import Window

    f = p["files"].filter(F.col("path") == file).select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    d = p["documents"].join(f, "file_id").withColumn("total_chunks", F.count(F.lit(1)).over(Window.partitionBy("file_id")))
    d = d if chunk_index is None else d.filter(F.col("chunk_index") == chunk_index)
    return d.select("file", "chunk_index", "heading", "start_line", "end_line", "content", "summary", "total_chunks").orderBy("chunk_index")


def save_context(p: Project, content: str, tags: str | None = None) -> DataFrame:
    """The stored entry: id and created_at."""
    top = p["context_entries"].agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first().m
    row = p.spark.createDataFrame([(top + 1, p.session_id, content, tags)], "id long, session_id string, content string, tags string").withColumn("created_at", F.current_timestamp())
    known = p["context_entries"]
    p.tables["context_entries"] = known.unionByName(dml.schema_like(row, known))
    p.refreshed("context_entries", known, CONTEXT_COLUMNS)
    return row.select("id", "created_at")


def get_session_memory(p: Project, session_id: str | None = None, file: str | None = None, symbol: str | None = None, include_stale: bool = False) -> dict[str, DataFrame]:
    """observations, anti_patterns and summary. A file overrides session and staleness; a symbol needs a file."""
    target = session_id or p.session_id
    o = p["session_observations"]
    if file:
        o = o.filter(F.col("file_path") == file)
        o = o.filter(F.col("symbol_name") == symbol) if symbol else o
        o = o.orderBy(F.desc("created_at"), F.desc("id")).limit(20)
    else:
        o = o.filter(F.col("session_id") == target)
        o = o if include_stale else o.filter("NOT stale")
        o = o.orderBy("created_at", "id").limit(500)
    text = F.coalesce(F.col("extra")["description"], F.col("event_type"))
    bad = memory.anti_pattern_events(p["session_events"], target)
    count = o.agg(F.count(F.when(F.col("stale"), 1)).alias("stale_count"))
    return {
        "observations": o.select("type", F.col("file_path").alias("file"), F.col("symbol_name").alias("symbol"), F.col("observation").alias("text"), "stale", "stale_reason", "created_at"),
        "anti_patterns": bad.select(F.col("event_type").alias("type"), F.col("file_path").alias("file"), F.col("symbol_name").alias("symbol"), text.alias("text"), "timestamp"),
        "summary": count.withColumns({"stale_warning": memory.stale_warning(F.col("stale_count")), "session_id": F.lit(target)}),
    }


def reindex(p: Project, target: str | None = None, languages=scan.DEFAULT_LANGUAGES, force: bool = True) -> DataFrame:
    """Index the tree, or one file of it, into the project's tables: (status, n). A project that was opened from a store
    commits them there."""
    from .indexing import index_files

    if target is None:
        files = scan.scan_project(p.spark, p.root, languages)
    else:  # reads that file only
        files = scan.as_text(scan.within_size(scan.named_files(p.spark, p.root, [target]))).filter(~F.col("path").rlike(scan.IGNORE_PATTERN))
    before = {t: p[t] for t in ("symbols", "documents")}
    held: list[DataFrame] = []
    tables, status = index_files(p.tables, files, whole=target is None, force=force, held=held)
    if p.store is not None:
        status = p.spark.createDataFrame(status.collect(), "status string, n long")
        changed = {t: df for t, df in tables.items() if df is not p.tables.get(t)}
        p.store.commit(**changed)
        tables = {t: p.store.table(t) for t in changed}
        for df in held:
            df.unpersist()
    p.tables.update(tables)
    p.refreshed("symbols", before["symbols"], SYMBOL_COLUMNS)
    p.refreshed("documents", before["documents"], DOCUMENT_COLUMNS)
    return status


# parsing a project without a store is a plain function too
parse_project = parse.parse
neighbours = graph.imports_of
