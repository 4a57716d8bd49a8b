"""The engine's queries over the generic tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import dml, fts, graph, memory, parse, tokens
from ..sources import scan
from ..sources.store import shared_folder
from . import dashboards, tools
from .views import TOOL_OF_EVENT, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')".format
_PATH = "source || '/' || doc_id || '.txt'"
_TOOL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TOOL_OF_EVENT.items()) + " ELSE 'reindex' END"
_TIMES = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {tokens.MULTIPLIERS.get(v, 0)}" for k, v in TOOL_OF_EVENT.items()) + " ELSE 0 END"
_LOG = f"""log AS (SELECT event_id AS id, user_id AS session_id, {_TOOL} AS tool_name, CAST(floor(value) AS BIGINT) AS tokens_used,
  greatest(CAST(floor(value) AS BIGINT) * ({_TIMES}), CAST(floor(value) AS BIGINT)) AS tokens_without_index, ts AS timestamp, user_id % 7 AS project FROM events)"""
_FILES = f"""files AS (SELECT doc_id AS id, {_PATH} AS path, lang AS language, md5(text) AS hash, CAST(ceil(length(text) / 4) AS BIGINT) AS raw_token_estimate, source AS project FROM documents)"""


# --- full-text search


def _search(v: Views, text: str, limit: int = 20) -> DataFrame:
    p, n = v.text_index()
    top = fts.search(p, n, text, ("content",), limit)
    # the few best rows fetch their text
    return top.join(v.texts, "id").select("id", "path", scalars.preview(F.col("content")).alias("preview"), F.round("score", 6).alias("score"))


def _term(t: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{t}'))"


def _phrase(a: str, b: str) -> str:
    return f"len(list_filter(range(1, len(t)), lambda i: t[i] = '{a}' AND t[i + 1] = '{b}'))"


def _bm25(counts: list[str], where: str, scored: list[str] | None = None, limit: int = 20, final: str | None = None) -> str:
    """scored: per phrase the condition under which it counts."""
    scored = scored or ["TRUE"] * len(counts)
    fs = ", ".join(f"{c} AS f{k}" for k, c in enumerate(counts))
    ns = ", ".join(f"count(*) FILTER (f{k} > 0) AS n{k}" for k in range(len(counts)))
    idf = lambda k: f"(CASE WHEN ln((docs - n{k} + 0.5) / (n{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - n{k} + 0.5) / (n{k} + 0.5)) END)"
    parts = " ".join(f"- (CASE WHEN {s} THEN {idf(k)} * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END)" for k, s in enumerate(scored))
    return f"""
WITH tok AS (SELECT doc_id AS id, {_PATH} AS path, source AS project, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents),
f AS (SELECT id, path, project, text, len(t) AS dl, {fs} FROM tok),
st AS (SELECT count(*) AS docs, avg(dl) AS avgdl, {ns} FROM f),
hits AS (SELECT id, path, project, text, 0.0 {parts} AS score FROM f, st WHERE {where})
""" + (final if final is not None else f"""SELECT id, path, CASE WHEN length(trim(text, E' \\t\\n\\r')) <= 200 THEN trim(text, E' \\t\\n\\r') ELSE left(trim(text, E' \\t\\n\\r'), 200) || '…' END AS preview, round(score, 6) AS score
FROM (SELECT * FROM hits ORDER BY score, id LIMIT {limit})""")


@query(_bm25([_term("trash")], "f0 > 0"))
def search_docs_bm25_single(v):
    return _search(v, "trash")


@query(_bm25([_term("with"), _term("from")], "f0 > 0 AND f1 > 0"))
def search_docs_bm25_and(v):
    return _search(v, "with from")


@query(_bm25([_term("worthless"), _term("avec")], "f0 > 0 OR f1 > 0", ["f0 > 0", "f1 > 0"]))
def search_docs_bm25_or(v):
    return _search(v, "worthless OR avec")


@query(_bm25([_term("from"), _term("trash")], "f0 > 0 AND NOT f1 > 0", ["TRUE", "FALSE"]))
def search_docs_bm25_not(v):
    return _search(v, "from NOT trash")


@query(_bm25([_phrase("of", "the")], "f0 > 0"))
def search_docs_phrase(v):
    return _search(v, '"of the"')


@query(_bm25(["len(list_filter(t, lambda x: starts_with(x, 'worth')))"], "f0 > 0"))
def search_docs_prefix(v):
    return _search(v, "worth*")


@query(_bm25(["CASE WHEN t[1] = 'the' THEN 1 ELSE 0 END"], "f0 > 0"))
def search_docs_initial(v):
    return _search(v, "^the")


@query(_bm25([_term("with"), _term("from"), _term("trash")], "(f0 > 0 AND f1 > 0) OR f2 > 0", ["f0 > 0 AND f1 > 0", "f0 > 0 AND f1 > 0", "f2 > 0"]))
def search_docs_grouped(v):
    return _search(v, "(with AND from) OR trash")


_NEAR = "len(list_filter({0}, lambda x: len(list_filter({1}, lambda y: abs(x - y) <= 6)) > 0))"
_AT = "list_filter(range(1, len(t) + 1), lambda i: t[i] = '{}')".format


@query(
    _bm25([_term("with"), _term("from"), _NEAR.format(_AT("with"), _AT("from")), _NEAR.format(_AT("from"), _AT("with"))], "f2 > 0 AND f3 > 0", final="").rsplit("hits AS", 1)[0]
    + f"""i AS (SELECT docs, avgdl, CASE WHEN ln((docs - n0 + 0.5) / (n0 + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - n0 + 0.5) / (n0 + 0.5)) END AS ia,
  CASE WHEN ln((docs - n1 + 0.5) / (n1 + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - n1 + 0.5) / (n1 + 0.5)) END AS ib FROM st),
hits AS (SELECT id, path, text, 0.0 - ia * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * dl / avgdl)) - ib * f3 * 2.2 / (f3 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM f, i WHERE f2 > 0 AND f3 > 0)
SELECT id, path, CASE WHEN length(trim(text, E' \\t\\n\\r')) <= 200 THEN trim(text, E' \\t\\n\\r') ELSE left(trim(text, E' \\t\\n\\r'), 200) || '…' END AS preview, round(score, 6) AS score
FROM (SELECT * FROM hits ORDER BY score, id LIMIT 20)"""
)
def search_docs_near(v):
    """Both words with at most five others between them; only occurrences that are near count."""
    return _search(v, "NEAR(with from, 5)")


@query(
    _bm25([_term("etaient"), _term("fur"), _term("cion")], "f0 > 0 OR f1 > 0 OR f2 > 0", ["f0 > 0", "f1 > 0", "f2 > 0"], final="SELECT id, round(score, 6) AS score FROM (SELECT * FROM hits ORDER BY score, id LIMIT 20)").replace(
        "lower(text)", "strip_accents(lower(text))"
    )
)
def search_docs_folded(v):
    p, n = v.text_index(diacritics=True)
    return fts.search(p, n, "etaient OR fur OR cion", ("content",)).select("id", F.round("score", 6).alias("score"))


@query("SELECT doc_id AS id, 0.0 AS score FROM documents WHERE false")
def search_docs_syntax_error(v):
    p, n = v.text_index()
    return fts.search(p, n, "GET /users", ("content",)).select("id", F.round("score", 6).alias("score"))


@query(
    "SELECT id, dl FROM (SELECT doc_id AS id, CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS BIGINT) AS dl FROM documents)"
)
def index_lengths(v):
    return fts.build_index(v.texts, ("content",), diacritics=False)[1]


@query(
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents)
SELECT term, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM t GROUP BY term"""
)
def index_terms(v):
    p, _ = fts.build_index(v.texts, ("content",), diacritics=False)
    per_doc = p.groupBy("term", "id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("docs"))


_CTX = """ctx AS (SELECT conv_id * 10000 + turn AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t, regexp_extract_all(lower(role), '[\\p{L}\\p{N}]+') AS g FROM conversations),
cf AS (SELECT id, len(t) + len(g) AS dl, len(list_filter(t, lambda x: x = 'from')) + len(list_filter(g, lambda x: x = 'from')) AS f0 FROM ctx),
cst AS (SELECT count(*) AS docs, avg(dl) AS avgdl, count(*) FILTER (f0 > 0) AS n0 FROM cf),
chit AS (SELECT id, 0.0 - (CASE WHEN ln((docs - n0 + 0.5) / (n0 + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - n0 + 0.5) / (n0 + 0.5)) END) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM cf, cst WHERE f0 > 0)"""


@query(
    _bm25([_term("from")], "f0 > 0", final="")
    + ", "
    + _CTX
    + """
SELECT type, id, round(score, 6) AS score FROM (
  (SELECT 'doc' AS type, id, score FROM hits ORDER BY score, id LIMIT 14) UNION ALL (SELECT 'context' AS type, id, score FROM chit ORDER BY score, id LIMIT 6))"""
)
def search_docs_quota_union(v):
    p = tools.Project(v.spark, {"documents": v.texts.withColumns({"file_id": F.col("id"), "chunk_index": F.lit(0), "heading": F.lit(None).cast("string"), "start_line": F.lit(1), "end_line": F.lit(1), "summary": F.lit(None).cast("string")}), "files": v.files, "context_entries": v.context.withColumn("created_at", F.lit(None).cast("timestamp"))})
    for name, df, columns in (("documents", v.texts, tools.DOCUMENT_COLUMNS), ("context_entries", v.context, tools.CONTEXT_COLUMNS)):
        p._indexes[name] = v.text_index() if name == "documents" else fts.build_index(df, columns, diacritics=False)
    return p.call("search_docs", query="from", limit=20).select("type", "id", F.round("score", 6).alias("score"))


@query(
    _bm25([_term("with")], "f0 > 0", final="""SELECT project, rank, id FROM (
  SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY score, id) AS rank FROM hits WHERE project IN ('src1', 'src2', 'src3')) WHERE rank <= 5""")
)
def federated_search_topk(v):
    """Each project's best five with the corpus-wide statistics, primary first."""
    p, n = v.text_index()
    hits = fts.match(p, n, "with", ("content",)).join(v.texts.filter(F.col("project").isin("src1", "src2", "src3")).select("id", "project"), "id")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy("score", "id"))).filter("rank <= 5").select("project", "rank", "id")


# --- files, chunks, context


@query(f"WITH {_FILES} SELECT * FROM files")
def files_view_hash_tokens(v):
    return v.files


@query(
    f"""WITH f AS (SELECT {_PATH} AS path, text FROM documents) SELECT path, reverse(split_part(reverse(path), '/', 1)) AS name, md5(path) AS hash, substr(md5(trim(regexp_replace(text, '[\\t-\\r \\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+', ' ', 'g'))), 1, 8) AS signature_hash,
 substr(sha256(path), 1, 8) AS project_hash, CAST(7842 + CAST('0x' || substr(sha256(path), 1, 4) AS INT) % 2000 AS INT) AS port, 'text' AS language FROM f"""
)
def project_hash_port(v):
    f = v.texts
    path = F.col("path")
    return f.select(
        "path", scalars.basename(path).alias("name"), scalars.content_hash(path).alias("hash"), scalars.signature_hash(F.col("content")).alias("signature_hash"), scalars.project_hash(path).alias("project_hash"),
        scalars.project_port(scalars.project_hash(path)).alias("port"), scalars.language_of(path).alias("language"),
    )


_CHUNKS = f"""lines AS (SELECT {_PATH} AS path, string_split(text, chr(10)) AS l FROM documents),
raw AS (SELECT path, k, l[k * 50 + 1:least(k * 50 + 50, len(l))] AS part, len(l) AS n FROM (SELECT path, l, unnest(range(0, CAST(ceil(len(l) / 50) AS BIGINT))) AS k FROM lines)),
chunks AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS chunk_index, k * 50 + 1 AS start_line, least(k * 50 + 50, n) AS end_line, array_to_string(part, chr(10)) AS content
 FROM raw WHERE regexp_matches(array_to_string(part, chr(10)), '[^\\s]'))"""


@query(f"WITH {_CHUNKS} SELECT path, CAST(chunk_index AS INT) AS chunk_index, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, md5(content) AS content_hash FROM chunks")
def doc_chunks_50_lines(v):
    return parse.line_chunks(v.texts).select("path", "chunk_index", "start_line", "end_line", F.md5("content").alias("content_hash"))


@query(f"WITH {_CHUNKS} SELECT path, CAST(chunk_index AS INT) AS chunk_index, content, (SELECT count(*) FROM chunks c WHERE c.path = chunks.path) AS total_chunks FROM chunks WHERE chunk_index = 1")
def get_doc_chunk(v):
    c = parse.line_chunks(v.texts)
    c = c.withColumn("total_chunks", F.count(F.lit(1)).over(Window.partitionBy("path")))
    return c.filter("chunk_index = 1").select("path", "chunk_index", "content", "total_chunks")


@query(
    f"""WITH l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS l FROM documents),
h AS (SELECT id, l, 1 + floor(len(l) / 2) AS t FROM l),
w AS (SELECT id, l, greatest(1, t - 3) AS s0, least(len(l), greatest(1, t - 3) + 5) AS e FROM h),
r AS (SELECT id, l, CASE WHEN e - s0 < 5 THEN greatest(1, e - 5) ELSE s0 END AS s, e FROM w)
SELECT id, CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line, md5(array_to_string(l[CAST(s AS INT):CAST(e AS INT)], chr(10))) AS code_hash FROM r"""
)
def get_context_window(v):
    """Six lines around the middle line of every document."""
    lines = F.split("content", "\n")
    middle = (F.floor(F.size(lines) / 2) + 1).cast("int")
    first, last = tools.context_range(middle, 6, F.size(lines))
    t = v.texts.withColumns({"start_line": first.cast("int"), "end_line": last.cast("int")})
    code = F.array_join(F.slice(lines, F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return t.select("id", "start_line", "end_line", F.md5(code).alias("code_hash"))


@query("SELECT doc_id AS id, CAST(i AS INT) AS line, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(2, 4)) AS i FROM documents) WHERE i <= len(l)")
def line_range_read(v):
    return scan.lines_between(v.texts, 2, 3, "id").select("id", F.col("line").cast("int").alias("line"), "text")


@query("SELECT page_id, md5(regexp_extract(html, '(?is)<script(?:\\s[^>]*)?>(.*?)</script>', 1)) AS script_hash FROM pages")
def extract_script_block(v):
    return parse.script_blocks(v.raw("pages"), "html").select("page_id", F.md5("script").alias("script_hash"))


@query(f"WITH {_FILES} SELECT path, language FROM files ORDER BY path")
def all_files_ordered(v):
    return v.files.select("path", "language").orderBy("path")


@query(f"WITH {_FILES} SELECT id, path, hash FROM files WHERE path = 'src1/1.txt'")
def file_by_path(v):
    return v.files.filter(F.col("path") == "src1/1.txt").select("id", "path", "hash").limit(1)


@query(f"WITH {_FILES} SELECT path FROM files WHERE NOT regexp_matches(path, '(^|/)src1/') AND contains(lower(path), 'src1')")
def path_filters(v):
    return v.files.filter(~F.col("path").rlike("(^|/)src1/") & F.lower("path").contains("src1")).select("path")


# --- overview


@query(f"WITH {_FILES} SELECT project, count(*) AS files, CAST(sum(raw_token_estimate) AS BIGINT) AS tokens, count(DISTINCT language) AS languages FROM files GROUP BY project")
def overview_counts(v):
    return v.files.groupBy("project").agg(F.count(F.lit(1)).alias("files"), F.sum("raw_token_estimate").alias("tokens"), F.count_distinct("language").alias("languages"))


@query(f"WITH {_FILES} SELECT language, count(*) AS n FROM files GROUP BY language ORDER BY n DESC, min(path) LIMIT 1")
def overview_language(v):
    return tools.dominant_language(v.files)


@query(
    f"""WITH {_FILES}, g AS (SELECT count(*) AS files, coalesce(sum(raw_token_estimate), 0) AS tokens FROM files), a AS (SELECT files, tokens, CAST(floor(tokens / files * 4 / 50 + 0.5) AS BIGINT) AS avg_lines FROM g)
SELECT files, CAST(tokens AS BIGINT) AS tokens, avg_lines, files >= 40 OR avg_lines >= 150 AS worthwhile, files || ' files, avg ~' || avg_lines || ' lines/file — index tools save tokens' AS reason FROM a"""
)
def overview_recommendation(v):
    return tokens.recommendation(v.files)


@query(
    f"""WITH {_FILES}, s AS (SELECT l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY 1) SELECT path, coalesce(n, 0) AS symbol_count FROM files LEFT JOIN s USING (id)"""
)
def overview_modules(v):
    symbols = v.dependencies.select(F.col("from_file").alias("file_id"))
    p = tools.Project(v.spark, {"files": v.files.withColumn("summary", F.lit(None).cast("string")), "symbols": symbols})
    return tools.modules(p).select("path", "symbol_count")


# --- graph and usages


@query("SELECT s_name AS path, CAST(l_linenumber AS VARCHAR) AS symbol_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = 7")
def get_dependencies_imported_by(v):
    files = v.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("path"))
    return graph.imported_by(v.dependencies, files, 7)


@query("SELECT p_name AS path, CAST(l_linenumber AS VARCHAR) AS symbol_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = 3")
def get_dependencies_imports(v):
    files = v.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("path"))
    return graph.imports_of(v.dependencies, files, 3)


@query("SELECT l_suppkey AS from_file, count(*) AS edges, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS targets FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def file_summary_imports(v):
    part = v.raw("part").select(F.col("p_partkey").alias("to_file"), "p_brand")
    j = v.dependencies.join(part, "to_file").groupBy("from_file").agg(F.count(F.lit(1)).alias("edges"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("targets"))
    return j


@query("SELECT o_orderpriority AS file, l_linenumber AS line, l_orderkey AS used_in_file, o_orderpriority || ':' || l_linenumber AS context FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey = 7 ORDER BY file, line, l_orderkey LIMIT 200")
def find_usages_topk(v):
    u = v.usages.filter("symbol_id = 7")
    o = v.raw("orders").select(F.col("o_orderkey").alias("used_in_file"), F.col("o_orderpriority").alias("file"))
    j = u.join(o, "used_in_file").orderBy("file", "used_at_line", "used_in_file").limit(200)
    return j.select("file", F.col("used_at_line").alias("line"), "used_in_file", F.concat_ws(":", "file", F.col("used_at_line").cast("string")).alias("context"))


@query("SELECT DISTINCT l_suppkey AS from_file, l_partkey AS to_file, CASE WHEN l_linenumber = 7 THEN '' ELSE CAST(l_linenumber AS VARCHAR) END AS symbol_name FROM lineitem")
def insert_ignore_dependencies(v):
    """Rows that are there already, or come twice, are ignored; a missing symbol is the empty one."""
    name = F.when(F.col("symbol_name") != "7", F.col("symbol_name"))
    rows = v.dependencies.withColumn("symbol_name", name)
    old = dml.insert_ignore(v.spark.createDataFrame([], "id long, from_file long, to_file long, symbol_name string"), rows.filter("symbol_name = '1'"), "dependencies")
    return dml.insert_ignore(old, rows, "dependencies").drop("id")


@query("SELECT count(*) AS left_over FROM lineitem WHERE l_suppkey % 10 <> 0 AND l_partkey % 10 <> 0")
def delete_file_cascade(v):
    ends = v.dependencies.select(F.col("from_file").alias("file_id")).unionByName(v.dependencies.select(F.col("to_file").alias("file_id")))
    gone = ends.filter("file_id % 10 = 0").distinct()
    d = dml.delete_where(v.dependencies, gone, {"from_file": "file_id"})
    return dml.delete_where(d, gone, {"to_file": "file_id"}).agg(F.count(F.lit(1)).alias("left_over"))


@query(f"WITH {_FILES} SELECT id, path, CASE WHEN id % 2 = 0 THEN 'new' ELSE hash END AS hash FROM files")
def upsert_files(v):
    old = v.files.select("id", "path", "hash")
    return dml.merge(old, old.filter("id % 2 = 0").select("path", F.lit("new").alias("hash")), "files")


@query(f"WITH {_FILES} SELECT max(id) + row_number() OVER (ORDER BY k) AS id, k AS path FROM (SELECT DISTINCT 'new/' || project AS k FROM files), (SELECT max(id) AS id FROM files) GROUP BY k")
def append_with_new_ids(v):
    fresh = v.files.select(F.concat(F.lit("new/"), "project").alias("path")).distinct()
    return dml.with_ids(fresh, v.files, ["path"]).select("id", "path")


@query(
    f"""WITH {_FILES} SELECT status, count(*) AS n FROM (SELECT CASE WHEN id % 5 = 0 THEN 'indexed' WHEN id % 3 = 0 THEN 'updated' ELSE 'skipped' END AS status FROM files) GROUP BY status"""
)
def incremental_status(v):
    known = v.files.filter("id % 5 <> 0").select("path", F.when(F.col("id") % 3 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    return parse.changed_files(v.files, known).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_FILES} SELECT id AS file_id FROM files WHERE id % 4 = 0")
def vanished_files(v):
    return dml.vanished(v.files, v.files.filter("id % 4 <> 0"))


# --- tokens and dashboards

_STATS = """SELECT session_id, count(*) AS calls, CAST(sum(tokens_used) AS BIGINT) AS total_used, CAST(sum(tokens_without_index) AS BIGINT) AS total_without, CAST(sum(tokens_without_index) - sum(tokens_used) AS BIGINT) AS total_saved,
 CASE WHEN sum(tokens_without_index) > 0 THEN floor((sum(tokens_without_index) - sum(tokens_used)) / sum(tokens_without_index) * 1000 + 0.5) / 10 ELSE 0 END AS savings_percent FROM log"""


@query(f"WITH {_LOG} {_STATS} GROUP BY session_id")
def session_stats(v):
    return tokens.session_stats(v.token_log)


@query(f"WITH {_LOG} SELECT id, tool_name, tokens_used, tokens_without_index FROM log")
def token_log_estimates(v):
    return v.token_log.select("id", "tool_name", "tokens_used", "tokens_without_index")


@query(
    f"""WITH {_LOG}, r AS (SELECT id, session_id, CAST(sum(tokens_used) OVER w AS BIGINT) AS cumulative_actual, CAST(sum(tokens_without_index - tokens_used) OVER w AS BIGINT) AS cumulative_savings, sum(tokens_without_index) OVER w AS a FROM log
 WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING))
SELECT id, session_id, cumulative_actual, cumulative_savings, CASE WHEN a > 0 THEN floor(cumulative_savings / a * 1000 + 0.5) / 10 ELSE 0 END AS cumulative_percent FROM r"""
)
def session_running_totals(v):
    return tokens.running_totals(v.token_log).select("id", "session_id", "cumulative_actual", "cumulative_savings", "cumulative_percent")


@query(
    f"""WITH {_LOG}, s AS (SELECT user_id AS id, min(ts) AS started_at, user_id % 7 AS project FROM events GROUP BY user_id),
r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY started_at DESC, id) AS n FROM s),
t AS (SELECT * FROM r WHERE n <= 12 ORDER BY started_at DESC, project, id LIMIT 12),
g AS (SELECT session_id, CAST(sum(tokens_used) AS BIGINT) AS total_tokens, CAST(sum(tokens_without_index - tokens_used) AS BIGINT) AS total_savings, max(timestamp) AS last FROM log GROUP BY 1)
SELECT id, project, {_STAMP('started_at')} AS started_at, total_tokens, total_savings, {_STAMP('last')} AS last_activity_at FROM t LEFT JOIN g ON g.session_id = t.id"""
)
def recent_sessions_merge(v):
    r = dashboards.recent_sessions(v.sessions, v.token_log)
    return r.select("id", "project", stamp("started_at").alias("started_at"), "total_tokens", "total_savings", stamp("last_activity_at").alias("last_activity_at"))


_SAVINGS = f"""{_LOG}, t AS (SELECT project, sum(tokens_used) AS a, sum(tokens_without_index) AS e FROM log GROUP BY project),
sv AS (SELECT project, CAST(greatest(0, e - a) AS BIGINT) AS tokens_saved, CAST(a AS BIGINT) AS tokens_actual, CAST(CASE WHEN e > 0 THEN greatest(0, floor((e - a) / e * 100 + 0.5)) ELSE 0 END AS BIGINT) AS savings_percent FROM t)"""


@query(f"WITH {_SAVINGS} SELECT * FROM sv")
def project_savings(v):
    return dashboards.savings(v.token_log)


@query(f"WITH {_SAVINGS} SELECT count(*) AS total_projects, CAST(sum(tokens_saved) AS BIGINT) AS saved, CAST(sum(tokens_actual) AS BIGINT) AS actual, CAST(floor(avg(savings_percent) + 0.5) AS BIGINT) AS avg_savings_percent FROM sv")
def project_savings_overview(v):
    s = dashboards.savings(v.token_log)
    zero = s.withColumns({"file_count": F.lit(0), "symbol_count": F.lit(0), "session_count": F.lit(0)})
    return dashboards.overview(zero).select("total_projects", F.col("total_tokens_saved").alias("saved"), F.col("total_tokens_actual").alias("actual"), "avg_savings_percent")


@query(f"SELECT user_id AS id, {_STAMP('min(ts)')} AS started_at FROM events GROUP BY user_id ORDER BY min(ts) DESC, id LIMIT 50")
def project_sessions(v):
    return dashboards.project_sessions(v.sessions).select("id", stamp("started_at").alias("started_at"))


@query(f"WITH {_LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, id DESC) AS k FROM log) SELECT session_id, id, tool_name FROM n WHERE k <= 20")
def latest_points(v):
    return dashboards.latest(v.token_log, "session_id", 20).select("session_id", "id", "tool_name")


@query(f"WITH {_FILES} SELECT path FROM files ORDER BY path LIMIT 6 OFFSET 12")
def files_page(v):
    return dashboards.page(v.files, ["path"], 2).select("path")


@query(f"WITH {_FILES} SELECT count(*) AS n FROM (SELECT 1 FROM files WHERE contains(lower(path), 'src1') LIMIT 500)")
def dashboard_text_search(v):
    return dashboards.search_table(v.files, "SRC1", ("path",)).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_FILES} SELECT CAST(coalesce(sum(raw_token_estimate), 0) AS BIGINT) AS tokens FROM files WHERE contains(lower(path), 'src12')")
def estimator_search_symbols(v):
    return tokens.estimate_search(v.files, "SRC12")


@query(f"WITH {_FILES} SELECT CAST(sum(floor(raw_token_estimate * 0.3 + 0.5)) AS BIGINT) AS tokens FROM files")
def estimator_overview(v):
    return tokens.estimate_overview(v.files)


@query(f"WITH {_FILES} SELECT CAST(floor(avg(raw_token_estimate) * 3 + 0.5) AS BIGINT) AS tokens FROM files")
def estimator_usages(v):
    return tokens.estimate_usages(v.files, 3)


@query(
    f"""WITH {_FILES}, o AS (SELECT raw_token_estimate AS own FROM files WHERE path = 'src3/3.txt'), d AS (SELECT coalesce(sum(raw_token_estimate), 0) AS d FROM lineitem JOIN files ON l_partkey = id WHERE l_suppkey = 3)
SELECT CAST(coalesce(max(own) + max(d), 800) AS BIGINT) AS tokens FROM o, d"""
)
def estimator_dependencies(v):
    return tokens.estimate_dependencies(v.files, v.dependencies, "src3/3.txt")


# --- memory


def _snapshots(v: Views) -> tuple[DataFrame, DataFrame]:
    first = F.substring_index("content", "\n", 1)
    rows = v.texts.select(F.col("project").alias("file_path"), F.col("id"), first.alias("line"))
    shape = lambda df, sig: df.select("file_path", F.col("id").cast("string").alias("symbol_name"), F.lit("function").alias("kind"), sig.alias("signature"), F.substring(F.md5(sig), 1, 8).alias("signature_hash"))
    old = shape(rows.filter("id % 7 <> 0"), F.col("line"))
    new = shape(rows.filter("id % 5 <> 0"), F.when(F.col("id") % 3 == 0, F.concat("line", F.lit("!"))).otherwise(F.col("line")))
    return old, new


_DIFF = """d AS (SELECT source AS file_path, CAST(doc_id AS VARCHAR) AS symbol_name, CASE WHEN doc_id % 5 = 0 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'added' ELSE 'sig_changed' END AS type FROM documents
 WHERE NOT (doc_id % 5 = 0 AND doc_id % 7 = 0) AND (doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 3 = 0))"""


@query(f"WITH {_DIFF} SELECT file_path, symbol_name, type, 'function `' || symbol_name || '` ' || CASE WHEN type = 'sig_changed' THEN 'signature changed' ELSE type END AS description FROM d")
def snapshot_diff(v):
    old, new = _snapshots(v)
    return memory.diff(old, new).select("file_path", "symbol_name", "type", "description")


@query(
    f"""WITH {_DIFF} SELECT o.doc_id AS id, o.doc_id % 2 = 0 OR d.type IS NOT NULL AS stale, CASE WHEN o.doc_id % 2 <> 0 AND d.type IS NOT NULL THEN 'function `' || o.doc_id || '` ' || CASE WHEN d.type = 'sig_changed' THEN 'signature changed' ELSE d.type END END AS stale_reason
 FROM documents o LEFT JOIN (SELECT * FROM d WHERE type <> 'added') d ON d.file_path = o.source AND d.symbol_name = CAST(o.doc_id AS VARCHAR)"""
)
def stale_marking(v):
    old, new = _snapshots(v)
    o = v.texts.select("id", F.col("project").alias("file_path"), F.col("id").cast("string").alias("symbol_name"), (F.col("id") % 2 == 0).alias("stale"), F.lit(None).cast("string").alias("stale_reason"))
    return dml.mark_stale(o, memory.diff(old, new).filter("type <> 'added'")).select("id", "stale", "stale_reason")


@query("SELECT user_id AS session_id, event_id AS id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS recent FROM events QUALIFY recent >= 2")
def thrash_window(v):
    e = v.events.withColumn("file_path", F.col("event_type"))
    types = ("view", "signup", "click", "error", "purchase")
    return memory.change_windows(e, 360, types).filter("recent >= 2").select("session_id", "id", "recent")


_HOT = "hot AS (SELECT user_id, event_type, ts, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 12 HOURS PRECEDING AND CURRENT ROW) AS n FROM events QUALIFY n >= 2)"
_REPORTS = f"""WITH RECURSIVE {_HOT},
r AS (SELECT user_id, event_type, min(ts) AS ts FROM hot GROUP BY ALL
 UNION ALL SELECT h.user_id, h.event_type, min(h.ts) AS ts FROM r JOIN hot h ON h.user_id = r.user_id AND h.event_type = r.event_type AND h.ts >= r.ts + INTERVAL 12 HOURS GROUP BY ALL)
SELECT DISTINCT {{}}, CAST(n AS {{}}) AS change_count, {_STAMP('r.ts')} AS timestamp FROM r JOIN hot USING (user_id, event_type, ts)"""


@query(_REPORTS.format("user_id AS session_id, event_type AS file_path", "VARCHAR"))
def thrash_suppression(v):
    e = v.events.withColumns({"file_path": F.col("event_type"), "symbol_name": F.lit(None).cast("string")})
    found = memory.thrashing(e, 2, 720, ("view", "signup", "click", "error", "purchase"))
    return found.select("session_id", "file_path", stamp("timestamp").alias("timestamp"), F.col("extra")["change_count"].alias("change_count"))


@query(_REPORTS.format("CAST(user_id AS VARCHAR) AS session_id, event_type AS file_path", "BIGINT"))
def stream_thrashing(v):
    from ..streaming import events as streams

    def shape(rows):
        return rows.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("file_path"), F.lit("sig_changed").alias("event_type"), F.col("ts").cast("timestamp").alias("timestamp"))

    def thrashing(rows):
        return streams.thrashing(rows, 2, 720)

    return _stream(v, shape, thrashing).select("session_id", "file_path", "change_count", stamp("timestamp").alias("timestamp"))


@query(
    f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS k, event_type, ts, event_id FROM events WHERE event_type IN ('signup', 'error')),
a AS (SELECT user_id, k, min((ts, event_id)) AS added FROM e WHERE event_type = 'signup' GROUP BY ALL),
r AS (SELECT e.user_id, e.k, min((e.ts, e.event_id)) AS removed FROM e JOIN a ON e.user_id = a.user_id AND e.k = a.k WHERE event_type = 'error' AND (e.ts, e.event_id) > a.added GROUP BY ALL)
SELECT user_id AS session_id, k AS file_path, {_STAMP('removed[1]')} AS timestamp FROM r"""
)
def stream_dead_ends(v):
    from ..streaming import events as streams

    def shape(rows):
        kind = F.when(F.col("event_type") == "signup", "symbol_added").when(F.col("event_type") == "error", "symbol_removed").otherwise("other")
        return rows.select(
            F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("session_id"), F.get_json_object("props", "$.k").alias("file_path"), F.lit("s").alias("symbol_name"), kind.alias("event_type"), F.col("ts").cast("timestamp").alias("timestamp")
        )

    return _stream(v, shape, streams.dead_ends).select("session_id", "file_path", stamp("timestamp").alias("timestamp"))


@query(
    f"""WITH e AS (SELECT user_id, json_extract_string(props, '$.k') AS k, event_type, ts, event_id FROM events WHERE event_type IN ('signup', 'error')),
a AS (SELECT user_id, k, min((ts, event_id)) AS added FROM e WHERE event_type = 'signup' GROUP BY ALL),
r AS (SELECT e.user_id, e.k, min((e.ts, e.event_id)) AS removed FROM e JOIN a ON e.user_id = a.user_id AND e.k = a.k WHERE event_type = 'error' AND (e.ts, e.event_id) > a.added GROUP BY ALL)
SELECT user_id AS session_id, k AS file_path, {_STAMP('removed[1]')} AS timestamp FROM r"""
)
def dead_end(v):
    kind = F.when(F.col("event_type") == "signup", "symbol_added").when(F.col("event_type") == "error", "symbol_removed").otherwise(F.col("event_type"))
    e = v.events.withColumns({"event_type": kind, "symbol_name": F.lit("s")})
    return memory.dead_ends(e).select("session_id", "file_path", stamp("timestamp").alias("timestamp"))


@query("SELECT user_id AS session_id, event_id AS id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view') WHERE n = 5")
def redundant_access(v):
    e = v.events.withColumns({"file_path": F.col("event_type"), "symbol_name": F.lit(None).cast("string"), "event_type": F.when(F.col("event_type") == "view", "accessed").otherwise("other")})
    return memory.redundant_access(e).join(e.select(F.col("session_id"), "timestamp", "id", "file_path"), ["session_id", "timestamp", "file_path"]).select("session_id", "id")


@query(f"SELECT user_id AS session_id, k AS query, {_STAMP('ts')} AS timestamp FROM (SELECT user_id, ts, json_extract_string(props, '$.k') AS k, row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY ts, event_id) AS n FROM events) WHERE n = 3")
def failed_search_repeat(v):
    e = v.events.withColumns({"extra": F.create_map(F.lit("query"), F.col("file_path")), "event_type": F.lit("failed_search"), "symbol_name": F.lit(None).cast("string")})
    return memory.repeated_failed_search(e).select("session_id", F.col("extra")["query"].alias("query"), stamp("timestamp").alias("timestamp"))


@query(f"SELECT user_id AS session_id, event_type, {_STAMP('max(ts)')} AS timestamp FROM events WHERE event_type = 'error' GROUP BY ALL")
def last_event_of_type(v):
    e = v.events.withColumn("file_path", F.col("event_type"))
    return memory.last_event(e, "error").select("session_id", F.col("file_path").alias("event_type"), stamp("timestamp").alias("timestamp"))


@query("SELECT count(DISTINCT user_id) AS prior_sessions FROM events WHERE user_id <> 5")
def prior_sessions(v):
    return memory.prior_sessions(v.events, 5)


@query("SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY")
def retention_cutoff(v):
    return dml.retain(v.events, "7d", "", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), "timestamp").select("id")


@query("SELECT event_id AS id FROM events WHERE user_id = 5")
def retention_session(v):
    return dml.retain(v.events.withColumn("session_id", F.col("session_id").cast("string")), "session", "5", F.lit(None), "timestamp").select("id")


@query(f"SELECT event_id AS id, event_type FROM events WHERE event_type IN ('error', 'purchase') AND user_id = 5 ORDER BY ts DESC, event_id DESC LIMIT 100")
def anti_pattern_list(v):
    e = v.events.filter("session_id = 5")
    return e.filter(F.col("event_type").isin("error", "purchase")).orderBy(F.desc("timestamp"), F.desc("id")).limit(100).select("id", "event_type")


@query(
    """SELECT user_id AS session_id, count(*) FILTER (value > 100) AS n, CASE WHEN count(*) FILTER (value > 100) > 0 THEN count(*) FILTER (value > 100) || ' observation' || CASE WHEN count(*) FILTER (value > 100) > 1 THEN 's' ELSE '' END
 || ' linked to code that has since changed — re-evaluate before relying on them' END AS warning FROM events GROUP BY user_id"""
)
def stale_warning(v):
    g = v.events.groupBy("session_id").agg(F.count(F.when(F.col("value") > 100, 1)).alias("n"))
    return g.select("session_id", "n", memory.stale_warning(F.col("n")).alias("warning"))


# --- further scalars, joins and sets

_URL_PATH = "regexp_replace(url, '^[a-z]+://', '')"


@query(
    f"""WITH u AS (SELECT page_id, {_URL_PATH} AS p FROM pages) SELECT page_id, reverse(split_part(reverse(p), '/', 1)) AS name, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '.' END AS folder,
 CASE WHEN contains(p, '/') THEN regexp_replace(regexp_replace(p, '/[^/]*$', ''), '(^|/)[^/]*$', '') || CASE WHEN regexp_matches(regexp_replace(p, '/[^/]*$', ''), '/') THEN '/x' ELSE 'x' END ELSE '../x' END AS joined FROM u"""
)
def path_functions(v):
    p = F.regexp_replace("url", "^[a-z]+://", "")
    u = v.raw("pages").select("page_id", p.alias("p")).filter(F.col("p").isNotNull())
    folder = scalars.dirname(F.col("p"))
    return u.select("page_id", scalars.basename(F.col("p")).alias("name"), folder.alias("folder"), scalars.join_path(folder, F.lit("../x")).alias("joined"))


@query(
    f"""WITH u AS (SELECT page_id, {_URL_PATH} AS p FROM pages), n AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'src/' || p WHEN 1 THEN 'node_modules/' || p WHEN 2 THEN 'a/dist/' || p ELSE 'a/b.min.js' END AS path FROM u)
SELECT page_id FROM n WHERE NOT regexp_matches(path, '(?:^|/)(?:node_modules|\\.git|dist|build|\\.next|target|\\.gradle|out|__pycache__|\\.venv|venv|vendor)/|(?:\\.min\\.js|\\.d\\.ts|\\.pyc)$')"""
)
def ignored_paths(v):
    p = F.regexp_replace("url", "^[a-z]+://", "")
    k = F.col("page_id") % 4
    path = F.when(k == 0, F.concat(F.lit("src/"), p)).when(k == 1, F.concat(F.lit("node_modules/"), p)).when(k == 2, F.concat(F.lit("a/dist/"), p)).otherwise("a/b.min.js")
    return v.raw("pages").select("page_id", path.alias("path")).filter(~F.col("path").rlike(scan.IGNORE_PATTERN)).select("page_id")


@query("SELECT conv_id, turn, upper(role) AS method, '/' || conv_id || '/' || turn AS path FROM conversations")
def route_split(v):
    name = F.concat(F.upper("role"), F.lit(" /"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    method, path = scalars.route_parts(F.col("name"), F.col("role"))
    return v.raw("conversations").withColumn("name", name).select("conv_id", "turn", method.alias("method"), path.alias("path"))


@query("SELECT doc_id AS id, md5(array_to_string(string_split(text, chr(10))[1:5], chr(10))) AS snippet_hash FROM documents")
def snippet_lines(v):
    return v.texts.select("id", F.md5(scalars.line_slice(F.col("content"), F.lit(1), 5)).alias("snippet_hash"))


@query("SELECT page_id, CAST(ceil(length(html) / 4) AS BIGINT) AS tokens, octet_length(encode(html)) <= 1048576 AS within_limit FROM pages")
def page_tokens_and_size(v):
    h = F.col("html")
    return v.raw("pages").select("page_id", scalars.estimate_tokens(h).alias("tokens"), (F.octet_length(h) <= scan.MAX_FILE_BYTES).alias("within_limit"))


@query("SELECT p_partkey AS id, p_name AS name, coalesce(uses, 0) AS uses, has_stale FROM part LEFT JOIN (SELECT l_partkey, count(*) AS uses, max(l_quantity) > 49 AS has_stale FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def symbol_join_aggregate(v):
    """Uses are counted per symbol before the join."""
    part = v.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    uses = v.raw("lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("uses"), F.bool_or(F.col("l_quantity") > 49).alias("has_stale"))
    return part.join(uses, "id", "left").select("id", "name", F.coalesce("uses", F.lit(0)).alias("uses"), "has_stale")


@query("SELECT user_id AS session_id, event_id AS id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3")
def latest_observations(v):
    w = Window.partitionBy("session_id").orderBy(F.desc("timestamp"), F.desc("id"))
    return v.events.withColumn("n", F.row_number().over(w)).filter("n <= 3").select("session_id", "id", "n")


@query(
    """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 50)
SELECT 'both' AS part, user_id FROM a JOIN b USING (user_id) UNION ALL SELECT 'first' AS part, user_id FROM a WHERE user_id NOT IN (SELECT user_id FROM b) UNION ALL SELECT 'second' AS part, user_id FROM b WHERE user_id NOT IN (SELECT user_id FROM a)"""
)
def set_differences(v):
    e = v.raw("events")
    a, b = e.filter("event_type = 'view'").select("user_id").distinct(), e.filter("event_type = 'error' AND value > 50").select("user_id").distinct()
    tag = lambda df, t: df.select(F.lit(t).alias("part"), "user_id")
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "first")).unionByName(tag(b.subtract(a), "second"))


@query(f"WITH {_LOG} SELECT count(DISTINCT session_id) AS sessions, CAST(sum(tokens_used) AS BIGINT) AS tokens, CAST(sum(tokens_without_index - tokens_used) AS BIGINT) AS savings FROM log")
def history_totals(v):
    return dashboards.history_totals(tokens.with_totals(v.sessions, v.token_log))


@query(
    f"""WITH {_SAVINGS}, {_FILES}, p AS (SELECT DISTINCT user_id % 7 AS project FROM events), s AS (SELECT user_id % 7 AS project, count(DISTINCT user_id) AS n FROM events GROUP BY 1), f AS (SELECT id % 7 AS project, count(*) AS n FROM files GROUP BY 1)
SELECT p.project, coalesce(f.n, 0) AS file_count, coalesce(s.n, 0) AS session_count, coalesce(tokens_saved, 0) AS tokens_saved, coalesce(tokens_actual, 0) AS tokens_actual, coalesce(savings_percent, 0) AS savings_percent FROM p LEFT JOIN f USING (project) LEFT JOIN s USING (project) LEFT JOIN sv USING (project)"""
)
def project_stats(v):
    projects = v.sessions.select("project").distinct()
    files = v.files.select((F.col("id") % 7).alias("project"), F.lit(None).cast("timestamp").alias("last_indexed"))
    s = dashboards.project_stats(projects, files, files.limit(0), v.sessions, v.token_log)
    return s.select("project", "file_count", "session_count", "tokens_saved", "tokens_actual", "savings_percent")


@query(
    """SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'tool_error' WHEN 'purchase' THEN 'accessed' WHEN 'click' THEN CASE WHEN value > 50 THEN 'accessed' ELSE 'index_blind_spot' END WHEN 'view' THEN 'failed_search' END AS event_type FROM events
WHERE event_type IN ('error', 'purchase', 'click') OR (event_type = 'view' AND value < 20)"""
)
def observe_calls(v):
    tool = F.when(F.col("event_type") == "click", "get_symbol").when(F.col("event_type") == "purchase", "get_context").when(F.col("event_type") == "view", "search_symbols").otherwise("search_docs")
    calls = v.events.select(
        F.col("id").cast("string").alias("session_id"), tool.alias("tool"), F.col("file_path").alias("file"), F.lit(None).cast("string").alias("target"), F.lit("s").alias("symbol"), F.col("file_path").alias("query"),
        (F.col("event_type") == "error").alias("error"), F.when(F.col("event_type") == "click", F.col("value") > 50).otherwise(F.col("value") >= 20).alias("found"), F.lit(True).alias("exists"), F.col("timestamp"),
    )
    return memory.observe_calls(calls).select(F.col("session_id").cast("long").alias("id"), "event_type")


@query("SELECT user_id AS session_id, event_id AS id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events")
def keyed_counters(v):
    w = Window.partitionBy("session_id", "event_type").orderBy("timestamp", "id")
    return v.events.select("session_id", "id", F.row_number().over(w).alias("nth"))


def _stream(v: Views, shape, run) -> DataFrame:
    """Run a stream over the events file to its end, into files of the shared folder."""
    raw, folder = v.raw("events"), shared_folder(v.spark)
    found = run(shape(v.spark.readStream.schema(raw.schema).parquet(f"{v.dir}/events.parquet*")))
    sink = found.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.schema(found.schema).parquet(f"{folder}/rows")


@query(
    f"""WITH {_LOG}, r AS (SELECT id, sum(tokens_used) OVER w AS cumulative_actual, sum(tokens_without_index - tokens_used) OVER w AS cumulative_savings FROM log WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING))
SELECT id, CAST(cumulative_actual AS BIGINT) AS cumulative_actual, CAST(cumulative_savings AS BIGINT) AS cumulative_savings FROM r"""
)
def stream_running_totals(v):
    from ..streaming import events as streams

    def shape(rows):
        table = F.create_map(*[F.lit(x) for k, t in TOOL_OF_EVENT.items() for x in (k, t)])
        used = F.floor("value").cast("long")
        tool = F.coalesce(F.try_element_at(table, F.col("event_type")), F.lit("reindex"))
        return rows.select(
            F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("timestamp"), used.alias("tokens_used"),
            tokens.logged_estimate(tool, used, F.lit(True)).alias("tokens_without_index"),
        )

    return _stream(v, shape, streams.running_totals).select("id", "cumulative_actual", "cumulative_savings")


@query(
    f"""SELECT session_id, key, {_STAMP('ts')} AS timestamp FROM (SELECT CAST(user_id AS VARCHAR) AS session_id, json_extract_string(props, '$.k') AS key, ts, row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY ts) AS n FROM events) WHERE n = 3"""
)
def stream_failed_search_alerts(v):
    from ..streaming import events as streams

    def shape(rows):
        return rows.select(
            F.col("user_id").cast("string").alias("session_id"), F.lit("failed_search").alias("event_type"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("symbol_name"),
            F.create_map(F.lit("query"), F.get_json_object("props", "$.k")).alias("extra"), F.col("ts").cast("timestamp").alias("timestamp"),
        )

    def run(rows):
        return streams.threshold_alerts(streams.counted_events(rows))

    return _stream(v, shape, run).select("session_id", "key", stamp("timestamp").alias("timestamp"))


# --- extractors


def _sources(v: Views, extension: str, header: str, body: str) -> DataFrame:
    """A source file per document, a declaration per line of its whole text: named by the line's first word and number,
    with the line as a comment. {n} is the name, {l} the line, {i} its number, {id} the document, {to} the next one."""
    word = lambda line: F.coalesce(F.nullif(F.regexp_extract(F.lower(line), "[a-z]+", 0), F.lit("")), F.lit("none"))

    def declared(line, i):
        out, name = F.lit(body), F.concat(word(line), F.lit("_"), i.cast("string"))
        for mark, value in (("{n}", name), ("{i}", i.cast("string")), ("{l}", line)):
            out = F.replace(out, F.lit(mark), value)
        return out

    head = F.replace(F.replace(F.lit(header), F.lit("{id}"), F.col("id").cast("string")), F.lit("{to}"), (F.col("id") + 1).cast("string"))
    made = F.concat(head, F.array_join(F.transform(F.split("content", "\n"), declared), ""))
    return v.texts.select("id", F.concat(F.lit("src/"), F.col("id").cast("string"), F.lit(extension)).alias("path"), made.alias("content"))


_BODIES = {
    "java": (".java", "import a.b.C;\n", "public class K{n} {\n  // {l}\n  public int m{n}(int x) { return {i}; }\n}\n"),
    "kotlin": (".kt", "import a.b.C\n", "class K{n} {\n  // {l}\n  fun m{n}(x: Int) {}\n}\n"),
    "python": (".py", "from .a import b\n", "class K{n}:\n    # {l}\n    pass\ndef f{n}():\n    return {i}\n"),
    "php": (".php", "use A\\B;\n", "class K{n} {\n  // {l}\n  public function m{n}($x) {}\n}\n"),
    "ruby": (".rb", "require 'x'\n", "class K{n}\n  # {l}\n  def m{n}\n  end\nend\n"),
    "csharp": (".cs", "using System.Text;\n", "public class K{n} {\n  // {l}\n  public void M{n}(int x) { }\n}\n"),
    "go": (".go", "import \"fmt\"\n", "type K{n} struct {}\n// {l}\nfunc m{n}(x int) {}\n"),
    "rust": (".rs", "use std::io;\n", "pub struct K{n};\n// {l}\npub fn f{n}() {}\n"),
    "ts": (".ts", "import { a, b } from './{to}';\n", "export class K{n} {\n  // {l}\n  async m{n}(x: number): Promise<void> { try { } catch (e) { } }\n}\napp.get('/{n}', (req, res) => {});\n"),
}
#: What each declaration gives: kind, name, signature, first and last line in it, exported, async, with try and catch.
_FOUND = {
    "java": [("class", "K{n}", "public class K{n} {", 0, 0, True, False, False), ("method", "m{n}", "public int m{n}(int x) { return {i}; }", 2, 2, True, False, False)],
    "kotlin": [("class", "K{n}", "class K{n} {", 0, 0, True, False, False), ("function", "m{n}", "fun m{n}(x: Int) {}", 2, 2, True, False, False)],
    "python": [("class", "K{n}", "class K{n}:", 0, 0, True, False, False), ("function", "f{n}", "def f{n}():", 3, 3, True, False, False)],
    "php": [("class", "K{n}", "class K{n} {", 0, 0, True, False, False), ("function", "m{n}", "public function m{n}($x) {}", 2, 2, True, False, False)],
    "ruby": [("class", "K{n}", "class K{n}", 0, 0, True, False, False), ("method", "m{n}", "def m{n}", 2, 2, True, False, False)],
    "csharp": [("class", "K{n}", "public class K{n} {", 0, 0, True, False, False), ("method", "M{n}", "public void M{n}(int x) { }", 2, 2, True, False, False)],
    "go": [("class", "K{n}", "type K{n} struct {}", 0, 0, True, False, False), ("function", "m{n}", "func m{n}(x int) {}", 2, 2, True, False, False)],
    "rust": [("class", "K{n}", "pub struct K{n};", 0, 0, True, False, False), ("function", "f{n}", "pub fn f{n}() {}", 2, 2, True, False, False)],
    "ts": [
        ("class", "K{n}", "class K{n}", 0, 3, True, False, True), ("method", "m{n}", "m{n}(x: number): Promise<void>", 2, 2, False, True, True),
        ("route", "GET /{n}", "GET /{n}", 4, 4, False, False, False),
    ],
}
_LINES = """ls AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
ln AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS l FROM ls),
nm AS (SELECT doc_id, i, coalesce(nullif(regexp_extract(lower(l), '[a-z]+'), ''), 'none') || '_' || i AS n FROM ln)"""


def _found_sql(name: str) -> str:
    extension, _, body = _BODIES[name]
    text = lambda s: "replace(replace('" + s.replace("'", "''") + "', '{n}', n), '{i}', CAST(i AS VARCHAR))"
    first = f"2 + i * {body.count(chr(10))}"
    rows = [
        f"""SELECT 'src/' || doc_id || '{extension}' AS path, {text(label)} AS name, '{kind}' AS kind, left({text(sig)}, {80 if name != 'ts' else 100_000}) AS signature, CAST({first} + {a} AS INT) AS start_line, CAST({first} + {b} AS INT) AS end_line,
 {exported} AS is_exported, {is_async} AS is_async, {tries} AS has_try_catch FROM nm"""
        for kind, label, sig, a, b, exported, is_async, tries in _FOUND[name]
    ]
    return f"WITH {_LINES} " + " UNION ALL ".join(rows)


def _add_extractor(name: str) -> None:
    def f(v: Views) -> DataFrame:
        return parse.symbols(parse.parse(_sources(v, *_BODIES[name]))).drop("ord")

    f.__name__ = f"{'ts' if name == 'ts' else 'regex'}_symbols" + ("" if name == "ts" else f"_{name}")
    query(_found_sql(name))(f)


for _name in _BODIES:
    _add_extractor(_name)


@query(
    """WITH f AS (SELECT doc_id, row_number() OVER (ORDER BY 'src/' || doc_id || '.ts') AS id FROM documents)
SELECT a.id AS from_file, b.id AS to_file, s AS symbol_name FROM f a JOIN f b ON b.doc_id = a.doc_id + 1, (VALUES ('a'), ('b')) t(s)"""
)
def import_resolution(v):
    """Every file imports two symbols of the next; that of the last has no file."""
    src = _sources(v, *_BODIES["ts"])
    files = dml.with_ids(src.select("path"), v.spark.createDataFrame([], "id long"), ["path"])
    return graph.resolve(parse.imports(parse.parse(src)), files)


@query(f"WITH {_LINES} SELECT 'GET' AS method, '/' || n AS path, 'src/' || doc_id || '.ts' AS file, CAST(6 + i * 5 AS INT) AS line, false AS is_async, false AS has_try_catch FROM nm")
def api_endpoints(v):
    """The tool over the symbols of all parsed files."""
    src = _sources(v, *_BODIES["ts"])
    files = src.select("id", "path")
    s = parse.symbols(parse.parse(src)).join(files.withColumnRenamed("id", "file_id"), "path").drop("path")
    return tools.Project(v.spark, {"files": files, "symbols": s}).call("get_api_endpoints")


@query(
    f"""WITH l AS (SELECT {_PATH} AS path, string_split(text, chr(10)) AS ls FROM documents),
r AS (SELECT path, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS raw FROM l),
m AS (SELECT path, pos, regexp_matches(raw, '^[A-Z][a-z]+\\.$') AS title, CASE WHEN regexp_matches(raw, '^[A-Z][a-z]+\\.$') THEN '## ' || raw ELSE raw END AS line, raw FROM r),
s AS (SELECT *, sum(CAST(title AS INT)) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM m),
g AS (SELECT path, section, max(CASE WHEN title THEN raw END) AS heading, min(pos) AS start_line, max(pos) AS end_line, string_agg(line, chr(10) ORDER BY pos) AS content FROM s GROUP BY path, section)
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY start_line) - 1 AS INT) AS chunk_index, heading, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, md5(content) AS content_hash FROM g WHERE regexp_matches(content, '[^\\s]')"""
)
def heading_chunks(v):
    marked = v.texts.select("path", F.regexp_replace("content", r"(?m)^([A-Z][a-z]+\.)$", "## $1").alias("content"))
    return parse.heading_chunks(marked).select("path", "chunk_index", "heading", "start_line", "end_line", F.md5("content").alias("content_hash"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["search_docs_bm25_and"](spark, sf_dir)
