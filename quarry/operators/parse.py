"""Parsing a scan into symbols, imports and document chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.extract import parse_file

CHUNK_LINES = 50
_SYMBOL = "name string, kind string, signature string, start_line int, end_line int, is_exported boolean, is_async boolean, has_try_catch boolean"
_PARSED = f"path string, symbols array<struct<{_SYMBOL.replace(' ', ':').replace(',:', ',')}>>, imports array<struct<source:string,symbols:array<string>>>"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        found = [parse_file(p, c) for p, c in zip(df["path"], df["content"], strict=True)]
        yield pd.DataFrame(
            {"path": df["path"], "symbols": [[vars(s) for s in x.symbols] for x in found], "imports": [[vars(i) for i in x.imports] for x in found]}
        )


def parse(files: DataFrame) -> DataFrame:
    """(path, symbols, imports) of source files (path, content): one Arrow pass, both results from one parse."""
    return files.select("path", "content").mapInPandas(_parse, _PARSED)


def symbols(parsed: DataFrame) -> DataFrame:
    """One row per symbol in order of emission (ord)."""
    return parsed.select("path", F.posexplode("symbols").alias("ord", "s")).select("path", "ord", "s.*")


def imports(parsed: DataFrame) -> DataFrame:
    """One row per imported symbol (symbol_name is empty for an import without names)."""
    one = parsed.select("path", F.posexplode("imports").alias("ord", "i")).select("path", "ord", "i.source", "i.symbols")
    names = F.when(F.size("symbols") > 0, F.col("symbols")).otherwise(F.array(F.lit("")))
    return one.select("path", "ord", "source", F.explode(names).alias("symbol_name"))


def file_rows(files: DataFrame) -> DataFrame:
    """(path, language, hash, raw_token_estimate) of files with content."""
    return files.select(
        scalars.forward_slashes(F.col("path")).alias("path"), scalars.language_of(F.col("path")).alias("language"),
        scalars.content_hash(F.col("content")).alias("hash"), scalars.estimate_tokens(F.col("content")).alias("raw_token_estimate"), "content",
    )


def changed_files(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose hash is new or differs from the index, with status indexed, updated or skipped."""
    old = known.select("path", F.col("hash").alias("_hash"))
    return rows.join(old, "path", "left").withColumn(
        "status", F.when(F.col("_hash").isNull(), "indexed").when(F.col("_hash") == F.col("hash"), "skipped").otherwise("updated")
    ).drop("_hash")


def _numbered(chunks: DataFrame, key: str) -> DataFrame:
    """Drop blank chunks and number the rest per file."""
    filled = chunks.filter(~F.col("content").rlike(r"^[\s\x{A0}\x{FEFF}]*$"))
    order = Window.partitionBy(key).orderBy("start_line")
    return filled.withColumn("chunk_index", F.row_number().over(order) - 1)


def line_chunks(texts: DataFrame, key: str = "path", content: str = "content", size: int = CHUNK_LINES) -> DataFrame:
    """(key, chunk_index, heading, start_line, end_line, content): so many lines each. A row makes its own chunks, no
    lines are shuffled."""
    lines = F.split(content, "\n")
    n = F.size(lines)
    starts = F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))
    made = F.transform(
        starts,
        lambda k: F.struct(
            (k * size + 1).alias("start_line"), F.least(k * size + size, n).alias("end_line"), F.array_join(F.slice(lines, k * size + 1, size), "\n").alias("content")
        ),
    )
    blank = r"^[\s\x{A0}\x{FEFF}]*$"
    kept = F.filter(made, lambda c: ~c["content"].rlike(blank))
    return texts.select(key, F.posexplode(kept).alias("chunk_index", "c")).select(
        key, "chunk_index", F.lit(None).cast("string").alias("heading"), "c.start_line", "c.end_line", "c.content"
    )


def heading_chunks(texts: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Markdown split at headings of levels 1 to 3, inside code fences too; the text before the first heading is a
    chunk without one."""
    lines = texts.select(key, F.posexplode(F.split(content, "\n")).alias("pos", "line"))
    title = F.regexp_extract("line", r"^#{1,3}[\s\x{A0}]+(.+)$", 1)
    lines = lines.withColumn("title", F.when(F.col("line").rlike(r"^#{1,3}[\s\x{A0}]+.+$"), F.trim(title)))
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.count("title").over(order))
    parts = lines.groupBy(key, "section").agg(
        F.max("title").alias("heading"), (F.min("pos") + 1).alias("start_line"), (F.max("pos") + 1).alias("end_line"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("content"),
    )
    return _numbered(parts, key).select(key, "chunk_index", "heading", "start_line", "end_line", "content")


def document_chunks(files: DataFrame) -> DataFrame:
    """Chunks of document files (path, content): markdown by headings, others by lines."""
    docs = files.withColumn("language", scalars.language_of(F.col("path"))).filter(scalars.is_document_language(F.col("language")))
    return heading_chunks(docs.filter("language = 'markdown'")).unionByName(line_chunks(docs.filter("language <> 'markdown'")))


def script_blocks(texts: DataFrame, content: str = "content") -> DataFrame:
    """The first script block of each text, as script."""
    return texts.withColumn("script", F.regexp_extract(F.coalesce(F.col(content), F.lit("")), r"(?is)<script(?:\s[^>]*)?>(.*?)</script>", 1))
