"""Table schemas of the index, with a version and the backfill between versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType

SCHEMA_VERSION = 6

_TYPES = {
    "long": LongType(), "int": IntegerType(), "string": StringType(), "boolean": BooleanType(), "timestamp": TimestampType(),
    "strings": ArrayType(StringType()), "map": MapType(StringType(), StringType()),
}


def _struct(spec: str) -> StructType:
    """A schema from "name type" items; an exclamation mark means!."""
    fields = [x.split() for x in spec.split(",")]
    return StructType([StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")) for name, kind in fields])


TABLES: dict[str, StructType] = {
    name: _struct(spec)
    for name, spec in {
        "files": "id long!, path string!, language string!, summary string, last_indexed timestamp, hash string, raw_token_estimate long",
        "symbols": "id long!, file_id long!, name string, kind string, signature string, summary string, start_line int, end_line int, is_exported boolean, is_async boolean, has_try_catch boolean",
        "dependencies": "id long!, from_file long!, to_file long!, symbol_name string",
        "imports": "id long!, file_id long!, ord int, source string, symbol_name string",
        "usages": "id long!, symbol_id long!, used_in_file long!, used_at_line int",
        "token_log": "id long!, timestamp timestamp, session_id string, tool_name string, tokens_used long, tokens_without_index long, files_touched strings, query string",
        "sessions": "id string!, started_at timestamp, mode string, label string",
        "documents": "id long!, file_id long!, chunk_index int, heading string, start_line int, end_line int, content string, summary string",
        "context_entries": "id long!, session_id string, content string, tags string, created_at timestamp",
        "ast_snapshots": "id long!, file_path string, symbol_name string, kind string, signature string, signature_hash string, captured_at timestamp",
        "session_observations": "id long!, session_id string, type string, file_path string, symbol_name string, observation string, stale boolean, stale_reason string, created_at timestamp",
        "session_events": "id long!, session_id string, event_type string, file_path string, symbol_name string, extra map, timestamp timestamp",
    }.items()
}
#: The key that a table's rows are unique by, beside id.
KEYS = {
    "files": ["path"],
    "dependencies": ["from_file", "to_file", "symbol_name"],
    "usages": ["symbol_id", "used_in_file", "used_at_line"],
    "sessions": ["id"],
    "ast_snapshots": ["file_path", "symbol_name"],
}

# --- fixed values: names of kinds, modes, observations and events
SYMBOL_KINDS = ("function", "class", "method", "interface", "type", "enum", "const", "variable", "route")
SESSION_MODES = ("indexed", "baseline")
CHANGE_EVENTS = ("symbol_added", "symbol_removed", "sig_changed")
ANTI_PATTERN_EVENTS = ("thrash_detected", "dead_end", "failed_search", "tool_error", "index_blind_spot", "redundant_access")
# --- end of fixed values


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type; columns that an older version lacks are filled with their default."""
    have = set(df.columns)
    columns = []
    for f in TABLES[table].fields:
        c = F.col(f.name) if f.name in have else (F.lit(False) if f.dataType.simpleString() == "boolean" else F.lit(None))
        columns.append(c.cast(f.dataType).alias(f.name))
    return df.select(*columns)


def empty(spark, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])
