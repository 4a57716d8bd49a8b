"""Row changes as whole-table functions: new contents in, new contents out. ``sources.store.Store`` makes them durable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema


def with_ids(new: DataFrame, old: DataFrame, order: list[str]) -> DataFrame:
    """Give rows the ids after the largest used one, in the order of a stable key.

    Ranks come from per-range counts, so the rows are sorted in parallel: the key is split into ranges, counted per
    range, and numbered inside each."""
    top = F.broadcast(old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")))  # one row
    ranged = new.drop("id").repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).persist()
    counts = ranged.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_part", before.alias("_before")))  # one row per partition
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(offsets, "_part").crossJoin(top).withColumn("id", F.col("_top") + F.col("_before") + inner).drop("_part", "_before", "_top")


def merge(old: DataFrame, new: DataFrame, table: str) -> DataFrame:
    """Upsert by the table's key: existing rows keep their id and take the new values, others are appended."""
    key = schema.KEYS[table]
    mark = new.select(*key, F.lit(True).alias("_new"))
    kept = old.join(mark, key, "left_anti")
    if key == ["id"]:
        return kept.unionByName(new.select(*old.columns))
    ids = old.select(*key, F.col("id").alias("_id"))
    known = new.drop("id").join(ids, key).withColumnRenamed("_id", "id")
    fresh = with_ids(new.join(ids, key, "left_anti"), old, key)
    columns = old.columns
    return kept.select(*columns).unionByName(known.select(*columns)).unionByName(fresh.select(*columns))


def insert_ignore(old: DataFrame, new: DataFrame, table: str) -> DataFrame:
    """Append the rows whose key is not there yet, once each. A missing symbol name is the empty one."""
    key = schema.KEYS[table]
    if "symbol_name" in key:
        new = new.withColumn("symbol_name", F.coalesce("symbol_name", F.lit("")))
    fresh = with_ids(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"), old, key)
    return old.unionByName(fresh.select(*old.columns))


def append(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    return old.unionByName(schema_like(with_ids(new, old, order), old))


def schema_like(df: DataFrame, like: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def delete_where(old: DataFrame, keys: DataFrame, on: dict[str, str]) -> DataFrame:
    """Without the rows whose columns equal a row of keys (table column -> key column)."""
    k = keys.select(*[F.col(v).alias(f"_k_{c}") for c, v in on.items()]).distinct()
    return old.join(k, [F.col(c) == F.col(f"_k_{c}") for c in on], "left_anti")


def delete_files(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Files with everything that hangs on them; ``ids`` has file_id. Snapshots stay: they are keyed by path."""
    out = dict(tables)
    gone = ids.select("file_id").distinct()
    symbols = tables["symbols"].join(gone, "file_id", "left_semi").select(F.col("id").alias("symbol_id"))
    out["files"] = delete_where(tables["files"], gone, {"id": "file_id"})
    for name in ("symbols", "documents", *(["imports"] if "imports" in tables else [])):
        out[name] = delete_where(tables[name], gone, {"file_id": "file_id"})
    deps = delete_where(tables["dependencies"], gone, {"from_file": "file_id"})
    out["dependencies"] = delete_where(deps, gone, {"to_file": "file_id"})
    uses = delete_where(tables["usages"], gone, {"used_in_file": "file_id"})
    out["usages"] = delete_where(uses, symbols, {"symbol_id": "symbol_id"})
    return out


def vanished(files: DataFrame, scanned: DataFrame) -> DataFrame:
    """(file_id) of indexed files that the scan no longer finds."""
    return files.join(scanned.select("path"), "path", "left_anti").select(F.col("id").alias("file_id"))


def last_per_key(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Of rows with the same key, the last in order."""
    names = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*names), order).alias("_v"))
    return best.select(*key, "_v.*")


def mark_stale(observations: DataFrame, changes: DataFrame) -> DataFrame:
    """Observations on a changed or removed symbol become stale, with the change as the reason, in every session.
    changes: file_path, symbol_name, description; already stale rows keep their reason."""
    why = changes.groupBy("file_path", "symbol_name").agg(F.min("description").alias("_why"))
    now = F.col("_why").isNotNull() & ~F.col("stale")
    return observations.join(why, ["file_path", "symbol_name"], "left").withColumns(
        {"stale_reason": F.when(now, F.col("_why")).otherwise(F.col("stale_reason")), "stale": F.col("stale") | now}
    ).select(*observations.columns)


def retain(table: DataFrame, policy: str, session_id: str, now: Column, time_col: str) -> DataFrame:
    """Retention: permanent, session (only the named session's rows), or Nd (rows of the last N days)."""
    if policy == "permanent":
        return table
    if policy == "session":
        return table.filter(F.col("session_id") == session_id)
    if not (policy.endswith("d") and policy[:-1].isdigit()):
        raise ValueError(f"unknown retention {policy!r}")
    return table.filter(F.col(time_col) >= now - F.expr(f"INTERVAL {int(policy[:-1])} DAYS"))
