"""The import graph: resolving relative imports to files, and its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

# --- fixed values: what a relative import may be completed by, in order of preference
SUFFIXES = (".ts", ".tsx", ".js", "/index.ts", "/index.js", "")
# --- end of fixed values


def candidates(imports: DataFrame) -> DataFrame:
    """(path, source, symbol_name, prio, candidate) of relative imports."""
    tries = F.posexplode(F.array(*[F.concat("source", F.lit(s)) for s in SUFFIXES])).alias("prio", "tail")
    rows = imports.filter(F.col("source").startswith(".")).select("path", "source", "symbol_name", tries)
    return rows.withColumn("candidate", scalars.join_path(scalars.dirname(F.col("path")), F.col("tail"))).drop("tail")


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Edges (from_file, to_file, symbol_name), all at once: each import's first candidate that is a known file."""
    # the many imports of a file share their candidates
    asked = candidates(imports.select("path", "source", F.lit("").alias("symbol_name")).distinct())
    known = files.select(F.col("path").alias("candidate"), F.col("id").alias("to_file"))
    best = asked.join(known, "candidate").groupBy("path", "source").agg(F.min_by("to_file", "prio").alias("to_file"))
    own = files.select("path", F.col("id").alias("from_file"))
    return imports.join(best, ["path", "source"]).join(own, "path").select("from_file", "to_file", F.coalesce("symbol_name", F.lit("")).alias("symbol_name")).distinct()


def imports_of(dependencies: DataFrame, files: DataFrame, file_id: int) -> DataFrame:
    """What a file imports: one row per imported symbol."""
    d = dependencies.filter(F.col("from_file") == file_id)
    return d.join(files, F.col("to_file") == files["id"]).select("path", "symbol_name").orderBy("path", "symbol_name")


def imported_by(dependencies: DataFrame, files: DataFrame, file_id: int) -> DataFrame:
    d = dependencies.filter(F.col("to_file") == file_id)
    return d.join(files, F.col("from_file") == files["id"]).select("path", "symbol_name").orderBy("path", "symbol_name")
