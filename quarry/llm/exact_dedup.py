"""Exact deduplication by a tree of sorted digest runs (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

_KEY = ["digest", "n_bytes", "check"]


def _normal(text_col: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def _slice(level: int, bits: int) -> Column:
    """The range of a digest at a level: its first ``bits * level`` bits."""
    most = 1 << bits * level
    return F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * F.lit(most) / F.lit(1 << 32)).cast("long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_bits: int = 3) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    A binomial tree of sorted runs. At its leaves, every partition of the input is a run of digests. In each round,
    2 ** ``fan_bits`` neighbouring runs exchange: a run covers all digests, and after the round the merged run is cut
    into that many times more ranges of the digest, one task each, so a task always holds the bytes of one partition.
    Each task merges what it got: the runs' rows are put in order of the digest, and neighbours of equal digest become
    one, which keeps the smallest (``keep="max"``: largest) id and the count. Rounds end with one run, which no task
    holds as a whole. The result then descends the same tree, so that the copies of one text are spread over all runs
    in every join. Groups are verified at every level: they share SHA-256, byte length and a second, independent hash,
    and texts that differ in one of them stay apart.

    Null text counts as empty. A null id never stays while its group has another id; a group of null ids keeps them
    all, as do rows that repeat both id and text (they cannot be told apart). An empty table gives no rows; extra
    columns are ignored, whatever their names; texts of any length are hashed as a whole.
    """
    norm = _normal(text_col)
    rows = cut(
        docs.select(
            F.col(id_col).alias("_id"),
            F.sha2(norm, 256).alias("digest"),
            F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_bytes"),
            F.xxhash64(norm).alias("check"),
            F.spark_partition_id().cast("long").alias("run"),
        ),
        "digests",
    )
    # an id in a struct sorts as a whole, and is merged by comparing neighbours of the sorted runs
    best, last = (F.min, F.col("_id").isNull()) if keep == "min" else (F.max, F.col("_id").isNotNull())
    ident = F.struct(last.alias("last"), F.col("_id").alias("id"))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    left = (rows.agg(F.max("run")).first()[0] or 0) + 1

    def merged(runs: DataFrame, level: int, size: Column) -> DataFrame:
        """Neighbouring runs merged to one, a range of the digest in a task."""
        ranged = runs.withColumn("range", _slice(level, fan_bits)).repartition(tasks, "run", "range")
        runs = ranged.sortWithinPartitions("run", "range", *_KEY).groupBy("run", "range", *_KEY).agg(best("ident").alias("ident"), size.alias("group_size"))
        return cut(runs.drop("range"), "runs")  # every round stands on the written runs of the one before

    up = [merged(rows.withColumn("ident", ident), 0, F.count(F.lit(1)))]
    while left > 1:
        left = -(-left // (1 << fan_bits))
        up.append(merged(up[-1].withColumn("run", F.shiftright("run", fan_bits)), len(up), F.sum("group_size")))
    found = up[-1]
    for below in reversed(up[:-1]):
        lower = below.select(*_KEY, F.col("run").alias("own"), F.shiftright("run", fan_bits).alias("run"))
        found = lower.hint("merge").join(found, [*_KEY, "run"]).select(*_KEY, F.col("own").alias("run"), "ident", "group_size")
    return rows.hint("merge").join(found, [*_KEY, "run"]).select(
        F.col("_id").alias(id_col),
        F.col("ident.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("ident.id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The input's rows that stay, with all their columns."""
    gone = exact_dedup(docs, id_col, text_col, keep).filter(~F.col("kept"))
    gone = gone.select(F.col(id_col).alias("_gone"), F.col("text_sha256").alias("_gone_digest")).distinct()
    digest = F.sha2(_normal(text_col), 256)
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("_gone")) & (digest == F.col("_gone_digest")), "left_anti")
