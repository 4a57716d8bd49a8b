"""Mixing sources to target weights with hash-threshold histograms (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_SPLIT, cut

_LEVELS, _BITS = 4, 12


def word_count(c: Column) -> Column:
    parts = F.split(F.coalesce(c, F.lit("")), SPACE_SPLIT)
    n = F.size(parts)
    return (n - (F.element_at(parts, 1) == "").cast("int") - ((n > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def _running(t: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """t with running sums (name -> expression) over the rows before each in the order. Rows are dealt to ranges of the
    order and summed inside each; what lies before a range is one row per range."""
    t = cut(t.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    parts = t.groupBy("_part").agg(*[F.sum(F.expr(x)).alias(f"_{n}") for n, x in sums.items()])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = F.broadcast(parts.select("_part", *[F.coalesce(F.sum(f"_{n}").over(ahead), F.lit(0)).alias(f"_{n}") for n in sums]))  # one row per range
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.join(parts, "_part").withColumns({n: F.coalesce(F.sum(F.expr(x)).over(before), F.lit(0)) + F.col(f"_{n}") for n, x in sums.items()})
    return t.drop("_part", *[f"_{n}" for n in sums])


def source_targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size) -> with w and target. Weights repeat over the sources by code point, null last.

    A source's target is its weighted share of ``share`` times all sizes, but at most ``most`` times its own size; the
    excess is dealt again by weight. Sources are taken by rising cap per weight: the capped ones are a prefix of that
    order, so two running sums give every level at once. The table has one row per source, and no task holds it whole."""
    name = [F.col("source").isNull(), F.col("source")]
    t = _running(sizes, name, {"at": "1"})
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("at", F.lit(len(weights))) + 1).cast("int"))
    t = t.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("w"))
    t = cut(_running(t, [F.col("ratio"), *name], {"cap_before": "cap", "w_before": "w"}), "sources")
    every = F.broadcast(t.agg(F.sum("w").alias("w_all"), (F.sum("source_size") * F.lit(float(share))).alias("whole")))  # one row
    level = (F.col("whole") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before"))
    # the water level is that of the first source whose cap is above it
    above = t.crossJoin(every).withColumn("level", level).filter("ratio > level").agg(F.min(F.struct("ratio", "level"))["level"].alias("_level"))
    t = t.crossJoin(F.broadcast(above))  # one row
    return t.select(
        "source", "source_size", F.when(F.col("_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("_level") * F.col("w"))).alias("target")
    )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken (words, repeats counted).

    Every document is taken floor(target / source size) times, and the rest of the target is met by the documents whose
    hash is below a threshold. Thresholds come from histograms: sizes are summed by source and the hash's first 12 bits,
    the bucket in which the running sum passes the rest is refined by the next 12 bits, and so on to 48; the last
    bucket is taken if that brings the sum nearer. No row is sorted, and a rerun takes the same documents.

    Null text has size 0; null is a source of its own, the last. Rows that repeat id and size share their hash and are
    taken together. Texts of any length are counted whole. An empty table gives no rows; extra columns are ignored,
    whatever their names.
    """
    size = word_count(F.col(text_col))
    name = F.md5(F.concat_ws("|", F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    rows = cut(
        docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), size.alias("size")).withColumn(
            "h", F.conv(F.substring(name, 1, _LEVELS * _BITS // 4), 16, 10).cast("long")
        ),
        "sizes",
    )
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = source_targets(sums, weights, share, most)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("base", base).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
    bound = cut(goal.withColumn("lo", F.lit(0).cast("long")), "targets")
    of = lambda t, *c: t.select(F.col("source").alias("_s"), *c)
    same = F.col("source").eqNullSafe(F.col("_s"))
    for k in range(_LEVELS):
        shift = _BITS * (_LEVELS - 1 - k)
        part = F.shiftright("h", shift).alias("b")
        if k:  # only the boundary bucket of each source is refined
            inside = rows.join(of(bound, "lo", "rest"), same & (F.shiftright("h", shift + _BITS) == F.shiftright("lo", shift + _BITS)))
            hist = inside.groupBy("source", part).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
        else:
            hist = rows.groupBy("source", part).agg(F.sum("size").alias("n")).join(of(bound, "rest"), same)
        run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("upto", F.sum("n").over(run)).filter(F.col("upto") > F.col("rest"))
        hit = hist.groupBy("source").agg(F.min(F.struct("b", "upto", "n")).alias("hit"))
        # a row per source of either table, put together by grouping: no hash table of the sources has to be kept
        held = bound.select("source", F.struct("source_size", "target", "base", "rest").alias("held"))
        bound = held.unionByName(hit, allowMissingColumns=True).groupBy("source").agg(F.max("held").alias("held"), F.max("hit").alias("hit"))
        bound = cut(
            bound.select(
                "source", "held.source_size", "held.target", "held.base",
                (F.col("held.rest") - F.coalesce(F.col("hit.upto") - F.col("hit.n"), F.lit(0))).alias("rest"),
                F.coalesce(F.shiftleft("hit.b", shift), F.lit(0)).cast("long").alias("lo"),
                F.coalesce(F.col("hit.n"), F.lit(0)).cast("long").alias("n"),
            ),
            "bounds",
        )
    below = F.col("lo") + F.when(F.col("rest") * 2 >= F.col("n"), F.lit(1)).otherwise(F.lit(0))
    take = of(bound, "source_size", "target", "base", below.alias("below"))
    return rows.join(take, same).select(
        F.col("_id").alias(id_col), "source", "size", "source_size", "target",
        (F.col("size") * (F.col("base") + (F.col("h") < F.col("below")).cast("long"))).alias("taken"),
    )
