"""Benchmark decontamination by a prefix-filtered join of word shingles (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, small, with_row_key, without_rows

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LONGEST_SHINGLE = 3


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), _SEPARATORS), "")


def _shingles(words: Column, g: int) -> Column:
    """Hashes of the g-word shingles, by position."""
    at = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(g)])
    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) >= g, F.transform(F.sequence(F.lit(0), F.size(words) - g), at)).otherwise(none)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: float = 0.05,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items (sorted, as strings), contaminated.

    A window is ``window`` consecutive words of an item (a shorter item is one window); a document word inside any
    occurrence is hit; ``contaminated``: n_hit > 0 and n_hit >= share * n_words.

    Shingles of up to three words of documents and items meet in one join. They are ordered by how often they occur in
    all documents, and each window is sought by its rarest shingle only (its prefix: an occurrence must contain it). A
    meeting fixes how the item would lie over the document; the length and positional bounds drop the alignments for
    which no whole window fits, and the rest are verified word by word over the item's length.

    Null texts have no words and repeat nothing; a null item id marks words but is not listed. Documents that repeat
    id and text share their row's values; an empty benchmark gives n_hit 0 everywhere, no documents no rows. Of shingles that
    are equally rare in a window the first by hash is its prefix, which changes no result. Texts of any length are read
    whole. Extra columns are ignored, whatever their names.
    """
    return _marked(docs, benchmark, id_col, text_col, item_col, item_text_col, window, share).drop("_id", "_t")


def _marked(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: float = 0.05,
) -> DataFrame:
    """The result of decontaminate with the key of each row, _id and _t."""
    base = with_row_key(docs, id_col, text_col)
    items = cut(
        with_row_key(benchmark, item_col, item_text_col, item_col)
        .select(F.col(item_col).cast("string").alias("item"), F.struct("_id", "_t").alias("key"), words_of(F.col("_text")).alias("iw"))
        .filter(F.size("iw") > 0)
        .dropDuplicates(["key"])
        .withColumn("g", F.least(F.size("iw"), F.lit(_LONGEST_SHINGLE))),
        "items",
    )
    # the shingles of the items: (g, key, p, s)
    sizes = sorted(r.g for r in items.select("g").distinct().collect())
    words = base.select("_id", "_t", words_of(F.col("_text")).alias("w"))
    found = None
    for g in sizes:
        own = items.filter(F.col("g") == g)
        wanted = small(cut(own.select(F.explode(_shingles(F.col("iw"), g)).alias("s")).distinct(), "shingles"))
        met = words.select("_id", "_t", F.posexplode(_shingles(F.col("w"), g)).alias("at", "s")).join(wanted, "s").withColumn("g", F.lit(g))
        found = met if found is None else found.unionByName(met)
    hits = None
    if found is not None:
        met = cut(found, "met")
        often = met.groupBy("g", "s").count()
        spread = None
        for g in sizes:
            x = items.filter(F.col("g") == g).select("g", "key", F.size("iw").alias("len"), F.posexplode(_shingles(F.col("iw"), g)).alias("p", "s"))
            spread = x if spread is None else spread.unionByName(x)
        ranked = spread.join(often, ["g", "s"], "left").groupBy("key", "g", "len").agg(
            F.sort_array(F.collect_list(F.struct("p", F.coalesce("count", F.lit(0)).alias("n"), "s"))).alias("a")
        )
        width = F.least(F.lit(window), F.col("len"))
        per_window = F.transform(
            F.sequence(F.lit(0), F.col("len") - width),
            lambda i: F.array_min(F.transform(F.slice(F.col("a"), i + 1, width - F.col("g") + 1), lambda x: F.struct(x["n"].alias("n"), x["s"].alias("s"), x["p"].alias("p")))),
        )
        prefix = ranked.select("g", "key", "len", F.explode(F.array_distinct(per_window)).alias("x")).select(
            "g", "key", "len", F.col("x.s").alias("s"), F.col("x.p").alias("p")
        ).filter(F.col("x.n") > 0)
        lie = met.join(small(cut(prefix, "prefix")), ["g", "s"]).select("_id", "_t", "key", "len", (F.col("at") - F.col("p")).alias("shift"))
        # positional bound: a window of the item starts inside the document
        lie = lie.filter(F.col("shift") > -F.col("len")).groupBy("_id", "_t", "key", "shift").agg(F.first("len").alias("len"))
        lie = lie.join(small(items.select("key", "item", "iw"), size=24 * F.size("iw")), "key").groupBy("_id", "_t").agg(
            F.collect_list(F.struct("shift", "item", "iw")).alias("lies")
        )
        words_in = F.aggregate("lies", F.lit(0), lambda a, x: a + 2 + F.size(x["iw"]))
        lie = small(cut(lie, "alignments"), size=24 * words_in)
        w, n = F.col("w"), F.size("w")

        def covered(x: Column) -> Column:
            iw = x["iw"]
            size = F.size(iw)
            width = F.least(F.lit(window), size)
            same = F.array_join(
                F.transform(iw, lambda t, j: F.when((x["shift"] + j >= 0) & (x["shift"] + j < n) & (F.get(w, F.greatest(x["shift"] + j, F.lit(0))) == t), "1").otherwise("0")), ""
            )
            starts = F.filter(F.sequence(F.lit(0), size - width), lambda i: F.substr(same, i + 1, width) == F.repeat(F.lit("1"), width))
            return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(x["shift"] + i, x["shift"] + i + width - 1))))

        checked = words.join(lie, ["_id", "_t"]).select(
            "_id", "_t", F.transform("lies", lambda x: F.struct(x["item"].alias("item"), covered(x).alias("hit"))).alias("c")
        )
        checked = checked.withColumn("c", F.filter("c", lambda x: F.size(x["hit"]) > 0)).filter(F.size("c") > 0)
        hits = cut(
            checked.select(
                "_id", "_t",
                F.size(F.array_distinct(F.flatten(F.col("c.hit")))).cast("long").alias("n_hit"),
                F.sort_array(F.array_distinct(F.filter(F.col("c.item"), lambda i: i.isNotNull()))).alias("items"),
            ).dropDuplicates(["_id", "_t"]),
            "hits",
        )
    out = with_row_key(docs, id_col, text_col, id_col).select(F.col(id_col), "_id", "_t", F.size(words_of(F.col("_text"))).cast("long").alias("n_words"))
    if hits is None:
        out = out.withColumns({"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>")})
    else:
        out = out.join(small(hits, size=48 + 24 * F.size("items")), ["_id", "_t"], "left").withColumns(
            {"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))}
        )
    return out.select(
        "_id", "_t", id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        ((F.col("n_hit") > 0) & (F.col("n_hit") >= F.col("n_words") * F.lit(share))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows that are not contaminated, with all their columns."""
    found = _marked(docs, benchmark, id_col, text_col, **options).filter("contaminated")
    return without_rows(docs, found, id_col, text_col)
