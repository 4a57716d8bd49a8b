"""MinHash near-deduplication: banded minima, verification on full shingle sets, star-contracted components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, bounded_batches, chunks, cut, mix, small, with_row_key, without_rows, word_hashes

ROWS, BANDS, KEPT = 6, 30, 128
#: Signature agreement below which a pair is not verified: five standard deviations under the threshold.
MARGIN = 0.17
#: Documents and bytes of shingles in a tile of a loose bucket.
TILE, TILE_BYTES = 1024, 32 << 20

_rng = np.random.default_rng(7)
_MULT = _rng.integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)
_JOIN = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: k-word shingles, or the whole sequence if shorter."""
    words, at = word_hashes([t.translate(LOWER_TABLE) for t in texts])
    n = len(words)
    grams = np.zeros(max(0, n - k + 1), dtype=np.uint64)
    for j in range(k):
        grams += words[j : n - k + 1 + j] * _JOIN[j]
    grams = mix(grams)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        elif b > a:
            out.append(mix((words[a:b] * _JOIN[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, hashes) smallest values of multiply-add-shift universal hashes; sets must not be empty."""
    out = np.empty((len(sets), ROWS * BANDS), dtype=np.uint32)
    for a, b in chunks([len(s) for s in sets], 16_384):
        h = np.concatenate(sets[a:b])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[a : b - 1]])]).astype(np.int64)
        for k in range(ROWS * BANDS):
            out[a:b, k] = np.minimum.reduceat((h * _MULT[k] + _ADD[k]) >> np.uint64(32), starts)
    return out


def _i64(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64).view(np.int64)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        raw = [t.encode() for t in df["_text"]]
        for a, b in chunks([len(t) for t in raw], 512 << 10):
            sets = shingle_sets(raw[a:b])
            full = [i for i, s in enumerate(sets) if len(s)]
            m = np.zeros((b - a, ROWS * BANDS), dtype=np.uint32)
            if full:
                m[full] = minima([sets[i] for i in full])
            bands = np.zeros((b - a, BANDS), dtype=np.uint64)
            for j in range(ROWS):
                bands += m[:, j::ROWS].astype(np.uint64) * _JOIN[j]
            bands = _i64(mix(bands))
            kept = (m[:, :KEPT] & 0xFFFF).astype("<u2")
            yield pd.DataFrame(
                {
                    "_id": df["_id"].to_numpy()[a:b],
                    "_t": df["_t"].to_numpy()[a:b],
                    "nil": df["nil"].to_numpy()[a:b],
                    "n": [len(s) for s in sets],
                    "d": [hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest() for s in sets],
                    "bands": [list(x) if len(s) else [] for x, s in zip(bands, sets, strict=True)],
                    "sig": [x.tobytes() for x in kept],
                }
            )


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        raw = [t.encode() for t in df["_text"]]
        for a, b in chunks([len(t) for t in raw], 512 << 10):
            yield pd.DataFrame({"node": df["node"].to_numpy()[a:b], "shingles": [s.astype("<u8").tobytes() for s in shingle_sets(raw[a:b])]})


def _common(a: bytes, b: bytes) -> tuple[int, int]:
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return both, len(x) + len(y) - both


def _near(threshold: int):
    """Filter of pairs (a, b, sa, sb) by signature agreement."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                x = np.frombuffer(b"".join(df["sa"]), "<u2").reshape(-1, KEPT)
                y = np.frombuffer(b"".join(df["sb"]), "<u2").reshape(-1, KEPT)
                df = df[(x == y).mean(axis=1) >= threshold / 100 - MARGIN]
            yield df[["a", "b"]]

    return run


def _linked(threshold: int):
    """Filter of pairs (a, b, xa, xb) by their full sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            ok = []
            for p, q in zip(df["xa"], df["xb"], strict=True):
                both, either = _common(p, q)
                ok.append(100 * both >= threshold * either)
            yield df.loc[ok, ["a", "b"]]

    return run


def _tile(threshold: int):
    """Links that join further components inside one tile: every pair of the tile that is not yet connected is compared,
    first by signature, then by its full sets; a link found connects the two sides, so joined sides are not compared."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("node").drop_duplicates("node")
        node, comp = df["node"].to_numpy(), df["comp"].to_numpy().copy()
        sig = np.frombuffer(b"".join(df["sig"]), "<u2").reshape(-1, KEPT)
        sets = df["shingles"].tolist()
        n = df["n"].to_numpy()
        links = []
        for i in range(len(node) - 1):
            rest = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
            rest = rest[(100 * np.minimum(n[rest], n[i]) >= threshold * np.maximum(n[rest], n[i]))]
            rest = rest[(sig[rest] == sig[i]).mean(axis=1) >= threshold / 100 - MARGIN] if len(rest) else rest
            for j in rest:
                if comp[j] != comp[i]:
                    both, either = _common(sets[i], sets[j])
                    if 100 * both >= threshold * either:
                        links.append((node[i], node[j]))
                        comp[comp == comp[j]] = comp[i]
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b): alternating large-star and small-star until only stars are left,
    which is seen by one count per node. Minima are aggregated and joined back, so no neighbourhood is gathered in one
    task. The joins are merges at every size: a hash table per join and round would pile up in the driver."""
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = both.hint("merge").join(low, "u")
        if large:  # neighbours above u point to the smallest of the neighbourhood
            return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        moved = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()

    def settled(e: DataFrame) -> bool:
        """Every node has one edge down or none, and no node has edges of both kinds."""
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("down")))
        return not ends.groupBy("node").agg(F.sum("down").alias("n"), F.min("down").alias("least")).filter("n > least").limit(1).count()

    while not settled(e):  # each round lowers labels
        e = cut(star(star(e, True), False), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 85) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Words are runs without white space, A-Z lower-cased; a document's set holds its distinct five-word shingles (the
    whole sequence if it has fewer words). Two documents are linked if 100 * intersection >= threshold * union on the
    full sets; component_id is the smallest id reachable.

    Documents whose full sorted sets have the same 128-bit BLAKE2 digest are one class before anything is compared; a
    class, not an id, is a node, so different texts under one id stay apart. Class representatives meet in the buckets
    of 30 bands of 6 minima (a pair at 0.85 is missed once in a million). In each bucket all compare with one member;
    what that leaves unconnected is compared in tiles of bounded rows and bytes. Components come from alternating
    large-star and small-star rounds.

    Null and empty texts have an empty set and are linked with nothing. A null id counts as larger
    than all others; a component without ids is named by a hash of a text. Repeated rows share a class and so a component. An empty table gives no rows; extra columns are ignored,
    whatever their names.
    """
    return _grouped(docs, id_col, text_col, threshold).drop("_id", "_t", "stays")


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: int) -> DataFrame:
    """The result of near_dedup with the key of each row, _id and _t."""
    bounded_batches(docs.sparkSession)
    base = with_row_key(docs, id_col, text_col, id_col).withColumn("nil", F.col(id_col).isNull()).select("_id", "_t", "_text", "nil")
    signed = cut(base.mapInPandas(_sign, "_id long, _t int, nil boolean, n long, d binary, bands array<long>, sig binary"), "signed")
    first_row = F.min(F.struct("nil", "_id", "_t", "bands", "sig")).alias("r")
    classes = signed.filter("n > 0").groupBy("d", "n").agg(first_row)
    # numbered as they are written: the table, not a plan, holds the numbers
    reps = cut(classes.select(F.monotonically_increasing_id().alias("node"), "d", "n", "r.*"), "reps")
    slots = reps.select("node", "n", F.posexplode("bands").alias("band", "bh"))
    centres = slots.groupBy("band", "bh").agg(F.min(F.struct("node", "n")).alias("c"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("mass"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).filter("size > 1")
    met = cut(slots.join(centres, ["band", "bh"]), "buckets")
    stars = met.filter(
        (F.col("node") != F.col("c.node"))
        & (F.lit(100) * F.least("n", "c.n") >= F.lit(threshold) * F.greatest("n", "c.n"))
    ).select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()
    sig = reps.select("node", "sig")
    pairs = stars.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").mapInPandas(_near(threshold), "a long, b long")
    pairs = cut(pairs, "pairs")
    # full sets of the documents that meet others
    needed = small(met.select("node").distinct().join(reps.select("node", "_id", "_t"), "node"))
    needed = base.join(needed, ["_id", "_t"]).select("node", "_text")
    sets = cut(needed.mapInPandas(_sets, "node long, shingles binary"), "sets").dropDuplicates(["node"])
    links = cut(
        pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b").mapInPandas(_linked(threshold), "a long, b long"), "links"
    )
    first = cut(components(links), "components")
    # buckets in which the stars left more than one component; equal buckets of several bands count once
    whole = met.join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = whole.groupBy("band", "bh").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("band", "bh")
    rest = cut(whole.join(open_, ["band", "bh"]), "open")
    once = rest.groupBy("who", "size").agg(F.min(F.struct("band", "bh")).alias("b")).select(F.col("b.band").alias("band"), F.col("b.bh").alias("bh"))
    rest = rest.join(once, ["band", "bh"]).withColumn(
        "parts", F.ceil(F.greatest(F.col("size") / F.lit(TILE // 2), F.col("mass") * 8 / F.lit(TILE_BYTES // 2))).cast("int")
    )
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")
    rest = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = rest.select("band", "bh", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", "n", "comp")
    two = tiles.groupBy("band", "bh", "p", "q").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").drop("lo", "hi")
    tiles = tiles.join(two, ["band", "bh", "p", "q"]).join(sig, "node").join(sets, "node")
    more = cut(tiles.groupBy("band", "bh", "p", "q").applyInPandas(_tile(threshold), "a long, b long"), "links")
    stars = first.select(F.col("node").alias("a"), F.col("comp").alias("b"))
    final = components(stars.unionByName(more)) if more.limit(1).count() else first
    # the smallest row of each component stands for it
    heads = final.join(reps.select("node", "nil", "_id", "_t"), "node").groupBy("comp").agg(F.min(F.struct("nil", "_id", "_t")).alias("head"))
    headed = final.join(heads, "comp").select("node", "head")
    named = cut(reps.join(headed, "node", "left").select("d", F.coalesce("head", F.struct("nil", "_id", "_t")).alias("head")), "named")
    by_row = signed.select("nil", "_id", "_t", "n", "d").dropDuplicates(["_id", "_t"]).join(named, "d", "left")
    own = F.struct("_id", "_t")
    by_row = by_row.select("_id", "_t", F.col("n").alias("n_shingles"), F.when(F.col("head").isNull(), own).otherwise(F.struct("head._id", "head._t")).alias("head"))
    rows = with_row_key(docs, id_col, text_col, id_col).select(F.col(id_col), "_id", "_t").join(by_row, ["_id", "_t"])
    return rows.select(
        "_id", "_t", F.col(id_col), "n_shingles", F.col("head._id").alias("component_id"),
        (F.col("_id") == F.col("head._id")).alias("kept"), (own == F.col("head")).alias("stays"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 85) -> DataFrame:
    """The input's rows that stay, with all their columns: of each component the one of the smallest id (of several
    texts under that id, one; rows that repeat both id and text stay together)."""
    gone = _grouped(docs, id_col, text_col, threshold).filter(~F.col("stays"))
    return without_rows(docs, gone, id_col, text_col)
