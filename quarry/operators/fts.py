"""Full-text index and ranked search over DataFrames.

Postings are (id, col, pos, term); lengths are (id, dl). A whole query runs as one pass over the postings of its terms:
terms meet a small literal table, phrases are rebuilt by grouping on their start, and the boolean tree becomes a filter on
per-document counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fts_query import Node, Query, QueryError, fold, near_hits, parse_query

# --- fixed values: the parameters of BM25
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
# --- end of fixed values


def _fold_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        yield pd.DataFrame({"id": df["id"], "col": df["col"], "terms": [fold(t) for t in df["text"]]})


def tokenised(corpus: DataFrame, columns: tuple[str, ...], id_col: str = "id", diacritics: bool = True) -> DataFrame:
    """(id, col, terms) per document and column. With ``diacritics`` accents are stripped (a vectorised Python leaf);
    without, tokens come from a built-in expression."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c), F.lit("")).alias("text")) for c in columns]))
    long = corpus.select(F.col(id_col).alias("id"), pairs.alias("p")).select("id", "p.col", "p.text")
    if diacritics:
        return long.mapInPandas(_fold_all, long.select("id").schema.simpleString()[7:-1].replace(":", " ", 1) + ", col string, terms array<string>")
    return long.select("id", "col", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("terms"))


def build_index(corpus: DataFrame, columns: tuple[str, ...], id_col: str = "id", diacritics: bool = True) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of a corpus."""
    t = tokenised(corpus, columns, id_col, diacritics)
    postings = t.select("id", "col", F.posexplode("terms").alias("pos", "term"))
    lengths = t.groupBy("id").agg(F.sum(F.size("terms")).cast("long").alias("dl"))
    return postings, lengths


def save_index(postings: DataFrame, lengths: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write an index in the order of its terms: a query's terms, and a prefix, then prune files and row groups by their
    minima and maxima. Very frequent terms spread over several files, as the id is part of the range."""
    ranged = postings.repartitionByRange(*([partitions] if partitions else []), "term", "id")
    ranged.sortWithinPartitions("term", "id", "col", "pos").write.mode("overwrite").parquet(f"{path}/postings")
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")


def load_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")


def refresh_index(
    postings: DataFrame, lengths: DataFrame, changed: DataFrame, removed: DataFrame, columns: tuple[str, ...], id_col: str = "id", diacritics: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The index after rows changed (new contents) and ids were removed: their postings are replaced."""
    gone = changed.select(F.col(id_col).alias("id")).unionByName(removed.select(F.col(id_col).alias("id"))).distinct()
    p, n = build_index(changed, columns, id_col, diacritics)
    return postings.join(gone, "id", "left_anti").unionByName(p), lengths.join(gone, "id", "left_anti").unionByName(n)


def phrase_hits(postings: DataFrame, query: Query) -> DataFrame:
    """(phrase, id, col, start) of every phrase of the query."""
    spark = postings.sparkSession
    exact, open_, sizes = [], [], []
    for k, p in enumerate(query.phrases):
        sizes.append((k, len(p.terms)))
        for j, t in enumerate(p.terms):
            (open_ if p.prefix and j == len(p.terms) - 1 else exact).append((k, j, t))
    found = None
    if exact:
        wanted = spark.createDataFrame(exact, "phrase int, off int, term string")
        rows = postings.filter(F.col("term").isin(sorted({t for _, _, t in exact})))
        found = rows.join(F.broadcast(wanted), "term").select("phrase", "id", "col", (F.col("pos") - F.col("off")).alias("start"), "off")
    for k, j, t in open_:
        more = postings.filter(F.col("term").startswith(t)).select(F.lit(k).alias("phrase"), "id", "col", (F.col("pos") - j).alias("start"), F.lit(j).alias("off"))
        found = more if found is None else found.unionByName(more)
    single = [k for k, n in sizes if n == 1]
    hits = found.filter(F.col("phrase").isin(single)).select("phrase", "id", "col", "start") if single else None
    many = [(k, n) for k, n in sizes if n > 1]
    if many:
        need = F.create_map(*[F.lit(x) for kn in many for x in kn])
        whole = found.filter(F.col("phrase").isin([k for k, _ in many])).groupBy("phrase", "id", "col", "start").agg(F.count(F.lit(1)).alias("n"))
        whole = whole.filter(F.col("n") == F.element_at(need, F.col("phrase"))).select("phrase", "id", "col", "start")
        hits = whole if hits is None else hits.unionByName(whole)
    keep = F.lit(False)
    for k, p in enumerate(query.phrases):
        c = F.col("phrase") == k
        if p.columns is not None:
            c = c & (F.col("col").isin(sorted(p.columns)) if p.columns else F.lit(False))
        if p.first:
            c = c & (F.col("start") == 0)
        keep = keep | c
    return hits.filter(keep)


def _near_groups(node: Node) -> list[Node]:
    return [node] if node.op == "near" else [g for c in node.children for g in _near_groups(c)]


def _near_filter(hits: DataFrame, query: Query, groups: list[Node]) -> DataFrame:
    """Keep, of the phrases of NEAR groups, only hits inside a near group."""
    sizes = [len(p.terms) for p in query.phrases]
    plans = [(g.phrases, g.distance) for g in groups]
    of = {p: k for k, (ps, _) in enumerate(plans) for p in ps}
    table = F.create_map(*[F.lit(x) for kv in of.items() for x in kv])
    near = hits.filter(F.col("phrase").isin(list(of))).withColumn("grp", F.element_at(table, F.col("phrase")))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        phrases, distance = plans[int(df["grp"].iloc[0])]
        starts = [sorted(set(df.loc[df["phrase"] == p, "start"])) for p in phrases]
        kept = near_hits(starts, [sizes[p] for p in phrases], distance) if all(starts) else [[] for _ in phrases]
        rows = [(p, s) for p, ss in zip(phrases, kept, strict=True) for s in ss]
        out = pd.DataFrame(rows, columns=["phrase", "start"])
        return out.assign(id=df["id"].iloc[0], col=df["col"].iloc[0])[["phrase", "id", "col", "start"]]

    schema = hits.select("phrase", "id", "col", "start").schema
    inside = near.groupBy("grp", "id", "col").applyInPandas(run, schema)
    return hits.filter(~F.col("phrase").isin(list(of))).select("phrase", "id", "col", "start").unionByName(inside)


def _holds(node: Node) -> Column:
    if node.op == "none":
        return F.lit(False)
    if node.op in ("phrase", "near"):
        c = F.lit(True)
        for p in node.phrases:
            c = c & (F.col(f"f{p}") > 0)
        return c
    a, b = (_holds(c) for c in node.children)
    return a & b if node.op == "and" else a | b if node.op == "or" else a & ~b


def _scored(node: Node, when: Column | None = None) -> dict[int, Column | None]:
    """The phrases that add to the score, each with the condition under which it does: a side of an OR counts only
    where that side holds, what a NOT excludes never does."""
    if node.op in ("phrase", "near"):
        return dict.fromkeys(node.phrases, when)
    if node.op == "not":
        return _scored(node.children[0], when)
    out: dict[int, Column | None] = {}
    for c in node.children:
        own = _holds(c) if node.op == "or" else None
        out |= _scored(c, when if own is None else own if when is None else when & own)
    return out


def match(postings: DataFrame, lengths: DataFrame, text: str, columns: tuple[str, ...]) -> DataFrame:
    """(id, score) of the rows that match; score is negative BM25, best first when ascending. A query that cannot be
    parsed matches nothing."""
    none = lengths.select("id", F.lit(0.0).alias("score")).limit(0)
    try:
        query = parse_query(text, columns)
    except QueryError:
        return none
    if query.root.op == "none" or not any(p.terms for p in query.phrases):
        return none
    hits = phrase_hits(postings, query)
    every = range(len(query.phrases))
    counted = lambda h: h.groupBy("id").agg(*[F.count(F.when(F.col("phrase") == k, 1)).alias(f"f{k}") for k in every])
    counts, groups = counted(hits), _near_groups(query.root)
    stats = counts.agg(*[F.count(F.when(F.col(f"f{k}") > 0, 1)).alias(f"n{k}") for k in every])
    # without a NEAR group both uses of the counts share one exchange
    rows = (counted(_near_filter(hits, query, groups)) if groups else counts).filter(_holds(query.root))
    corpus = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("avgdl"))
    rows = rows.join(lengths, "id").crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(corpus))  # one row each
    score = F.lit(0.0)
    for k, when in sorted(_scored(query.root).items()):
        n, f = F.col(f"n{k}"), F.col(f"f{k}").cast("double")
        f = f if when is None else F.when(when, f).otherwise(F.lit(0.0))
        idf = F.log((F.col("docs") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        score = score - idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.select("id", score.alias("score"))


def search(postings: DataFrame, lengths: DataFrame, text: str, columns: tuple[str, ...], limit: int = 20) -> DataFrame:
    """The best rows, (id, score, rank)."""
    top = match(postings, lengths, text, columns).orderBy("score", "id").limit(limit)
    return top
