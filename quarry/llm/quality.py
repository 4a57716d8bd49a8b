"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics, compiled to Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .common import SPACE_SPLIT

#: Labelled rows that are fitted on, at most; those of the least id hashes.
SAMPLE_ROWS = 20_000
_TREES, _DEPTH, _BINS = 40, 3, 24


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, all built-in expressions."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    part = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))) / n
    words = F.array_remove(F.split(t, SPACE_SPLIT), "")
    lines = F.split(t, "\n")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    n_lines = F.size(lines).cast("double")
    space = part(r"[\x20\x09-\x0D]+")
    return {
        "n_words": F.size(words).cast("double"),
        "word_length": n * (1 - space) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "words_per_line": n_words / n_lines,
        "upper": part("[A-Z]+"),
        "digit": part("[0-9]+"),
        "stop": part("[.,;:]+"),
        "mark": part("[!?]+"),
        "symbol": part(r"[#$%&*+<=>@\^_~\\/|{}\[\]]+"),
    }


@dataclass
class RuleEnsemble:
    """score = sigmoid(bias + sum of the weights of the rules that hold); a rule is a tuple of (name, above, threshold)."""

    bias: float
    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]]

    def column(self, stats: dict[str, Column]) -> Column:
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            holds = None
            for name, above, cut in rule:
                c = stats[name] > F.lit(cut) if above else stats[name] <= F.lit(cut)
                holds = c if holds is None else holds & c
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, names: list[str], x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            z += weight * _holds(rule, names, x)
        return 1 / (1 + np.exp(-z))


def _holds(rule, names: list[str], x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for name, above, cut in rule:
        v = x[:, names.index(name)]
        ok &= (v > cut) if above else (v <= cut)
    return ok


def _grow(binned, cuts, grad, names, rows, path, depth, features, out) -> None:
    """Split the rows where the squared sum of gradients gains most; every path below the root becomes a rule."""
    if path:
        out.append(tuple(path))
    if depth == 0 or len(rows) < 20:
        return
    best = (1e-9, None, None)
    g = grad[rows]
    whole, n = g.sum(), len(rows)
    for f in features:
        b = binned[rows, f]
        count = np.cumsum(np.bincount(b, minlength=_BINS + 1))[:-1]
        sums = np.cumsum(np.bincount(b, weights=g, minlength=_BINS + 1))[:-1]
        ok = (count >= 5) & (n - count >= 5)
        if ok.any():
            c, s = np.maximum(count, 1), sums
            gain = np.where(ok, s**2 / c + (whole - s) ** 2 / np.maximum(n - count, 1) - whole**2 / n, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
    _, f, k = best
    if f is None or k >= len(cuts[f]):
        return
    for above in (False, True):
        side = rows[(binned[rows, f] > k) == above]
        _grow(binned, cuts, grad, names, side, [*path, (names[f], above, float(cuts[f][k]))], depth - 1, features, out)


def fit_rules(names: list[str], x: np.ndarray, y: np.ndarray, seed: int = 1, l1: float = 3e-4, rounds: int = 400) -> RuleEnsemble:
    """Boosted shallow trees propose rules; lasso logistic regression (accelerated proximal gradient) keeps a sparse set.
    With fewer than two classes the score is the share of label 1, smoothed."""
    n, ones = len(y), float(y.sum()) if len(y) else 0.0
    prior = np.log((ones + 1) / (n - ones + 1))
    if ones in (0.0, float(n)):
        return RuleEnsemble(float(prior), [])
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, _BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    rules: list = []
    z = np.full(n, prior)
    for _ in range(_TREES):
        grad = y - 1 / (1 + np.exp(-z))
        rows = np.sort(rng.choice(n, max(min(n, 50), n // 2), replace=False))
        features = rng.choice(x.shape[1], max(2, x.shape[1] * 2 // 3), replace=False)
        found: list = []
        _grow(binned, cuts, grad, names, rows, [], _DEPTH, features, found)
        leaves = [r for r in found if not any(len(q) > len(r) and q[: len(r)] == r for q in found)]
        for r in leaves:
            ok = _holds(r, names, x)
            p = 1 / (1 + np.exp(-z[ok]))
            z[ok] += 0.4 * (y[ok] - p).sum() / ((p * (1 - p)).sum() + 1)
        rules += found
    rules = list(dict.fromkeys(rules))
    a = np.empty((n, len(rules)), dtype=np.float32)
    for k, r in enumerate(rules):
        a[:, k] = _holds(r, names, x)
    share = a.mean(axis=0)
    mixed = (share > 0) & (share < 1)
    rules, a = [r for r, ok in zip(rules, mixed, strict=True) if ok], a if mixed.all() else a[:, mixed]
    w, v, b, vb, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), prior, prior, 1.0
    # the largest eigenvalue of a'a by power iteration bounds the step
    u = np.ones(a.shape[1], dtype=np.float32)
    for _ in range(30):
        u = a.T @ (a @ (u / max(np.linalg.norm(u), 1e-12)))
    step = 4.0 / (1 + 1.05 * np.linalg.norm(u) / n)
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(a @ v.astype(np.float32) + vb))) - y
        w_new = v - step * (a.T @ r.astype(np.float32)) / n
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - step * l1, 0)
        b_new = vb - step * r.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return RuleEnsemble(float(b), [(r, float(c)) for r, c in zip(rules, w, strict=True) if abs(c) > 1e-4])


def in_fold(id_col: str, folds: int, held_out: int) -> Column:
    """crc32 of the id as text, modulo folds, equals held_out; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == held_out, F.lit(False))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS, folds: int = 3, held_out: int = 1,
) -> RuleEnsemble:
    """Fit on the labelled documents outside the held-out fold, at most ``sample_rows`` of them (by id hash)."""
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~in_fold(id_col, folds, held_out))
    chosen = chosen.select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_label_id"), "_label_id", "_y").limit(sample_rows)
    stats = statistics(F.col(text_col))
    got = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_label_id")).select("_label_id", "_y", *[c.alias(n) for n, c in stats.items()])
    pdf = got.toPandas().sort_values(["_label_id", "_y", *stats]).reset_index(drop=True)[: 2 * sample_rows]
    return fit_rules(list(stats), pdf[list(stats)].to_numpy(dtype=float), pdf["_y"].to_numpy(dtype=float))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: RuleEnsemble | None = None, **fit
) -> DataFrame:
    """The input's columns with held_out, score (0 to 1) and predicted (1 if score >= 0.5). A column of the input that has
    one of these names is replaced by the result; all others stay as they are, whatever their names.

    Only statistics of the text are inputs; texts of any length are read whole. Null text counts as empty and is scored
    as such; without labels of both classes the score is their smoothed share; a score of exactly 0.5 is label 1; an
    empty table gives no rows; repeated rows score alike.
    """
    rows = _scored(docs, labels, id_col, text_col, model, **fit)
    own = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("held_out", "score", "predicted")]
    return rows.select(*own, "held_out", "score", "predicted")


def _scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: RuleEnsemble | None = None, **fit) -> DataFrame:
    """(_row, held_out, score, predicted), where _row holds the input's columns."""
    model = model or fit_quality(docs, labels, id_col, text_col, **fit)
    stats = statistics(F.col(text_col))
    held = in_fold(id_col, fit.get("folds", 3), fit.get("held_out", 1))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), held.alias("held_out"), *[c.alias(f"_stat_{n}") for n, c in stats.items()])
    out = out.withColumn("score", model.column({n: F.col(f"_stat_{n}") for n in stats}))
    return out.select("_row", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The input's rows that score 0.5 or more, with all their columns as they are.

    A filter on the score would be pushed below the statistics, with their expressions repeated for every rule; rows are
    dropped by an explode of none or one instead, which stays above them."""
    rows = _scored(docs, labels, **options)
    once = F.explode(F.when(F.col("predicted") == 1, F.array("_row")).otherwise(F.array().cast(ArrayType(docs.schema))))
    return rows.select(once.alias("_row")).select("_row.*")
