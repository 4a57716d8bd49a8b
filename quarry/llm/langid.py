"""Language identification by a small byte convolutional network trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks
from .quality import in_fold

#: Documents that are fitted on, at most; those of the least id hashes.
SAMPLE_ROWS = 4_000
#: Bytes of text that the sample holds together, at most; documents beyond are left out whole, in order of the id hash.
SAMPLE_BYTES = 64 << 20
WINDOW, EMBED, FILTERS, WIDTHS = 128, 8, 8, (2, 3, 4)
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class ByteConvNet:
    """Multi-width filters over byte embeddings, rectified, max-pooled over the window, then softmax."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # per width: (width, EMBED, FILTERS)
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def compiled(self) -> np.ndarray:
        """Per byte, its share in every filter at every offset: a convolution is then a sum of table rows."""
        return np.concatenate([self.embed @ f[k] for f in self.filters for k in range(len(f))], axis=1).astype(np.float32)

    def window_logits(self, windows: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        table = self.compiled() if table is None else table
        out = np.empty((len(windows), len(self.langs)), dtype=np.float32)
        for a in range(0, len(windows), 128):
            x = table[windows[a : a + 128]]
            pooled, at = [], 0
            for w in WIDTHS:
                z = x[:, : WINDOW - w + 1, at : at + FILTERS].copy()
                for k in range(1, w):
                    z += x[:, k : WINDOW - w + 1 + k, at + k * FILTERS : at + (k + 1) * FILTERS]
                pooled.append(z.max(axis=1))
                at += w * FILTERS
            out[a : a + 128] = np.maximum(np.concatenate(pooled, axis=1) + self.shift, 0) @ self.out + self.bias
        return out


def _windows(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All fixed-length windows of the texts (the last one padded with zeros), and where each text's begin."""
    count = np.array([max(1, -(-len(t) // WINDOW)) for t in raw], dtype=np.int64)
    data = b"".join(t.ljust(int(c) * WINDOW, b"\0") for t, c in zip(raw, count, strict=True))
    return np.frombuffer(data, dtype=np.uint8).reshape(-1, WINDOW), np.cumsum(count) - count


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], steps: int = 1200, batch: int = 96, seed: int = 3) -> ByteConvNet:
    """Adam on cross-entropy over random crops of 6 to 128 bytes, cut at any byte."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    y_all = np.array([names.index(x) for x in langs], dtype=np.int64)
    raw = [t.encode() for t in texts]
    n_out = len(WIDTHS) * FILTERS
    p = {
        "embed": rng.normal(0, 0.3, (256, EMBED)), "shift": np.zeros(n_out),
        "out": rng.normal(0, 0.2, (n_out, len(names))), "bias": np.zeros(len(names)),
        **{f"f{w}": rng.normal(0, 0.5 / np.sqrt(w), (w, EMBED, FILTERS)) for w in WIDTHS},
    }
    net = lambda: ByteConvNet(names, p["embed"], [p[f"f{w}"] for w in WIDTHS], p["shift"], p["out"], p["bias"])
    if len(names) < 2:
        return net()
    by_lang = [np.flatnonzero(y_all == k) for k in range(len(names))]
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.integers(0, len(names), batch)  # languages in equal shares
        rows = [raw[rng.choice(by_lang[k])] for k in y]
        x = np.zeros((batch, WINDOW), dtype=np.uint8)
        for i, t in enumerate(rows):
            n = int(min(len(t), WINDOW if rng.random() < 0.5 else rng.integers(6, WINDOW + 1)))
            a = int(rng.integers(0, len(t) - n + 1))
            x[i, :n] = np.frombuffer(t[a : a + n], dtype=np.uint8)
        e = p["embed"][x]
        pooled, tops = [], []
        for w in WIDTHS:
            f = p[f"f{w}"]
            z = sum(e[:, k : WINDOW - w + 1 + k] @ f[k] for k in range(w))
            tops.append(z.argmax(axis=1))
            pooled.append(np.take_along_axis(z, tops[-1][:, None], axis=1)[:, 0])
        pre = np.concatenate(pooled, axis=1) + p["shift"]
        act = np.maximum(pre, 0)
        d = _softmax(act @ p["out"] + p["bias"])
        d[np.arange(batch), y] -= 1
        d /= batch
        g = {"out": act.T @ d, "bias": d.sum(axis=0)}
        back = (d @ p["out"].T) * (pre > 0)
        g["shift"] = back.sum(axis=0)
        g_e = np.zeros_like(e)
        who = np.arange(batch)[:, None]
        for j, w in enumerate(WIDTHS):
            b, f = back[:, j * FILTERS : (j + 1) * FILTERS], p[f"f{w}"]
            gf = np.zeros_like(f)
            for k in range(w):
                seen = e[who, tops[j] + k]  # (batch, FILTERS, EMBED)
                gf[k] = np.einsum("bf,bfe->ef", b, seen)
                np.add.at(g_e, (who, tops[j] + k), b[:, :, None] * f[k].T[None])
            g[f"f{w}"] = gf
        g["embed"] = np.zeros_like(p["embed"])
        touched = np.flatnonzero(np.abs(g_e).sum(axis=2).ravel())
        np.add.at(g["embed"], x.ravel()[touched], g_e.reshape(-1, EMBED)[touched])
        rate = 0.01 * (1 - step / (steps + 1)) + 1e-4
        for k, v in g.items():
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.999 * m2[k] + 0.001 * v * v
            p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return net()


def fit_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_rows: int = SAMPLE_ROWS, folds: int = 4, held_out: int = 2, steps: int = 1200,
) -> ByteConvNet:
    """Train on documents with text and language outside the held-out fold: at most ``sample_rows``, and SAMPLE_BYTES of
    text, by id hash. Crops are drawn at any place of the whole texts."""
    known = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0) & F.col(id_col).isNotNull()
    rows = docs.filter(known & ~in_fold(id_col, folds, held_out)).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    first = rows.select("i", F.octet_length("t").alias("n")).orderBy(F.xxhash64("i"), "i").limit(sample_rows).collect()
    ids, held = set(), 0
    for r in first:
        held += r.n
        if held <= SAMPLE_BYTES:
            ids.add(r.i)
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in sorted(ids)], f"i {kind}")), "i")  # at most sample_rows
    pdf = chosen.orderBy("i", "l", "t").limit(sample_rows).toPandas()
    if not len(pdf):
        return train([], [])
    return train(pdf["t"].tolist(), pdf["l"].tolist(), steps=steps)


def _apply(model: ByteConvNet):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = model.compiled() if model.langs else None
        for df in batches:
            raw = [t.encode() if t is not None else b"" for t in df["_text"]]
            letters = np.array([t is not None and _LETTER.search(t) is not None for t in df["_text"]], dtype=bool)
            for a, b in chunks([len(t) for t in raw], 512 << 10):
                if model.langs:
                    windows, begin = _windows(raw[a:b])
                    # a padded last window counts by the bytes it holds
                    weight = np.full(len(windows), float(WINDOW))
                    ends = np.concatenate([begin[1:], [len(windows)]]) - 1
                    weight[ends] = [max(1, len(t) - (-(-len(t) // WINDOW) - 1) * WINDOW) for t in raw[a:b]]
                    prob = _softmax(model.window_logits(windows, table)) * weight[:, None]
                    prob = np.add.reduceat(prob, begin, axis=0)
                    prob /= prob.sum(axis=1, keepdims=True)
                    best, score = prob.argmax(axis=1), prob.max(axis=1)
                    lang = [model.langs[k] if ok else "und" for k, ok in zip(best, letters[a:b], strict=True)]
                    score = np.where(letters[a:b], score, 0.0)
                else:
                    lang, score = ["und"] * (b - a), np.zeros(b - a)
                yield pd.DataFrame({"_row": df["_row"].iloc[a:b].to_numpy(), "_held": df["_held"].iloc[a:b].to_numpy(), "lang_pred": lang, "score": score.astype(float)})

    return run


def identify_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: ByteConvNet | None = None, **fit
) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score.

    Every window of the whole text is scored; a text's probability is the mean over its windows, weighted by bytes.
    Texts that are null or hold no letter are "und" with score 0, as is everything when nothing could be learned.
    Of languages with equal probability the first by name is taken. Repeated rows score alike; an empty table gives no
    rows; extra columns are ignored, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    model = model or fit_language(docs, id_col, text_col, **fit)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_row"), in_fold(id_col, fit.get("folds", 4), fit.get("held_out", 2)).alias("_held"), F.col(text_col).alias("_text"))
    # the id goes through as text, so that a null stays null
    rows = rows.withColumn("_row", F.col("_row").cast("string"))
    out = rows.mapInPandas(_apply(model), "_row string, _held boolean, lang_pred string, score double")
    return out.select(F.col("_row").cast(kind).alias(id_col), F.col("_held").alias("held_out"), "lang_pred", "score")
