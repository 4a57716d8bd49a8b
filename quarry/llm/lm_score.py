"""Cross-entropy difference scoring with matched target and background bigram models over the whole corpus."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, bounded_batches, chunks, cut, mix, new_path, small, word_hashes
from .warc import _open

#: Weight of the bigram estimate, and what every word of the vocabulary gets in the unigram estimate.
LAMBDA, ALPHA = 0.5, 0.5
#: Bytes of text in a block (documents that are counted and scored together), and of all texts in a slice of the keys.
BLOCK_BYTES = SLICE_BYTES = 16 << 20
_CHUNK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Stands before the first word of a text, and after the last.
_EDGE = np.uint64(0x5851F42D4C957F2D)
_PREVIOUS, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_WORDS, _PAIRS, _TOTALS = 0, 1, -1
_SENT = "kind int, slice long, block long, counts binary"
_MERGED = _SENT + ", t long, n long, kinds long"


# --- counts as bytes -----------------------------------------------------------------------------------------------


def _packed(first: np.ndarray, counts: np.ndarray) -> bytes:
    """Some bytes, and counts (2, n) in as few bytes each as the largest takes, compressed."""
    kind = np.min_scalar_type(int(counts.max()) if counts.size else 0).newbyteorder("<")
    body = first.tobytes() + counts.astype(kind).tobytes()
    head = b"".join(x.to_bytes(6, "little") for x in (first.size, counts.shape[1], kind.itemsize))
    return head + pa.Codec("zstd", 1).compress(body, asbytes=True)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, n, width = (int.from_bytes(blob[k : k + 6], "little") for k in (0, 6, 12))
    body = pa.Codec("zstd").decompress(blob[18:], size + 2 * n * width, asbytes=True)
    return np.frombuffer(body, dtype=np.uint8, count=size), np.frombuffer(body, dtype=f"<u{width}", offset=size).reshape(2, n).astype(np.int64)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted different keys with their counts, (2, keys) for target and all: the steps between keys as byte planes."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return _packed(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T), counts)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes, counts = _unpacked(blob)
    steps = planes.reshape(8, -1).T.copy().view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64), counts


def pack_some(mask: np.ndarray, counts: np.ndarray) -> bytes:
    """Counts (2, marked) of the marked keys of a block that has the keys itself."""
    return _packed(np.packbits(mask), counts)


def unpack_some(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The places of the marked keys, and their counts."""
    bits, counts = _unpacked(blob)
    return np.flatnonzero(np.unpackbits(bits)), counts


# --- one block of documents ----------------------------------------------------------------------------------------


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A long text, cut at white space."""
    at = 0
    while len(raw) - at > _CHUNK:
        found = _SPACE.search(raw, at + _CHUNK)
        end = found.start() if found else len(raw)
        yield raw[at:end]
        at = end
    yield raw[at:]


class Block:
    """The words of some texts in a row, and the words and pairs that differ among them, counted."""

    def __init__(self, texts: list[str], target: np.ndarray):
        raw = [t.encode().translate(LOWER_TABLE) for t in texts]
        words, self.size = [np.zeros(0, dtype=np.uint64)], np.zeros(len(raw), dtype=np.int64)
        for a, b in chunks([len(t) for t in raw], _CHUNK):
            for part in _pieces(raw[a]) if b - a == 1 else ():
                found, at = word_hashes([part])
                words.append(found)
                self.size[a] += len(found)
            if b - a > 1:
                found, at = word_hashes(raw[a:b])
                words.append(found)
                self.size[a:b] = np.diff(at)
        flat = np.concatenate(words)
        self.target = np.asarray(target, dtype=bool)
        self.end = np.cumsum(self.size)
        full = self.size > 0
        self.doc = np.repeat(np.arange(len(raw), dtype=np.int32), self.size)
        first = (self.end - self.size)[full]
        before = np.empty_like(flat)
        before[1:] = flat[:-1]
        before[first] = _EDGE
        flags = self.target[self.doc]
        edges = np.full(int(full.sum()), _EDGE)
        # an edge closes each text: what follows a word adds up to how often it occurs
        pairs = mix(np.concatenate([before * _PREVIOUS + flat * _WORD, flat[self.end[full] - 1] * _PREVIOUS + edges * _WORD]))
        marks = np.concatenate([flags, self.target[full]])
        self.words, at, self.word_counts = _counted(np.concatenate([flat, edges]), marks)
        self.word = at[: len(flat)]
        self.pairs, at, self.pair_counts = _counted(pairs, marks)
        self.pair = at[: len(flat)]
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        self.before[first] = np.searchsorted(self.words, _EDGE)

    def keyed(self) -> tuple[tuple[int, np.ndarray, np.ndarray], ...]:
        return (_WORDS, self.words, self.word_counts), (_PAIRS, self.pairs, self.pair_counts)

    def own(self, at: np.ndarray, kinds: int) -> np.ndarray:
        """For each word, how often its document has what is at its place."""
        _, back, n = np.unique(self.doc.astype(np.int64) * kinds + at, return_inverse=True, return_counts=True)
        return n[back]

    def losses(self, totals: np.ndarray, kinds: int) -> list[np.ndarray]:
        """Mean bits per word of each text under both models, each without the text's own counts. totals: all words and
        edges of target and background; kinds: words that differ, with the edge."""
        own_word, own_pair = self.own(self.word, len(self.words)), self.own(self.pair, len(self.pairs))
        own_before = np.empty_like(own_word)
        own_before[1:] = own_word[:-1]
        own_before[(self.end - self.size)[self.size > 0]] = 1
        out = []
        for m in (0, 1):
            mine = self.target if m == 0 else np.ones(len(self.target), dtype=bool)
            here = mine[self.doc]
            word = self.word_counts[m][self.word] - own_word * here
            before = self.word_counts[m][self.before] - own_before * here
            pair = self.pair_counts[m][self.pair] - own_pair * here
            every = (totals[m] - (self.size + 1) * mine)[self.doc]
            single = (word + ALPHA) / (every + ALPHA * kinds)
            p = np.where(before > 0, LAMBDA * pair / np.maximum(before, 1) + (1 - LAMBDA) * single, single)
            bits, full = np.zeros(len(self.size)), self.size > 0
            if len(p):  # each text is summed by itself, wherever it stands in the block
                bits[full] = np.add.reduceat(-np.log2(p), (self.end - self.size)[full])
            out.append(bits / np.maximum(self.size, 1))
        return out


def _counted(keys: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, the place of each key, and (2, different) counts of target and all."""
    kinds, at = np.unique(keys, return_inverse=True)
    n = np.bincount(at, minlength=len(kinds))
    t = np.bincount(at[target], minlength=len(kinds))
    return kinds, at.astype(np.int32), np.stack([t, n])


# --- stages --------------------------------------------------------------------------------------------------------


def _blocks(size: int) -> Callable:
    """Number the blocks of a task: its documents in order, ``size`` bytes of text each (a longer one stands alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = 0, 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("_text")).to_pylist()
            own = np.empty(len(sizes), dtype=np.int64)
            for i, n in enumerate(sizes):
                if held and held + n > size:
                    block, held = block + 1, 0
                held += n
                own[i] = block
            part = batch.column("_part").to_numpy().astype(np.int64)
            columns = [batch.column(c) for c in ("_row", "_text", "target")] + [pa.array(part << 32 | own), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "_text", "target", "block", "n_bytes"])

    return run


def _whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of each block; they come one after another."""
    held, at_block = [], None
    for df in batches:
        block = df["block"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(df)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                if held and block[a] != at_block:
                    yield at_block, pd.concat(held, ignore_index=True)
                    held = []
                at_block = int(block[a])
                held.append(df.iloc[a:b])
    if held:
        yield at_block, pd.concat(held, ignore_index=True)


def _cuts(keys: np.ndarray, slices: int) -> np.ndarray:
    """Where each slice of the sorted keys begins, and the end: slices are equal ranges of the hash."""
    edges = np.array([(i << 64) // slices for i in range(1, slices)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _count(slices: int) -> Callable:
    """The counts of each block, cut into slices of the keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for at_block, df in _whole_blocks(batches):
            for kind, keys, counts in Block(df["_text"].tolist(), df["target"].to_numpy()).keyed():
                at = _cuts(keys, slices)
                rows = [(kind, s, at_block, pack(keys[a:b], counts[:, a:b])) for s, (a, b) in enumerate(zip(at, at[1:])) if b > a]
                if rows:
                    yield pd.DataFrame(rows, columns=["kind", "slice", "block", "counts"])

    return run


def _merge(df: pd.DataFrame) -> pd.DataFrame:
    """One slice: each block gets the sums of those of its keys that other blocks have too (of the others it has all).
    Words also give a row of totals: all words of target and background, and how many differ."""
    found = [unpack(x) for x in df["counts"]]
    kind, at_slice = int(df["kind"].iloc[0]), int(df["slice"].iloc[0])
    edges = np.cumsum([0, *(len(k) for k, _ in found)])
    keys, counts = np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found], axis=1)
    del found
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sums = np.add.reduceat(counts[:, order], heads, axis=1)
    times = np.diff(np.append(heads, len(keys)))
    which = np.empty(len(keys), dtype=np.int64)
    which[order] = np.repeat(np.arange(len(heads)), times)
    rows = []
    for block, a, b in zip(df["block"].tolist(), edges, edges[1:]):
        own = which[a:b]
        shared = times[own] > 1
        if shared.any():
            rows.append((kind, at_slice, block, pack_some(shared, sums[:, own[shared]]), 0, 0, 0))
    if kind == _WORDS:
        rows.append((kind, at_slice, _TOTALS, b"", *sums.sum(axis=1).tolist(), len(heads)))
    return pd.DataFrame(rows, columns=["kind", "slice", "block", "counts", "t", "n", "kinds"])


def _read(folder: str, block: int) -> pd.DataFrame | None:
    """The rows that belong to a block, or None if there are none."""
    store, base = _open(f"{folder}/block={block}")
    if store.get_file_info(base).type == fs.FileType.NotFound:
        return None
    return pq.read_table(base, filesystem=store, partitioning=None, use_threads=False).to_pandas()


def _score(folder: str, slices: int, totals: np.ndarray, kinds: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for at_block, df in _whole_blocks(batches):
            block = Block(df["_text"].tolist(), df["target"].to_numpy())
            found = _read(folder, at_block)
            begin = {kind: _cuts(keys, slices) for kind, keys, _ in block.keyed()}
            for kind, k, blob in () if found is None else zip(found["kind"], found["slice"], found["counts"], strict=True):
                at, counts = unpack_some(blob)
                into = block.word_counts if kind == _WORDS else block.pair_counts
                into[:, begin[kind][k] + at] = counts
            t, n = block.losses(totals, kinds)
            yield pd.DataFrame({"_row": df["_row"].to_numpy(), "n_tokens": block.size, "target_bits": t, "background_bits": n})

    return run


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score all documents against the target set, the documents whose ids are in ``targets``. One row per input row:
    id, n_tokens, target_bits, background_bits (mean loss per token), score = their difference: the lower, the more
    like the target.

    Both models are bigrams interpolated with unigrams over one vocabulary: every word of the corpus. They count every
    word and pair of all documents, those that occur once too. A text is scored without its own counts, so a text that
    occurs again is known to the models, and one that does not is not known from itself.

    Documents are dealt to blocks of bounded size, which count their words and pairs. Counts travel as compressed
    slices of the sorted keys; each slice is summed over the blocks in a task, and every block gets back which of its keys
    another block has too, with their sums. So a task holds the part of the models that its block uses, a
    frequent word or pair is one entry per block, and the driver gets one row of totals.

    Null and empty texts have no tokens and all values 0. Without targets the target model is uniform over the
    vocabulary. A null id is in no target. Repeated rows are counted as often as they occur and score alike; an empty
    table gives no rows; extra columns are ignored, whatever their names; long texts are read whole.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    ids = small(targets.select(F.col(id_col).alias("_target_id")).filter(F.col("_target_id").isNotNull()).distinct(), 200_000)
    marked = docs.join(ids, F.col(id_col) == F.col("_target_id"), "left")
    rows = marked.select(
        F.col(id_col).cast("string").alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col("_target_id").isNotNull().alias("target"), F.spark_partition_id().alias("_part")
    )
    # written once, so that both passes see the same blocks
    texts = cut(rows.mapInArrow(_blocks(BLOCK_BYTES), "_row string, _text string, target boolean, block long, n_bytes long"), "texts")
    slices = max(1, math.ceil((texts.agg(F.sum("n_bytes")).first()[0] or 0) / SLICE_BYTES))
    sent = texts.select("_text", "target", "block").mapInPandas(_count(slices), _SENT)
    folder = new_path(spark, "counts")
    merged = sent.groupBy("kind", "slice").applyInPandas(_merge, _MERGED).repartition("block")
    merged.write.option("compression", "none").partitionBy("block").parquet(folder)
    sums = spark.read.schema(_MERGED).parquet(folder).filter(F.col("block") == _TOTALS).agg(F.sum("t"), F.sum("n"), F.sum("kinds")).first()
    totals, kinds = np.array([sums[0] or 0, sums[1] or 0], dtype=np.int64), sums[2] or 0
    out = texts.select("_row", "_text", "target", "block").mapInPandas(_score(folder, slices, totals, kinds), "_row string, n_tokens long, target_bits double, background_bits double")
    return out.select(F.col("_row").cast(kind).alias(id_col), "n_tokens", "target_bits", "background_bits", (F.col("target_bits") - F.col("background_bits")).alias("score"))
