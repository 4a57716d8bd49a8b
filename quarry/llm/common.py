"""Helpers shared by the training-data operators: shared storage, row keys, checked broadcasts, byte hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the word rules: space and the control characters 9 to 13.
SPACE_SPLIT = r"[\x20\x09-\x0D]+"
#: Rows up to which a narrow table may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 50_000
#: Bytes up to which a table of wider rows may be broadcast.
BROADCAST_BYTES = 16 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="quarry-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    return path


def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the folder belongs to it
            return


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write to the shared folder and reread: cuts lineage, survives lost executors, gives the planner a known size."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in small Arrow batches, so that a worker holds a few megabytes of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most ``rows`` rows, and, where ``size`` estimates a row's bytes, at most
    BROADCAST_BYTES of them; else df as it is, which is joined by a shuffle. Rows without ``size`` must be narrow."""
    if size is None:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= BROADCAST_BYTES else df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; pure ASCII takes the faster built-in."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """_id and _t of with_row_key."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col))), F.hash(F.col(text_col))


def with_row_key(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(_id, _t, _text[, more]): _id and _t name a row by its id and text, so that repeated ids with different texts
    stay apart and identical rows share their result. A null id is replaced by a hash of the text."""
    own_id, own_t = row_key(id_col, text_col)
    return docs.select(
        own_id.alias("_id"),
        own_t.alias("_t"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        *[F.col(c) for c in more],
    )


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs, with all its columns, without the rows that ``gone`` names by _id and _t as with_row_key does."""
    own_id, own_t = row_key(id_col, text_col)
    gone = gone.select(F.col("_id").alias("_gone_id"), F.col("_t").alias("_gone_t")).distinct()
    return docs.join(gone, (own_id == F.col("_gone_id")) & (own_t == F.col("_gone_t")), "left_anti")


# --- numpy hashing of byte strings -------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_CODE = np.random.default_rng(20240521).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("b", ())) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        for k, x in (("b", _BASE), ("i", _INV)):
            a = np.full(m, np.uint64(x), dtype=np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["b"][:n], _powers["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each 64-bit value (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class PrefixHash:
    """Polynomial hashes modulo 2**64 of any substring of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        b, self.inv = _power(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_CODE[data] * b[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inv[:n])


_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(9, 14)]] = True
LOWER_TABLE = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space-separated words of the texts in order, and where each text's words start
    (one entry more than texts)."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    sep = _SEP[data]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate([[1], 1 + np.cumsum(lengths + 1)])
    return PrefixHash(data).of(start, end), np.searchsorted(start, begins)


def chunks(sizes, most: int):
    """Consecutive index ranges whose sizes add up to at most ``most`` (a larger single item stands alone)."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)
