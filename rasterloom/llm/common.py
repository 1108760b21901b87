"""What the text operators share: reading tables, lineage cuts and vectorised hashing of words."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93 | 1
_STEP_INV = pow(_STEP, -1, 1 << 64)
_BYTES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What parts alphanumeric words: every ASCII byte but letters and digits.
PUNCTUATED = np.ones(256, dtype=bool)
PUNCTUATED[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

#: The separators of a word, for Java's regular expressions.
SPACES = r"[\x20\x09-\x0D]+"

_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir, else the context's own.

    Where neither is set, one is made up, but only on a local master: on a cluster a folder of
    one machine would lose what is written with that machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
        at = tempfile.mkdtemp(prefix="rasterloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that the cluster shares."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


_written: list[tuple[SparkSession, str]] = []


def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001, PERF203  the session has gone, and its folder is the cluster's to clear
            pass


def written(df: DataFrame, path: str) -> DataFrame:
    """The same rows, written to a Parquet table and read again; the table is removed when Python ends."""
    if not _written:
        atexit.register(_remove_written)
    _written.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the folder that the cluster shares.

    Cuts the lineage like checkpointed(), in compressed columns. The shuffle files that led to
    the table are let go at once, so that disk holds one step's shuffles and not all steps'."""
    spark = df.sparkSession
    out = written(df, f"{shared_folder(spark)}/rasterloom-{uuid.uuid4().hex}")
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def powers(step: int, n: int) -> np.ndarray:
    """1, step, step^2, ... modulo 2^64, at least n of them."""
    have = _powers.get(step)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), step, dtype=U64)
        out[0] = 1
        have = np.cumprod(out, dtype=U64)
        if n <= 1 << 22:
            _powers[step] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that the low and high bits depend on all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Words:
    """The words of some documents: hashes, and where each document's and word's bytes lie.

    code: 64-bit hash of each word; first: index of each document's first word, with the
    total appended; begin, end: byte positions of each word in buf."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False, blanks: np.ndarray = _SPACE):
        self.buf = _LOWER[buf] if lower else buf
        blank = blanks[buf]
        n = len(buf)
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        before = np.ones(n, dtype=bool)
        before[1:] = blank[:-1]
        self.begin = np.flatnonzero(~blank & (before | cut[:-1]))
        after = np.ones(n, dtype=bool)
        after[:-1] = blank[1:]
        self.end = np.flatnonzero(~blank & (after | cut[1:])) + 1
        self.first = np.searchsorted(self.begin, offsets)
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum(_BYTES[self.buf] * powers(_BASE, n), out=total[1:])
        code = (total[self.end] - total[self.begin]) * powers(_BASE_INV, n + 1)[self.begin]
        self.code = mixed(code + (self.end - self.begin).astype(U64))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of every k consecutive words, across documents too."""
        n = len(self.code)
        if n < k:
            return np.zeros(0, dtype=U64)
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum(self.code * powers(_STEP, n), out=total[1:])
        return mixed((total[k:] - total[:-k]) * powers(_STEP_INV, n - k + 1))


def text_slices(text: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of a string column, about `most` bytes at a time.

    A row is never cut: one longer than `most` comes alone, whole."""
    if pa.types.is_large_string(text.type):
        kind = np.int64
    else:
        text, kind = text.cast(pa.string()), np.int32
    if len(text) == 0:
        return
    _, where, data = text.buffers()
    offsets = np.frombuffer(where, dtype=kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        to = min(to, len(text))
        yield at, to, whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64, copy=False).view(np.int64)


def spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... length[0] of them, then those of begin[1], and so on."""
    if len(begin) == 0:
        return np.zeros(0, dtype=np.int64)
    total = np.cumsum(length)
    return np.arange(total[-1]) + np.repeat(begin - (total - length), length)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b): component is the smallest node reachable.

    Labels spread over the edges and are then followed to their own label, so that a chain
    takes a number of rounds that grows with its length's logarithm. All state stays in
    checkpointed tables; the driver sees one count a round."""
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        spread = spread.join(jump, "component", "left").select("node", "old", F.least("component", "further").alias("component"))
        spread = checkpointed(spread)
        changed = spread.filter("old <> component").limit(1).count()
        labels = spread.select("node", "component")
        if not changed:
            return labels
