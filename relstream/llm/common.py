"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that one vectorised step holds; a longer text is a step of its own.
CHUNK_CHARS = 1 << 19
#: A key is hot from this share of all rows on (one over it); so there are fewer hot keys than this.
HOT_KEYS = 64

#: ``bytes.translate`` table: A-Z lower-cased, a-z, 0-9 and all bytes of non-ASCII characters kept, the rest a space.
_WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the path is only ever opened by Spark's readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after lower-casing A-Z, as UTF-8. Null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_TABLE).split() if text else []


def chunks(texts: Sequence[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` that hold about ``limit`` characters each (one text at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def steps(x: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[list[str | None]]:
    """The texts of an Arrow array as lists of about ``limit`` bytes each: only one step's texts become Python strings.

    An empty array is one empty step.
    """
    size = np.cumsum(pc.fill_null(pc.binary_length(x.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(x) or not len(x):
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + limit, "right")))
        yield x.slice(start, end - start).to_pylist()
        if not len(x):
            return
        start = end
    trim()


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Give freed memory back to the system: Python workers are kept for later stages, and several share an executor."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) on a uint64 array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that all machines share: the cluster's ``spark.checkpoint.dir``.

    Where it is unset a local session takes one under its warehouse; on a cluster that is an error, as no folder is known
    to be shared there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not conf and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(conf or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return sc.getCheckpointDir()


class Scratch:
    """Tables written to the shared folder to cut lineage: they survive lost executors, and ``clear`` deletes them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.written = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame) -> DataFrame:
        """``df``, written and read back. Files hold what they hold: rows are not computed again."""
        self.written += 1
        path = f"{self.folder}/{self.written}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def hot_join(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``facts`` (one row a key, with column ``size``, the key's number of rows; ``total``: all rows).

    Keys that hold more than 1/HOT_KEYS of all rows are fewer than HOT_KEYS: they are named to the driver, their facts are
    broadcast, and their rows never meet in one task; all other rows are shuffled to a merge join at every size, as neither
    side has a bound. ``size`` is not in the result. ``how``: inner or left. Keys are not null.
    """
    hot = [r[0] for r in facts.where(F.col(size) * HOT_KEYS > F.lit(total)).select(key).collect()]
    facts = facts.drop(size)
    if not hot:
        return rows.join(facts.hint("merge"), key, how)
    often = F.col(key).isin(hot)
    return rows.where(often).join(F.broadcast(facts.where(often)), key).unionByName(rows.where(~often).join(facts.where(~often).hint("merge"), key, how))


def fold(doc_id: str = "doc_id"):
    """``crc32(doc_id as text) mod 3``; 1 is the held-out part. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


_BYTE = np.random.default_rng(1).integers(1 << 62, (1 << 63) - 1, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x5851F42D4C957F2D
_P_INVERSE = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    own = _POWERS.get(base)
    if own is None or len(own) < n:
        with np.errstate(over="ignore"):
            own = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 16), np.uint64(base))])
        if n <= 1 << 20:
            _POWERS[base] = own
    return own[:n]


def hash_words(texts: Sequence[str | None], space: bytes = _WORD_TABLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' words in order, the first word of each text (one more entry: the end), and the words' byte lengths.

    Words are those of ``words()``; another ``bytes.translate`` table gives other words. A word's hash is a polynomial
    of random numbers for its bytes, read off one running sum over all bytes, and mixed.
    """
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    buf = np.frombuffer(b" ".join([b"", *raw, b""]).translate(space), np.uint8)
    at = np.cumsum([1, *(len(r) + 1 for r in raw)])
    edge = np.flatnonzero(np.diff((buf != 32).view(np.int8)))
    first, last = edge[0::2] + 1, edge[1::2] + 1
    return hash_spans(buf, first, last), np.searchsorted(first, at), last - first


def hash_spans(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hash of each range [first, last) of the bytes ``buf``."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * _powers(_P, len(buf)))])
        return mix((total[last] - total[first]) * _powers(_P_INVERSE, max(1, len(buf)))[first] + (last - first).astype(np.uint64))
