"""Text quality by a hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

A text's words are its white-space tokens. Features are hashed one- and two-word grams of the tokens and hashed one- to
three-word grams of their shapes (letter case, digits and punctuation, runs collapsed, and whether the token repeats
the one before); a feature's value is its share of the text's tokens, so long texts count no more than short ones. The
score is a sparse dot product: the mean weight of the grams met.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relstream.llm.common import chunks, fold, mix, steps, table, trim

#: Weights of the hashed features; the last one is the bias.
DIMS = 1 << 18
#: Labelled rows at most, smallest hash of the id first, that the model is fitted on.
TRAIN_ROWS = 8_000
#: FTRL-proximal: learning rate, its smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.01
_RUNS = re.compile(r"(.)\1+", re.S)


class _Shape(dict):
    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        self[cp] = out = "0" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c
        return out


class _Tokens(dict):
    """Token to hash of its text (high 40 bits) and of its shape (low 24), remembered for up to 100,000 tokens."""

    shape = _Shape()

    def __missing__(self, token: str) -> int:
        if len(self) > 100_000:
            self.clear()
        if len(self.shape) > 20_000:
            self.shape.clear()
        raw = token.encode("utf-8", "surrogatepass")
        form = _RUNS.sub(r"\1", token.translate(self.shape))
        h = zlib.crc32(raw) << 8 | (zlib.adler32(raw) ^ len(raw)) & 0xFF
        self[token] = out = h << 24 | zlib.crc32(form.encode("utf-8", "surrogatepass")) >> 8
        return out


_TOKENS = _Tokens({"": 0})


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all tokens (a row of five each), and each text's first row (one more entry: the end)."""
    tokens = [["", *t.split()] if t else [""] for t in texts]
    at = np.cumsum([0, *map(len, tokens)])
    packed = np.fromiter(map(_TOKENS.__getitem__, chain.from_iterable(tokens)), np.uint64, at[-1])
    word, shape = packed >> np.uint64(24), packed & np.uint64(0xFFFFFF)
    same = np.r_[False, packed[1:] == packed[:-1]]
    same[at[:-1]] = False
    shape = shape << np.uint64(1) | same
    prev = np.r_[np.uint64(0), word[:-1]]
    shape1, shape2 = np.r_[np.uint64(0), shape[:-1]], np.r_[np.zeros(2, np.uint64), shape[:-2]][: len(shape)]
    shape2[at[:-1][np.diff(at) > 1] + 1] = 0  # grams of a first token do not reach into the text before
    k = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        pairs = shape * k + shape1
        kinds = (word, word * k + prev, shape, pairs, pairs * k + shape2)
        out = np.stack([mix(x * np.uint64(8) + np.uint64(i)) & np.uint64(DIMS - 1) for i, x in enumerate(kinds)], 1)
    return out.astype(np.int32), at


def dot(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """Log-odds of quality per text."""
    out = np.full(len(texts), weights[DIMS], np.float64)
    for lo, hi in chunks(texts):
        idx, at = hashed(texts[lo:hi])
        row = np.concatenate([[0.0], np.cumsum(weights[idx].sum(1), dtype=np.float64)])
        first = at[:-1] + 1  # after the start mark
        n = at[1:] - first
        out[lo:hi] += np.where(n > 0, (row[at[1:]] - row[first]) / np.maximum(n, 1), 0.0)
    return out


def ftrl(examples: Iterator[tuple[str | None, int]]) -> np.ndarray:
    """One pass of FTRL-proximal over (text, label 0/1); memory is that of the weights and one text."""
    z, n, w = (np.zeros(DIMS + 1) for _ in range(3))
    for text, y in examples:
        idx, at = hashed([text])
        feature, count = np.unique(idx[1:], return_counts=True)
        feature, x = np.r_[feature, DIMS], np.r_[count / max(1, len(idx) - 1), 1.0]
        zf, nf = z[feature], n[feature]
        l1 = np.where(feature == DIMS, 0.0, L1)
        wf = np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((BETA + np.sqrt(nf)) / ALPHA + L2))
        g = (1 / (1 + np.exp(-np.clip(wf @ x, -30, 30))) - y) * x
        z[feature] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / ALPHA * wf
        n[feature] = nf + g * g
    l1 = np.r_[np.full(DIMS, L1), 0.0]
    np.divide(-(z - np.sign(z) * l1), (BETA + np.sqrt(n)) / ALPHA + L2, out=w, where=np.abs(z) > l1)
    return w.astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> np.ndarray:
    """Weights from up to TRAIN_ROWS labelled rows outside the held-out fold.

    The sample is taken from ``labels`` by the hash of the id and is broadcast, so no other text moves; one task reads
    it in that order, so the weights do not depend on the partitioning. Null labels are left out; without rows all
    weights are 0 and every score is a half. Repeated ids give all their pairs of text and label.
    """
    known = labels.where(fold() != 1).where(F.col(label).isin(0, 1))
    known = known.select(F.xxhash64("doc_id", F.lit(5)).alias("h"), "doc_id", F.col(label).cast("int").alias("y"))
    pick = known.orderBy("h", "doc_id", "y").limit(TRAIN_ROWS)
    sample = docs.where(fold() != 1).select("doc_id", "text").join(F.broadcast(pick), "doc_id")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = ftrl((b.column(0)[i].as_py(), b.column(1)[i].as_py()) for b in batches for i in range(b.num_rows))
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])

    one = sample.repartition(1).sortWithinPartitions("h", "doc_id", "text", "y").select("text", "y")
    got = one.mapInArrow(fit, "w binary").collect()
    return np.frombuffer(bytes(got[0][0]), np.float32) if got else np.zeros(DIMS + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with column ``out``: how likely the text is of quality 1, from 0 to 1. Null counts as the empty text,
    which gets the bias alone; texts are read whole, and equal ones get equal scores, alone or beside others; an empty
    table stays empty; a column already named ``out`` is replaced. The weights are 1 MiB and are broadcast; no rows move.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            odds = np.concatenate([dot(own, shared.value) for own in steps(texts)])
            yield pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))), pa.float64())

    return docs.withColumn(out, quality(F.col(text)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from 0.5)."""
    docs = table(spark, sf_dir, "documents")
    weights = train(docs, table(spark, sf_dir, "labels"))
    done = score(docs.select("doc_id", "text"), weights)
    return done.select(
        "doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
