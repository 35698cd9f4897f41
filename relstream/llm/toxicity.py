"""Toxicity scores from class-conditional Kneser-Ney models.

Two character 5-gram models, one of toxic and one of ordinary text, share every order below the highest: the backoff
probabilities are Kneser-Ney continuation counts pooled over both classes, so a rare expression (a stem with an ending
never seen before) is smoothed alike on both sides and only evidence of the class moves the ratio. Text is lower-cased;
its characters are taken as they are, of whatever script, so expressions spelled with digits or signs stay apart.

Counts cover every labelled training row: tasks emit summed counts of the grams they saw and Spark adds them up; the
probabilities of all orders are formed by grouping and joining that table. So the model grows with the labelled text. It
is kept as log-ratios of the grams that differ from what their context gives to unseen ones, and is broadcast up to
MODEL_ROWS of these (9 bytes each); a larger one stays a table, and groups of documents are joined to the part of it
that they need.

Scores compare length-normalised log-likelihoods of the two models over the whole text and over all windows of three
lengths; a logistic link from these to the label is fitted on a bounded sample of training rows from a hashed quarter,
whose features come from the counts of the other three quarters (cross-fitting), and its ridge is chosen by
cross-validation inside that sample. The counts of all rows then score. Held-out rows are used for nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relstream.llm.common import CHUNK_CHARS, Scratch, chunks, fold, mix, steps, table, trim

ORDER = 5
#: Bits of a character in packed grams.
BITS = 21
#: Window lengths in characters over which log-likelihoods are compared, besides the whole text.
WINDOWS = (8, 16, 32)
FEATURES = 1 + 2 * len(WINDOWS)
#: Steps of the stored log-ratios: an int8 covers +-12.7 nats.
STEP = 0.1
#: Rows of a model at most that is broadcast (9 bytes each).
MODEL_ROWS = 1 << 24
#: Documents that share one look into a model that is not broadcast.
TOGETHER = 256
#: Grams that a counting task holds before it gives them out.
HELD_GRAMS = 1 << 20
#: Rows at most, smallest hash first, on which the logistic link is fitted, and the ridges it is chosen from.
LINK_ROWS = 6000
RIDGES = (0.01, 0.1, 1.0, 10.0, 100.0)
#: Counts of a gram: toxic and ordinary, over all rows and over those outside the link's quarter.
COUNTS = ("t", "o", "rest_t", "rest_o")
_K = np.uint64(0x9E3779B97F4A7C15)


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, each preceded by ORDER-1 blanks, and each text's start (one more entry: the end)."""
    pad = " " * (ORDER - 1)
    low = [pad + t.lower() if t else pad for t in texts]
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.cumsum([0, *map(len, low)])


def grams(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 5-gram that ends at each character from the fifth on: its first three characters packed, the fourth, the fifth."""
    n = max(0, len(cp) - ORDER + 1)
    return cp[:n] << 2 * BITS | cp[1 : n + 1] << BITS | cp[2 : n + 2], cp[3 : n + 3], cp[4 : n + 4]


def key(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """64-bit hash of a gram; with c = -1, of its context."""
    with np.errstate(over="ignore"):
        return mix(mix(a) + ((b << BITS) + c + 1).astype(np.uint64) * _K)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic, link) to (a, b, c, toxic count, ordinary count, both again without the rows marked link), summed over the task."""
    parts: list[list[np.ndarray]] = []  # a, b, c, class, n; the first is summed, the rest is once it is as long

    def summed() -> list[np.ndarray]:
        a, b, c, kind, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, first, back = np.unique(key(a, b, c) + kind.astype(np.uint64) * _K, return_index=True, return_inverse=True)
        return [a[first], b[first], c[first], kind[first], np.bincount(back, n, len(first)).astype(np.int64)]

    def give() -> Iterator[pa.RecordBatch]:
        a, b, c, kind, n = summed()
        _, first, back = np.unique(key(a, b, c), return_index=True, return_inverse=True)
        by = [np.bincount(back, n * (kind == k), len(first)).astype(np.int64) for k in range(4)]
        cols = [a[first], b[first], c[first], by[1] + by[3], by[0] + by[2], by[1], by[0]]
        for i in range(0, len(first), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in cols], ["a", "b", "c", *COUNTS])

    for batch in batches:
        texts, kinds = batch.column(0).to_pylist(), [y + 2 * k for y, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        for lo, hi in chunks(texts):
            cp, at = encode(texts[lo:hi])
            inside = np.ones(len(cp), bool)  # grams that end in a text, not in the blanks before one
            inside[(at[:-1, None] + np.arange(ORDER - 1)).reshape(-1)] = False
            kind = np.repeat(np.array(kinds[lo:hi], np.int64), np.diff(at))
            own = [x[inside[ORDER - 1 :]] for x in (*grams(cp), kind[ORDER - 1 :])]
            parts.append([*own, np.ones(len(own[0]), np.int64)])
            if sum(len(p[0]) for p in parts[1:]) > max(len(parts[0][0]), CHUNK_CHARS):
                parts = [summed()]
                if len(parts[0][0]) > HELD_GRAMS:
                    yield from give()
                    parts = []
    if parts:
        yield from give()
    trim()


def count_grams(rows: DataFrame, link: Column | None = None) -> DataFrame:
    """Gram counts by class over all rows of (text, toxic 0/1): t and o, and rest_t and rest_o without the rows where ``link`` holds."""
    return (
        rows.select("text", F.col("toxic").cast("int"), (F.lit(False) if link is None else link).cast("int").alias("link"))
        .mapInArrow(count_batches, "a long, b long, c long, " + ", ".join(f"{c} long" for c in COUNTS))
        .groupBy("a", "b", "c")
        .agg(*(F.sum(c).alias(c) for c in COUNTS))
    )


def _suffix(x: Column, n: int) -> Column:
    """The last ``n`` of the characters packed in ``x``."""
    return x.bitwiseAND(F.lit((1 << BITS * n) - 1))


def _discount(one: int | None, two: int | None) -> float:
    """The absolute discount from how many counts are one and two."""
    return one / (one + 2 * (two or 0)) if one else 0.5


def _ones_and_twos(c: str) -> tuple[Column, Column]:
    return F.sum((F.col(c) == 1).cast("long")).alias(f"{c}_1"), F.sum((F.col(c) == 2).cast("long")).alias(f"{c}_2")


def shared_backoff(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(x, c, p): the Kneser-Ney probability of c after the three characters packed in x, from types pooled over both classes.

    Types (x, c, n) of orders 4 to 1 are c after the characters x and the number of its distinct left extensions.
    """
    x = F.shiftleft(_suffix(F.col("a"), 2), BITS).bitwiseOR(F.col("b"))
    levels = [scratch.cut(counts.groupBy(x.alias("x"), "c").agg(F.count(F.lit(1)).alias("n")))]
    for n in (2, 1, 0):
        levels.append(scratch.cut(levels[-1].groupBy(_suffix(F.col("x"), n).alias("x"), "c").agg(F.count(F.lit(1)).alias("n"))))
    low = None
    for n, own in enumerate(levels[::-1]):
        met = own.agg(*_ones_and_twos("n"), F.count(F.lit(1)).alias("rows")).first()
        d, w = _discount(met.n_1, met.n_2), Window.partitionBy("x")
        own = own.withColumn("total", F.sum("n").over(w)).withColumn("kinds", F.count(F.lit(1)).over(w))
        if low is None:
            below = F.lit(1.0 / (met.rows + 1))
        else:
            own = own.withColumn("y", _suffix(F.col("x"), n - 1)).join(low.select(F.col("x").alias("y"), "c", F.col("p").alias("below")), ["y", "c"])
            below = F.col("below")
        low = own.select("x", "c", ((F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("kinds") * below) / F.col("total")).alias("p"))
        low = scratch.cut(low)
    return low


def estimate(counts: DataFrame, scratch: Scratch, classes: tuple[tuple[str, str], ...] = (("t", "o"), ("rest_t", "rest_o"))) -> DataFrame:
    """Steps of log P(toxic) - log P(ordinary) of all grams (a, b, c), for each pair of count columns: stepN, and backN,
    which unseen followers of the gram's context have. A gram without counts of a pair has stepN = backN.

    The shared lower orders come from the texts of all rows, without their classes.
    """
    low = shared_backoff(counts, scratch)
    every = [c for pair in classes for c in pair]
    met = counts.agg(*(x for c in every for x in _ones_and_twos(c))).first()
    w = Window.partitionBy("a", "b")
    x = F.shiftleft(_suffix(F.col("a"), 2), BITS).bitwiseOR(F.col("b"))
    own = counts.select("a", "b", "c", x.alias("x"), *every, *(F.sum(c).over(w).alias(f"{c}_sum") for c in every), *(F.sum((F.col(c) > 0).cast("long")).over(w).alias(f"{c}_kinds") for c in every))
    own = own.join(low, ["x", "c"])
    step = lambda r: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(r / STEP))).cast("byte")

    def logs(c: str) -> tuple[Column, Column]:
        d = _discount(met[f"{c}_1"], met[f"{c}_2"])
        total = F.greatest(F.col(f"{c}_sum"), F.lit(1))
        back = F.when(F.col(f"{c}_sum") > 0, d * F.col(f"{c}_kinds") / total).otherwise(1.0)
        return F.log(F.greatest(F.greatest(F.col(c) - d, F.lit(0.0)) / total + back * F.col("p"), F.lit(1e-300))), F.log(back)

    out = []
    for i, (t, o) in enumerate(classes):
        (seen_t, back_t), (seen_o, back_o) = logs(t), logs(o)
        out += [F.when(F.col(t) + F.col(o) > 0, step(seen_t - seen_o)).otherwise(step(back_t - back_o)).alias(f"step{i}"), step(back_t - back_o).alias(f"back{i}")]
    return own.select("a", "b", "c", *out)


def log_ratios(estimated: DataFrame, i: int) -> DataFrame:
    """(a, b, c, step) of pair ``i``: the 5-grams whose step is not their context's and, with c = -1, the contexts whose unseen
    followers have one that is not 0.
    """
    own = estimated.select("a", "b", "c", F.col(f"step{i}").alias("step"), F.col(f"back{i}").alias("back"))
    contexts = own.where("back <> 0").groupBy("a", "b").agg(F.first("back").alias("step")).select("a", "b", F.lit(-1).cast("long").alias("c"), "step")
    return own.where("step <> back").drop("back").unionByName(contexts)


class Lookup:
    """Log-ratio steps by hashed gram: two sorted arrays."""

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, step: np.ndarray):
        keys = key(a, b, c)
        order = np.argsort(keys)
        self.keys, self.steps = keys[order], step[order].astype(np.int8)

    @classmethod
    def of(cls, rows: pa.Table) -> Lookup:
        return cls(*(rows.column(c).to_numpy() for c in ("a", "b", "c", "step")))

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int8), np.zeros(len(keys), bool)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.steps[i], self.keys[i] == keys

    def get(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Steps of grams; one that is not there has its context's, and 0 without that."""
        keys, first, back = np.unique(key(a, b, c), return_index=True, return_inverse=True)
        step, known = self._find(keys)
        un = first[~known]
        low, there = self._find(key(a[un], b[un], np.full(len(un), -1)))
        step = step.copy()
        step[~known] = np.where(there, low, 0)
        return step[back]


def features(texts: list[str | None], lookup: Lookup) -> np.ndarray:
    """Per text: mean log-ratio per character, then the largest window sums (their share that is the best window's and the next disjoint one's)."""
    out = np.zeros((len(texts), FEATURES), np.float64)
    for lo, hi in chunks(texts):
        cp, at = encode(texts[lo:hi])
        r = np.zeros(len(cp), np.float32)
        r[ORDER - 1 :] = lookup.get(*grams(cp))
        start, end = at[:-1] + ORDER - 1, at[1:]
        r[(at[:-1, None] + np.arange(ORDER - 1)).reshape(-1)] = 0
        cum = np.concatenate([[0.0], np.cumsum(r, dtype=np.float64)])
        out[lo:hi, 0] = (cum[end] - cum[start]) / np.maximum(end - start, 1)
        own_start = np.repeat(start, np.diff(at))
        for k, w in enumerate(WINDOWS):
            first = np.maximum(np.arange(1, len(cp) + 1) - w, own_start)  # a window never reaches into the text before
            win = cum[1:] - cum[first]
            for j, (s, e) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
                if s == e:
                    continue
                own = win[s:e]
                i = int(own.argmax())
                rest = max(own[: max(0, i - w + 1)].max(initial=0.0), own[i + w :].max(initial=0.0))
                out[lo + j, 1 + 2 * k : 3 + 2 * k] = own[i] / w, rest / w
    return out * STEP


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Newton steps of a ridge logistic regression with a free bias, which comes first."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w, reg = np.zeros(z.shape[1]), ridge * np.r_[0.0, np.ones(z.shape[1] - 1)]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(reg + 1e-6)
        w = w - np.linalg.solve(h, z.T @ (p - y) + reg * w)
    return w


def choose_ridge(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> float:
    """The ridge of RIDGES with the least log-loss over rows left out in turn by ``part``; parts must not follow labels."""
    def loss(ridge: float) -> float:
        total = 0.0
        for p in np.unique(part):
            rest, own = part != p, part == p
            w = _logistic(x[rest], y[rest], ridge)
            odds = np.clip(w[0] + x[own] @ w[1:], -30, 30)
            total += np.logaddexp(0, np.where(y[own] == 1, -odds, odds)).sum()
        return total

    return min(RIDGES, key=loss)


@dataclass
class Model:
    """Log-ratios, broadcast as ``lookup`` or as the table ``rows``, and the link: mean and scale of the features, weights (bias first)."""

    lookup: Broadcast | None
    rows: DataFrame | None
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def _held(spark: SparkSession, rows: DataFrame, scratch: Scratch) -> tuple[Broadcast | None, DataFrame | None]:
    """A model's log-ratios, broadcast if they are few enough."""
    rows = scratch.cut(rows)
    if rows.count() > MODEL_ROWS:
        return None, rows
    return spark.sparkContext.broadcast(Lookup.of(rows.toArrow())), None


def featured(docs: DataFrame, lookup: Broadcast | None, rows: DataFrame | None, text: str, out: str) -> DataFrame:
    """``docs`` with array column ``out``: the features of each text."""
    if lookup is not None:

        @F.arrow_udf("array<double>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for x in batches:
                yield pa.array([f for own in steps(x) for f in features(own, lookup.value)], pa.list_(pa.float64()))

        return docs.withColumn(out, run(F.col(f"`{text}`")))
    group = "_g" + uuid.uuid4().hex[:8]
    tagged = Scratch(docs.sparkSession, "toxicity").cut(docs.withColumn(group, F.floor(F.monotonically_increasing_id() / TOGETHER)))

    def needed(own: pa.Table) -> pa.Table:
        a, b, c = grams(encode(own.column(text).to_pylist())[0])
        _, first = np.unique(key(a, b, c), return_index=True)
        _, context = np.unique(key(a, b, c * 0 - 1), return_index=True)
        cols = np.r_[a[first], a[context]], np.r_[b[first], b[context]], np.r_[c[first], np.full(len(context), -1)]
        g = own.column(group)[0].as_py()
        return pa.table([pa.array(np.full(len(cols[0]), g)), *map(pa.array, cols)], [group, "a", "b", "c"])

    def joined(own: pa.Table, part: pa.Table) -> pa.Table:
        x = features(own.column(text).to_pylist(), Lookup.of(part))
        return own.drop_columns([group]).append_column(out, pa.array(list(x), pa.list_(pa.float64())))

    part = tagged.select(group, text).groupBy(group).applyInArrow(needed, f"{group} long, a long, b long, c long").join(rows, ["a", "b", "c"])
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    return tagged.groupBy(group).cogroup(part.groupBy(group)).applyInArrow(joined, schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fit on the labelled rows outside the held-out fold: gram counts over all of them, the link on LINK_ROWS rows of
    a hashed quarter, seen through the counts of the other three.

    Counting joins texts to labels by a merge join at any size: neither side has a bound. The link's rows are picked
    from the labels and broadcast. Rows whose label is null are left out, null and empty texts hold no gram; repeated ids
    give all their pairs of text and label. With rows of one class only, or none, every score is 0 or 1. Scores never
    see ids.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")
    known = labels.where(fold() != 1).where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("toxic"))
    mark = F.xxhash64("doc_id", F.lit(9))
    part = F.pmod(mark, F.lit(4)) == 0
    texts = docs.where(fold() != 1).select("doc_id", "text")
    counts = scratch.cut(count_grams(texts.join(known.hint("merge"), "doc_id"), part))
    estimated = scratch.cut(estimate(counts, scratch))
    lookup, rows = _held(spark, log_ratios(estimated, 1), scratch)
    pick = known.where(part).withColumn("h", mark).orderBy("h", "doc_id", "toxic").limit(LINK_ROWS)
    sample = texts.join(F.broadcast(pick), "doc_id").select("h", "toxic", "text")
    fit = featured(sample, lookup, rows, "text", "x").select("h", "toxic", "x").toArrow()
    if lookup is not None:
        lookup.destroy()
    held = _held(spark, log_ratios(estimated, 0), scratch)
    if held[0] is not None:
        scratch.clear()
    y, h = fit.column("toxic").to_numpy().astype(np.float64), fit.column("h").to_numpy()
    x = np.array(fit.column("x").to_pylist(), np.float64).reshape(len(y), FEATURES)
    order = np.lexsort((*x.T, y, h))  # sums do not depend on the order in which rows came
    x, y, h = x[order], y[order], h[order]
    if len(y) == 0 or y.min() == y.max():
        rate = float(y[0]) if len(y) else 0.0
        return Model(*held, np.zeros(FEATURES), np.ones(FEATURES), np.r_[30.0 if rate else -30.0, np.zeros(FEATURES)])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - mean) / scale
    return Model(*held, mean, scale, _logistic(z, y, choose_ridge(z, y, mix(h.view(np.uint64)) % np.uint64(5))))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with column ``out``: toxicity from 0 to 1. Null and empty texts get the score of a text without evidence.

    Texts are read whole; equal texts get equal scores, alone or beside others; an empty table stays empty. No rows move
    unless the model is too large to be broadcast. A column already named ``out`` is replaced.
    """
    name = "_x" + uuid.uuid4().hex[:8]
    w = model.weights[1:] / model.scale
    bias = float(model.weights[0] - (w * model.mean).sum())
    odds = reduce(Column.__add__, [F.get(F.col(name), i) * float(v) for i, v in enumerate(w)], F.lit(bias))
    done = featured(docs, model.lookup, model.rows, text, name)
    return done.withColumn(out, 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))).drop(name)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from 0.7)."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    done = score(docs.select("doc_id", "text"), model)
    return done.select(
        "doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
