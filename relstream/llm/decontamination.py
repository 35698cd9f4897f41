"""Benchmark decontamination by suffix arrays.

Every batch of training texts is a shard. Words become benchmark vocabulary numbers (0 for other words), and the shard's
suffix array holds all suffixes that can match a test suffix at all (those that start with as many vocabulary words as a
window has), sorted by as many words as a window has. Every test suffix is searched in it by bisection, which gives all
its places in the shard; runs of hits along a diagonal of text and item give longest verbatim matches and their places,
beyond the depth to which the array is sorted.

The benchmark is the query side. It is read in blocks of at most BLOCK_WORDS words (or one longer item), and every block
is broadcast for a pass of its own over the documents; between passes the documents lie in the shared folder. So a
benchmark of any size is searched whole, and no task holds more than one block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relstream.llm.common import Scratch, chunks, hash_words, steps, table, words

WINDOW = 13
#: Benchmark words in one broadcast block, about 80 bytes each in a worker.
BLOCK_WORDS = 1_000_000
#: Hits times items that one step of the longest-match search holds; a text with more is a step of its own.
STEP_HITS = 1 << 21


def _keys(numbers: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` words from each place as one string of big-endian numbers, so that strings sort like word sequences."""
    if not len(at):
        return np.zeros(0, f"S{4 * n}")
    rows = np.lib.stride_tricks.sliding_window_view(numbers.astype(">u4"), n)[at]
    return np.ascontiguousarray(rows).view(f"S{4 * n}").ravel()


class Windows:
    """The distinct windows of one length, sorted, and where in the items each of them lies."""

    def __init__(self, numbers: np.ndarray, at: np.ndarray, item: np.ndarray, place: np.ndarray, n: int):
        keys = _keys(numbers, at, n)
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.edges = np.r_[first, len(order)]
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)


class Block:
    """Some benchmark items: their vocabulary, and their windows by length."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        hashes, at, _ = hash_words([t for _, t in items])
        self.items = [item for item, _ in items]
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        numbers = numbers + 1
        size = np.diff(at)
        length = np.minimum(size, WINDOW)
        self.windows: dict[int, Windows] = {}
        for n in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == n)
            count = size[own] - n + 1
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            self.windows[n] = Windows(numbers, np.repeat(at[own], count) + place, np.repeat(own, count), place, n)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word hash, 0 if it is none of the benchmark's."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        i = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[i] == hashes, i + 1, 0)


def suffix_array(numbers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard's suffixes that start with ``n`` vocabulary words, sorted by these: their keys and their places."""
    if len(numbers) < n:
        return np.zeros(0, f"S{4 * n}"), np.zeros(0, np.int64)
    gaps = np.r_[0, np.cumsum(numbers == 0)]
    at = np.flatnonzero(gaps[n:] == gaps[:-n])
    keys = _keys(numbers, at, n)
    order = np.argsort(keys, kind="stable")
    return keys[order], at[order]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def search(numbers: np.ndarray, block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By window length: the places in the shard at which a test suffix was found, and which window it is."""
    for n, own in block.windows.items():
        keys, places = suffix_array(numbers, n)
        low, high = np.searchsorted(keys, own.keys, "left"), np.searchsorted(keys, own.keys, "right")
        met = np.flatnonzero(high > low)
        count = high[met] - low[met]
        yield n, places[_ranges(low[met], count)], np.repeat(met, count)


def _match(texts: list[str | None], block: Block) -> Iterator[dict]:
    """Per text: n_words, runs of hit words (flat starts and ends), items, and the longest verbatim match: words, start, item."""
    for lo, hi in chunks(texts):
        hashes, at, _ = hash_words(texts[lo:hi])
        n = hi - lo
        # a blank number between texts keeps matches inside one text
        numbers = np.zeros(len(hashes) + n, np.int64)
        numbers[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(at))] = block.number(hashes)
        first = at[:-1] + np.arange(n)
        hit = np.zeros(len(numbers) + 1, np.int32)
        items: dict[int, set[str]] = {}
        longest: dict[int, tuple[int, int, int]] = {}
        found = [(length, place, window) for length, place, window in search(numbers, block) if len(place)]
        for length, place, _ in found:
            np.add.at(hit, place, 1)
            np.add.at(hit, place + length, -1)
        for length, place, window in found:
            _items(block, length, place, window, first, items, longest)
        on = np.r_[False, np.cumsum(hit[:-1]) > 0, False]
        edge = np.flatnonzero(on[1:] != on[:-1])
        doc = np.searchsorted(first, edge, "right") - 1
        doc[1::2] = doc[0::2]
        runs: dict[int, list[int]] = {}
        for d, x in zip(doc.tolist(), (edge - first[doc]).tolist(), strict=True):
            runs.setdefault(d, []).append(x)
        for d in range(n):
            size, start, k = longest.get(d, (0, None, None))
            yield {
                "n_words": int(at[d + 1] - at[d]), "runs": runs.get(d, []), "items": sorted(items.get(d, ())),
                "longest": size, "longest_at": start, "longest_item": block.items[k] if k is not None else None,
            }


def _items(block: Block, length: int, place: np.ndarray, window: np.ndarray, first: np.ndarray, items: dict[int, set[str]], longest: dict[int, tuple[int, int, int]]) -> None:
    """Add the items of all hits of one window length to ``items``, and longer matches than are known to ``longest``.

    Hits are multiplied by the items that hold them some texts at a time.
    """
    own = block.windows[length]
    order = np.argsort(place, kind="stable")
    place, window = place[order], window[order]
    doc = np.searchsorted(first, place, "right") - 1
    count = own.edges[window + 1] - own.edges[window]
    heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    total = np.r_[0, np.cumsum(count)]
    i = 0
    while i < len(heads):
        a = heads[i]
        j = max(i + 1, int(np.searchsorted(total[np.r_[heads, len(doc)]], total[a] + STEP_HITS, "right")) - 1)
        b = heads[j] if j < len(heads) else len(doc)
        at = _ranges(own.edges[window[a:b]], count[a:b])
        p, k, x = np.repeat(place[a:b], count[a:b]), own.item[at], own.place[at]
        d = np.repeat(doc[a:b], count[a:b])
        for one in np.unique(d * len(block.items) + k).tolist():
            name = block.items[one % len(block.items)]
            if name is not None:
                items.setdefault(one // len(block.items), set()).add(name)
        for text, best in _longest(p, k, x, length, d, first).items():
            old = longest.get(text)
            if old is None or (-best[0], best[1], best[2]) < (-old[0], old[1], old[2]):
                longest[text] = best
        i = j


def _longest(place: np.ndarray, item: np.ndarray, at: np.ndarray, length: int, doc: np.ndarray, first: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """By text: the longest run of hits on one diagonal of text and item, as (words, start in the text, item); the earliest of equals."""
    order = np.lexsort((place, place - at, item))
    place, item, at, doc = place[order], item[order], at[order], doc[order]
    new = np.r_[True, (np.diff(place) != 1) | (np.diff(place - at) != 0) | (np.diff(item) != 0)]
    head = np.flatnonzero(new)
    size = np.diff(np.r_[head, len(place)]) - 1 + length
    order = np.lexsort((item[head], place[head], -size, doc[head]))
    order = order[np.r_[True, np.diff(doc[head][order]) != 0]]
    head, size = head[order], size[order]
    return {
        d: (n, p, k)
        for d, n, p, k in zip(doc[head].tolist(), size.tolist(), (place[head] - first[doc[head]]).tolist(), item[head].tolist(), strict=True)
    }


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", limit: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of about ``limit`` words, streamed to the driver one partition at a time."""
    held, size, some = [], 0, False
    for r in benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).distinct().toLocalIterator():
        n = len(words(r["t"]))
        if held and size + n > limit:
            yield Block(held)
            held, size, some = [], 0, True
        held.append((r["i"], r["t"]))
        size += n
    if held or not some:
        yield Block(held)


_MATCH = pa.struct([
    ("n_words", pa.int64()), ("runs", pa.list_(pa.int32())), ("items", pa.list_(pa.string())),
    ("longest", pa.int64()), ("longest_at", pa.int64()), ("longest_item", pa.string()),
])
_MATCH_DDL = "n_words bigint, runs array<int>, items array<string>, longest bigint, longest_at bigint, longest_item string"


def match(text: Column, shared: Broadcast) -> Column:
    """Struct (n_words, runs, items, longest, longest_at, longest_item) of a text against one broadcast block."""

    @F.arrow_udf(_MATCH_DDL)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array([r for own in steps(x) for r in _match(own, shared.value)], _MATCH)

    return run(text)


def united(parts: list[Column]) -> Column:
    """The structs of several blocks as one: runs are merged where they touch or overlap, the longest match wins."""
    if len(parts) == 1:
        return parts[0]

    @F.arrow_udf(_MATCH_DDL)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for cols in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in cols), strict=True):
                merged: list[list[int]] = []
                for a, b in sorted(p for r in row for p in zip(r["runs"][0::2], r["runs"][1::2], strict=True)):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                best = max(row, key=lambda r: (r["longest"], -(r["longest_at"] or 0)))
                out.append(best | {"runs": [x for r in merged for x in r], "items": sorted({i for r in row for i in r["items"]})})
            yield pa.array(out, _MATCH)

    return run(*parts)


def matched(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "match", limit: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with struct column ``out``: n_words, runs (hit word ranges, flat), items, and the longest
    verbatim match (longest in words, longest_at its first word, longest_item).

    Words and windows are as in ``op1_decontamination``. A null text has no words; an empty benchmark hits nothing;
    items without words have no window; an item with a null id hits but is not listed; repeated items count once; an
    empty table stays empty; a column already named ``out`` is replaced, others keep names and values. No rows of
    ``docs`` are shuffled. A benchmark of several blocks of ``limit`` words takes a pass and a written copy of ``docs``
    for each but the last one.
    """
    spark = docs.sparkSession
    found, scratch, shared = docs.drop(out), None, None
    for block in blocks(benchmark, limit=limit):
        past, shared = shared, spark.sparkContext.broadcast(block)
        own = match(F.col(text), shared)
        if past is None:
            found = found.withColumn(out, own)
            continue
        scratch = scratch or Scratch(spark, "decontamination")
        found = scratch.cut(found)
        past.destroy()
        found = found.withColumn(out, united([F.col(out), own]))
    return found


def is_contaminated(m: str = "match") -> tuple[Column, Column]:
    """(hit words, contaminated): at least one word hit, and at least a twentieth of all."""
    n_hit = F.aggregate(
        F.sequence(F.lit(0), F.floor(F.size(f"{m}.runs") / 2).cast("int")), F.lit(0).cast("long"),
        lambda s, i: s + F.coalesce(F.get(F.col(f"{m}.runs"), 2 * i + 1) - F.get(F.col(f"{m}.runs"), 2 * i), F.lit(0)),
    )
    return n_hit, (n_hit > 0) & (20 * n_hit >= F.col(f"{m}.n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the affected rows: those whose text holds a window of the benchmark, however long the text is.

    Columns stay as they are. Null, empty and wordless texts stay; repeated rows stay or go together; an empty benchmark
    removes nothing.
    """
    name = "_match_" + uuid.uuid4().hex[:8]
    found = matched(docs, benchmark, text, name)
    return found.where(is_contaminated(name)[0] == 0).drop(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest match in words and its first word."""
    found = matched(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit, bad = is_contaminated()
    return found.select(
        "doc_id", F.col("match.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("match.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("match.items"), ","), 256).alias("items_sha256"), bad.alias("contaminated"),
        F.col("match.longest").alias("longest"), F.col("match.longest_at").alias("longest_at"),
    )
