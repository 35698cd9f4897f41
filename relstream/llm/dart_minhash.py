"""Near-duplicate detection by DartMinHash over five-word shingles.

Every element of a weighted set owns a region as wide as its weight. Darts (hashes, one per unit cell on average) fall
into the regions at pseudo-random ranks, the same for the same element in every document. A document looks at the
darts below a rank limit set from its total weight, so about ``k ln k + 2k`` darts are seen whatever its length, and
keeps the earliest dart of each of ``k`` coordinates; two documents share a coordinate with probability equal to the
weighted Jaccard similarity of their sets. Bands of coordinates make buckets; candidates from buckets are verified on
the exact shingle sets.

Plan: exact copies (same words) collapse first, in a partially aggregated group-by. Candidates are documents that meet in
a bucket. First every document goes to one star: the centre is the least document of the bucket group it meets most. A
star is dealt to blocks of bounded size, each with a copy of the centre; a block's shingle sets are intersected all at
once by matrix products, and only a spanning forest of its verified links leaves the task, at most one link a block to
the centre. Components of verified links are found by contracting edges to the least neighbour. Then every bucket whose
members are still in several components is settled: its members outside the bucket's largest component meet all its
members, again in blocks, so that no pair that shares a bucket stays undecided unless its two ends are linked anyway.
Buckets never join up: what is compared follows from shared buckets and verified links alone.

No table of this plan has a bound but those of hot keys, so all other joins are merge joins at every size: Spark would
choose by the size of a table's files, and equal values take next to no room in these, so a broadcast could fill the driver.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relstream.llm.common import Scratch, chunks, hash_words, hot_join, mix, steps, table, trim

SHINGLE = 5
THRESHOLD = 0.8
#: Bands times rows a band; at similarity 0.8 a pair meets in some band but for 2.2 in 10,000 cases.
BANDS, ROWS = 16, 4
#: Members and shingles of a block at most, on average.
BLOCK_DOCS, BLOCK_SHINGLES = 96, 1 << 16
#: Characters whose darts are thrown together: some thousand bytes for each short text.
SKETCH_CHARS = 1 << 17
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_K = np.uint64(0x9E3779B97F4A7C15)
_POISSON = [np.uint64(int(sum(math.exp(-1) / math.factorial(i) for i in range(j + 1)) * (1 << 64)) - 1) for j in range(9)]


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Shingle hashes of all texts in order, repeats kept, each text's first (one more entry: the end), and the texts' keys.

    A text of fewer words than ``size``, but not none, has one shingle of all its words. Keys are equal for texts of the
    same words; texts without words have equal keys only if identical.
    """
    h, at, _ = hash_words(texts)
    n = np.diff(at)
    keys = [
        hashlib.md5(h[a:b].tobytes() if a < b else b"\0" + (t or "").encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
        for t, a, b in zip(texts, at[:-1], at[1:], strict=True)
    ]
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    start = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(at[:-1] - start[:-1], count) + np.arange(start[-1])
    with np.errstate(over="ignore"):
        full = np.full(max(0, len(h) - size + 1), size, np.uint64)
        for k in range(size):
            full *= _K
            full += h[k : k + len(full)]
        short = np.flatnonzero((n > 0) & (n < size))
        out = full[np.minimum(first, max(0, len(full) - 1))] if len(full) else np.zeros(len(first), np.uint64)
        if len(short):
            few = n[short]
            x = few.astype(np.uint64)
            for k in range(size - 1):
                x = np.where(k < few, x * _K + h[np.minimum(at[short] + k, len(h) - 1)], x)
            out[start[short]] = x
    return mix(out), start, keys


def signatures(element: np.ndarray, weight: np.ndarray | None, start: np.ndarray, k: int) -> np.ndarray:
    """DartMinHash: ``k`` earliest dart ranks of each weighted set; an empty set has none (all ones).

    ``weight`` None means 1 each; then repeats of an element change nothing.
    """
    docs = len(start) - 1
    out = np.full((docs, k), _NONE)
    size = np.diff(start)
    w = np.ones(len(element)) if weight is None else weight
    total = np.add.reduceat(np.r_[w, 0.0], start[:-1]) if docs else np.zeros(0)
    limit = (k * math.log(k) + 2 * k) / np.maximum(np.where(size > 0, total, 1.0), 1e-9)
    long = (size > 0) & (limit <= 1) & (weight is None)
    todo = [np.flatnonzero(long), np.flatnonzero((size > 0) & ~long)]
    while any(map(len, todo)):
        for own in filter(len, todo):
            _throw(element, weight, start, limit, own, k, out)
        again = [t[(out[t] == _NONE).any(1)] for t in todo]
        limit[np.concatenate(again)] *= 2
        todo = [again[0][:0], np.concatenate(again)]
    return out


def _throw(element: np.ndarray, weight: np.ndarray | None, start: np.ndarray, limit: np.ndarray, docs: np.ndarray, k: int, out: np.ndarray) -> None:
    """Throw the darts of ``docs`` below their rank limits and keep the earliest of each coordinate in ``out``."""
    n = start[docs + 1] - start[docs]
    at = np.repeat(start[docs] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    own = np.repeat(docs, n)
    most = np.repeat(np.minimum(limit[docs] * 2.0**40, 2.0**62).astype(np.uint64), n)
    x, low, across = element[at], None, None
    with np.errstate(over="ignore"):
        if weight is not None or limit[docs].max() > 1:
            high = np.repeat(np.ceil(limit[docs]).astype(np.int32), n)
            wide = np.ones(len(at), np.int32) if weight is None else np.ceil(weight[at]).astype(np.int32)
            cells = (wide * high).astype(np.int64)
            i = np.repeat(np.arange(len(at), dtype=np.int32), cells)
            up = (np.arange(len(i)) - np.repeat(np.cumsum(cells) - cells, cells)).astype(np.int32)
            x = x[i]
            if weight is not None:
                across = up // high[i]
                up -= across * high[i]
                x += mix(across.astype(np.uint64))
            low = up.astype(np.uint64)
            x += low * _K
            low <<= np.uint64(40)
            own, most = own[i], most[i]
        u = mix(x)
        live = np.flatnonzero(u > _POISSON[0])
        for j in range(len(_POISSON)):
            if j:
                live = live[u[live] > _POISSON[j]]
            if not len(live):
                break
            d = mix(u[live] + np.uint64(j + 1) * _K)
            rank = d >> np.uint64(24)
            if low is not None:
                rank |= low[live]
            ok = rank < most[live]
            if weight is not None:
                ok &= across[live] + (mix(d) >> np.uint64(24)) / 2.0**40 < weight[at[i[live]]]
            d, rank, live_ok = d[ok], rank[ok], live[ok]
            coordinate = ((d & np.uint64(0xFFFFFF)) * np.uint64(k) >> np.uint64(24)).astype(np.int64)
            np.minimum.at(out.reshape(-1), own[live_ok] * k + coordinate, rank)


def _sketch_batch(texts: list[str | None], weighted: bool) -> pa.StructArray:
    keys, bands, size = [], [], []
    for lo, hi in chunks(texts, SKETCH_CHARS):
        element, start, own = shingles(texts[lo:hi])
        keys += own
        size += np.diff(start).tolist()
        weight = None
        if weighted:
            doc = np.repeat(np.arange(hi - lo), np.diff(start))
            pairs, count = np.unique(np.stack([doc.astype(np.uint64), element]), axis=1, return_counts=True)
            element, weight = pairs[1], count.astype(np.float64)
            start = np.searchsorted(pairs[0], np.arange(hi - lo + 1).astype(np.uint64))
        sig = signatures(element, weight, start, BANDS * ROWS).reshape(hi - lo, BANDS, ROWS)
        with np.errstate(over="ignore"):
            h = reduce(lambda a, r: a * _K + sig[:, :, r], range(ROWS), np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((hi - lo, 1), np.uint64))
        h = mix(h.reshape(-1)).view(np.int64).reshape(hi - lo, BANDS)
        bands += [None if a == b else x for x, a, b in zip(h, start[:-1], start[1:], strict=True)]
    return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["key", "size", "bands"])


def sketch(text: Column, weighted: bool = False) -> Column:
    """Struct (key binary, size long, bands array<long>) of a text: its number of shingles, repeats among them; ``bands``
    is null for a text without words."""

    @F.arrow_udf("key binary, size bigint, bands array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.concat_arrays([_sketch_batch(own, weighted) for own in steps(x)])

    return run(text)


def shingle_set(text: Column, weighted: bool = False) -> Column:
    """Struct (elements, counts): the distinct shingle hashes of a text and, if ``weighted``, how often each occurs (else null)."""

    @F.arrow_udf(T.StructType([T.StructField("elements", T.BinaryType()), T.StructField("counts", T.BinaryType())]))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            sets, counts = [], []
            for t in (t for own in steps(x) for t in own):
                u, n = np.unique(shingles([t])[0], return_counts=True)
                sets.append(u.tobytes())
                counts.append(n.astype(np.uint32).tobytes() if weighted else None)
            yield pa.StructArray.from_arrays([pa.array(v, pa.binary()) for v in (sets, counts)], ["elements", "counts"])

    return run(text)


def overlaps(sets: list[np.ndarray], counts: list[np.ndarray] | None) -> np.ndarray:
    """Jaccard similarity of all sets (of multisets if ``counts``), by products of matrices of 4,096 shared shingles."""
    m = len(sets)
    size = np.array([len(x) if counts is None else c.sum() for x, c in zip(sets, counts or sets, strict=True)], np.float64)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    shingle, column, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    both = np.zeros((m, m), np.float64)
    new = np.cumsum(times > 1) - 1
    live = times[column] > 1
    owner, column = owner[live], new[column[live]]
    value = None if counts is None else np.concatenate([np.zeros(0, np.uint32), *counts])[live].astype(np.float32)
    order = np.argsort(column, kind="stable")
    edges = np.searchsorted(column[order], np.arange(0, (int(new[-1]) + 1 if len(new) else 0) + 4096, 4096))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        i = order[a:b]
        x = np.zeros((m, 4096), np.float32)
        if value is None:
            x[owner[i], column[i] - 4096 * k] = 1
            both += x @ x.T
        else:  # sum of minima: one product for every count level
            x[owner[i], column[i] - 4096 * k] = value[i]
            for level in range(1, int(value[i].max(initial=0)) + 1):
                y = (x >= level).astype(np.float32)
                both += y @ y.T
    np.fill_diagonal(both, size)  # shingles of one set alone were left out
    return both / np.maximum(size[:, None] + size[None, :] - both, 1)


def _parts(near: np.ndarray) -> np.ndarray:
    """The component of every node of the graph given by a symmetric boolean matrix."""
    part = np.full(len(near), -1)
    for i in range(len(near)):
        if part[i] < 0:
            own = near[i].copy()
            own[i] = True
            while (more := near[own].any(0) | own).sum() > own.sum():
                own = more
            part[own] = i
    return part


def _links(threshold: float, weighted: bool, sides: bool):
    """Grouped function: a block's rows (g, nid, side, elements, counts) to links (a, b) that span its components; with
    ``sides``, only pairs of side 0 and side 1 count.

    A component's members are linked to the least of them, the group's centre (nid = g) aside, and that one to the
    centre: so a centre has one link a block, however large its group is.
    """

    def run(block: pa.Table) -> pa.Table:
        nid, side = block.column("nid").to_numpy(), block.column("side").to_numpy()
        centre = block.column("g")[0].as_py()
        _, one = np.unique(nid * 2 + side, return_index=True)
        nid, side = nid[one], side[one]
        sets = [np.frombuffer(x, np.uint64) for x in block.column("elements").take(pa.array(one)).to_pylist()]
        counts = [np.frombuffer(x, np.uint32) for x in block.column("counts").take(pa.array(one)).to_pylist()] if weighted else None
        near = overlaps(sets, counts) >= threshold - 1e-12
        if sides:
            near &= (side[:, None] != side[None, :]) & (nid[:, None] != nid[None, :])
        part = _parts(near)
        links = set()
        for p in np.unique(part).tolist():
            own = sorted(set(nid[part == p].tolist()), key=lambda n: (n == centre, n))
            links.update((min(own[0], n), max(own[0], n)) for n in own[1:])
        trim()
        a, b = zip(*sorted(links), strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b): every node of a component gets the same root, a node of it.

    Each round maps nodes to their least neighbour and contracts the edges; rounds follow the logarithm of the longest
    path. Nothing but a number and a yes or no per round reaches the driver. Nodes of few links are assumed; a component
    of any size is not dealt by its root where its nodes are relabelled.
    """
    root = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        least = scratch.cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")))
        if root is None:
            root = least.select(F.col("n").alias("node"), F.col("m").alias("root"))
        else:
            sizes = root.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
            facts = scratch.cut(sizes.join(least.hint("merge"), sizes["root"] == least["n"]).select("root", "m", "size"))
            root = scratch.cut(hot_join(root, facts, "root", "size", root.count(), "left").select("node", F.coalesce("m", "root").alias("root")))
        x, y = least.toDF("a", "ma"), least.toDF("b", "mb")
        edges = edges.join(x.hint("merge"), "a").join(y.hint("merge"), "b").where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct()
        edges = scratch.cut(edges)
        if edges.isEmpty():
            return root


def _identity(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two hashes that tell a row (id and text) from others; never null."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(doc_id, doc_id.isNull(), text), F.xxhash64(text)


def _share(n: Column, size: Column) -> Column:
    """Blocks for ``n`` documents of ``size`` shingles."""
    return F.greatest(F.ceil(n / BLOCK_DOCS), F.ceil(size / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _place(n: Column) -> Column:
    return F.pmod(F.xxhash64("nid"), n).cast("int")


def _steps_to(n: Column) -> Column:
    """0 to n - 1; nothing for null or 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate classes of ``docs``: rows (doc_id, key, rid, h) as they came, and nodes (key, class_id, class_key,
    class_rid, class_h, copies).

    A node is a distinct word sequence with its number of rows; ``class_id`` is the least id in its class, the other
    class columns tell which document has it. Similarity is the Jaccard index of five-word shingle sets (of multisets if
    ``weighted``). A null text counts as empty; texts without words are in one class only if identical; a class whose ids
    are all null has a null class_id. Repeated rows are exact copies; of rows of equal ids and different texts in a class
    the one with the least key stands for it. An empty table gives empty tables. Other columns are not looked at.
    """
    spark, one = docs.sparkSession, F.lit(1)
    results, scratch = Scratch(spark, "near"), Scratch(spark, "near-work")
    rid, h = _identity(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), rid.alias("rid"), h.alias("h"))
    rows = results.cut(base.select("doc_id", "rid", "h", sketch(F.col("text"), weighted).alias("s")).select("doc_id", "rid", "h", "s.*"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "h")).alias("m")
    nodes = rows.groupBy("key").agg(first, F.count(one).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = scratch.cut(nodes.select("key", F.col("m.doc_id").alias("id"), "m.rid", "m.h", "copies", "size", "bands", F.monotonically_increasing_id().alias("nid")))

    # which documents meet where, and one star for each
    every = nodes.select("nid", F.explode("bands").alias("bucket"))
    shared = scratch.cut(every.groupBy("bucket").agg(F.min("nid").alias("lo"), F.count(one).alias("n")).where("n > 1"))
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = scratch.cut(hot_join(every, shared, "bucket", "n", total).select("bucket", "nid", "lo"))
    meets = pairs.where("nid <> lo").groupBy("nid", "lo").agg(F.count(one).alias("n"))
    pick = meets.groupBy("nid").agg(F.max(F.struct("n", (-F.col("lo")).alias("lo"))).alias("m")).select("nid", (-F.col("m.lo")).alias("star"))
    pick = scratch.cut(pick.join(nodes.select("nid", "size").hint("merge"), "nid"))
    stars = scratch.cut(pick.groupBy("star").agg(F.count(one).alias("n"), F.sum("size").alias("s")).select("star", "n", _share(F.col("n"), F.col("s")).alias("blocks")))
    placed = hot_join(pick, stars, "star", "n", pick.count()).select("nid", "star", _place(F.col("blocks")).alias("i"))
    wanted = placed.join(stars.select(F.col("star").alias("nid"), F.col("blocks").alias("own")).hint("merge"), "nid", "full")
    wanted = scratch.cut(wanted.join(nodes.select("nid", "rid", "h").hint("merge"), "nid"))

    # shingle sets of all documents that meet another, each read once
    again = scratch.cut(rows.groupBy("rid", "h").count().where("count > 1").select("rid", "h"))
    texts = lambda w: base.select("rid", "h", "text").join(w.hint("merge"), ["rid", "h"]).select("nid", "star", "i", "own", "text")
    if again.isEmpty():
        found = texts(wanted)
    else:
        again = again.hint("merge")
        found = texts(wanted.join(again, ["rid", "h"], "left_anti")).union(texts(wanted.join(again, ["rid", "h"], "left_semi")).dropDuplicates(["nid"]))
    sets = scratch.cut(found.select("nid", "star", "i", "own", shingle_set(F.col("text"), weighted).alias("s")).select("nid", "star", "i", "own", "s.*"))
    to = F.concat(
        F.when(F.col("star").isNotNull(), F.array(F.struct(F.col("star").alias("g"), F.col("i").alias("i")))).otherwise(F.array().cast("array<struct<g:bigint,i:int>>")),
        F.transform(_steps_to(F.col("own")), lambda j: F.struct(F.col("nid").alias("g"), j.alias("i"))),
    )
    dealt = sets.select("nid", "elements", "counts", F.lit(0).alias("side"), F.explode(to).alias("to")).select("to.*", "nid", "side", "elements", "counts")
    edges = scratch.cut(dealt.groupBy("g", "i").applyInArrow(_links(threshold, weighted, False), "a long, b long"))
    roots = components(edges, scratch)
    more = _open_buckets(pairs, roots, nodes, wanted, sets, scratch, threshold, weighted)
    if more is not None and not more.isEmpty():
        roots = components(scratch.cut(edges.union(more)), scratch)

    member = scratch.cut(nodes.join(roots.withColumnRenamed("node", "nid").hint("merge"), "nid", "left").select("key", "id", "rid", "h", "copies", "root"))
    linked = member.where("root is not null")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.hex("key").alias("hex"), "rid", "h")).alias("m")
    best = scratch.cut(linked.groupBy("root").agg(best, F.count(one).alias("n")))
    named = lambda f, m: f.select("key", F.col(f"{m}id").alias("class_id"), *[F.unhex("m.hex").alias("class_key") if m else F.col("key").alias("class_key")], F.col(f"{m}rid").alias("class_rid"), F.col(f"{m}h").alias("class_h"), "copies")
    full = named(hot_join(linked.select("key", "copies", "root"), best, "root", "n", linked.count()), "m.").union(named(member.where("root is null"), ""))
    full = results.cut(full)
    scratch.clear()
    return rows.select("doc_id", "key", "rid", "h"), full


def _open_buckets(pairs: DataFrame, roots: DataFrame, nodes: DataFrame, placed: DataFrame, sets: DataFrame, scratch: Scratch, threshold: float, weighted: bool) -> DataFrame | None:
    """Links between the members of buckets that hold several components and did not all meet in one block of a star;
    None if there is no such bucket.

    Members outside a bucket's largest component go to all blocks of the bucket, each member to all parts of these. Of
    buckets with the same members one is enough.
    """
    one = F.lit(1)
    held = pairs.join(placed.select("nid", F.struct("star", "i").alias("block")).hint("merge"), "nid", "left")
    held = held.join(roots.withColumnRenamed("node", "nid").hint("merge"), "nid", "left")
    held = scratch.cut(held.withColumn("root", F.coalesce("root", "nid")))
    same = ["x", "n", "low", "high", "lo"]
    rest, first = F.when(F.col("nid") != F.col("lo"), F.col("block")), F.when(F.col("nid") == F.col("lo"), F.col("block"))
    several = held.groupBy("bucket", "lo").agg(
        F.bit_xor(F.xxhash64("nid")).alias("x"), F.count(one).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"),
        F.min(rest).alias("from"), F.max(rest).alias("upto"), F.max(first).alias("own"),
    )
    met = (F.col("from") == F.col("upto")) & ((F.col("lo") == F.col("from.star")) | F.col("own").eqNullSafe(F.col("from")))
    several = scratch.cut(several.where("low <> high").where(~met).groupBy(*same).agg(F.min("bucket").alias("bucket")).select("bucket", "n"))
    if several.isEmpty():
        return None
    total = several.agg(F.sum("n")).first()[0]
    held = hot_join(held.select("bucket", "nid", "root"), several, "bucket", "n", total)
    held = scratch.cut(held.join(nodes.select("nid", "size").hint("merge"), "nid"))
    parts = held.groupBy("bucket", "root").agg(F.count(one).alias("n"), F.sum("size").alias("s"))
    facts = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "s", "root")).alias("m"))
    facts = facts.select(
        "bucket", "n", F.col("m.root").alias("main"), _share(F.col("n"), F.col("s")).alias("blocks"),
        _share(F.col("n") - F.col("m.n"), F.col("s") - F.col("m.s")).alias("parts"),
    )
    dealt = scratch.cut(hot_join(held, scratch.cut(facts), "bucket", "n", total))
    to = F.concat(
        F.transform(_steps_to(F.col("parts")), lambda i: F.struct(i.alias("i"), _place(F.col("blocks")).alias("j"), F.lit(1).alias("side"))),
        F.transform(_steps_to(F.when(F.col("root") != F.col("main"), F.col("blocks"))), lambda j: F.struct(_place(F.col("parts")).alias("i"), j.alias("j"), F.lit(0).alias("side"))),
    )
    # members get their sets before they are dealt: one row of each in the join, not one a block
    dealt = dealt.join(sets.select("nid", "elements", "counts").hint("merge"), "nid")
    full = dealt.select(F.col("bucket").alias("g"), "nid", "elements", "counts", F.explode(to).alias("to")).select("g", "nid", "to.*", "elements", "counts")
    return scratch.cut(full.groupBy("g", "i", "j").applyInArrow(_links(threshold, weighted, True), "a long, b long"))


def labelled(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The two results of ``classes`` joined: every row with its class."""
    return hot_join(rows, nodes, "key", "copies", rows.count())


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of ``docs``, with all its columns: the one with the least id (of repeated rows, any one).

    Null ids come last; null texts count as empty; an empty table stays empty; columns keep names, order and values.
    """
    rows, nodes = classes(docs, doc_id, text, threshold)
    r, h = (f"_{c}{uuid.uuid4().hex[:8]}" for c in "rh")
    best = nodes.select(F.col("class_rid").alias(r), F.col("class_h").alias(h)).distinct()
    rid, own = _identity(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    kept = docs.withColumn(r, rid).withColumn(h, own).join(best.hint("merge"), [r, h], "left_semi")
    again = rows.groupBy("rid", "h").count().where("count > 1").select(F.col("rid").alias(r), F.col("h").alias(h))
    again = Scratch(docs.sparkSession, "near").cut(again).hint("merge")
    if not again.isEmpty():
        kept = kept.join(again, [r, h], "left_anti").union(kept.join(again, [r, h], "left_semi").dropDuplicates([r, h]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, class_id, kept (it is its class's representative)."""
    rows, nodes = classes(table(spark, sf_dir, "documents"))
    return labelled(rows, nodes).select(
        "doc_id", "class_id", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key"))).alias("kept")
    )
