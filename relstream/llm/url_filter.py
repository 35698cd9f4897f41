"""URL filters: fixed rules first, then a classifier over segmented host words.

A host's labels are split into words by unigram Viterbi (``cheappills`` to ``cheap pills``) over word frequencies that
are first counted in all URLs' paths and in the pieces of labels that hyphens or digits delimit, and then re-estimated
in ROUNDS of segmenting all distinct hosts: a name in one piece, which may be words run together, does not vouch for
itself. Host and path words then go through multinomial naive Bayes.

URLs carry no labels, so training takes two kinds of evidence: the text of the page (``spoken``: it speaks of what is to
be blocked, whatever the host is called), and a short seed list of host words. From pages of both kinds naive Bayes
learns the words of hosts and paths that go along with them, and verdicts follow from the URL alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relstream.llm.common import table

#: Rules (verdict, host, path) and seed words of hosts to block.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
SEEDS = frozenset(
    "ads adserver adult bet bets betting casino cheap clickbait fakes gambling hentai loan loans lottery malware payday pharma pills phishing poker porn replica sex slots spam track tracker viagra virus warez xxx".split()
)
#: Rounds in which word frequencies are re-estimated from segmented hosts.
ROUNDS = 2
#: Seed words in a page's text from which it speaks of what is to be blocked: so many, and one in so many words.
SPOKEN, SPOKEN_IN = 3, 100
_WORDS = re.compile(r"[^\W\d_]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: then up to ``? #`` or the end. Both empty for null or without ``://``."""
    u = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(u, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(u, pattern, 2)


def rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule whose host is the host or a parent domain and whose path starts the path; else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def raw_words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def lexicon_words(host: str, path: str) -> list[str]:
    """Words that count for the segmenter: those of the path, and a host label's if it has several."""
    pieces = [raw_words(label) for label in host.split(":")[0].split(".")]
    return [w for own in pieces if len(own) > 1 for w in own] + raw_words(path)


def word_hash(word: str) -> int:
    """Signed 64-bit hash of a word."""
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Lookup(NamedTuple):
    """Numbers of words, kept as sorted 64-bit hashes: 16 bytes a word, however many there are; and the longest word's length."""

    keys: np.ndarray
    values: np.ndarray
    longest: int = 0

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray, longest: int = 0) -> Lookup:
        order = np.argsort(keys)
        return cls(keys[order], values[order], longest)

    def get(self, word: str, default: float = 0.0) -> float:
        h = np.int64(word_hash(word))
        i = int(np.searchsorted(self.keys, h))
        return float(self.values[i]) if i < len(self.keys) and self.keys[i] == h else default

    def with_words(self, words: dict[str, float]) -> Lookup:
        """Also the numbers of ``words`` that are not there yet."""
        new = {word_hash(w): x for w, x in words.items() if self.get(w, math.nan) != self.get(w, math.nan)}
        keys, values = np.fromiter(new.keys(), np.int64, len(new)), np.fromiter(new.values(), self.values.dtype, len(new))
        return Lookup.of(np.r_[self.keys, keys], np.r_[self.values, values], max([self.longest, *map(len, words)]))


class Segmenter:
    """Unigram Viterbi: unknown words cost by length, known ones by their frequency."""

    def __init__(self, counts: Lookup | dict[str, int]):
        if isinstance(counts, dict):
            counts = Lookup(np.zeros(0, np.int64), np.zeros(0, np.int64)).with_words(counts)
        total = int(counts.values.sum()) + len(counts.keys) + 1
        self.cost = Lookup(counts.keys, np.log(total / (counts.values + 1)), counts.longest)
        self.unknown = math.log(total) + 2.0
        self.split = lru_cache(50_000)(self._split)

    def _split(self, word: str) -> tuple[str, ...]:
        """The best words; labels and words of any length are searched whole."""
        if len(word) < 4:
            return (word,)
        best, prev = [0.0] + [math.inf] * len(word), [0] * (len(word) + 1)
        # an unknown piece costs by its length: of all its starts the one with the least best[start] - 3 start is best
        low, low_at = math.inf, 0
        for end in range(1, len(word) + 1):
            if end >= 3 and best[end - 3] - 3.0 * (end - 3) < low:
                low, low_at = best[end - 3] - 3.0 * (end - 3), end - 3
            if low + 3.0 * end + self.unknown < best[end]:
                best[end], prev[end] = low + 3.0 * end + self.unknown, low_at
            for start in range(max(0, end - max(2, self.cost.longest)), end):
                # a piece of a word costs a word; two letters or fewer are no word of a compound unless they are all of it
                c = self.cost.get(word[start:end], self.unknown + 3.0 * (end - start)) + (4.0 if end - start < 3 else 0.0)
                if best[start] + c < best[end]:
                    best[end], prev[end] = best[start] + c, start
        out, end = [], len(word)
        while end:
            out.append(word[prev[end] : end])
            end = prev[end]
        return tuple(out[::-1])

    def compound_words(self, host: str) -> list[str]:
        """The words of labels in one piece that are split into several known words."""
        pieces = [own[0] for label in host.split(":")[0].split(".") if len(own := raw_words(label)) == 1]
        return [w for p in pieces if len(words := self.split(p)) > 1 and all(self.cost.get(w, -1.0) >= 0 for w in words) for w in words]

    def tokens(self, host: str, path: str) -> list[str]:
        """Host words as ``h:word``, path words as ``p:word``; the top-level domain and ``www`` say nothing."""
        labels = host.split(":")[0].split(".")
        own = [w for label in labels[: max(1, len(labels) - 1)] if label != "www" for raw in raw_words(label) for w in self.split(raw)]
        return [f"h:{w}" for w in own] + [f"p:{w}" for w in raw_words(path)]


class Model(NamedTuple):
    words: Lookup
    #: log P(token | block) - log P(token | allow) of every token seen
    ratio: Lookup
    prior: float


def _count(of):
    """Task function: (host, path, evidence) rows to (word's hash, blocked, n, length), summed over the task. ``of`` gives (words, blocked) of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def give() -> pa.RecordBatch:
            cols = [pa.array([word_hash(w) for w, _ in total], pa.int64()), pa.array([b for _, b in total]), pa.array(list(total.values())), pa.array([len(w) for w, _ in total])]
            return pa.RecordBatch.from_arrays(cols, ["word", "blocked", "n", "length"])

        for b in batches:
            for host, path, spoke in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words, blocked = of(host, path, spoke)
                for w in words:
                    total[w, blocked] += 1
            if len(total) > 200_000:
                yield give()
                total.clear()
        if total:
            yield give()

    return run


def _counted(urls: DataFrame, of) -> DataFrame:
    rows = urls.select("host", "path", "evidence").mapInArrow(_count(of), "word long, blocked boolean, n long, length long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("blocked"), F.col("n")).otherwise(0)).alias("bad"), F.max("length").alias("length"))


def spoken(html: Column, seeds: frozenset[str] = SEEDS) -> Column:
    """Whether a page's text (scripts, styles and tags aside) holds SPOKEN seed words, and one in SPOKEN_IN words. Null: no."""
    text = F.regexp_replace(F.lower(F.coalesce(html, F.lit(""))), r"(?s)<(script|style)\b.*?</\1|<[^>]*+>?+", " ")
    count = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    met = count(rf"\b(?:{'|'.join(sorted(seeds))})\b")
    return F.when(met < SPOKEN, False).otherwise(met * SPOKEN_IN >= count(r"\p{L}++"))


def train(urls: DataFrame, seeds: frozenset[str] = SEEDS) -> Model:
    """Word frequencies and naive Bayes counts over all rows of (host, path), and of evidence (boolean) if there.

    A row is an example of what to block if its evidence holds or its host has a seed word. Both tables hold every word,
    as 16 bytes, and are broadcast: what is sent to tasks grows with the distinct words. Without rows, or without a
    blocked example, only seed words speak. Null evidence is none; repeated rows count each time for naive Bayes, hosts
    once for the words that they are split into.
    """
    urls = urls.select("host", "path", F.coalesce(F.col("evidence"), F.lit(False)).alias("evidence") if "evidence" in urls.columns else F.lit(False).alias("evidence"))
    hosts = urls.select("host").distinct().select("host", F.lit("").alias("path"), F.lit(False).alias("evidence"))
    sc = urls.sparkSession.sparkContext

    def table_of(rows: DataFrame) -> Lookup:
        got = rows.toArrow()
        return Lookup.of(*(got.column(c).to_numpy() for c in ("word", "n")), max(got.column("length").to_pylist(), default=0)).with_words(dict.fromkeys(seeds, 1))

    bare = urls.select("host", "path", F.lit(False).alias("evidence"))  # pages are read for their evidence once, below
    plain = _counted(bare, lambda host, path, _: (lexicon_words(host, path), False)).select("word", "n", "length")
    words = table_of(plain)
    for _ in range(ROUNDS):
        shared = sc.broadcast(words)
        split = _counted(hosts, _compounds(shared)).select("word", "n", "length")
        words = table_of(plain.unionByName(split).groupBy("word").agg(F.sum("n").alias("n"), F.max("length").alias("length")))
        shared.destroy()
    shared = sc.broadcast(words)

    def judged(host: str, path: str, spoke: bool) -> tuple[list[str], bool]:
        own = segmenter(shared).tokens(host, path)
        return [*own, ""], spoke or any(t[:2] == "h:" and t[2:] in seeds for t in own)

    got = _counted(urls, judged).toArrow()
    key, a, b = (got.column(c).to_numpy() for c in ("word", "n", "bad"))
    row = key == word_hash("")  # each row counts once under the empty word
    rows, rows_bad, kinds = int(a[row].sum()), int(b[row].sum()), len(key)
    key, a, b = key[~row], a[~row], b[~row]
    n, bad = int(a.sum()), int(b.sum())
    ratio = Lookup.of(key, np.log((b + 1) / (bad + kinds + 1)) - np.log((a - b + 1) / (n - bad + kinds + 1)))
    return Model(words, ratio.with_words({f"h:{s}": 8.0 for s in seeds}), math.log((rows_bad + 1) / (rows - rows_bad + 1)))


def _compounds(shared):
    return lambda host, path, _: (segmenter(shared).compound_words(host), False)


_SEGMENTERS: dict[int, Segmenter] = {}


def segmenter(shared) -> Segmenter:
    """One segmenter per broadcast table and Python worker."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _SEGMENTERS:
        _SEGMENTERS.clear()
        value = shared.value
        _SEGMENTERS[key] = Segmenter(value.words if isinstance(value, Model) else value)
    return _SEGMENTERS[key]


def odds(model: Model, tokens: list[str]) -> float:
    """Log-odds that the URL of these tokens is to be blocked. Tokens never seen say nothing."""
    return model.prior + sum(model.ratio.get(t, 0.0) for t in tokens)


def judged(pages: DataFrame, model: Model, url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names are replaced. Null URLs have empty host and path and are allowed."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def verdict(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = segmenter(shared)
        for h, p in batches:
            yield pa.array(["block" if odds(shared.value, own.tokens(a, b)) > 0 else "allow" for a, b in zip(h.to_pylist(), p.to_pylist(), strict=True)], pa.string())

    host, path = host_and_path(F.col(url))
    found = pages.withColumn("host", host).withColumn("path", path)
    name, by_rule = rule(F.col("host"), F.col("path"), rules)
    return found.withColumn("rule", name).withColumn("verdict", F.coalesce(by_rule, verdict("host", "path")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict."""
    pages = table(spark, sf_dir, "pages")
    host, path = host_and_path(F.col("url"))
    model = train(pages.select(host.alias("host"), path.alias("path"), spoken(F.col("html")).alias("evidence")))
    return judged(pages.select("page_id", "url"), model).select("page_id", "host", "path", "rule", "verdict")
