"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

White space is marked by the space byte itself (the pieces' marker is read as a space), every text gets one leading
marker, and characters that no piece covers fall back to byte pieces, so decoding gives back exactly the text. A marker
character in the text itself is spelled in bytes, never taken for a space.

Texts are cut before every run of spaces: no piece reaches over such a place (checked when the model is read), so the
best segmentation of a text is that of its parts. Equal parts are segmented once per step, all parts of one length
together, column by column over arrays; long parts go through the plain form of the same search.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relstream.llm.common import hash_spans, steps, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Longest part, in bytes, that is segmented together with others.
TOGETHER = 24
#: Ids that one step of decoding holds.
STEP_IDS = 1 << 18
#: A character without a piece costs this much more than the rarest piece.
UNKNOWN_COST = 10.0


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return out, i


def _fields(b: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of a protocol-buffer message; fixed-width values stay bytes."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            v, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if tag & 7 == 2 else (8 if tag & 7 == 1 else 4, i)
            v, i = b[i : i + n], i + n
        yield tag >> 3, v


def read_model(path: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, log score, type) by id from a SentencePiece model file.

    Types: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte. A model whose scores are merge ranks gets
    log probabilities by Zipf's law over the ranks; a unigram model's scores stay.
    """
    with open(path, "rb") as f:
        raw = f.read()
    pieces, kind = [], 1
    for number, v in _fields(raw):
        if number == 1:
            own = dict(_fields(v))
            pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0" * 4))[0], own.get(3, 1)))
        elif number == 2:
            kind = dict(_fields(v)).get(3, 1)
    if kind != 2:
        return pieces
    rank = [min(-s, len(pieces)) + 1 for _, s, _ in pieces]
    z = np.log(sum(1 / r for r, (_, _, k) in zip(rank, pieces, strict=True) if k in (1, 4)))
    return [(p, float(-np.log(r) - z), k) for r, (p, _, k) in zip(rank, pieces, strict=True)]


class Codec:
    """A piece table as a double-array trie: the child of state s by byte c is t = base[s] + c + 1 if check[t] == s."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.bytes_id = np.full(256, -1, np.int32)
        spelled: dict[bytes, int] = {}
        blob: list[bytes] = []
        for i, (p, _, kind) in enumerate(pieces):
            own = b""
            if kind == 6:
                self.bytes_id[int(p[1:-1], 16)] = i
                own = bytes([int(p[1:-1], 16)])
            elif kind in (1, 4) and p:
                own = p.replace(MARK, " ").encode()
                spelled.setdefault(own, i)
            blob.append(own)
        if (self.bytes_id < 0).any():
            raise ValueError("the model has no byte pieces, so it can't spell every text")
        self.score = np.array([s for _, s, _ in pieces], np.float64)
        self.unknown = float(min((self.score[i] for i in spelled.values()), default=0.0)) - UNKNOWN_COST
        self.splits = all(b" " not in p.lstrip(b" ") for p in spelled)
        self.longest = max(map(len, spelled), default=1)
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.blob_at = np.cumsum([0, *map(len, blob)])
        self._build(spelled)

    def _build(self, spelled: dict[bytes, int]) -> None:
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for p in sorted(spelled):
            s = 0
            for c in p:
                if c not in children[s]:
                    children[s][c] = len(children)
                    children.append({})
                    ends.append(-1)
                s = children[s][c]
            ends[s] = spelled[p]
        size = 2 * len(children) + 1024
        base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0], low, wide, queue = 1, 1, 0, [(0, 0)]
        for node, state in queue:
            own = children[node]
            if not own:
                continue
            at = sorted(own)
            if len(at) == 1:  # single children fill the first hole
                while used[low] or low <= at[0]:
                    low += 1
                b = low - at[0] - 1
            else:  # several go behind the last such place, so that no search starts over
                b = wide
                while any(used[b + c + 1] for c in at):
                    b += 1
                wide = b
            while b + 600 >= len(used):
                used += bytearray(len(used))
            if len(used) > len(base):
                grow = len(used) - len(base)
                base, check, piece = np.r_[base, np.zeros(grow, np.int32)], np.r_[check, np.full(grow, -1, np.int32)], np.r_[piece, np.full(grow, -1, np.int32)]
            base[state] = b
            for c in at:
                t = b + c + 1
                used[t] = 1
                check[t], piece[t] = state, ends[own[c]]
                queue.append((own[c], t))
        room = np.zeros(258, np.int32)
        self.base, self.check, self.piece = np.r_[base, room], np.r_[check, room - 1], np.r_[piece, room - 1]

    @staticmethod
    def _width(lead: np.ndarray) -> np.ndarray:
        return 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)

    def _together(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best pieces of parts of one length (a row each): ids from the end backwards, padded, and their number."""
        rows, n = m.shape
        best = np.full((rows, n + 1), -np.inf)
        best[:, 0] = 0
        ids, prev = np.zeros((rows, n + 1), np.int32), np.zeros((rows, n + 1), np.int32)
        for i in range(n):
            live = np.flatnonzero(best[:, i] > -np.inf)
            if not len(live):
                continue
            width = self._width(m[live, i])
            covered = np.zeros(rows, bool)
            row, state, w = live, np.zeros(len(live), np.int32), width
            for j in range(i, min(n, i + self.longest)):
                t = self.base[state] + m[row, j] + 1
                ok = self.check[t] == state
                row, state, w = row[ok], t[ok], w[ok]
                if not len(row):
                    break
                p = self.piece[state]
                end = p >= 0
                r, p = row[end], p[end]
                covered[r[w[end] == j + 1 - i]] = True
                s = best[r, i] + self.score[p]
                up = s > best[r, j + 1]
                r = r[up]
                best[r, j + 1], ids[r, j + 1], prev[r, j + 1] = s[up], p[up], i
            bare = ~covered[live]
            for k in range(1, 5):
                r = live[bare & (width == k)]
                if not len(r) or i + k > n:
                    continue
                s = best[r, i] + self.unknown
                r, s = r[s > best[r, i + k]], s[s > best[r, i + k]]
                best[r, i + k] = s
                for b in range(k):
                    ids[r, i + b + 1], prev[r, i + b + 1] = self.bytes_id[m[r, i + b]], i + b
        out, count, at, every = np.zeros((rows, n), np.int32), np.zeros(rows, np.int64), np.full(rows, n), np.arange(rows)
        for k in range(n):
            out[:, k] = np.where(at > 0, ids[every, at], 0)
            count += at > 0
            at = np.where(at > 0, prev[every, at], 0)
            if not at.any():
                break
        return out, count

    def _alone(self, part: bytes) -> list[int]:
        """Best pieces of one part of any length; the same search in plain form."""
        n, base, check, piece, score = len(part), self.base, self.check, self.piece, self.score
        best, ids, prev = [-np.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            b = best[i]
            if b == -np.inf:
                continue
            lead = part[i]
            width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            covered, state = False, 0
            for j in range(i, min(n, i + self.longest)):
                t = int(base[state]) + part[j] + 1
                if check[t] != state:
                    break
                state = t
                p = int(piece[t])
                if p >= 0:
                    covered |= width == j + 1 - i
                    if b + score[p] > best[j + 1]:
                        best[j + 1], ids[j + 1], prev[j + 1] = b + score[p], p, i
            if not covered and i + width <= n and b + self.unknown > best[i + width]:
                best[i + width] = b + self.unknown
                for k in range(width):
                    ids[i + k + 1], prev[i + k + 1] = int(self.bytes_id[part[i + k]]), i + k
        out, at = [], n
        while at:
            out.append(ids[at])
            at = prev[at]
        return out[::-1]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and each text's first (one more entry: the end). Null and empty texts have none."""
        raw = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        buf = np.frombuffer(b"".join(raw), np.uint8)
        text_at = np.cumsum([0, *map(len, raw)])
        begin = np.zeros(len(buf), bool)
        if self.splits and len(buf):
            space = buf == 32
            begin = space & ~np.r_[False, space[:-1]]
        begin[text_at[:-1][text_at[:-1] < text_at[1:]]] = True
        first = np.flatnonzero(begin)
        last = np.r_[first[1:], len(buf)] if len(first) else first
        _, at, back = np.unique(hash_spans(buf, first, last), return_index=True, return_inverse=True)
        size = (last - first)[at]
        count = np.zeros(len(at), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            if n <= TOGETHER:
                got, count[own] = self._together(buf[first[at[own]][:, None] + np.arange(n)].astype(np.int32))
                parts.append((own, got))
        alone = {int(k): self._alone(buf[first[at[k]] : last[at[k]]].tobytes()) for k in np.flatnonzero(size > TOGETHER)}
        for k, v in alone.items():
            count[k] = len(v)
        start = np.concatenate([[0], np.cumsum(count)])
        flat = np.zeros(start[-1], np.int32)
        for own, got in parts:
            c = count[own]
            k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            flat[np.repeat(start[own], c) + k] = got[np.repeat(np.arange(len(own)), c), np.repeat(c, c) - 1 - k]
        for k, v in alone.items():
            flat[start[k] : start[k] + len(v)] = v
        c = count[back]
        total = np.concatenate([[0], np.cumsum(c)])
        ids = flat[np.repeat(start[back] - total[:-1], c) + np.arange(total[-1])]
        return ids, total[np.searchsorted(first, text_at)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Bytes of texts given as by ``encode``: pieces spelled out, the leading marker taken off. Control pieces spell nothing."""
        out: list[bytes] = []
        size = (self.blob_at[1:] - self.blob_at[:-1]).astype(np.int32)
        k = 0
        while k < len(at) - 1:  # steps of about STEP_IDS ids
            e = max(k + 1, int(np.searchsorted(at, at[k] + STEP_IDS, "right")) - 1)
            own = ids[at[k] : at[e]]
            n = size[own]
            total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            raw = self.blob[np.repeat(self.blob_at[own] - total[:-1], n) + np.arange(total[-1])].tobytes()
            cut = total[at[k : e + 1] - at[k]].tolist()
            out += [raw[a + (raw[a : a + 1] == b" ") : b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            k = e
        return out


def encoded(docs: DataFrame, text: str = "text", out: str = "ids", model: str = MODEL) -> DataFrame:
    """``docs`` with array<int> column ``out``; null and empty texts get an empty array. Pieces are broadcast: their
    number is that of the model, some tens of thousands. No rows move.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Codec(read_model(model)))

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            done = [shared.value.encode(own) for own in steps(x)]
            ids = np.concatenate([np.zeros(0, np.int32), *(i for i, _ in done)])
            count = np.concatenate([np.zeros(1, np.int64), *(np.diff(a) for _, a in done)])
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(count), pa.int32()), pa.array(ids, pa.int32()))

    return docs.withColumn(out, run(F.col(text)))


def decoded(docs: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``docs`` with string column ``out``; null ids give null, ids that spell no valid UTF-8 get replacement characters."""
    shared = docs.sparkSession.sparkContext.broadcast(Codec(read_model(model)))

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            flat, at = x.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(0 if n is None else n for n in x.value_lengths().to_pylist())])
            texts = [b.decode("utf-8", "replace") for b in shared.value.decode(flat, at)]
            yield pa.array([t if v else None for t, v in zip(texts, x.is_valid().to_pylist(), strict=True)], pa.string())

    return docs.withColumn(out, run(F.col(ids)))


def round_trip(docs: DataFrame, text: str = "text", out: str = "coded", model: str = MODEL) -> DataFrame:
    """``docs`` with struct ``out`` (ids, n_chars of the decoded text, lossless): encoded and decoded in one step, so that
    a task needs one Python worker and the decoded text is not sent back. Null counts as empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Codec(read_model(model)))

    @F.arrow_udf("ids array<int>, n_chars bigint, lossless boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            ids, count, chars, same = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], [], []
            for own in steps(x):
                flat, at = shared.value.encode(own)
                ids.append(flat)
                count.append(np.diff(at))
                back = [b.decode("utf-8", "surrogatepass") for b in shared.value.decode(flat, at)]
                chars += map(len, back)
                same += [b == (t or "") for b, t in zip(back, own, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(count)), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
            yield pa.StructArray.from_arrays([lists, pa.array(chars, pa.int64()), pa.array(same, pa.bool_())], ["ids", "n_chars", "lossless"])

    return docs.withColumn(out, run(F.col(text)))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids, n_chars of the decoded text, lossless (decoding gives back the text)."""
    docs = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.size("coded.ids").cast("long").alias("n_tokens"), "coded.ids", "coded.n_chars", "coded.lossless")
