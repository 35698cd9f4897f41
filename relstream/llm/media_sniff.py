"""Media columns by signature sniffing.

One Aho-Corasick automaton over the magic bytes of all formats finds every place where media may start; a validator
per format walks its structure there and gives the length, or rejects it. The media at the start of a value tells its
true type, whatever was declared; media that start later, outside what is already carved, are embedded ones.

Validators share what they learn about a value: ends that are searched for are found once, and a place from which a walk
failed is not walked again, so many magics in one value do not multiply the work.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relstream.llm.common import steps, table


class Found(NamedTuple):
    kind: str
    start: int
    length: int


class Value:
    """The bytes of one value, with what validators have learned about them."""

    def __init__(self, data: bytes):
        self.data = data
        self._places: dict[bytes, list[int]] = {}
        self._dead: dict[str, set] = {}

    def find(self, what: bytes, at: int) -> int:
        """``data.find``: all places are looked up in one pass, the next one by bisection."""
        if what not in self._places:
            own, i = [], self.data.find(what)
            while i >= 0:
                own.append(i)
                i = self.data.find(what, i + 1)
            self._places[what] = own
        own = self._places[what]
        k = bisect_left(own, at)
        return own[k] if k < len(own) else -1

    def walk(self, name: str, at, step) -> int:
        """The end of a structure that is walked from state ``at``: ``step`` gives (next state, end); -1 if neither or if
        the walk comes to a state from which one failed before.
        """
        dead, met = self._dead.setdefault(name, set()), []
        while at is not None and at not in dead:
            met.append(at)
            at, end = step(self.data, at)
            if end is not None:
                return end
        dead.update(met)
        return -1


def _png_step(b: bytes, i: int) -> tuple[int | None, int | None]:
    if i + 12 > len(b):
        return None, None
    n, kind = struct.unpack_from(">I4s", b, i)
    if i + 12 + n > len(b) or zlib.crc32(memoryview(b)[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
        return None, None
    return (None, i + 12 + n) if kind == b"IEND" else (i + 12 + n, None)


def _png(v: Value, at: int) -> int:
    return v.walk("png", at + 8, _png_step) - at if v.data[at + 12 : at + 16] == b"IHDR" else 0


def _gif_step(b: bytes, at: tuple[int, bool]) -> tuple[tuple[int, bool] | None, int | None]:
    """From a block, or from a sub-block in one."""
    i, inside = at
    if i >= len(b):
        return None, None
    mark = b[i]
    if inside:
        return (i + 1 + mark, mark > 0), None
    if mark == 0x3B:
        return None, i + 1
    if mark == 0x2C and i + 10 <= len(b):
        return (i + 10 + (3 << (b[i + 9] & 7) + 1 if b[i + 9] & 128 else 0) + 1, True), None
    return ((i + 2, True) if mark == 0x21 else None), None


def _gif(v: Value, at: int) -> int:
    if at + 13 > len(v.data):
        return 0
    flags = v.data[at + 10]
    return v.walk("gif", (at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0), False), _gif_step) - at


def _jpeg(v: Value, at: int) -> int:
    def step(b: bytes, i: int) -> tuple[int | None, int | None]:
        if i + 4 > len(b) or b[i] != 0xFF:
            return None, None
        n = struct.unpack_from(">H", b, i + 2)[0]
        if n < 2:
            return None, None
        if b[i + 1] != 0xDA:
            return i + 2 + n, None
        end = v.find(b"\xff\xd9", i + 2 + n)
        return None, end + 2 if end >= 0 else None

    return v.walk("jpeg", at + 2, step) - at


def _riff(v: Value, at: int) -> int:
    b = v.data
    if at + 12 > len(b) or b[at + 8 : at + 12] not in (b"WAVE", b"WEBP"):
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b) or end < at + 12:
        return 0

    def step(b: bytes, i: int) -> tuple[int | None, int | None]:
        if i + 8 > end:
            return None, end if i in (end, end + 1) else None
        n = struct.unpack_from("<I", b, i + 4)[0]
        return i + 8 + n + n % 2, None

    return v.walk(f"riff{end}", at + 12, step) - at


def _bmp(v: Value, at: int) -> int:
    if at + 26 > len(v.data):
        return 0
    size, _, pixels, head = struct.unpack_from("<IIII", v.data, at + 2)
    return size if head in (12, 40, 52, 56, 108, 124) and 14 + head <= pixels <= size <= len(v.data) - at else 0


def _pdf(v: Value, at: int) -> int:
    table_at = v.find(b"startxref", at)
    end = v.find(b"%%EOF", table_at) if table_at >= 0 else -1
    return end + 5 - at if end >= 0 else 0


def _zip(v: Value, at: int) -> int:
    end = v.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(v.data):
        return 0
    size, offset, note = struct.unpack_from("<IIH", v.data, end + 12)
    return end + 22 + note - at if at + offset + size == end and end + 22 + note <= len(v.data) else 0


def _gzip(v: Value, at: int) -> int:
    b = v.data
    flags, i = (b[at + 3] if at + 10 <= len(b) else 0xFF), at + 10
    if flags & 0xE0:
        return 0
    if flags & 4:
        i += 2 + int.from_bytes(b[i : i + 2], "little")
    for bit in (8, 16):  # name and comment end with a zero
        if flags & bit:
            i = v.find(b"\0", i) + 1
            if not i:
                return 0

    def step(b: bytes, i: int) -> tuple[None, int | None]:
        d = zlib.decompressobj(-15)
        crc = size = 0
        try:
            while not d.eof and i < len(b):
                got = d.decompress(d.unconsumed_tail or b[i : i + 65536], 1 << 20)
                crc, size = zlib.crc32(got, crc), size + len(got)
                if not d.unconsumed_tail:
                    i = min(i + 65536, len(b))
        except zlib.error:
            return None, None
        end = i - len(d.unused_data)
        whole = d.eof and b[end : end + 8] == struct.pack("<II", crc, size & 0xFFFFFFFF)
        return None, end + 8 if whole else None

    return v.walk("gzip", i + (2 if flags & 2 else 0), step) - at


def _ogg_step(b: bytes, i: int) -> tuple[int | None, int | None]:
    if b[i : i + 4] != b"OggS" or i + 27 > len(b) or b[i + 4] != 0:
        return None, None
    n = b[i + 26]
    end = i + 27 + n + sum(b[i + 27 : i + 27 + n])
    if i + 27 + n > len(b) or end > len(b):
        return None, None
    return (None, end) if b[i + 5] & 4 else (end, None)


def _ogg(v: Value, at: int) -> int:
    return v.walk("ogg", at, _ogg_step) - at


#: Magic bytes, media type, validator.
FORMATS = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"RIFF", "riff", _riff),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"OggS", "audio/ogg", _ogg),
)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), k)
    a.make_automaton()
    return a


_MAGIC = _automaton()


def sniff(data: bytes) -> list[Found]:
    """All confirmed media in the bytes, by place; what lies inside another one found is left to a look into that one."""
    out: list[Found] = []
    value, free = Value(data), 0
    for end, k in _MAGIC.iter(data.decode("latin-1")):
        magic, kind, validate = FORMATS[k]
        at = end + 1 - len(magic)
        if at >= free and (n := validate(value, at)) > 0:
            if kind == "riff":
                kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp"}[data[at + 8 : at + 12]]
            out.append(Found(kind, at, n))
            free = at + n
    return out


def true_type(data: bytes | None, declared: str | None = None) -> str | None:
    """The type of the media that fills the bytes from the start; else what was declared."""
    found = sniff(data) if data else []
    return found[0].kind if found and found[0].start == 0 else declared


def carve(data: bytes) -> list[bytes]:
    """The bytes of all embedded media: those found after the start."""
    return [data[f.start : f.start + f.length] for f in sniff(data) if f.start]


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """A mono WAV file of 8-bit samples."""
    pad = b"\0" * (len(samples) % 2)
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples(media: bytes) -> bytes:
    """The samples of a WAV file: its data chunk."""
    i = 12
    while i + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, i)
        if kind == b"data":
            return media[i + 8 : i + 8 + n]
        i += 8 + n + n % 2
    raise ValueError("no data chunk")


#: Types that stored values are declared to be, in turn by the checksum of the text: of a WAV file one is right.
DECLARED = ("audio/wav", "image/png", "text/plain", "application/octet-stream")


def stored(text: str | None) -> tuple[bytes, str, bytes]:
    """A text's value in a media column: the payload as a WAV file, its declared type, and a bundle that has it embedded."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    media = wav(raw + b"\0" * (max(64, -len(raw) % 64 + len(raw)) - len(raw)))
    declared = DECLARED[zlib.crc32(raw) % len(DECLARED)]
    return media, declared, b"type: " + declared.encode() + b"\n\n" + media + b"\n--\n"


def _row(text: str | None) -> dict:
    """Store, correct the declared type, carve the media out of the bundle and read all values from what was carved."""
    media, declared, bundle = stored(text)
    kind, found = true_type(media, declared), carve(bundle)
    payload = samples(found[0])
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    inner = sniff(payload)
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    feature = f"{kind};samples={len(x)};sum={x.sum()};squares={(x * x).sum()};crossings={crossings};embedded=" + ",".join(f"{f.kind}@{f.start}+{f.length}" for f in inner)
    return {
        "n_bytes": len((text or "").encode("utf-8", "surrogatepass")), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(found[0]), "media_sha256": hashlib.sha256(found[0]).hexdigest(), "feature": feature,
        "declared": declared, "true_type": kind, "n_carved": len(found), "embedded_bytes": sum(f.length for f in inner),
    }


_KINDS = {
    "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string",
    "feature": "string", "declared": "string", "true_type": "string", "n_carved": "bigint", "embedded_bytes": "bigint",
}


def media_column(text: Column) -> Column:
    """Struct of the contract's values for a text: stored as WAV under a declared type that may be wrong and in a bundle,
    the type corrected and the media carved by signature, read back. Null is empty; a text of any length is stored whole;
    equal texts give equal values.
    """
    kind = pa.struct([(c, pa.int64() if t == "bigint" else pa.string()) for c, t in _KINDS.items()])

    @F.arrow_udf(", ".join(f"{c} {t}" for c, t in _KINDS.items()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array([_row(t) for own in steps(x) for t in own], kind)

    return run(text)


def sniffed(df: DataFrame, data: str, declared: str | None = None, out: str = "media") -> DataFrame:
    """``df`` with ``out``: struct (type, found array of (kind, start, length)) of a binary column.

    ``type`` is the sniffed type, else the declared one. Null data has no finds and keeps its declared type.
    """
    kind = pa.struct([("type", pa.string()), ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())])))])

    @F.arrow_udf("type string, found array<struct<kind:string,start:bigint,length:bigint>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, d in batches:
            rows = []
            for b, t in zip(x.to_pylist(), d.to_pylist(), strict=True):
                found = sniff(b) if b else []
                rows.append({"type": found[0].kind if found and not found[0].start else t, "found": [f._asdict() for f in found]})
            yield pa.array(rows, kind)

    return df.withColumn(out, run(F.col(data), F.col(declared) if declared else F.lit(None).cast("string")))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id and the values of ``media_column`` over its whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", media_column(F.col("text")).alias("m"))
    return docs.select("doc_id", "m.*")
