"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Everything is a DataFrame expression. Places come from splitting a text at a pattern: running sums over the lengths of the
pieces between matches and of the matches themselves are code-point offsets. Candidates are maximal runs of token
characters; a window slides over each, and its entropy follows from counts per character that are carried along and
changed by the character that enters and the one that leaves. A candidate's threshold depends on its character class
(hex, or wider alphabets); an allow-list suppresses well-known harmless strings. Entropy only ever adds spans to those of
the patterns.

Work is linear in the text and in a candidate; running sums over many matches go in blocks of BLOCK, so that arrays grow
by copying in short pieces only.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relstream.llm.common import table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Shortest value of an assignment.
ASSIGN_MIN = 6
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates: maximal runs of these characters, at least a window long.
WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Bits per character from which a full window counts: hex digits only, or a wider alphabet.
HEX_BITS, WIDE_BITS = 3.0, 3.7
#: A candidate with a letter and a digit can be a secret; long plain words can't.
MIXED = r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])"
#: Candidates that match any of these are left alone by the entropy scan.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxxx",
    r"^(?i:sha(1|256|384|512)[-_])",
    r"^[A-Za-z]+([-_/=+][A-Za-z]+)*[-_/=+]?[0-9]{0,4}$",
)

#: Parts of ALLOW that the regex engine would walk by recursion, and the same without steps back, which it walks in a loop.
IN_A_LOOP = {"([-_/=+][A-Za-z]+)*": "(?:[-_/=+][A-Za-z]++)*+"}
#: Elements in one block of a running fold.
BLOCK = 64
#: n log2 n for the counts of a window, as whole multiples of 2**-40, so that adding and taking off leaves no error.
_WEIGHTS = [round(n * math.log2(n) * 2**40) if n else 0 for n in range(WINDOW + 2)]
#: Candidates' characters lie from + to z.
_FIRST, _SYMBOLS = ord("+"), ord("z") - ord("+") + 1
#: Counts of a window, at most WINDOW < 32, in one long.
_PACKED = 12


def _running(array: str, step: str) -> str:
    """SQL: the running folds of an int array by ``step`` (of s and x, from 0), in two levels of blocks."""
    blocks = f"transform(sequence(0, (size({array}) - 1) div {BLOCK}), k -> slice({array}, k * {BLOCK} + 1, {BLOCK}))"
    none = "cast(array() as array<int>)"
    before = f"""aggregate(transform({blocks}, b -> aggregate(b, 0, (s, x) -> {step})), named_struct('s', 0, 'out', {none}),
        (a, x) -> named_struct('s', transform(array(a.s), s -> {step})[0], 'out', concat(a.out, array(a.s))), a -> a.out)"""
    return f"""flatten(zip_with({blocks}, {before}, (b, o) -> aggregate(b, named_struct('s', o, 'out', {none}),
        (a, x) -> transform(array(transform(array(a.s), s -> {step})[0]), s -> named_struct('s', s, 'out', concat(a.out, array(s))))[0], a -> a.out)))"""


def _entropy(c: str) -> str:
    """SQL: struct (first, last) of the window starts in candidate ``c`` whose entropy reaches its class's bits, 0-based; first -1 if none."""
    most = lambda bits: int(WINDOW * (math.log2(WINDOW) - bits) * 2**40)
    weights = f"array({', '.join(f'{w}L' for w in _WEIGHTS)})"
    weight = lambda n: f"{weights}[{n}]"
    count = lambda v: f"cast(shiftrightunsigned(a.n[o.{v} div {_PACKED}], 5 * (o.{v} % {_PACKED})) & 31L as int)"
    one = lambda v: f"if(k = o.{v} div {_PACKED}, shiftleft(1L, 5 * (o.{v} % {_PACKED})), 0L)"
    # n: counts in the window, in fields of five bits; s: the sum of n log2 n over them; x enters, y leaves (-1 while the window fills)
    return f"""transform(array(transform(split({c}, ''), x -> ascii(x) - {_FIRST})), h -> aggregate(
        sequence(0, size(h) - 1),
        named_struct('n', array_repeat(0L, {_SYMBOLS // _PACKED + 1}), 's', 0L, 'first', -1, 'last', -1, 'most', if({c} rlike '^[0-9a-fA-F]+$', {most(HEX_BITS)}L, {most(WIDE_BITS)}L)),
        (a, i) -> transform(transform(array(named_struct('x', h[i], 'y', if(i < {WINDOW}, -1, h[greatest(0, i - {WINDOW})]))),
            o -> if(o.x = o.y, named_struct('n', a.n, 's', a.s), transform(array(named_struct('x', {count('x')}, 'y', if(o.y < 0, 0, {count('y')}))), m -> named_struct(
                'n', transform(a.n, (n, k) -> n + {one('x')} - if(o.y < 0, 0L, {one('y')})),
                's', a.s + {weight('m.x + 1')} - {weight('m.x')} + if(o.y < 0, 0L, {weight('greatest(0, m.y - 1)')} - {weight('m.y')})))[0])), z -> named_struct(
            'n', z.n, 's', z.s,
            'first', if(a.first < 0 and i >= {WINDOW - 1} and z.s <= a.most, i - {WINDOW - 1}, a.first),
            'last', if(i >= {WINDOW - 1} and z.s <= a.most, i - {WINDOW - 1}, a.last),
            'most', a.most))[0]))[0]"""


def _sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _looped(pattern: str) -> str:
    for part, same in IN_A_LOOP.items():
        pattern = pattern.replace(part, same)
    return pattern


def scanned(docs: DataFrame, text: str = "text", out: str = "spans", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``docs`` with ``out``: array of (start, rank, end), sorted; ranks number KINDS, ends are exclusive code points.

    Null and empty texts have no spans; a text of any length is scanned whole; spans of equal starts come by rank;
    repeated rows get equal spans; an empty table stays empty. No rows move and no Python runs. Other columns stay,
    whatever their names; a column already named ``out`` is replaced.
    """
    tag = "_s" + uuid.uuid4().hex[:8]
    t, none = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.array().cast("array<string>")
    parts = docs
    for rank, (k, p) in enumerate({"a": ASSIGN, "k": ACCESS, "h": HEX, "e": CANDIDATE}.items()):
        found, gaps = f"{tag}{k}", f"{tag}{k}g"
        parts = parts.withColumn(found, F.regexp_extract_all(t, F.lit(p), F.lit(0)))
        parts = parts.withColumn(gaps, F.when(F.size(found) > 0, F.split(t, p, -1)).otherwise(none))
        parts = parts.withColumn(f"{tag}{k}n", F.expr(f"zip_with(slice({gaps}, 1, size({found})), {found}, (x, y) -> length(x) + length(y))"))
        ends = f"if(size({found}) = 0, cast(array() as array<int>), {_running(f'{tag}{k}n', 's + x')})"
        parts = parts.withColumn(f"{tag}{k}s", F.expr(f"zip_with({ends}, {found}, (e, m) -> named_struct('start', e - length(m), 'rank', {rank}, 'end', e, 'm', m))"))
    harmless = " or ".join(f"x.m rlike {_sql_text(_looped(p))}" for p in allow) or "false"
    long_enough = f"length(regexp_extract(x.m, {_sql_text(ASSIGN)}, 2)) >= {ASSIGN_MIN}"
    plain = "x -> named_struct('start', x.start, 'rank', x.rank, 'end', x.end)"
    parts = parts.withColumn(f"{tag}b", F.expr(f"array_sort(transform(concat(filter({tag}as, x -> {long_enough}), {tag}ks, {tag}hs), {plain}))"))
    parts = parts.withColumn(f"{tag}c", F.expr(f"filter({tag}es, x -> x.m rlike {_sql_text(MIXED)} and not ({harmless}))"))
    # of each candidate the part that high-entropy windows cover, unless the patterns have it already
    found = f"""filter(transform({tag}c, x -> transform(array({_entropy('x.m')}), w ->
        named_struct('start', x.start + w.first, 'rank', if(w.first < 0, -1, 3), 'end', x.start + w.last + {WINDOW}))[0]),
        y -> y.rank >= 0 and not exists({tag}b, z -> z.start <= y.start and y.end <= z.end))"""
    parts = parts.withColumn(out, F.when(F.size(f"{tag}c") == 0, F.col(f"{tag}b")).otherwise(F.expr(f"array_sort(concat({tag}b, {found}))")))
    return parts.drop(*[c for c in parts.columns if c.startswith(tag)])


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mark``; ``n_chars``, if there, is counted anew.

    A null text stays null. Rows without secrets stay as they are, repeated rows stay repeated.
    """
    tag = "_r" + uuid.uuid4().hex[:8]
    spans, ends, cuts = f"{tag}s", f"{tag}e", f"{tag}c"
    done = scanned(docs, text, spans)
    done = done.withColumn(ends, F.transform(spans, lambda s: s["end"]))
    # a span begins behind all that ended before it, or lies in what is masked already
    done = done.withColumn(ends, F.expr(f"if(size({spans}) = 0, {ends}, {_running(ends, 'greatest(s, x)')})"))
    done = done.withColumn(cuts, F.expr(f"zip_with({spans}, zip_with(concat(array(0), slice({ends}, 1, greatest(0, size({ends}) - 1))), {ends}, (p, e) -> named_struct('p', p, 'e', e)), (s, z) -> named_struct('start', s.start, 'past', z.p, 'upto', z.e))"))
    # texts are cut block by block, as a place in a text is found by walking to it
    masked = f"""concat(array_join(transform(sequence(0, (size({cuts}) - 1) div {BLOCK}), k -> transform(array(slice({cuts}, k * {BLOCK} + 1, {BLOCK})), b ->
        transform(array(substring(`{text}`, b[0].past + 1, element_at(b, -1).upto - b[0].past)), own -> array_join(transform(b, c ->
            if(c.start >= c.past, concat(substring(own, c.past - b[0].past + 1, c.start - c.past), {_sql_text(mark)}), '')), ''))[0])[0]), ''),
        substring(`{text}`, element_at({cuts}, -1).upto + 1))"""
    done = done.withColumn(text, F.when(F.size(spans) == 0, F.col(f"`{text}`")).otherwise(F.expr(masked)))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(f"`{text}`").isNull(), F.col("n_chars")).otherwise(F.length(f"`{text}`").cast(docs.schema["n_chars"].dataType)))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda r: F.size(F.filter("spans", lambda s: s["rank"] == r)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["rank"] < 3)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
