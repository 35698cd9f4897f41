"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from relstream.llm.chat import op7_chat
from relstream.llm.dart_minhash import op10_near_dedup
from relstream.llm.decontamination import op1_decontamination
from relstream.llm.html_extract import op2_html_text
from relstream.llm.media_sniff import op4_media
from relstream.llm.quality import op5_quality
from relstream.llm.secrets import ALLOW, HEX_BITS, WIDE_BITS, WINDOW, op6_secrets
from relstream.llm.toxicity import op9_toxicity
from relstream.llm.unigram_codec import op3_sentencepiece
from relstream.llm.url_filter import op8_url_filter

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_html_text": op2_html_text,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_media": op4_media,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_chat": op7_chat,
    "op8_url_filter": op8_url_filter,
    "op9_toxicity": op9_toxicity,
    "op10_near_dedup": op10_near_dedup,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT item, i AS j, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS g
       FROM b, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) t(i) WHERE len(ws) > 0),
dw AS (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
       FROM d, (SELECT DISTINCT n FROM bw) k, unnest(range(1, len(ws) - n + 2)) t(i)),
hits AS (SELECT rid, i, j, n, item FROM dw JOIN bw USING (n, g)),
hit_words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) t(p) GROUP BY rid),
hit_items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY rid),
runs AS (SELECT rid, item, i, n, i - row_number() OVER (PARTITION BY rid, item, i - j ORDER BY i) AS island, i - j AS diagonal FROM hits),
spans AS (SELECT rid, item, min(i) AS i, count(*) - 1 + any_value(n) AS len FROM runs GROUP BY rid, item, diagonal, island),
best AS (SELECT rid, max(len) AS longest, arg_max(i, struct_pack(a := len, b := -i)) - 1 AS longest_at FROM spans GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated,
       CAST(coalesce(longest, 0) AS BIGINT) AS longest, CAST(longest_at AS BIGINT) AS longest_at
FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid) LEFT JOIN best USING (rid)
"""

_ESCAPED = "replace(replace(replace({}, '\\', '\\\\'), '[', '\\['), '<', '\\<')"

_OP7 = f"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length({_ESCAPED.format('text')}) + 4
                ELSE length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + 14 END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

_KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = f"({_KEYWORD})[\"\'\']?\\x20*[:=]\\x20*[\"\'\']?([A-Za-z0-9+/_.=-]+)"


def _places(rank: int, pattern: str, keep: str = "true") -> str:
    """SQL: matches of a pattern with their places, from the pieces between them."""
    return f"""SELECT rid, {rank} AS rank, m, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM (
    SELECT rid, ms[i] AS m, list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d) p, unnest(range(1, len(ms) + 1)) u(i)) WHERE {keep}"""


_HARMLESS = " OR ".join(f"regexp_matches(m, '{p}')" for p in ALLOW)

_OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_places(0, _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6")}
    UNION ALL {_places(1, "AKIA[A-Z0-9]+", "length(m) >= 20")} UNION ALL {_places(2, "[0-9a-f]+", "length(m) >= 24")}),
candidates AS ({_places(3, "[A-Za-z0-9+/_=-]{20,}", f"regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT ({_HARMLESS})")}),
dense AS (SELECT rid, s + min(w) AS s, s + max(w) + {WINDOW} AS e FROM candidates c, unnest(range(0, length(m) - {WINDOW - 1})) u(w)
    WHERE list_entropy(string_split(substring(m, w + 1, {WINDOW}), '')) >= CASE WHEN regexp_matches(m, '^[0-9a-fA-F]+$') THEN {HEX_BITS} ELSE {WIDE_BITS} END
    GROUP BY rid, m, c.s),
spans AS (SELECT rid, rank, s, e FROM base UNION ALL
    SELECT rid, 3, s, e FROM dense x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = x.rid AND b.s <= x.s AND x.e <= b.e)),
named AS (SELECT rid, rank, s, (['assign', 'access', 'hex', 'entropy'])[rank + 1] || ':' || s || ':' || e AS one FROM spans),
lists AS (SELECT rid, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS k, count(*) FILTER (rank = 2) AS h,
    string_agg(one, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(one, ',' ORDER BY s, rank) AS everything FROM named GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(everything, '') AS spans FROM d LEFT JOIN lists USING (rid)
"""

_OP10 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
sh AS (SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(2, len(ws) - 3))) u(i) WHERE len(ws) > 0
    UNION ALL SELECT rid, chr(1) || t FROM d WHERE len(ws) = 0),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
near AS (SELECT x.rid AS a, y.rid AS b FROM sh x JOIN sh y ON x.g = y.g AND x.rid <> y.rid JOIN n nx ON nx.rid = x.rid JOIN n ny ON ny.rid = y.rid
    GROUP BY ALL HAVING 5 * count(*) >= 4 * (any_value(nx.n) + any_value(ny.n) - count(*))),
reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b),
class AS (SELECT reach.a AS rid, min(d.doc_id) AS class_id FROM reach JOIN d ON d.rid = reach.b GROUP BY reach.a)
SELECT doc_id, class_id, doc_id IS NOT DISTINCT FROM class_id AS kept FROM d JOIN class USING (rid)
"""

ORACLES: dict[str, str] = {
    "op6_secrets": _OP6,
    "op7_chat": _OP7,
    "op10_near_dedup": _OP10,
    "op1_decontamination": _OP1,
}
