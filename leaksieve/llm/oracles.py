"""DuckDB SQL of the operators' queries that SQL can say."""

from __future__ import annotations

from itertools import permutations

WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def _crc_table() -> list[int]:
    """The byte table of the CRC-32 polynomial in reflected form."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


EXACT_DEDUP = rf"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{WS}', ' ', 'g') AS norm FROM documents),
     g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)"""


def _shard(n: int) -> str:
    score = "-1.0 / ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || s), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
    return f"(SELECT arg_max(s, ({score}, s)) FROM unnest(range(0, {n})) u(s))"


SHARDING = f"""
WITH t AS (SELECT {_crc_table()} AS tbl),
     d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) + 1 AS size,
                  xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
                                  lambda c, b: xor(c >> 8, tbl[CAST((xor(c, b) & 255) + 1 AS INTEGER)]), 4294967295), 4294967295) AS text_crc32,
                  {_shard(16)} AS shard, {_shard(17)} AS grown_shard FROM documents, t)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, CAST(grown_shard AS INTEGER) AS grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat_ws(':', doc_id, size, text_crc32)), 1, 3), doc_id, text_crc32, size) - 1 AS slot FROM d"""

QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM documents),
     win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS x FROM d, unnest(range(1, len(w) - 6)) u(i)),
     rep AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, x) AS n FROM win) WHERE n > 1),
     cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, unnest(range(0, 8)) u(k) GROUP BY r),
     b AS (SELECT d.r, doc_id, text, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines,
                  length(regexp_replace(text, '\P{{L}}+', '', 'g')) AS letters FROM d LEFT JOIN cov USING (r)),
     f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT n_symbols > n_words * 0.2 AND NOT n_dup_lines > n_lines * 0.6 AND word_chars / n_words BETWEEN 2.0 AND 15.0
       AND NOT len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > n_words * 0.3 AND NOT letters * 2 < word_chars AS kept FROM f"""

_LUHN = "list_sum(list_transform(range(1, length(dg) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(dg[length(dg) + 1 - i] AS INTEGER) ELSE CAST(dg[length(dg) + 1 - i] AS INTEGER) * 2 - CASE WHEN dg[length(dg) + 1 - i] > '4' THEN 9 ELSE 0 END END)) % 10 = 0"
_MOD97 = """list_reduce(list_transform(string_split(substr(s, 5) || substr(s, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INTEGER) ELSE ascii(c) - 55 END), lambda a, v: CASE WHEN v > 9 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END, 0) = 1"""
_SSN = "NOT regexp_matches(s, '^(000|666|9)|-00-|-0000$')"
_ROUTING = "list_sum(list_transform(range(1, 10), lambda i: CAST(s[i] AS INTEGER) * [3, 7, 1][CAST((i - 1) % 3 AS INTEGER) + 1])) % 10 = 0 AND s <> '000000000'"
#: kind, pattern, test, score in hundredths, context, and whether its spans stay whatever their score
_PII_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 80, "mail|contact|courriel|correo", True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(s, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || ltrim(p, '0') AS BIGINT) > 255)) = 0", 70, r"\bip\b|host|server|addr", True),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length(dg) BETWEEN 12 AND 19 AND {_LUHN}", 70, "card|visa|credit|karte|carte|tarjeta", True),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(dg) BETWEEN 9 AND 15", 70, "phone|call|tel|mobile|fax", True),
    ("iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", _MOD97, 60, "iban|bank|konto|cuenta|compte|account", False),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", _SSN, 40, r"\bssn\b|social security", False),
    ("routing", r"\b[0-9]{9}\b", _ROUTING, 40, r"\baba\b|routing|bank", False),
)
_NEAR = "lower(substr(text, greatest(CAST(b AS BIGINT) - 39, 1), least(b, 40)) || ' ' || substr(text, e + 1, 40))"
_PII_SPANS = " UNION ALL ".join(
    f"""SELECT r, kind_no, kind, b, e, score FROM (SELECT *, {score} + CASE WHEN regexp_matches(near, '{context}') THEN 20 ELSE 0 END - CASE WHEN regexp_matches(near, 'example|sample|dummy|version|checksum') THEN 20 ELSE 0 END AS score FROM (
        SELECT *, {_NEAR} AS near FROM (SELECT r, text, {n} AS kind_no, '{name}' AS kind, a AS b, a + length(s) AS e, s FROM (
        SELECT r, text, m[i] AS s, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
        FROM (SELECT r, text, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM d WHERE regexp_matches(text, '{pattern}')), unnest(range(1, len(m) + 1)) u(i)) x
        WHERE (SELECT {test} FROM (SELECT regexp_replace(s, '[^0-9]', '', 'g') AS dg))))) WHERE {"true" if always else "score >= 50"}"""
    for n, (name, pattern, test, score, context, always) in enumerate(_PII_KINDS)
)
_JOINED = "coalesce(string_agg({x}, ',' ORDER BY b, kind_no, e){f}, '')"
_SPAN = "kind || ':' || b || ':' || e"
PII = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), s AS ({_PII_SPANS})
SELECT doc_id, {", ".join(f"count(kind) FILTER (kind = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone"))},
       sha256({_JOINED.format(x=_SPAN, f=" FILTER (kind_no < 4)")}) AS base_sha256, {_JOINED.format(x=_SPAN, f="")} AS spans, {_JOINED.format(x="score", f="")} AS scores
FROM d LEFT JOIN s USING (r) GROUP BY r, doc_id"""

# every row against every order: the filter that removes it is the first in the order that it fails
_FAILS = "CASE substr(o, {k}, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END"
_FIRST = "CASE " + " ".join(f"WHEN {_FAILS.format(k=k)} THEN {k}" for k in range(1, 6)) + " ELSE 6 END"
FILTER_AUDIT = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
     y AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
     f AS (SELECT part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
                  coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN y ON w.doc_id = y.doc_id),
     n AS (SELECT part, a, b, c, d, e, good, toxic, count(*) AS n FROM f GROUP BY ALL),
     o AS (SELECT unnest({["".join(p) for p in permutations("ABCDE")]}) AS o),
     x AS (SELECT *, {_FIRST} AS first FROM n, o),
     s AS (SELECT part, o, k, substr(o, k, 1) AS filter, CAST(sum(CASE WHEN first > k THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN first = k THEN n ELSE 0 END) AS BIGINT) AS removed,
                  CAST(sum(CASE WHEN first < k AND {_FAILS.format(k="k")} THEN n ELSE 0 END) AS BIGINT) AS redundant,
                  CAST(sum(CASE WHEN CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) + CAST(e AS INT) = 1 AND {_FAILS.format(k="k")} THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
                  CAST(sum(CASE WHEN first = k AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN first = k AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
           FROM x, unnest(range(1, 6)) u(k) GROUP BY part, o, k)
SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM s"""

HARD_NEGATIVES = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score FROM r AS a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
     p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
     n AS (SELECT p.*, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
           FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

_CONTROLS = r"(?:<\\*(?:s>|/s>|\|endoftext\|>)|\[\\*/?(?:SYS|INST|TURN|ROLE)\])"
_ESCAPED = f"(length({{x}}) + len(regexp_extract_all({{x}}, '{_CONTROLS}')))"
CHAT_FORMAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
     g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
                  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
                  CAST(sum({_ESCAPED.format(x="text")} + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 26 + {_ESCAPED.format(x="role")} END) AS BIGINT) AS formatted_chars
           FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

ORACLE_SQL = {"op13_chat_format": CHAT_FORMAT, "op12_hard_negatives": HARD_NEGATIVES, "op11_filter_audit": FILTER_AUDIT, "op3_sharding": SHARDING, "op4_quality_rules": QUALITY_RULES, "op6_pii": PII, "op9_exact_dedup": EXACT_DEDUP}
