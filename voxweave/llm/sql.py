"""SQL twins of the corpus queries, over whole tables. A twin follows the definition of the result, not the method."""

from __future__ import annotations

from .quality_hosts import MOST_DUP_LINES, MOST_SYMBOLS, WORD_LENGTH
from .quality_hosts import RULES as FURTHER
from .secret_scan import BASE, RULES

_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LAST = 9223372036854775807  # stands for a null doc_id


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tokens(table: str, text: str, pattern: str, columns: str, name: str) -> str:
    """Tables ``name``_row (one row per input row, with its number r) and ``name`` (r, i, word)."""
    return f"""{name}_row AS MATERIALIZED (
        SELECT row_number() OVER () AS r, {columns}, coalesce(regexp_extract_all({text}, '{pattern}'), []) AS ws FROM {table}),
    {name} AS MATERIALIZED (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM {name}_row)"""


def _gram(k: int) -> str:
    """The k words from a token on, null beyond the end of the text."""
    return " || ' ' || ".join(["word", *[f"lead(word, {j}) OVER d" for j in range(1, k)]])


def _grams(k: int, source: str) -> str:
    return f"SELECT r, i, {_gram(k)} AS g FROM {source} WINDOW d AS (PARTITION BY r ORDER BY i)"


OP1 = f"""
WITH {_tokens("documents", "text", _SPACED, "doc_id", "tok")},
win AS MATERIALIZED (SELECT * FROM ({_grams(13, "tok")}) WHERE g IS NOT NULL),
first AS (SELECT g, min(doc_id) AS lo FROM win JOIN tok_row USING (r) GROUP BY g),
bad AS (SELECT r, i FROM win JOIN first USING (g) JOIN tok_row USING (r) WHERE lo < coalesce(doc_id, {_LAST})),
marked AS (
    SELECT r, i, word, bool_or(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
    FROM (SELECT t.r, t.i, t.word, b.i IS NOT NULL AS hit FROM tok t LEFT JOIN bad b ON t.r = b.r AND t.i = b.i))
SELECT any_value(doc_id) AS doc_id, count(word) AS n_words, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM tok_row LEFT JOIN marked USING (r) GROUP BY r
"""

_EACH = " UNION ALL ".join(f"SELECT r, i, {k} AS n, g FROM ({_grams(k, 'tok')}) WHERE g IS NOT NULL" for k in range(1, 11))

OP2 = f"""
WITH {_tokens("documents", _lower("text"), _ALNUM, "doc_id", "tok")},
{_tokens("benchmark", _lower("text"), _ALNUM, "CAST(item_id AS VARCHAR) AS item_id", "own")},
windows AS (
    SELECT DISTINCT r, 10 AS n, g FROM ({_grams(10, "own")}) WHERE g IS NOT NULL
    UNION ALL
    SELECT r, len(ws) AS n, array_to_string(ws, ' ') AS g FROM own_row WHERE len(ws) BETWEEN 1 AND 9),
item_windows AS (SELECT DISTINCT item_id, n, g FROM windows JOIN own_row USING (r)),
hits AS MATERIALIZED (SELECT s.r, s.i, s.n, w.item_id FROM ({_EACH}) s JOIN item_windows w ON s.n = w.n AND s.g = w.g),
ends AS (SELECT r, i, max(i + n) AS stop FROM hits GROUP BY r, i),
covered AS (
    SELECT r, count(*) FILTER (reach > i) AS n_hit FROM (
        SELECT t.r, t.i, max(e.stop) OVER (PARTITION BY t.r ORDER BY t.i) AS reach
        FROM tok t LEFT JOIN ends e ON t.r = e.r AND t.i = e.i) GROUP BY r),
listed AS (
    SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM tok_row LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""

def _prior(rule: str) -> str:
    """prior_<rule>(mean, strength): the beta distribution of the hosts' failure rates of a rule, by moments."""
    return f"""moments_{rule} AS (
    SELECT sum(n) AS total, sum(n * n) AS squares, count(*) AS k, sum(f_{rule}) / sum(n) AS mean, sum(f_{rule} * f_{rule} / n) AS npp FROM hosts),
spread_{rule} AS (
    SELECT mean, mean * (1 - mean) AS noise, (npp - total * mean * mean - (k - 1) * mean * (1 - mean))
           / nullif(total - squares / total - (k - 1), 0) AS spread FROM moments_{rule}),
prior_{rule} AS (
    SELECT mean AS mean_{rule}, CASE WHEN spread > 0 THEN greatest(1.0, least(1e9, noise / spread - 1)) ELSE 1e9 END AS strength_{rule} FROM spread_{rule})"""


OP3 = rf"""
WITH {_tokens("documents", "text", _SPACED, "doc_id, source, coalesce(text, '') AS text", "tok")},
twice AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM ({_grams(3, "tok")}) WHERE g IS NOT NULL) WHERE n > 1),
repeated AS (
    SELECT r, count(*) FILTER (hit) AS n_repeat_words FROM (
        SELECT t.r, bool_or(w.i IS NOT NULL) OVER (PARTITION BY t.r ORDER BY t.i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit
        FROM tok t LEFT JOIN twice w ON t.r = w.r AND t.i = w.i) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_SPACED}')) AS ls FROM tok_row),
measured AS MATERIALIZED (
    SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
           CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
           strlen(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_bytes, len(ls) AS n_lines,
           CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
           len(ws) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(ws) AS base_failed
    FROM tok_row LEFT JOIN repeated USING (r) LEFT JOIN lines USING (r)),
judged AS MATERIALIZED (
    SELECT *, coalesce(n_symbols / nullif(n_words, 0), 0) / {MOST_SYMBOLS}::DOUBLE AS over_symbols, coalesce(n_dup_lines / nullif(n_lines, 0), 0) / {MOST_DUP_LINES}::DOUBLE AS over_dup_lines,
           greatest(CASE WHEN word_bytes < 2 * word_chars THEN coalesce(word_chars / nullif(n_words, 0), 0) / {WORD_LENGTH[1]}::DOUBLE ELSE 0 END,
                    {WORD_LENGTH[0]}::DOUBLE * coalesce(n_words / nullif(word_chars, 0), 0)) AS over_word_length FROM measured),
hosts AS (
    SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS f_base,
           {", ".join(f"CAST(count(*) FILTER (over_{r} > 1) AS DOUBLE) AS f_{r}" for r in FURTHER)}
    FROM judged WHERE source IS NOT NULL GROUP BY source),
{", ".join(map(_prior, ("base", *FURTHER)))},
rates AS (
    SELECT source, {", ".join(f"(f_{r} + mean_{r} * strength_{r}) / (n + strength_{r}) AS rate_{r}" for r in ("base", *FURTHER))}
    FROM hosts, {", ".join(f"prior_{r}" for r in ("base", *FURTHER))})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(rate_base, 0) < 0.9
       AND {" AND ".join(f"coalesce(rate_{r}, 0) < 0.9 AND over_{r} <= 1 - coalesce(rate_{r}, 0) / 2" for r in FURTHER)} AS kept
FROM judged LEFT JOIN rates USING (source)
"""

OP7 = f"""
WITH RECURSIVE {_tokens("documents", _lower("text"), _SPACED, "doc_id", "tok")},
sets AS MATERIALIZED (
    SELECT DISTINCT r, g FROM ({_grams(5, "tok")}) WHERE g IS NOT NULL
    UNION ALL
    SELECT r, array_to_string(ws, ' ') AS g FROM tok_row WHERE len(ws) BETWEEN 1 AND 4),
keyed AS MATERIALIZED (SELECT r, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS key FROM sets GROUP BY r),
classes AS MATERIALIZED (SELECT min(r) AS c, any_value(n) AS n, key FROM keyed GROUP BY key),
items AS MATERIALIZED (SELECT c, n, g FROM classes JOIN sets ON c = r),
common AS (SELECT x.c AS a, y.c AS b, x.n AS na, y.n AS nb, count(*) AS k FROM items x JOIN items y ON x.g = y.g AND x.c < y.c GROUP BY ALL),
link AS MATERIALIZED (
    SELECT a, b FROM common WHERE 100 * k >= 85 * (na + nb - k) UNION ALL
    SELECT b, a FROM common WHERE 100 * k >= 85 * (na + nb - k)),
reach AS (SELECT c AS node, c AS root FROM classes UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node),
lowest AS (SELECT c, min(doc_id) AS low FROM keyed JOIN tok_row USING (r) JOIN classes USING (key) GROUP BY c),
named AS (SELECT root AS c, min(low) AS component_id FROM reach JOIN lowest ON reach.node = lowest.c GROUP BY root),
found AS (SELECT r, keyed.n, component_id FROM keyed JOIN classes USING (key) JOIN named USING (c))
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id,
       n IS NULL OR doc_id IS NOT DISTINCT FROM component_id AS kept
FROM tok_row LEFT JOIN found USING (r)
"""


def _secrets(place: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Matches of a rule; a match starts after all matches and all that lies between them before it."""
    p = pattern.replace("'", "''")
    before = "OVER (PARTITION BY r ORDER BY j)"
    return f"""SELECT r, {place} AS place, '{kind}' AS kind, pos, pos + length(m) AS stop FROM (
        SELECT r, m, v, sum(length(b) + length(m)) {before} - length(m) AS pos FROM (
            SELECT r, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(regexp_extract_all(text, '{p}', {group})) AS v,
                   unnest(string_split_regex(text, '{p}')[:-2]) AS b, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS j
            FROM doc WHERE regexp_matches(text, '{p}'))) WHERE length(v) >= {least}"""


OP8 = f"""
WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
span AS ({" UNION ALL ".join(_secrets(i, *rule) for i, rule in enumerate(RULES))}),
named AS (SELECT r, pos, place, concat_ws(':', kind, CAST(pos AS BIGINT), CAST(stop AS BIGINT)) AS s FROM span)
SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(*) FILTER (place = {i}) AS n_{kind}" for i, kind in enumerate(BASE))},
       sha256(coalesce(string_agg(s, ',' ORDER BY pos, place) FILTER (place < {len(BASE)}), '')) AS base_sha256,
       coalesce(string_agg(s, ',' ORDER BY pos, place), '') AS spans
FROM doc LEFT JOIN named USING (r) GROUP BY r
"""

_CRC = """crc_step(byte, k, c) AS (
    SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) g(i) UNION ALL
    SELECT byte, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY byte) AS entries FROM crc_step WHERE k = 8)"""


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, with crc_table at hand."""
    step = "lambda c, x: xor(c >> 8, entries[(xor(c, x) & 255) + 1])"
    bytes_of = f"[CAST('0x' || substr(hex({text}), 2 * i - 1, 2) AS BIGINT) FOR i IN range(1, strlen({text}) + 1)]"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_of}), {step}), 4294967295)"


def _product_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd's rounds unrolled. d(r, p, k): squared distance of part p of vector r to entry k."""
    far = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
            SELECT r, p, arg_min(k, [d, k]) AS k, min(d) AS d FROM (SELECT x.r, x.p, c.k, {far} AS d FROM part x JOIN book{i} c USING (p)) GROUP BY r, p)""")
        if i < rounds:
            steps.append(f"""mean{i} AS (
                SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (
                    SELECT p, k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
                        SELECT p, k, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM near{i} JOIN part USING (r, p)) GROUP BY p, k, j) GROUP BY p, k),
            book{i + 1} AS MATERIALIZED (SELECT p, k, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN mean{i} m USING (p, k))""")
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, [CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
    SELECT r, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v FROM kept, (SELECT unnest(range({parts})) AS p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS k, v FROM part WHERE r <= {entries}),
{", ".join(steps)},
coded AS (SELECT r, string_agg(lower(printf('%02x', k)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest
"""


OP11 = _product_codes()

OP13 = f"""
WITH RECURSIVE {_tokens("documents", _lower("text"), _ALNUM, "doc_id", "tok")},
{_tokens("benchmark", _lower("text"), _ALNUM, "item_id", "own")},
{_CRC},
hashed AS MATERIALIZED (SELECT word, {_crc32("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM (SELECT word FROM tok UNION ALL SELECT word FROM own)), crc_table),
source AS (SELECT bucket, count(*) AS n FROM tok JOIN hashed USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS n FROM own JOIN hashed USING (word) GROUP BY bucket),
size AS (SELECT (SELECT coalesce(sum(n), 0) FROM source) AS s, (SELECT coalesce(sum(n), 0) FROM target) AS t),
gain AS (
    SELECT bucket, CAST(floor(1000 * ln((coalesce(b.n, 0) + 1.0::DOUBLE) * (s + 10000) / ((a.n + 1.0::DOUBLE) * (t + 10000)))) AS BIGINT) AS gain
    FROM source a LEFT JOIN target b USING (bucket), size),
weighed AS (SELECT r, CAST(sum(gain) AS BIGINT) AS total, count(*) AS n FROM tok JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (
    SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
           CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
    FROM tok_row LEFT JOIN weighed USING (r)),
noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features DESC) AS place,
           count(*) OVER (PARTITION BY n_features >= 20) AS fit FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM ranked
"""

SQL = {"op1_substring_dedup": OP1, "op2_decontaminate": OP2, "op3_quality_hosts": OP3, "op7_near_dedup": OP7,
       "op8_secret_scan": OP8, "op11_vector_codes": OP11, "op13_importance": OP13}
