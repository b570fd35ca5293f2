"""DuckDB SQL for the queries that SQL can express."""

from .quality_rules import MARKS, STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


QUALITY_RULES = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
keyed AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM windows),
often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM keyed),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM often WHERE c >= 2) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(regexp_extract_all(translate(lower(t), {_quoted(MARKS)}, '{" " * len(MARKS)}'), '{_WORD}'),
             lambda x: list_contains([{", ".join(map(_quoted, STOP_WORDS))}], x)))::BIGINT AS n_stop_words
  FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (
         n_symbols > 0.1::DOUBLE * n_words
         OR (n_words >= 30 AND n_stop_words < 0.02::DOUBLE * n_words)
         OR (n_words >= 30 AND n_dup_lines > 0.5::DOUBLE * n_lines)
         OR word_chars > 25::DOUBLE * n_words OR word_chars < 1.5::DOUBLE * n_words) AS kept,
       n_lines, n_stop_words
FROM b"""

#: Lengths of the template's control strings around a turn: 15, 13 and 7 around system, user and assistant, and 16
#: around other roles, which are named there. One backslash is added to each control string in a text.
_ESCAPED = r"[<\[]\\*(<SYS>>|</SYS>>|/INST\]|/TURN\]|INST\]|TURN\]|/s>|s>|:\])"
CHAT_FORMAT = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{_ESCAPED}'))
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 16 + length(role) + len(regexp_extract_all(role, '{_ESCAPED}')) END AS chars
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id"""

WARC = """
SELECT *, row_number() OVER (ORDER BY url_key, captured_at, page_id) AS history_rank FROM (
WITH p AS (
  SELECT page_id, lower(coalesce(url, '')) AS u, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to,
       array_to_string(list_reverse(string_split(regexp_extract(u, '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '.')), ',') || ')'
         || regexp_extract(u, '^(?:[a-z][a-z0-9+.-]*://[^/?#]*)?([^#]*)', 1) AS url_key,
       strftime(make_timestamp((1704067200 + coalesce(page_id, 0)) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
FROM f)"""

NGRAM_LM = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS w, unnest(list_prepend(NULL, w[:-2])) AS before FROM d),
n AS (SELECT count(*) AS total FROM p),
own AS (SELECT doc_id, count(*) AS n_words FROM p GROUP BY doc_id),
u AS (SELECT w, count(*) AS c FROM p GROUP BY w),
b AS (SELECT before, w, count(*) AS c FROM p WHERE before IS NOT NULL GROUP BY before, w),
ud AS (SELECT doc_id, w, count(*) AS c FROM p GROUP BY doc_id, w),
bd AS (SELECT doc_id, before, w, count(*) AS c FROM p WHERE before IS NOT NULL GROUP BY doc_id, before, w),
r AS (
  SELECT p.doc_id, p.before, u.c - ud.c AS c1, u0.c - ud0.c AS c0, b.c - bd.c AS c2, n.total - own.n_words AS others
  FROM p CROSS JOIN n JOIN own ON own.doc_id = p.doc_id
  JOIN u ON u.w = p.w JOIN ud ON ud.doc_id = p.doc_id AND ud.w = p.w
  LEFT JOIN u u0 ON u0.w = p.before LEFT JOIN ud ud0 ON ud0.doc_id = p.doc_id AND ud0.w = p.before
  LEFT JOIN b ON b.before = p.before AND b.w = p.w LEFT JOIN bd ON bd.doc_id = p.doc_id AND bd.before = p.before AND bd.w = p.w),
s AS (
  SELECT doc_id, before IS NOT NULL AND c2 = 0 AS backed,
         CASE WHEN c2 > 0 THEN ln(c2::DOUBLE / c0)
              ELSE CASE WHEN before IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END
                + CASE WHEN c1 > 0 THEN ln(c1::DOUBLE / greatest(others, 1)) ELSE ln(1::DOUBLE / (others + 1)) END END AS x
  FROM r)
SELECT d.doc_id, coalesce(count(x), 0) AS n_words, round(coalesce(avg(x), 0), 6) AS mean_log_score,
       coalesce(sum(backed::INT), 0)::BIGINT AS n_backoffs
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id)::INT AS positive_rank
  FROM s WHERE same QUALIFY positive_rank <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
       id AS negative_id, positive_score, score AS negative_score, positive_rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35),
k AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS k FROM s),
r AS (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS c FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM r WHERE c > 1),
b AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
x AS (
  SELECT b.doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY b.i) FILTER (WHERE g.i IS NULL) AS kept
  FROM b LEFT JOIN g ON g.doc_id = b.doc_id AND g.i = b.i GROUP BY b.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x ON x.doc_id = d.doc_id"""

COLLOCATIONS = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i
  FROM w, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE len(w) >= k),
f AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
u AS (
  SELECT c.lang, c.phrase, c.k, a, w, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT u.lang, u.phrase, a, cut, x.f AS l, y.f AS r, n,
         ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM u JOIN t ON t.lang = u.lang
  JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY score, cut) = 1),
i AS (
  SELECT lang, array_to_string(w[b:b + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, k, m, unnest(range(1, k - m + 2)) AS b FROM c, (VALUES (2), (3), (4)) v(m) WHERE m < k) GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank,
       s.phrase, a, l, r, n, score, cut::BIGINT AS cut
FROM s LEFT JOIN i ON i.lang = s.lang AND i.phrase = s.phrase
WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY rank <= 2000"""
