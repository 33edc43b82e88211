"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from postlens.llm.secret_scan import (
    CHARS_PER_JOINT,
    KINDS,
    MIN_ASSIGNED,
    MIN_ENTROPY,
    MIN_OPAQUE,
    PATTERNS,
)

# mixed and opaque strings are runs of one pattern
_QUOTED = [p.replace("'", "''") for p in (*PATTERNS, PATTERNS[-1])]
_TIMES = "(length(value) - length(replace(value, c, '')))"
_ENTROPY = f"""log2(length(value)) - list_sum(list_transform(list_distinct(string_split(value, '')),
      lambda c: {_TIMES} * log2({_TIMES}))) / length(value)"""
_HAS = lambda c: f"regexp_matches(value, '{c}')"
_JOINTS = "(length(value) - length(translate(value, '+/_-', '')))"
_TESTS = {
    0: f"length(regexp_extract(value, '{_QUOTED[0]}', 2)) >= {MIN_ASSIGNED}",
    7: f"""length(value) < {MIN_OPAQUE} AND {_JOINTS} = 0 AND {_HAS('[0-9]')} AND {_HAS('[a-z]')} AND {_HAS('[A-Z]')}
      AND {_ENTROPY} >= {MIN_ENTROPY}""",
    8: f"""length(value) >= {MIN_OPAQUE} AND {_HAS('[0-9]')} AND {_HAS('[A-Za-z]')}
      AND {_JOINTS} * {CHARS_PER_JOINT} <= length(value)""",
}


def _spans(kind: int) -> str:
    """Spans of one kind: a match starts after the pieces and the matches before it."""
    pattern = _QUOTED[kind]
    return f"""
    SELECT n, {kind} AS kind, {0 if kind < 3 else 1 if kind < 7 else 2} AS rank,
           gap + before AS start, gap + before + size AS stop, value FROM (
      SELECT n, value, length(value) AS size,
             sum(length(piece)) OVER (PARTITION BY n ORDER BY nth) AS gap,
             coalesce(sum(length(value)) OVER (
               PARTITION BY n ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT n, unnest(regexp_extract_all(text, '{pattern}')) AS value,
                   unnest(regexp_split_to_array(text, '{pattern}')) AS piece,
                   generate_subscripts(regexp_split_to_array(text, '{pattern}'), 1) AS nth FROM docs))
    WHERE value IS NOT NULL AND {_TESTS.get(kind, "true")}"""


_NAMES = f"list_value({', '.join(repr(k) for k in KINDS)})[kind + 1]"

SECRETS = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, source, lang, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(_spans(k) for k in range(len(KINDS)))}),
every_span AS (
  SELECT * FROM found o WHERE rank = 0 OR NOT EXISTS (
    SELECT 1 FROM found b WHERE b.n = o.n AND b.start < o.stop AND o.start < b.stop
      AND (b.rank = 0 OR b.rank = 1 AND o.rank = 2))),
spans AS (
  SELECT s.*, source, lang, CASE WHEN kind = 0 THEN regexp_extract(value, '{_QUOTED[0]}', 2) ELSE value END AS secret
  FROM every_span s JOIN docs USING (n)),
owned AS (
  SELECT secret, count(DISTINCT coalesce(source, chr(0))) AS owners,
         count(DISTINCT (coalesce(source, chr(0)), coalesce(lang, chr(0)))) AS repositories
  FROM spans GROUP BY secret),
judged AS (
  SELECT n, kind, start, stop, owners <= 1 AND repositories <= 3 AS live FROM spans JOIN owned USING (secret)),
said AS (
  SELECT n,
    count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex,
    string_agg({_NAMES} || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS base_spans,
    string_agg({_NAMES} || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
  FROM judged GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM docs LEFT JOIN said USING (n)
"""

CHATS = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
said AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS everything,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(replace(replace(role, '%', '%25'), '<|', '%3C|')) + 2 * (length(role) - length(replace(role, chr(10), '')))
        + length(replace(replace(text, '%', '%25'), '<|', '%3C|'))
        + length('<|im_start|><|im_end|>') + 2) AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(everything) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM said
"""

_WORD = r"[^\x20\x09-\x0D]+"

COMPONENTS = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[]
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingles a JOIN shingles b USING (s)
  WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * i >= 75 * (p.n + q.n - i)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reached r JOIN both_ways b ON r.y = b.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least_reached, doc_id)) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id)
  LEFT JOIN (SELECT x AS doc_id, min(y) AS least_reached FROM reached GROUP BY x) USING (doc_id)
"""

# The given pages have one layout: an article of paragraphs, with few character references.
ARTICLES = r"""
WITH told AS (SELECT page_id, url, regexp_replace(regexp_replace(
    regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS t FROM pages)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (SELECT page_id, url,
  trim(regexp_replace(regexp_replace(replace(t, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM told)
"""

# The checksum of the decimal id, byte by byte and bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
    lambda a, x: list_reduce(range(8), lambda t, i: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384::BIGINT) ELSE t >> 1 END,
      xor(a, x)), 4294967295::BIGINT), 4294967295::BIGINT)"""

RUNS = f"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, {_CRC} AS h FROM documents),
chosen AS (SELECT doc_id, w, len(w) AS n, h, (h // 10) % greatest(len(w), 1) AS a, (h // 10) % 8 AS e FROM words),
planted AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n),
    lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + e)) END]) ELSE w END AS w FROM chosen),
tokens AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM planted),
equal AS (SELECT x.doc_id, y.pos - x.pos AS q, x.pos AS i FROM tokens x JOIN tokens y
  ON x.doc_id = y.doc_id AND x.word = y.word AND y.pos > x.pos AND 3 * (y.pos - x.pos) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island
  HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS nth FROM runs),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT t.doc_id, pos FROM tokens t JOIN runs r
  ON t.doc_id = r.doc_id AND pos >= start + period AND pos < start + length),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM tokens ANTI JOIN dropped USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM planted LEFT JOIN listed USING (doc_id) LEFT JOIN (SELECT * FROM ranked WHERE nth = 1) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

QUALITY_COUNTS = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
repeats AS (SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS n FROM lines
  WHERE regexp_matches(line, '{_WORD}') GROUP BY ALL) GROUP BY doc_id),
tokens AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS pos FROM docs),
windows AS (SELECT doc_id, pos, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
twice AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows WHERE c IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT pos + d) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
counted AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs LEFT JOIN repeats USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
"""

MIXING_TARGETS = f"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
sources AS (SELECT source, sum(size) AS total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][number % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * total AS cap FROM sources),
-- a source stands at its cap if filling all sources up to its level of words per weight takes no more than there is
levels AS (SELECT a.source, a.cap, a.weight, (SELECT sum(least(b.cap, b.weight * (a.cap / a.weight))) FROM weighed b) AS needed FROM weighed a),
capped AS (SELECT *, needed <= 1.5 * (SELECT sum(total) FROM weighed) AS at_cap FROM levels),
rest AS (SELECT (1.5 * (SELECT sum(total) FROM weighed) - coalesce(sum(cap) FILTER (at_cap), 0.0)) /
    sum(weight) FILTER (NOT at_cap) AS level FROM capped)
SELECT doc_id, size, total::BIGINT AS source_size, round(CASE WHEN at_cap THEN capped.cap ELSE level * capped.weight END, 4) AS target
FROM sized JOIN sources ON sized.source IS NOT DISTINCT FROM sources.source
  JOIN capped ON capped.source IS NOT DISTINCT FROM sources.source, rest
"""

FINGERPRINT_EDITS = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
following AS (SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next FROM docs WINDOW o AS (ORDER BY doc_id))
SELECT doc_id, length(text)::BIGINT AS n_chars,
  sha256(left(text, length(text) - length(text) // 4) || left(next, length(text) // 4)) AS edited_sha256 FROM following
"""

WHITENING_DEVIATION = """
WITH x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::HUGEINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
fit AS (SELECT DISTINCT x FROM x),
sums AS (SELECT list(s ORDER BY d) AS s, max(n) AS n FROM (SELECT d, sum(v) AS s, count(*) AS n
  FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS d FROM fit) GROUP BY d))
SELECT vec_id, n, list_sum(list_transform(list_zip(x, s), lambda p: (n * p[1] - p[2]) * (n * p[1] - p[2])))::BIGINT AS deviation
FROM x, sums
"""

SQL: dict[str, str] = {
    "op1_ngram_join": COMPONENTS,
    "op2_secret_scan": SECRETS,
    "op9_chat_format": CHATS,
    "op12_html_extraction": ARTICLES,
    "op13_periodic_runs": RUNS,
    "quality_counts": QUALITY_COUNTS,
    "mixing_targets": MIXING_TARGETS,
    "fingerprint_edits": FINGERPRINT_EDITS,
    "whitening_deviation": WHITENING_DEVIATION,
}
