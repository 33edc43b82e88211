"""The same results as ``catalog`` in DuckDB SQL, over the same tables."""

from __future__ import annotations

from postlens.functions.labels import (
    CLIMATE_SENTIMENT_LABELS,
    EUROPEAN_COUNTRIES,
    TWITTER_SENTIMENT_LABELS,
)
from postlens.plans.catalog import (
    BOOSTERS,
    CONTRAST,
    KEYWORDS,
    MODIFIERS,
    NEGATIONS,
    STOP_WORDS,
    TEMP_KEYWORDS,
    TOPIC_WORDS,
)

# The cleaning patterns step by step, in RE2 syntax.
URL_RE = (
    r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
)
WWW_RE = r"www\.[a-zA-Z0-9\-]+\.[a-zA-Z]{2,}"
WS = (
    r"\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
    r"\x{3000}"
)


def _clean(text: str) -> str:
    for pattern, new in (
        (URL_RE, ""),
        (WWW_RE, ""),
        (rf"[^\p{{L}}\p{{N}}_{WS}]", ""),
        (r"\p{Nd}+", ""),
        (f"[{WS}]+", " "),
    ):
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return f"lower(trim({text}))"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '[^{WS}]+')"


def _runs(text: str) -> str:
    return rf"regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+')"


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


CLEANED = f"cleaned AS MATERIALIZED (SELECT doc_id, lang, source, {_clean('text')} AS t FROM documents)"
BENCH_WORDS = f"bw AS MATERIALIZED (SELECT DISTINCT unnest({_runs('lower(text)')}) AS word FROM benchmark)"
CONV_WORDS = f"cw AS MATERIALIZED (SELECT DISTINCT unnest({_runs('lower(text)')}) AS word FROM conversations)"
# the words of every cleaned document with their positions
TOKENS = f"""tokens AS MATERIALIZED (
  SELECT doc_id, unnest({_words('t')}) AS w, generate_subscripts({_words('t')}, 1) AS pos FROM cleaned)"""
MAPPING = f"""mapping AS MATERIALIZED (
  SELECT * FROM (VALUES {', '.join(f"('{k}', '{u}')" for k, _, u, _ in KEYWORDS)}) v(key, cond))"""


def _keyword_tags(source: str, text: str) -> str:
    """CTE ``tags``: doc_id, weather_topics, weather_temp of every row with a match."""
    return f"""{MAPPING},
hits AS (SELECT s.doc_id, m.key, m.cond FROM {source} s JOIN mapping m
  ON len(list_filter({_runs('lower(s.' + text + ')')}, lambda x: contains(x, m.key))) > 0),
tags AS MATERIALIZED (SELECT doc_id,
    array_to_string(list_sort(list(DISTINCT key)), ', ') AS weather_topics,
    array_to_string(list_sort(list(DISTINCT cond)), ', ') AS weather_temp
  FROM hits GROUP BY doc_id)"""


TAGGED_DOCS = f"""{CLEANED},
{_keyword_tags('cleaned', 't')},
tagged AS MATERIALIZED (SELECT c.*, weather_topics, weather_temp FROM cleaned c LEFT JOIN tags USING (doc_id))"""


def _gazetteer(min_length: int, codes: bool, priority: str = "country iso2 iso3 city") -> str:
    """CTE ``gaz``: one row per known word."""
    rank = {name: i for i, name in enumerate(priority.split())}
    sides = [("city", "word"), ("country", "country")]
    sides += [("iso2", "right(word, 2)"), ("iso3", "right(word, 3)")] if codes else []
    union = " UNION ALL ".join(
        f"SELECT {rank[name]} AS rank, row_no, {expr} AS token, country FROM cities"
        for name, expr in sides
    )
    return f"""numbered AS MATERIALIZED (SELECT word, ('0x' || left(md5(word), 8))::BIGINT AS row_no
  FROM bw WHERE length(word) >= {min_length}),
cities AS MATERIALIZED (SELECT n.word, n.row_no, c.country FROM numbered n JOIN
  (SELECT row_no % 25 AS b, min(word) AS country FROM numbered GROUP BY 1) c ON n.row_no % 25 = c.b),
gaz AS MATERIALIZED (SELECT token, country FROM ({union})
  QUALIFY row_number() OVER (PARTITION BY token ORDER BY rank, row_no DESC) = 1)"""


FIRST_COUNTRY = """country AS MATERIALIZED (SELECT doc_id, arg_min(country, pos) AS country
  FROM tokens JOIN gaz ON w = token GROUP BY doc_id)"""

PLACES = f"""bench_at AS (SELECT {_words(_clean('text'))} AS w FROM benchmark),
bench_pos AS (SELECT w, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM bench_at),
sized AS (SELECT *, CASE WHEN length(word) >= 10 THEN 1 WHEN length(word) = 9 THEN 3
  WHEN length(word) = 8 THEN 2 END AS n FROM bench_pos),
names AS MATERIALIZED (SELECT DISTINCT array_to_string(w[pos : pos + n - 1], ' ') AS name, n
  FROM sized WHERE pos - 1 + n <= len(w)
  UNION SELECT 'iceland', 1),
grams AS (
  SELECT doc_id, pos, 1 AS n, w AS name FROM tokens
  UNION ALL SELECT doc_id, pos, 2, w || ' ' || lead(w, 1) OVER d FROM tokens WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
  UNION ALL SELECT doc_id, pos, 3, w || ' ' || lead(w, 1) OVER d || ' ' || lead(w, 2) OVER d FROM tokens
    WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
found AS MATERIALIZED (SELECT doc_id, pos, max(n) AS n, arg_max(name, n) AS name
  FROM grams JOIN names USING (name, n) GROUP BY doc_id, pos),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM found),
walk AS (WITH RECURSIVE r(doc_id, k, next, names) AS (
    SELECT doc_id, k, pos + n, [name] FROM ranked WHERE k = 1
    UNION ALL
    SELECT f.doc_id, f.k, CASE WHEN f.pos >= r.next THEN f.pos + f.n ELSE r.next END,
      CASE WHEN f.pos >= r.next THEN list_append(r.names, f.name) ELSE r.names END
    FROM r JOIN ranked f ON f.doc_id = r.doc_id AND f.k = r.k + 1)
  SELECT doc_id, arg_max(array_to_string(names, ', '), k) AS places FROM r GROUP BY doc_id)"""

LOCATION = f"""{BENCH_WORDS},
{_gazetteer(9, False)},
{FIRST_COUNTRY},
{PLACES},
located AS MATERIALIZED (SELECT c.doc_id, coalesce(country.country, walk.places, 'Unknown') AS final_location
  FROM cleaned c LEFT JOIN country USING (doc_id) LEFT JOIN walk USING (doc_id))"""


def _region(location: str) -> str:
    return f"""CASE WHEN lower({location}) IN ({_quoted(EUROPEAN_COUNTRIES)}) THEN 'EU'
  WHEN lower({location}) = 'united states' THEN 'US'
  WHEN lower({location}) = 'unknown' THEN 'Unknown' ELSE 'Other' END"""


# Noun rules on the distinct tokens that end in one of the suffixes. Level 1 is the token and
# one rule; deeper levels apply the rules again.
NOUN_RULES = (
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"),
    ("shes", "sh"), ("men", "man"), ("ies", "y"),
)

LEMMAS = f"""{BENCH_WORDS},
{CONV_WORDS},
exceptions AS (SELECT word, coalesce(
    (SELECT arg_min(f, (length(f), CASE WHEN f = word THEN 0 ELSE 1 END)) FROM
      (SELECT unnest([word, left(word, 4)]) AS f) WHERE f IN (SELECT word FROM cw)), word) AS lemma
  FROM bw WHERE length(word) >= 7),
rules AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(NOUN_RULES))}) r(i, old, new)),
vocabulary AS MATERIALIZED (SELECT DISTINCT w FROM tokens),
forms AS (WITH RECURSIVE f(w, form, level, i) AS (
    SELECT w, w, 0, -1 FROM vocabulary WHERE w LIKE '%s' OR w LIKE '%men'
    UNION
    SELECT f.w, left(f.form, length(f.form) - length(old)) || new, level + 1, rules.i
    FROM f JOIN rules ON ends_with(f.form, rules.old))
  SELECT * FROM f),
by_rule AS (SELECT w, arg_min(form, (greatest(level, 1), length(form), level, i)) AS lemma
  FROM forms WHERE form IN (SELECT word FROM cw) GROUP BY w),
lemma_of AS MATERIALIZED (SELECT v.w, coalesce(e.lemma, r.lemma, v.w) AS lemma FROM vocabulary v
  LEFT JOIN exceptions e ON e.word = v.w LEFT JOIN by_rule r ON r.w = v.w)"""

GLOSSARY = f"""terms AS (SELECT text, item_id, unnest({_runs('lower(text)')}) AS term FROM benchmark),
defined AS (SELECT term, arg_max(text, item_id) AS definition FROM terms GROUP BY term),
kept AS MATERIALIZED (SELECT word AS token, word AS value FROM cw
  UNION ALL SELECT term, definition FROM defined WHERE term NOT IN (SELECT word FROM cw))"""

SCORES = f"""scored AS MATERIALIZED (SELECT word, (length(word) % 5 - 2) * 0.5::DOUBLE AS s FROM bw)"""


def _score_sums(table: str, keys: str) -> str:
    return f"""{BENCH_WORDS}, {SCORES},
spoken AS (SELECT {keys}, unnest({_runs('lower(text)')}) AS word FROM {table}),
sums AS (SELECT {keys}, sum(s) AS s, count(*) AS n FROM spoken JOIN scored USING (word) GROUP BY {keys}),
totals AS (SELECT {', '.join('d.' + k for k in keys.split(', '))}, coalesce(s, 0.0) AS s, coalesce(n, 0) AS n
  FROM {table} d LEFT JOIN sums USING ({keys}))"""


COMPOUND = "s / sqrt(s * s + 15)"
VALENCE = f"CASE WHEN {COMPOUND} >= 0.05 THEN 'positive' WHEN {COMPOUND} <= -0.05 THEN 'negative' ELSE 'neutral' END"
MEAN = "CASE WHEN n = 0 THEN 0.0 ELSE s / n END"
POLARITY = "CASE WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' ELSE 'neutral' END"

# The rollup input of ``catalog.tagged``, one row per document with more than three words.
ROLLUP_ROWS = f"""{TAGGED_DOCS},
posts AS MATERIALIZED (
  SELECT coalesce(weather_topics, lang || ' topic') AS group_topic, lang AS final_location,
    nullif(source, 'src0') AS account,
    CASE quality * 2 + toxic WHEN 0 THEN 'very cold' WHEN 1 THEN 'cold' WHEN 2 THEN 'mild/not relevant'
      WHEN 3 THEN 'hot' WHEN 4 THEN 'very hot' ELSE 'unknown' END AS temp_category
  FROM tagged LEFT JOIN labels USING (doc_id) WHERE len({_words('t')}) > 3)"""
ROLLUP_GROUPS = """grouped AS (SELECT group_topic, final_location, count(account) AS tweet_count,
    count(DISTINCT account) AS account_count, count(*) AS row_count
  FROM posts GROUP BY ALL),
counted AS (SELECT group_topic, final_location, temp_category, count(*) AS temp_count FROM posts GROUP BY ALL),
shares AS (SELECT group_topic, final_location, tweet_count, account_count, row_count, temp_category, temp_count,
    printf('%d (%.1f%%)', temp_count, temp_count / row_count * 100) AS temp_percentage
  FROM counted JOIN grouped USING (group_topic, final_location))"""
_ORDER = "list_position(['very cold', 'cold', 'mild/not relevant', 'hot', 'very hot', 'unknown'], temp_category)"
ROLLUP_TEXT = f"""SELECT group_topic, final_location, tweet_count, account_count,
  '{{' || string_agg('''' || temp_category || ''': ' || temp_count, ', ' ORDER BY temp_count DESC, {_ORDER}) || '}}' AS temp_counts,
  '{{' || string_agg('''' || temp_category || ''': ''' || temp_percentage || '''', ', ' ORDER BY temp_count DESC, {_ORDER}) || '}}' AS temp_percentages
FROM shares GROUP BY group_topic, final_location, tweet_count, account_count"""

LABELLED_DOCS = f"""{TAGGED_DOCS},
labelled AS MATERIALIZED (SELECT *, CASE {' '.join(
    f"WHEN {' OR '.join(f'''contains(t, '{w}')''' for w in words)} THEN 'Topic {i}'"
    for i, words in enumerate(TOPIC_WORDS))} END AS label FROM tagged)"""


def _tfidf(source: str, label: str, text: str) -> str:
    """CTE ``tfidf``: label, token, tfidf."""
    return rf"""group_tokens AS (SELECT {label} AS label,
    unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}')) AS token FROM {source} WHERE {label} IS NOT NULL),
tf AS MATERIALIZED (SELECT label, token, count(*) AS tf FROM group_tokens GROUP BY ALL),
weighted AS MATERIALIZED (SELECT label, token, tf * (ln((1 + (SELECT count(DISTINCT {label}) FROM {source}))
    / (1 + count(*) OVER (PARTITION BY token))) + 1) AS v FROM tf),
norms AS (SELECT label, sqrt(sum(v * v)) AS norm FROM weighted GROUP BY label),
tfidf AS MATERIALIZED (SELECT label, token, v / norm AS tfidf FROM weighted JOIN norms USING (label))"""


# The stop-filtered, lemmatised documents of the whole analysis, and all that follows from them.
STOPPED = f"""raw_tokens AS MATERIALIZED (
  SELECT doc_id, unnest({_words('t')}) AS w, generate_subscripts({_words('t')}, 1) AS pos FROM cleaned),
tokens AS MATERIALIZED (SELECT doc_id, w, pos FROM raw_tokens WHERE w NOT IN ({_quoted(STOP_WORDS)}))"""
PREPARED = f"""{CLEANED},
{STOPPED},
{LEMMAS},
prepared AS MATERIALIZED (SELECT c.doc_id, c.lang, c.source, c.t AS cleaned_text,
    coalesce(p.lemmatized_text, '') AS lemmatized_text
  FROM cleaned c LEFT JOIN (SELECT doc_id, string_agg(lemma, ' ' ORDER BY pos) AS lemmatized_text
    FROM tokens JOIN lemma_of USING (w) GROUP BY doc_id) p USING (doc_id))"""


def _located_on(source: str, column: str) -> str:
    """Location CTEs over another text column, under names of their own."""
    body = f"""loc_tokens AS MATERIALIZED (SELECT doc_id, unnest({_words(column)}) AS w,
    generate_subscripts({_words(column)}, 1) AS pos FROM {source}),
{_gazetteer(9, False)},
{FIRST_COUNTRY},
{PLACES},
located AS MATERIALIZED (SELECT c.doc_id, coalesce(country.country, walk.places, 'Unknown') AS final_location
  FROM {source} c LEFT JOIN country USING (doc_id) LEFT JOIN walk USING (doc_id))"""
    return body.replace("FROM tokens", "FROM loc_tokens")


_MATCHES = [
    " + ".join(f"contains(combined_text, '{w}')::INT" for w in words) or "0" for words in TEMP_KEYWORDS
]
_SCORE_LIST = ", ".join(
    f"({m})::DOUBLE" + (" + 0.5" if i == 2 else "") for i, m in enumerate(_MATCHES)
)
ANALYZED = f"""{PREPARED},
{_keyword_tags('prepared', 'cleaned_text')},
{_located_on('prepared', 'lemmatized_text')},
{GLOSSARY},
mapped AS (SELECT doc_id, string_agg(value, ', ' ORDER BY pos) AS m FROM loc_tokens JOIN kept ON w = token GROUP BY doc_id),
joined AS MATERIALIZED (SELECT p.*, weather_topics, weather_temp, final_location, coalesce(m, '') AS "Glossary_Map",
    lemmatized_text || ' ' || coalesce(weather_temp, 'None') AS combined_text
  FROM prepared p LEFT JOIN tags USING (doc_id) LEFT JOIN located USING (doc_id) LEFT JOIN mapped USING (doc_id)),
scored_posts AS (SELECT *, [{_SCORE_LIST}] AS scores FROM joined),
analyzed AS MATERIALIZED (SELECT *, (list_position(scores, list_max(scores)) - 1)::INT AS climate_bert_temp_sentiment,
    {_region('final_location')} AS region FROM scored_posts)"""

# The lookup queries that have two physical ways share their SQL.
_LEMMATIZE = f"""WITH {CLEANED}, {TOKENS}, {LEMMAS}
SELECT c.doc_id, coalesce(x.t, '') AS lemmatized_text FROM cleaned c LEFT JOIN
  (SELECT doc_id, string_agg(lemma, ' ' ORDER BY pos) AS t FROM tokens JOIN lemma_of USING (w) GROUP BY doc_id) x
  USING (doc_id)"""
_MAP_GLOSSARY = f"""WITH {CLEANED}, {TOKENS}, {CONV_WORDS}, {GLOSSARY}
SELECT c.doc_id, coalesce(x.m, '') AS "Glossary_Map" FROM cleaned c LEFT JOIN
  (SELECT doc_id, string_agg(value, ', ' ORDER BY pos) AS m FROM tokens JOIN kept ON w = token GROUP BY doc_id) x
  USING (doc_id)"""


def _map_country(priority: str) -> str:
    return f"""WITH {CLEANED}, {TOKENS}, {BENCH_WORDS}, {_gazetteer(6, True, priority)}, {FIRST_COUNTRY}
SELECT doc_id, coalesce(country, 'Unknown') AS country FROM cleaned LEFT JOIN country USING (doc_id)"""


_EXTRACT_PLACES = f"""WITH {CLEANED}, {TOKENS}, {PLACES}
SELECT doc_id, places FROM cleaned LEFT JOIN walk USING (doc_id)"""
_LEXICON_SENTIMENT = f"""WITH {_score_sums('documents', 'doc_id')}
SELECT doc_id, {VALENCE} AS lexicon_sentiment, round({COMPOUND}, 6) AS score FROM totals"""
_MAPPING_ROWS = f"""mapping_rows AS (SELECT word, CASE WHEN length(word) % 2 = 1 THEN 'cold' ELSE 'warm, windy' END AS "EU",
    CASE WHEN length(word) % 2 = 1 THEN 'warm ' ELSE 'cold ' END || item_id AS "USA",
    ((pos - 1) % 2)::INT AS need_location, item_id * 1000000 + pos - 1 AS row_no
  FROM (SELECT item_id, unnest({_runs('text')}) AS word, generate_subscripts({_runs('text')}, 1) AS pos FROM benchmark))"""
_UNPIVOTED = """SELECT word, need_location, row_no, 'EU' AS region, "EU" AS mapping FROM mapping_rows
UNION ALL SELECT word, need_location, row_no, 'USA', "USA" FROM mapping_rows"""
_RELEVANCE = f"""WITH {CLEANED}, {TOKENS},
bag AS (SELECT doc_id, w, count(*) AS n FROM tokens GROUP BY ALL),
df AS (SELECT w, count(*)::DOUBLE AS df FROM bag GROUP BY w),
best AS (SELECT doc_id, w, df * n AS score, row_number() OVER (PARTITION BY doc_id ORDER BY df * n DESC, w) AS k
  FROM bag JOIN df USING (w))
SELECT c.doc_id, coalesce(x.t, '') AS top_3_relevance_words FROM cleaned c LEFT JOIN
  (SELECT doc_id, string_agg(w, ' ' ORDER BY k) AS t FROM best WHERE k <= 3 GROUP BY doc_id) x USING (doc_id)"""

# Rules of valence and polarity; a word may have apostrophes inside.
_SPOKEN = r"[\p{L}\p{N}_]+(?:''[\p{L}\p{N}_]+)*"


def _case(word: str, values: dict[str, float]) -> str:
    cases = " ".join(f"WHEN '{w}' THEN {v}::DOUBLE" for w, v in values.items())
    return f"CASE {word} {cases} END"


def _valence(table: str, keys: str) -> str:
    """CTE ``valence``: keys, s of every row; the steps look back one, two and three words."""
    own = ", ".join("t." + k for k in keys.split(", "))
    steps, last = [], "v0"
    for d, decay in ((1, 1.0), (2, 0.95), (3, 0.9)):
        sign = f"(CASE WHEN {last} > 0 THEN 1.0 ELSE -1.0 END)::DOUBLE"
        counts = f"pos > {d} AND value{d} IS NULL"
        boosted = f"""CASE WHEN {counts} AND boost{d} IS NOT NULL THEN {last} +
          (boost{d} * {sign} + CASE WHEN capital{d} AND mixed THEN 0.733::DOUBLE * {sign} ELSE 0.0::DOUBLE END) * {decay}::DOUBLE
          ELSE {last} END"""
        steps.append(f"b{d} AS (SELECT *, {boosted} AS w{d} FROM {'near' if d == 1 else f's{d - 1}'})")
        between = " OR ".join(f"word{e} IN ('so', 'this')" for e in range(1, d)) or "false"
        factor = {1: 1.0, 2: 1.5, 3: 1.25}[d]
        steps.append(f"""s{d} AS (SELECT *, CASE WHEN {counts} AND word{d} = 'never' AND ({between}) THEN w{d} * {factor}::DOUBLE
          WHEN {counts} AND negates{d} THEN w{d} * -0.74::DOUBLE ELSE w{d} END AS v{d} FROM b{d})""")
        last = f"v{d}"
    lags = ", ".join(
        f"lag({c}, {d}) OVER p AS {c}{d}" for d in (1, 2, 3) for c in ("word", "value", "boost", "negates", "capital")
    )
    return f"""{BENCH_WORDS}, {SCORES},
said AS (SELECT {keys}, unnest(regexp_extract_all(text, '{_SPOKEN}')) AS raw,
    generate_subscripts(regexp_extract_all(text, '{_SPOKEN}'), 1) AS pos FROM {table}),
known AS (SELECT {own}, pos, lower(raw) AS word, s AS value, {_case('lower(raw)', BOOSTERS)} AS boost,
    lower(raw) IN ({_quoted(NEGATIONS)}) OR contains(lower(raw), 'n''t') AS negates,
    raw = upper(raw) AND raw <> lower(raw) AS capital
  FROM said t LEFT JOIN scored ON scored.word = lower(raw)),
near AS (SELECT *, {lags}, bool_or(capital) OVER a AND bool_or(NOT capital) OVER a AS mixed,
    min(CASE WHEN word = '{CONTRAST}' THEN pos END) OVER a AS contrast_at,
    value + CASE WHEN capital AND bool_or(capital) OVER a AND bool_or(NOT capital) OVER a
      THEN 0.733::DOUBLE * (CASE WHEN value > 0 THEN 1.0 ELSE -1.0 END)::DOUBLE ELSE 0.0::DOUBLE END AS v0
  FROM known WINDOW a AS (PARTITION BY {keys}), p AS (PARTITION BY {keys} ORDER BY pos)),
{', '.join(steps)},
least_told AS (SELECT *, CASE WHEN pos > 1 AND value1 IS NULL AND word1 = 'least' AND NOT (pos > 2 AND word2 IN ('at', 'very'))
    THEN v3 * -0.74::DOUBLE ELSE v3 END AS v4 FROM s3),
sums AS (SELECT {keys}, sum(CASE WHEN value IS NOT NULL AND boost IS NULL THEN
      v4 * (CASE WHEN contrast_at IS NULL THEN 1.0 WHEN pos < contrast_at THEN 0.5 WHEN pos > contrast_at THEN 1.5 ELSE 1.0 END)::DOUBLE
    ELSE 0.0::DOUBLE END ORDER BY pos) AS s FROM least_told GROUP BY {keys}),
marked AS (SELECT {own}, coalesce(s, 0.0) AS s, least(length(text) - length(replace(text, '!', '')), 4) * 0.292::DOUBLE +
    (CASE WHEN q > 3 THEN 0.96 WHEN q > 1 THEN q * 0.18 ELSE 0.0 END)::DOUBLE AS marks
  FROM (SELECT *, length(text) - length(replace(text, '?', '')) AS q FROM {table}) t LEFT JOIN sums USING ({keys})),
valence AS (SELECT {keys}, CASE WHEN s > 0 THEN s + marks WHEN s < 0 THEN s - marks ELSE 0.0 END AS s FROM marked)"""


def _polarity(table: str, keys: str) -> str:
    """CTE ``polarity``: keys, mean of every row, by one fold over its words."""
    chain = "{'word': NULL::VARCHAR, 'value': NULL::DOUBLE, 'factor': NULL::DOUBLE, 'negated': false, 'total': 0.0::DOUBLE, 'n': 0, 'last': 0.0::DOUBLE}"
    within = lambda x: f"greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {x}))"
    state = lambda f, g, t, n, v: (
        f"{{'word': NULL::VARCHAR, 'value': NULL::DOUBLE, 'factor': {f}, 'negated': {g}, 'total': {t}, 'n': {n}, 'last': {v}}}"
    )
    factor = _case("x.word", MODIFIERS)
    product = within("x.value * coalesce(a.factor, 1.0::DOUBLE)")
    own = f"CASE WHEN a.negated THEN {product} * -0.5::DOUBLE ELSE {product} END"
    stronger = within("a.last * 1.25::DOUBLE")
    return f"""{BENCH_WORDS}, {SCORES},
said AS (SELECT {keys}, unnest(regexp_extract_all(lower(text), '{_SPOKEN}|!')) AS w,
    generate_subscripts(regexp_extract_all(lower(text), '{_SPOKEN}|!'), 1) AS pos FROM {table}),
rows_of AS (SELECT {keys}, list({{'word': w, 'value': s, 'factor': NULL::DOUBLE, 'negated': false, 'total': 0.0::DOUBLE,
    'n': 0, 'last': 0.0::DOUBLE}} ORDER BY pos) AS l FROM said LEFT JOIN scored ON word = w GROUP BY {keys}),
folded AS (SELECT {keys}, list_reduce(l, lambda a, x: CASE
    WHEN x.word = '!' THEN {state('a.factor', 'a.negated', f'a.total + CASE WHEN a.n > 0 THEN {stronger} - a.last ELSE 0.0::DOUBLE END', 'a.n', stronger)}
    WHEN {factor} IS NOT NULL THEN {state(f'coalesce(a.factor, 1.0::DOUBLE) * {factor}', 'a.negated', 'a.total', 'a.n', 'a.last')}
    WHEN x.word IN ({_quoted(NEGATIONS)}) OR contains(x.word, 'n''t') THEN {state('a.factor', 'true', 'a.total', 'a.n', 'a.last')}
    WHEN x.value IS NOT NULL THEN {state('NULL::DOUBLE', 'false', f'a.total + {own}', 'a.n + 1', own)}
    ELSE {state('CASE WHEN length(x.word) <= 2 THEN a.factor END', 'a.negated AND length(x.word) <= 1', 'a.total', 'a.n', 'a.last')}
  END, {chain}) AS r FROM rows_of),
polarity AS (SELECT {', '.join('d.' + k for k in keys.split(', '))}, CASE WHEN r.n > 0 THEN r.total / r.n ELSE 0.0 END AS p
  FROM {table} d LEFT JOIN folded USING ({keys}))"""


POLARITY_OF = "CASE WHEN p > 0 THEN 'positive' WHEN p < 0 THEN 'negative' ELSE 'neutral' END"


def _predicted(labels: tuple[str, ...]) -> str:
    """Label of the first class whose keyword a text holds, as ``catalog.keyword_scores`` has it."""
    return f"""CASE WHEN contains(text, 'tion') THEN '{labels[0]}' WHEN contains(text, 'e') THEN '{labels[1]}'
  WHEN contains(text, 'heed') OR contains(text, 'sch') THEN '{labels[2]}' ELSE '{labels[0]}' END"""


_TOPIC_TOKENS = f"""{TAGGED_DOCS},
topic_posts AS MATERIALIZED (SELECT doc_id, t, weather_topics IS NULL AND len({_words('t')}) > 3 AS eligible FROM tagged),
topic_tokens AS MATERIALIZED (SELECT doc_id, unnest({_words('t')}) AS w FROM topic_posts WHERE eligible)"""

_STREAMED = f"""WITH {CLEANED}, {STOPPED},
prepared AS MATERIALIZED (SELECT c.doc_id, c.t AS cleaned_text, coalesce(p.l, '') AS lemmatized_text
  FROM cleaned c LEFT JOIN (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS l FROM tokens GROUP BY doc_id) p
  USING (doc_id)),
{BENCH_WORDS},
{_keyword_tags('prepared', 'cleaned_text')},
{_located_on('prepared', 'lemmatized_text')}
SELECT p.doc_id, lemmatized_text, weather_topics, final_location, {_region('final_location')} AS region
FROM prepared p LEFT JOIN tags USING (doc_id) LEFT JOIN located USING (doc_id)"""

SQL: dict[str, str] = {
    "word_count": f"SELECT doc_id, len({_words('text')})::INT AS word_count FROM documents",
    "filter_min_words": f"SELECT conv_id, turn FROM conversations WHERE len({_words('text')}) > 3",
    "topic_eligible": f"""WITH {TAGGED_DOCS}
SELECT doc_id, weather_topics IS NULL AND len({_words('t')}) > 3 AS eligible FROM tagged""",
    "combined_text": f"""WITH {TAGGED_DOCS}
SELECT doc_id, t || ' ' || coalesce(weather_temp, 'None') AS combined_text FROM tagged""",
    "temp_category": """SELECT doc_id, CASE quality * 4 + toxic WHEN 0 THEN 'very cold' WHEN 1 THEN 'cold'
  WHEN 2 THEN 'mild/not relevant' WHEN 3 THEN 'hot' WHEN 4 THEN 'very hot' ELSE 'unknown' END AS temp_category
FROM documents LEFT JOIN labels USING (doc_id)""",
    "categorize_region": f"""WITH l AS (SELECT doc_id, CASE WHEN source = 'src0' THEN 'unknown'
  WHEN source = 'src1' THEN 'paris, london' WHEN lang = 'de' THEN 'Germany' WHEN lang = 'fr' THEN 'france'
  WHEN lang = 'en' THEN 'United States' ELSE 'Moldova' END AS location FROM documents)
SELECT doc_id, {_region('location')} AS region FROM l""",
    "clean_text": f"SELECT doc_id, {_clean('text')} AS cleaned_text FROM documents",
    "clean_text_links": f"""SELECT page_id,
  {_clean("('see ' || url || '#part ' || html || ' www.a-b.org/x')")} AS cleaned_text FROM pages""",
    "tokenize": f"""WITH c AS (SELECT conv_id, turn,
  {_words(_clean("('we cannot gonna ' || text || ' wanna lemmes gotta')"))} AS w FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(w, lambda x: CASE x WHEN 'cannot' THEN 'can|not'
  WHEN 'gimme' THEN 'gim|me' WHEN 'gonna' THEN 'gon|na' WHEN 'gotta' THEN 'got|ta' WHEN 'lemme' THEN 'lem|me'
  WHEN 'wanna' THEN 'wan|na' ELSE x END), '|') AS tokens FROM c""",
    "remove_stopwords": f"""WITH {CLEANED} SELECT doc_id,
  array_to_string(list_filter({_words('t')}, lambda x: x NOT IN ({_quoted(STOP_WORDS)})), ' ') AS kept FROM cleaned""",
    "lemmatize_lookup": _LEMMATIZE,
    "lemmatize_joined": _LEMMATIZE,
    "prepare_text": f"WITH {PREPARED} SELECT doc_id, cleaned_text, lemmatized_text FROM prepared",
    "unpivot_mapping": f"WITH {_MAPPING_ROWS} {_UNPIVOTED}",
    "dedupe_mapping": f"""WITH {_MAPPING_ROWS}, u AS ({_UNPIVOTED})
SELECT lower(word) AS word, arg_max(mapping, (region, row_no)) AS mapping FROM u GROUP BY 1""",
    "match_keywords": f"""WITH {TAGGED_DOCS}
SELECT doc_id, replace(weather_topics, ', ', '|') AS matched_keys FROM tagged""",
    "map_conditions": f"WITH {TAGGED_DOCS} SELECT doc_id, weather_topics, weather_temp FROM tagged",
    "map_conditions_joined": f"""WITH {CLEANED}, {TOKENS}, {BENCH_WORDS},
keys AS (SELECT word, 'c' || length(word) % 3 AS cond FROM bw WHERE length(word) >= 6),
vocabulary AS (SELECT DISTINCT unnest({_runs('w')}) AS v FROM tokens),
holds AS MATERIALIZED (SELECT v, word, cond FROM vocabulary JOIN keys ON contains(v, word)),
runs AS (SELECT DISTINCT doc_id, unnest({_runs('w')}) AS v FROM tokens),
hit AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT word)), ', ') AS weather_topics,
    array_to_string(list_sort(list(DISTINCT cond)), ', ') AS weather_temp
  FROM runs JOIN holds USING (v) GROUP BY doc_id)
SELECT doc_id, weather_topics, weather_temp FROM cleaned LEFT JOIN hit USING (doc_id)""",
    "map_phrases": f"""WITH {CLEANED}, {BENCH_WORDS},
bench AS (SELECT {_words(_clean('text'))} AS w FROM benchmark),
windows AS (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS t FROM bench),
keys AS (SELECT DISTINCT word, 'c' || length(word) % 3 AS cond FROM (
  SELECT right(t[1], (length(t[1]) + 1) // 2) || ' ' || t[2] || ' ' || left(t[3], (length(t[3]) + 1) // 2) AS word FROM windows
  UNION ALL SELECT word FROM bw WHERE length(word) >= 9)),
hit AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT word)), ', ') AS weather_topics,
    array_to_string(list_sort(list(DISTINCT cond)), ', ') AS weather_temp
  FROM cleaned JOIN keys ON contains(t, word) GROUP BY doc_id)
SELECT doc_id, weather_topics, weather_temp FROM cleaned LEFT JOIN hit USING (doc_id)""",
    "map_glossary": _MAP_GLOSSARY,
    "map_glossary_joined": _MAP_GLOSSARY,
    "map_country": _map_country("country iso2 iso3 city"),
    "map_country_joined": _map_country("country iso2 iso3 city"),
    "map_country_city_first": _map_country("city iso2 iso3 country"),
    "extract_places": _EXTRACT_PLACES,
    "extract_places_joined": _EXTRACT_PLACES,
    "final_location": f"""WITH {CLEANED}, {TOKENS}, {LOCATION}
SELECT doc_id, final_location, {_region('final_location')} AS region FROM located""",
    "vocabulary_counts": f"""WITH {CLEANED}, {TOKENS}
SELECT w AS token, count(DISTINCT doc_id) AS df, count(*) AS tf FROM tokens GROUP BY w""",
    "bag_of_words": f"""WITH {CLEANED}, {TOKENS}
SELECT doc_id, w AS token, count(*) AS n FROM tokens GROUP BY ALL""",
    "number_words": f"""WITH {CLEANED}, {TOKENS}
SELECT row_number() OVER (ORDER BY count(*) DESC, w) - 1 AS index, w AS token, count(*) AS tf FROM tokens GROUP BY w""",
    "topic_word_mass": f"""WITH {_TOPIC_TOKENS}
SELECT row_number() OVER (ORDER BY count(*) DESC, w) - 1 AS index, w AS token, count(*) AS counted
FROM topic_tokens GROUP BY w""",
    "topic_assignment_check": f"""WITH {_TOPIC_TOKENS}
SELECT doc_id, eligible AS has_topic, CASE WHEN eligible THEN true END AS is_heaviest,
  CASE WHEN eligible THEN true END AS has_its_words FROM topic_posts""",
    "token_responsibilities": f"""WITH {_TOPIC_TOKENS}
SELECT doc_id, w AS token, count(*) AS n, 4 AS topics, 1.0::DOUBLE AS total, true AS in_range
FROM topic_tokens GROUP BY ALL""",
    "relevance_words": _RELEVANCE,
    "lexicon_sentiment": _LEXICON_SENTIMENT,
    "lexicon_sentiment_joined": _LEXICON_SENTIMENT,
    "polarity_sentiment": f"""WITH {_score_sums('documents', 'doc_id')}
SELECT doc_id, {POLARITY} AS polarity_sentiment, round({MEAN}, 6) AS score FROM totals""",
    "valence_sentiment": f"""WITH {_valence('documents', 'doc_id')}
SELECT doc_id, {VALENCE} AS valence_sentiment, round({COMPOUND}, 6) AS score FROM valence""",
    "modified_polarity": f"""WITH {_polarity('documents', 'doc_id')}
SELECT doc_id, {POLARITY_OF} AS modified_polarity, round(p, 6) AS score FROM polarity""",
    "compare_sentiment": f"""WITH v AS (WITH {_valence('conversations', 'conv_id, turn')} SELECT * FROM valence),
p AS (WITH {_polarity('conversations', 'conv_id, turn')} SELECT * FROM polarity)
SELECT conv_id, turn, {VALENCE} AS valence, {POLARITY_OF} AS polarity,
  {_predicted(TWITTER_SENTIMENT_LABELS)} AS twitter, {_predicted(CLIMATE_SENTIMENT_LABELS)} AS climate
FROM conversations JOIN v USING (conv_id, turn) JOIN p USING (conv_id, turn)""",
    "classify_hook": """SELECT doc_id, CASE WHEN contains(text, 'tion') THEN 'positive'
  WHEN contains(text, 'e') THEN 'neutral' WHEN contains(text, 'heed') OR contains(text, 'sch') THEN 'negative'
  ELSE 'positive' END AS label FROM documents""",
    "train_val_split": """SELECT doc_id, ('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT % 100 < 20 AS is_val
FROM documents""",
    "exact_split": """SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR))
  <= (SELECT ceil(count(*) * 0.2) FROM documents) AS is_val FROM documents""",
    "classification_metrics": """WITH s AS (SELECT quality * 2 + toxic AS l,
    CASE WHEN n_chars > 2500 THEN 3 WHEN n_chars > 500 THEN 2 ELSE 0 END AS p
  FROM documents JOIN labels USING (doc_id)),
per AS (SELECT c, count(*) FILTER (l = c) AS support, count(*) FILTER (p = c) AS predicted,
    count(*) FILTER (l = c AND p = c) AS hits
  FROM s, (SELECT l AS c FROM s UNION SELECT p FROM s) GROUP BY c)
SELECT round(sum(hits) / sum(support), 6) AS accuracy,
  round(sum(coalesce(2 * hits / nullif(support + predicted, 0), 0) * support) / sum(support), 6) AS f1,
  round(sum(coalesce(hits / nullif(predicted, 0), 0) * support) / sum(support), 6) AS precision,
  round(sum(coalesce(hits / nullif(support, 0), 0) * support) / sum(support), 6) AS recall FROM per""",
    "epochs_resumed": "SELECT epoch::INT AS epoch, true AS same_loss, true AS same_weights FROM range(1, 4) t(epoch)",
    "value_counts": f"""WITH {ROLLUP_ROWS.replace(f" WHERE len({_words('t')}) > 3)", ")")}
SELECT final_location, temp_category, count(*) AS n FROM posts GROUP BY ALL""",
    "group_counts": f"""WITH {ROLLUP_ROWS}, {ROLLUP_GROUPS}
SELECT group_topic, final_location, tweet_count, account_count FROM grouped""",
    "count_percentages": """WITH g AS (SELECT lang, nullif(source, 'src0') AS account, count(*) AS n
  FROM documents GROUP BY ALL)
SELECT lang, account, printf('%d (%.1f%%)', n, n / sum(n) OVER (PARTITION BY lang) * 100) AS share FROM g""",
    "rollup_posts": f"WITH {ROLLUP_ROWS}, {ROLLUP_GROUPS} {ROLLUP_TEXT}",
    "rollup_long": f"WITH {ROLLUP_ROWS}, {ROLLUP_GROUPS} SELECT * FROM shares",
    "analyze_posts_result": f"""WITH {ANALYZED}
SELECT doc_id, lemmatized_text, "Glossary_Map", weather_topics, final_location, region, combined_text,
  climate_bert_temp_sentiment FROM analyzed""",
    "analyze_posts_rollup": f"""WITH {ANALYZED},
posts AS MATERIALIZED (SELECT weather_topics AS group_topic, final_location, nullif(source, 'src0') AS account,
    ['very cold', 'cold', 'mild/not relevant', 'hot', 'very hot'][climate_bert_temp_sentiment + 1] AS temp_category
  FROM analyzed WHERE len({_words('lemmatized_text')}) > 3 AND weather_topics IS NOT NULL),
{ROLLUP_GROUPS} SELECT * FROM shares""",
    "analyze_posts_totals": f"""WITH {ANALYZED},
posts AS MATERIALIZED (SELECT final_location, nullif(source, 'src0') AS account,
    ['very cold', 'cold', 'mild/not relevant', 'hot', 'very hot'][climate_bert_temp_sentiment + 1] AS temp_category
  FROM analyzed WHERE len({_words('lemmatized_text')}) > 3),
per AS (SELECT final_location, temp_category, count(*) AS n FROM posts GROUP BY ALL),
told AS (SELECT final_location, count(account) AS tweets FROM posts GROUP BY ALL)
SELECT final_location, temp_category, n, tweets FROM per JOIN told USING (final_location)""",
    "restrict_vocab": f"""WITH {CLEANED}, {TOKENS},
known AS (SELECT DISTINCT unnest({_words(_clean('text'))}) AS w FROM benchmark)
SELECT c.doc_id, coalesce(x.v, '') AS vocab FROM cleaned c LEFT JOIN
  (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS v FROM tokens JOIN known USING (w) GROUP BY doc_id) x USING (doc_id)""",
    "label_by_topic_words": f"WITH {LABELLED_DOCS} SELECT doc_id, label AS labels FROM labelled",
    "finalize_words": f"""WITH {LABELLED_DOCS} SELECT doc_id, CASE WHEN weather_topics IS NOT NULL THEN weather_temp
  {' '.join(f"WHEN label = 'Topic {i}' THEN '{', '.join(w)}'" for i, w in enumerate(TOPIC_WORDS))}
  END AS final_weather_words FROM labelled""",
    "tfidf_by_group": f"WITH {_tfidf('documents', 'lang', 'text')} SELECT label, token, round(tfidf, 8) AS tfidf FROM tfidf",
    "top_tfidf_words": f"""WITH {LABELLED_DOCS}, {_tfidf('labelled', 'label', 't')},
open_tokens AS (SELECT doc_id, label, unnest({_words('t')}) AS token, generate_subscripts({_words('t')}, 1) AS pos
  FROM labelled WHERE weather_topics IS NULL AND label IS NOT NULL AND length(t) > 3),
firsts AS (SELECT doc_id, label, token, min(pos) AS pos FROM open_tokens GROUP BY ALL),
best AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, pos) AS k
  FROM firsts JOIN tfidf USING (label, token)),
fill AS (SELECT doc_id, string_agg(token, ', ' ORDER BY k) AS words FROM best WHERE k <= 2 GROUP BY doc_id)
SELECT doc_id, coalesce(weather_topics, words) AS weather_topics FROM labelled LEFT JOIN fill USING (doc_id)""",
    "csv_posts_round_trip": """SELECT doc_id, text, nullif(source, 'src0') AS account, lang FROM documents""",
    "csv_rollup_round_trip": f"WITH {ROLLUP_ROWS}, {ROLLUP_GROUPS} {ROLLUP_TEXT}",
    "mapping_csv_scan": f'WITH {_MAPPING_ROWS} SELECT word, "EU", "USA", need_location FROM mapping_rows',
    "gazetteer_csv_scan": f"""WITH {BENCH_WORDS}, {_gazetteer(6, True)}
SELECT word AS city, word AS city_ascii, country, NULL::VARCHAR AS admin_name, NULL::VARCHAR AS capital,
  nullif(right(word, 2), 'na') AS iso2, nullif(right(word, 3), 'nan') AS iso3 FROM cities""",
    "labelled_csv_scan": """SELECT doc_id, text, (quality * 2 + toxic)::INT AS label
FROM documents JOIN labels USING (doc_id)""",
    "stream_enrichment": _STREAMED,
    "stream_batch_enrichment": _STREAMED,
    "glossary_json_scan": f"""WITH w AS (SELECT item_id, unnest({_runs('text')}) AS word,
    generate_subscripts({_runs('text')}, 1) - 1 AS pos FROM benchmark),
e AS (SELECT item_id % 8 AS part, item_id, pos, lower(word) AS term,
    CASE WHEN pos % 7 <> 3 THEN item_id || ' ' || pos END AS definition FROM w)
SELECT term, arg_max(definition, (part, item_id, pos)) AS definition FROM e WHERE definition IS NOT NULL GROUP BY term""",
    "extract_places_model": f"""WITH {CLEANED}, {TOKENS}, {BENCH_WORDS}, {_gazetteer(9, False)}, {FIRST_COUNTRY},
named AS (SELECT doc_id, string_agg(w, ', ' ORDER BY pos) AS places FROM tokens WHERE length(w) >= 14 GROUP BY doc_id)
SELECT doc_id, coalesce(country, places, 'Unknown') AS final_location
FROM cleaned LEFT JOIN country USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "model_round_trip": "SELECT doc_id, true AS same_class, true AS same_topic FROM documents",
    "value_count_rows": f"""WITH {CLEANED}
SELECT bucket, word, count(*) AS n FROM (SELECT length(t) % 3 AS bucket, unnest({_words('t')}) AS word FROM cleaned) GROUP BY ALL""",
}
