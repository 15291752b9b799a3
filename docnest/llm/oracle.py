"""The same results in DuckDB's SQL, where SQL can express them.

Models, signatures with Spark's own hash, tokenizers and lexers are beyond SQL; those queries are tested by brute force.
"""

from __future__ import annotations

from docnest.llm import quality, sharding, url_rules, vector_codes
from docnest.llm.manifest import FANOUT
from docnest.llm.mixing import HASH_BITS

WORD = r"[^\x20\x09-\x0D]+"
SHARDS = 40

OP1 = rf"""
WITH RECURSIVE
docs AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 16 AS size FROM documents
),
tbl AS (  -- the 256 remainders of a byte
  SELECT list(r ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b::BIGINT, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS r FROM range(256) x(b)
  )
),
crc AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(size - 16), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS text_crc32
  FROM docs, tbl
),
slots AS (
  SELECT *, (('0x' || substr(md5(key), 1, 8))::BIGINT % {sharding.N_SLOTS})::INT AS virtual_slot,
    (('0x' || substr(md5(key || ':' || size), 1, 8))::BIGINT % {sharding.LANES})::INT AS lane
  FROM (SELECT *, coalesce(doc_id::VARCHAR, 'text ' || text_crc32) AS key FROM crc)
),
lanes AS (SELECT virtual_slot, lane, sum(size)::BIGINT AS bytes, count(*) AS n FROM slots GROUP BY ALL),
units AS (
  SELECT virtual_slot, unit, sum(bytes)::BIGINT AS bytes FROM (
    SELECT *, CASE WHEN sum(bytes) OVER (PARTITION BY virtual_slot) > sum(bytes) OVER () * ({sharding.SPLIT}::DOUBLE / {SHARDS}) THEN lane ELSE -1 END AS unit
    FROM lanes)
  GROUP BY ALL
),
ordered AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, virtual_slot, unit) AS nth FROM units),
deal(nth, shard, loads) AS (
  SELECT 0::BIGINT, NULL::INT, [0::BIGINT FOR x IN range({SHARDS})]
  UNION ALL
  SELECT o.nth, list_position(d.loads, list_min(d.loads))::INT - 1,
    [CASE WHEN i = list_position(d.loads, list_min(d.loads)) THEN v + o.bytes ELSE v END FOR v, i IN d.loads]
  FROM deal d JOIN ordered o ON o.nth = d.nth + 1
),
placed AS (SELECT virtual_slot, unit, shard FROM deal JOIN ordered USING (nth) WHERE shard IS NOT NULL)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY s.virtual_slot, lane, doc_id, text_crc32, size) - 1 AS slot,
  NULL::INT AS grown_shard, s.virtual_slot
FROM slots s JOIN placed p ON p.virtual_slot = s.virtual_slot AND (p.unit = -1 OR p.unit = s.lane)
"""

OP3 = rf"""
WITH RECURSIVE
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE [concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) FOR i IN range(1, len(w) - 3)] END) AS s
  FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))
),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(least.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""

OP7 = rf"""
WITH rows AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS source_key, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text ' || coalesce(text, ''))), 1, {HASH_BITS // 4}))::BIGINT AS hash
  FROM documents
),
sizes AS (SELECT source_key, sum(size)::BIGINT AS source_size FROM rows GROUP BY 1),
ranked AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source_key) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM sizes),
filled AS (
  SELECT *, cap / weight AS level, sum(cap) OVER upto AS capped, sum(weight) OVER () - sum(weight) OVER upto AS open, sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM ranked WINDOW upto AS (ORDER BY cap / weight, source_key ROWS UNBOUNDED PRECEDING)
),
stops AS (SELECT *, capped + level * open <= total AS stops FROM filled),
goal AS (
  SELECT source_key, source_size, CASE WHEN stops THEN cap ELSE
    (total - sum(CASE WHEN stops THEN cap ELSE 0 END) OVER ()) / (sum(CASE WHEN stops THEN 0 ELSE weight END) OVER ()) * weight END AS target
  FROM stops
),
want AS (
  SELECT *, target - rounds * source_size AS want
  FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS rounds FROM goal)
),
hashes AS (SELECT source_key, hash, sum(size) AS words FROM rows GROUP BY ALL),
reached AS (SELECT *, sum(words) OVER (PARTITION BY source_key ORDER BY hash ROWS UNBOUNDED PRECEDING) AS reach FROM hashes),
edge AS (
  SELECT source_key, min_by(hash + CASE WHEN reach - want < want - (reach - words) THEN 1 ELSE 0 END, hash) AS threshold
  FROM reached JOIN want USING (source_key) WHERE reach >= want GROUP BY 1
)
SELECT doc_id, size, source_size, target, (size * (rounds + CASE WHEN hash < threshold THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rows JOIN want USING (source_key) JOIN edge USING (source_key)
"""


def _measures(over: str) -> str:
    return f"""[{{'m': 'mean_word', 'v': coalesce(word_chars * 1000 // {over}, 0)}}, {{'m': 'symbols', 'v': coalesce(n_symbols * 1000 // {over}, 0)}},
      {{'m': 'dup_lines', 'v': coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0)}}, {{'m': 'repeats', 'v': coalesce(n_repeat_words * 1000 // {over}, 0)}}]"""


def _by_measure(field: str) -> str:
    return "CASE m " + " ".join(f"WHEN '{n}' THEN {getattr(m, field) or 0}::DOUBLE" for n, m in quality.MEASURES.items()) + " END"


def _fences(name: str, by: str, group: str) -> str:
    """Quartiles and fences of the sketches per ``by``."""
    spread = f"greatest(q3 - q1, q3 * {_by_measure('share')}, {_by_measure('floor')}) * {_by_measure('reach')}"
    return f"""
{name} AS (
  SELECT {group}, m, n, least(q3 + {spread}, {_by_measure('most')}) AS high, greatest(q1 - {spread}, q1 * {_by_measure('least')}) AS low
  FROM (
    SELECT {group}, m, sum(n) AS n, min(bucket) FILTER (upto >= 0.25) AS q1, min(bucket) FILTER (upto >= 0.75) AS q3
    FROM (SELECT *, sum(n) OVER (PARTITION BY {by} m ORDER BY bucket) / sum(n) OVER (PARTITION BY {by} m)::DOUBLE AS upto
          FROM (SELECT {group}, m, bucket, sum(n) AS n FROM sketch GROUP BY ALL))
    GROUP BY ALL)
)"""


OP10 = rf"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
),
windows AS (
  SELECT r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM again) GROUP BY 1),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '{WORD}') GROUP BY 1
),
counts AS (
  SELECT r, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(repeats.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM words LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)
),
measures AS (SELECT r, lang, source, unnest({_measures("nullif(n_words, 0)")}, recursive := true) FROM counts),
sketch AS (
  SELECT lang, source, m, (v >> low) << low AS bucket, count(*) AS n
  FROM (SELECT lang, source, m, v, greatest(length(bin(v)) - {quality.SUB_BITS + 1}, 0)::BIGINT AS low FROM measures WHERE r IN (SELECT r FROM counts WHERE n_words > 0))
  GROUP BY ALL
),
{_fences("fine", "lang, source,", "lang, source")},
{_fences("mid", "lang,", "lang")},
{_fences("whole", "", "1 AS one")},
limits AS (
  SELECT fine.lang, fine.source, fine.m,
    CASE WHEN fine.n >= {quality.ENOUGH} THEN 'source' WHEN mid.n >= {quality.ENOUGH} THEN 'language' ELSE 'corpus' END AS level,
    CASE WHEN fine.n >= {quality.ENOUGH} THEN fine.low WHEN mid.n >= {quality.ENOUGH} THEN mid.low ELSE whole.low END AS low,
    CASE WHEN fine.n >= {quality.ENOUGH} THEN fine.high WHEN mid.n >= {quality.ENOUGH} THEN mid.high ELSE whole.high END AS high
  FROM fine JOIN mid ON fine.m = mid.m AND fine.lang IS NOT DISTINCT FROM mid.lang JOIN whole ON fine.m = whole.m
),
judged AS (
  SELECT r, any_value(level) AS level, bool_or(v > high OR x.m = 'mean_word' AND v < low) AS outside
  FROM measures x JOIN limits l ON x.m = l.m AND x.lang IS NOT DISTINCT FROM l.lang AND x.source IS NOT DISTINCT FROM l.source GROUP BY 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(outside, false) AS kept, level
FROM (SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed FROM counts) LEFT JOIN judged USING (r)
"""

def _codes_sql() -> str:
    """Every round written out: entries by part, squared distances, first nearest entries, floors of the means."""
    parts, rounds = vector_codes.PARTS, vector_codes.ROUNDS
    sql = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, [floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p)),
first AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS e, r FROM (SELECT vec_id, min_by(r, v) AS r FROM kept GROUP BY 1) ORDER BY vec_id LIMIT {vector_codes.ENTRIES}),
book0 AS MATERIALIZED (SELECT p, e, x AS c FROM first JOIN parts USING (r))"""
    for i in range(rounds + 1):
        sql += f""",
near{i} AS MATERIALIZED (
  SELECT r, p, (min(d * 256 + e) % 256)::BIGINT AS e, min(d) AS d FROM (
    SELECT r, p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN book{i} USING (p))
  GROUP BY ALL
)"""
        if i < rounds:
            sql += f""",
book{i + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(list(m ORDER BY i) FILTER (m IS NOT NULL), any_value(c)) AS c FROM book{i} LEFT JOIN (
    SELECT p, e, i, ((sum(y) - (sum(y) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS m
    FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM near{i} JOIN parts USING (r, p)) GROUP BY ALL) USING (p, e)
  GROUP BY ALL
)"""
    return sql + f""",
codes AS (SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN codes USING (r)
"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: More levels than any tree over 2^32 leaves has.
_LEVELS = 8


def _run_sql(source: str, name: str, of: str) -> str:
    """Runs and the next level's nodes; a lone node stays what it is."""
    return f""",
{name}_runs AS MATERIALIZED (
  SELECT {of}, i // {FANOUT} AS run, list(h ORDER BY i) AS hs, any_value(n) AS n FROM {source} GROUP BY ALL
),
{name} AS MATERIALIZED (
  SELECT {of}, run AS i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + {FANOUT - 1}) // {FANOUT} AS n FROM {name}_runs
)"""


def _step_sql(run: str, at: str) -> str:
    """Fold of one level and its siblings."""
    i = f"({at} % {FANOUT})"
    folded = f"CASE WHEN {run}.n = 1 THEN f ELSE sha256(array_to_string({run}.hs[:{i}], '') || f || array_to_string({run}.hs[{i} + 2:], '')) END"
    return f"SELECT * REPLACE ({folded} AS f, proof || array_to_string({run}.hs[:{i}], '') || array_to_string({run}.hs[{i} + 2:], '') AS proof, {at} // {FANOUT} AS {at})"


def _manifest_sql() -> str:
    field = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}, '-')"
    head = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
    sql = f"""
WITH tbl AS (
  SELECT list(r ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b::BIGINT, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS r FROM range(256) x(b))
),
crc AS (
  SELECT documents.*, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS crc
  FROM documents, tbl
),
leaves AS MATERIALIZED (
  SELECT doc_id, source, sha256({head} || {field.format("text")}) AS h,
    CASE WHEN crc % 5 = 0 THEN sha256({head} || {field.format(low)}) ELSE sha256({head} || {field.format("text")}) END AS f
  FROM crc
),
level0 AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves
)"""
    for k in range(1, _LEVELS + 1):
        sql += _run_sql(f"level{k - 1}", f"level{k}", "source")
    sql += f""",
top0 AS MATERIALIZED (SELECT 0 AS one, source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM level{_LEVELS})"""
    for k in range(1, _LEVELS + 1):
        sql += _run_sql(f"top{k - 1}", f"top{k}", "one")
    sql += """,
fold0 AS (SELECT doc_id, source, h AS leaf, f, '' AS proof, i FROM level0)"""
    for k in range(1, _LEVELS + 1):
        sql += f""",
fold{k} AS ({_step_sql("u", "i")} FROM fold{k - 1} JOIN level{k}_runs u ON u.source IS NOT DISTINCT FROM fold{k - 1}.source AND u.run = i // {FANOUT})""".replace(
            "SELECT *", f"SELECT fold{k - 1}.*"
        )
    sql += f""",
up0 AS (SELECT d.doc_id, d.leaf, d.f, d.proof, t.h AS subroot, t.i FROM fold{_LEVELS} d JOIN top0 t ON t.source IS NOT DISTINCT FROM d.source)"""
    for k in range(1, _LEVELS + 1):
        sql += f""",
up{k} AS ({_step_sql("u", "i")} FROM up{k - 1} JOIN top{k}_runs u ON u.run = i // {FANOUT})""".replace("SELECT *", f"SELECT up{k - 1}.*")
    return sql + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM up{_LEVELS}, top{_LEVELS}
"""


OP13 = f"""
WITH urls AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in url_rules.RULES)}) t(verdict, rule, rule_host, rule_path)),
numbered AS (SELECT *, row_number() OVER () AS r FROM urls),
best AS (
  SELECT r, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM numbered JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1
)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[^A-Za-z0-9])({"|".join(url_rules.UNWANTED)})([^A-Za-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM numbered LEFT JOIN best USING (r)
"""

ORACLE: dict[str, str] = {
    "op1_sharding": OP1, "op3_neardup": OP3, "op7_mixing": OP7, "op10_quality": OP10, "op11_vector_codes": _codes_sql(),
    "op12_manifest": _manifest_sql(), "op13_url_filter": OP13,
}
