"""DuckDB SQL for the queries that SQL can express."""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM sums),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(k % 3 + 1)::INT]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS lvl
  FROM weighed WINDOW w AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT min_by(lvl, (cap / weight, k)) AS lvl FROM levels WHERE lvl * weight < cap),
targets AS (
  SELECT source, source_size, CASE WHEN l.lvl * weight >= cap OR w.lvl IS NULL THEN cap ELSE least(w.lvl * weight, cap) END AS target
  FROM levels l CROSS JOIN water w),
numbered AS (
  SELECT s.*, t.source_size, t.target,
         row_number() OVER (PARTITION BY s.source ORDER BY size, ('0x' || substr(md5(doc_id::VARCHAR), 1, 6))::BIGINT % 4096, doc_id) AS rank,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS expected,
         (('0x' || substr(md5('20:' || coalesce(s.source, chr(0) || 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies
FROM (SELECT *, (floor(expected * rank + start) - floor(expected * (rank - 1) + start))::BIGINT AS copies FROM numbered)
"""

CHAT = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
escaped AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS t,
         replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n') AS r FROM rows_)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(r) + length(t) + 24)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

#: CRC-32 of a list of byte values, in a list `tab` of what each byte turns a state of 0 into.
CRC_TABLE = """
tab AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) ORDER BY b) AS tab FROM range(256) r(b)),
"""
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

RESAMPLING = rf"""
WITH {CRC_TABLE}
texts AS (SELECT 's' AS side, doc_id, {LOWER.format("text")} AS text FROM documents UNION ALL SELECT 't', NULL, {LOWER.format("text")} FROM benchmark),
words AS (SELECT side, doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
each AS (SELECT side, doc_id, word, count(*) AS n FROM words GROUP BY ALL),
hashed AS (SELECT word, {CRC.format("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM each), tab),
held AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM each JOIN hashed USING (word) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM held) + 10000) / ((s + 1) * ((SELECT sum(t) FROM held) + 10000))))::BIGINT AS gain FROM held),
sums AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM each JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 's' GROUP BY doc_id),
weighed AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(floor(total / n_features), 0)::BIGINT AS weight,
         (('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM documents d LEFT JOIN sums ON d.doc_id = sums.doc_id),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM weighed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY n_features >= 20) AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * able // 100 THEN k END AS rank FROM ranked
"""

SPELLING = rf"""
WITH RECURSIVE {CRC_TABLE}
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce({LOWER.format("text")}, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {CRC.format("(doc_id || ':' || run)")} AS h FROM each, tab),
given AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM given WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
without AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM without a JOIN without b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word),
near AS (SELECT word, count(*)::BIGINT AS n_near, min_by(other, (-other_n, other)) AS best, max(other_n) AS best_n FROM pairs GROUP BY word),
known AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN near USING (word)),
steps AS (
  SELECT word, word AS place, 0 AS k FROM known
  UNION ALL SELECT s.word, known.form, k + 1 FROM steps s JOIN known ON s.place = known.word WHERE known.form IS NOT NULL),
roots AS (SELECT word, max_by(place, k) AS root FROM steps GROUP BY word)
SELECT known.word, form, root, n, n_near, form_n FROM known JOIN roots ON known.word = roots.word
"""

ORACLES = {"op5_systematic_mixing": MIXING, "op6_chat_formatting": CHAT, "op11_importance_resampling": RESAMPLING, "op13_spelling_variants": SPELLING}
