"""DuckDB SQL that gives the rows of a query by plain set logic."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM words, unnest(range(1, greatest(2, len(w) - 2))) AS r(i) WHERE len(w) > 0 AND i + 4 <= greatest(len(w), 5)
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id
"""

_MIX_BODY = r"""
sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM {documents}
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
), steps AS (
  SELECT *, 1.5 * sum(source_size) OVER () AS budget,
         coalesce(sum(2 * source_size) OVER o, 0) AS full_words, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS rest
  FROM sources WINDOW o AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min((budget::DOUBLE - full_words::DOUBLE) / rest::DOUBLE, full_words) AS level FROM steps
  WHERE (budget::DOUBLE - full_words::DOUBLE) / rest::DOUBLE <= 2 * source_size / weight
), goals AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, coalesce(level, 0) * weight) AS target FROM sources, level
), drawn AS (
  SELECT sized.*, source_size, target, floor(least(2.0, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE * 1.0 ELSE 0.0 END)) AS whole,
         least(2.0, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE * 1.0 ELSE 0.0 END) AS expected
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source
), ranked AS (
  SELECT *, CASE WHEN expected - whole > 0 AND size > 0 THEN (u / (1 - u)) / ((expected - whole) / (1 - (expected - whole))) END AS place FROM drawn
), placed AS (
  SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS words_left,
         coalesce(sum(CASE WHEN place IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY place NULLS FIRST, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
  FROM ranked
), mixed AS (
  SELECT *, ((whole + CASE WHEN place IS NOT NULL AND so_far + size / 2.0 <= words_left THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM placed
)
"""

MIX = "WITH " + _MIX_BODY.replace("{documents}", "documents") + "SELECT doc_id, size, source_size, target, taken FROM mixed"

CONTAMINATION = rf"""
WITH words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS s
  FROM items, unnest(range(1, greatest(2, len(w) - 8))) AS r(i) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT n FROM windows),
places AS MATERIALIZED (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM words, lengths, unnest(range(1, len(w) - n + 2)) AS r(i)
), hits AS MATERIALIZED (SELECT doc_id, i, places.n, item_id FROM places JOIN windows ON places.s = windows.s AND places.n = windows.n),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(0, n)) AS r(j) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered ON covered.doc_id = words.doc_id LEFT JOIN found ON found.doc_id = words.doc_id
"""

PERSPECTIVES = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
party AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
seen AS (
  SELECT turns.*, perspective,
         '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || replace(translate(speaker, chr(10) || chr(13), '  '), '<|im_', '<|im-') END || chr(10) AS head
  FROM turns JOIN party ON turns.conv_id IS NOT DISTINCT FROM party.conv_id
), drawn AS (SELECT *, head || replace(text, '<|im_', '<|im-') || '<|im_end|>' || chr(10) AS rendered FROM seen),
placed AS (
  SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM drawn
)
SELECT conv_id, perspective, turn, speaker, sha256(rendered) AS rendered_sha256, place::BIGINT AS start, (place + length(head))::BIGINT AS mask_start,
       (CASE WHEN speaker = perspective THEN place + length(rendered) - 1 ELSE place + length(head) END)::BIGINT AS mask_end, speaker = perspective AS trained
FROM placed
"""

FILTER_AUDIT = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), least AS (SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text),
told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(texts.text, '[^A-Z]', '', 'g')) > 10 * length(texts.text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(texts.text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN texts.doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM texts JOIN least ON least.text = texts.text LEFT JOIN told ON told.doc_id = texts.doc_id
), counted AS MATERIALIZED (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, fails),
orders AS (
  SELECT '' AS o
  UNION ALL
  SELECT o || l FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS letters(l) WHERE NOT contains(o, l)
), steps AS (SELECT o AS filter_order, step, substr(o, step, 1) AS f, substr(o, 1, step - 1) AS before FROM orders, range(1, 6) AS r(step) WHERE length(o) = 5),
each AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) AS hit, before <> '' AND regexp_matches(fails, '[' || before || 'x]') AS gone
  FROM counted, steps
), summed AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM each GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM summed
"""

STRUCTURE_REPAIR = r"""
WITH RECURSIVE bytes AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, zero: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(0::BIGINT, 256::BIGINT) AS r(n)
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT)),
                         lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, bytes
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM named, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS r(copy)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), judged AS (
  SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
         substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), told AS MATERIALIZED (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM judged
), follow(state, nxt, needed) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
allowed(state, initial, nxt) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts AS (
  SELECT state, state AS at, 0 AS c, '' AS a, []::VARCHAR[] AS put FROM follow
  UNION ALL SELECT f.state, f.nxt, 5, 'I', [f.needed || ':'] FROM follow f
  UNION ALL SELECT f.state, g.nxt, 10, 'II', [f.needed || ':', g.needed || ':'] FROM follow f JOIN follow g ON g.state = f.nxt
), lengths AS (SELECT conv_id, count(*) AS n FROM told GROUP BY conv_id),
paths AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS put FROM lengths
  UNION ALL
  SELECT conv_id, i, state, cost, audit, put FROM (
    SELECT p.conv_id, t.i, e.nxt AS state, p.cost + s.c + e.c + CASE WHEN t.fault = 'truncated' AND e.letter <> 'D' THEN 5 ELSE 0 END AS cost,
           p.audit || s.a || e.letter AS audit,
           list_concat(p.put, s.put, CASE e.letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [t.role || ':' || t.text] ELSE [e.needed || ':' || t.text] END) AS put,
           row_number() OVER (PARTITION BY p.conv_id, e.nxt ORDER BY p.cost + s.c + e.c + CASE WHEN t.fault = 'truncated' AND e.letter <> 'D' THEN 5 ELSE 0 END, p.audit || s.a || e.letter) AS best
    FROM paths p JOIN told t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i + 1 JOIN inserts s ON s.state = p.state
    JOIN (
      SELECT state, state AS nxt, 'D' AS letter, 2 AS c, '' AS needed, NULL AS initial FROM follow
      UNION ALL SELECT state, nxt, 'R', 1, needed, NULL FROM follow
      UNION ALL SELECT state, nxt, 'K', 0, '', initial FROM allowed
    ) e ON e.state = s.at AND (e.letter = 'D' OR t.fault NOT IN ('blank', 'duplicate')) AND (e.initial IS NULL OR e.initial = t.initial)
  ) WHERE best = 1
), ended AS (
  SELECT p.conv_id, p.cost + s.c AS cost, p.audit || s.a AS audit, list_concat(p.put, s.put) AS put,
         row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + s.c, p.audit || s.a) AS best
  FROM paths p JOIN lengths l ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.n = p.i JOIN inserts s ON s.state = p.state WHERE s.at IN (0, 3)
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM told GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(put, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM c.conv_id AND best = 1
"""
