"""SQL equivalents of the queries that SQL can express; tests hold the others against brute-force versions."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op2_suffix_automaton": f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {ALNUM} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {ALNUM} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, 13 AS n, array_to_string(w[i:i + 12], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, CAST(len(w) AS BIGINT) - 11)) AS i FROM items WHERE len(w) >= 13)
  UNION SELECT DISTINCT item, CAST(len(w) AS INTEGER), array_to_string(w, ' ') FROM items WHERE len(w) BETWEEN 1 AND 12),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT rid, w, n, unnest(range(1, CAST(len(w) AS BIGINT) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n),
found AS (
  SELECT p.rid, p.i, p.n, v.item FROM (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM places) p
  JOIN windows v ON v.n = p.n AND v.k = p.k),
hit AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM found) GROUP BY rid),
owned AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN owned USING (rid)""",
    "op5_chat_rendering": r"""
WITH said AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\*\|'))
    + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id""",
    "op7_url_sweep": f"""
WITH rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {AZ}) AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
fits AS (
  SELECT rid, rh || rp AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC, rh || rp) AS place
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (rid)""",
    "op9_quality_lines": f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
lines AS (SELECT rid, source, text, l, regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+') AS lw
  FROM (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS l FROM docs)),
worded AS (SELECT *, translate(array_to_string(lw, ' '), {AZ}) AS k FROM lines WHERE len(lw) > 0),
often AS (SELECT source, k FROM worded GROUP BY source, k HAVING count(DISTINCT text) > 20),
gone AS (SELECT rid, sum(len(lw)) AS n FROM worded JOIN often ON worded.source IS NOT DISTINCT FROM often.source AND worded.k = often.k
  GROUP BY rid),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM worded GROUP BY rid),
windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS times
  FROM (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
    FROM (SELECT rid, w, unnest(range(1, CAST(len(w) AS BIGINT) - 1)) AS i FROM docs WHERE len(w) >= 3))),
again AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM windows WHERE times > 1) GROUP BY rid),
all_of AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM docs LEFT JOIN dup USING (rid) LEFT JOIN again USING (rid) LEFT JOIN gone USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= CAST(0.3 AS DOUBLE) * n_words AS kept
FROM all_of""",
    "op12_fill_in_middle": f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, text, w, CAST(len(w) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM cut),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
    ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts""",
    "op13_residue_hard_negatives": """
WITH vectors AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.rid AS a, a.vec_id AS anchor_id, b.rid AS b, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.c, b.c), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 50 = 0 AND a.rid <> b.rid),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id, b) AS place FROM pairs WHERE same)
  WHERE place <= 5),
ranked AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.place ORDER BY n.score DESC, n.other_id, n.b) AS rank
  FROM positives p JOIN pairs n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3""",
}
