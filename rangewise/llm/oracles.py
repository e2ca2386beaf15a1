"""The queries of this subpackage that SQL can say, in DuckDB's SQL."""

from __future__ import annotations

from rangewise.llm.license_scan import BASE, COVERAGE, K, SLACK, TEMPLATES, template_rows

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5 = f"""
WITH d AS (SELECT doc_id, {_SPACED} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM d, unnest(generate_series(1, len(ws) - 49)) AS g(i)),
firsts AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS pos FROM win JOIN firsts USING (k) WHERE first < doc_id),
word AS (SELECT doc_id, pos, ws[pos] AS w FROM d, unnest(generate_series(1, len(ws))) AS g(pos)),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

OP7 = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
b AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, ws[i:i + least(10, len(ws)) - 1] AS words
FROM b, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS g(i) WHERE len(ws) > 0),
win AS (SELECT doc_id, i, n, ws[i:i + n - 1] AS words FROM d, (SELECT DISTINCT n
FROM p) AS l, unnest(generate_series(1, len(ws) - n + 1)) AS g(i)),
hit AS (SELECT doc_id, i, win.n, item_id FROM win JOIN p ON p.words = win.words AND p.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS x FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)"""

_GRAMS = ", ".join(f"({t}, '{label}', {is_base}, '{gram}', {place}, {bit}::BIGINT, {grams}, {of_words})" for t, label, is_base, gram, place, bit, grams, of_words in template_rows(TEMPLATES, BASE))
OP10 = f"""
WITH t AS (SELECT * FROM (VALUES {_GRAMS}) v(template, label, is_base, gram, place, bit, grams, of_words)),
d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
g AS (SELECT doc_id, i - 1 AS spot, ws[i] || ' ' || ws[i + 1] AS gram FROM d, unnest(generate_series(1, len(ws) - {K - 1})) AS s(i)),
diag AS (SELECT doc_id, template, label, is_base, grams, of_words, spot - place AS diagonal, bit_or(bit) AS voted, min(spot) AS first, max(spot + {K - 1}) AS last
FROM g JOIN t USING (gram) GROUP BY ALL),
cut AS (SELECT *, is_base AND bit_count(voted) = grams AS whole, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template
ORDER BY diagonal) > {SLACK}, false)::INT AS apart FROM diag),
numbered AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM cut),
near AS (SELECT a.doc_id, a.template, a.run, a.diagonal, bit_count(bit_or(b.voted)) AS near FROM numbered a
JOIN numbered b ON a.doc_id = b.doc_id AND a.template = b.template AND a.run = b.run AND b.diagonal >= a.diagonal AND b.diagonal < a.diagonal + a.of_words
GROUP BY ALL),
most AS (SELECT doc_id, template, run, max(near) AS near FROM near GROUP BY ALL),
run AS (SELECT doc_id, template, label, is_base, grams, run, bit_or(voted) AS voted, count(*) FILTER (whole) AS places, min(diagonal) FILTER (whole) AS first_place, max(diagonal) FILTER (whole) AS last_place
FROM numbered GROUP BY ALL),
judged AS (SELECT run.*, CASE WHEN is_base THEN bit_count(voted) ELSE near END / grams AS share, CASE WHEN is_base THEN places > 0 ELSE near / grams >= {COVERAGE} END AS found
FROM run JOIN most USING (doc_id, template, run)),
doc AS (SELECT doc_id, sum(places) AS n_base, min(first_place) AS first_word, max(last_place) AS last_word, string_agg(DISTINCT label, ','
ORDER BY label) FILTER (places > 0) AS base_labels, string_agg(DISTINCT label, ','
ORDER BY label) FILTER (found) AS labels, max(share) FILTER (found) AS score FROM judged GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN doc USING (doc_id)"""
