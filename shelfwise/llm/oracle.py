"""DuckDB statements for the registered queries that SQL can express."""

from __future__ import annotations

from shelfwise.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, needed, reach

SUBSTRING = r"""
WITH held AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), placed AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM held
), windows AS (
  SELECT doc_id, s, array_to_string(ws[s : s + 49], ' ') AS w FROM placed
), first_in AS (
  SELECT w, min(doc_id) AS least FROM windows GROUP BY w
), hit AS (
  SELECT doc_id, s FROM windows JOIN first_in USING (w) WHERE least < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(s, s + 50)) AS i FROM hit)
), numbered AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM held
), kept AS (
  SELECT n.doc_id, count(*) AS n_kept, string_agg(n.word, ' ' ORDER BY n.i) AS words
  FROM numbered n ANTI JOIN gone g ON n.doc_id = g.doc_id AND n.i = g.i GROUP BY n.doc_id
)
SELECT h.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(words, '')) AS kept_sha256
FROM held h LEFT JOIN kept USING (doc_id)
"""

LEAKS = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), ik AS (SELECT item_id, ws, least(len(ws), 5) AS k FROM iw WHERE len(ws) > 0),
items AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[s : s + k - 1], ' ') AS g
  FROM (SELECT item_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS s FROM ik)
), sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id),
docs AS (
  SELECT DISTINCT doc_id, k, array_to_string(ws[s : s + k - 1], ' ') AS g
  FROM (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS s FROM dw, (SELECT DISTINCT k FROM ik))
)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM items JOIN docs USING (k, g) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _licenses() -> str:
    """Every phrase at every word, and every template against every block, without filters."""
    phrases = ", ".join(f"('{p}', '{label}', {p.count(' ') + 1})" for p, label in PHRASES)
    templates = ", ".join(
        f"('{label}', string_split('{' '.join(held)}', ' '), {len(held)}, {needed(len(held), THRESHOLD)}, {reach(text)})"
        for label, text in TEMPLATES
        for held in [sorted(set(text.split()))]
    )
    return f"""
WITH held AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, {_WORD}) AS ws FROM documents
), phrases(phrase, label, n) AS (VALUES {phrases}),
starts AS (
  SELECT doc_id, label, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM held), phrases
  WHERE ws[i] = string_split(phrase, ' ')[1] AND array_to_string(ws[i : i + n - 1], ' ') = phrase
), base AS (
  SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word,
    list_sort(list(DISTINCT label)) AS labels
  FROM starts GROUP BY doc_id
), templates(label, t, size, needed, r) AS (VALUES {templates}),
blocks AS (
  SELECT doc_id, r, list_distinct(ws[k * r + 1 : (k + 2) * r]) AS b
  FROM (SELECT doc_id, ws, r, unnest(range(0, (len(ws) + r - 1) // r)) AS k FROM held, (SELECT DISTINCT r FROM templates))
), found AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(len(list_intersect(t, b)) / size) AS best
  FROM blocks JOIN templates USING (r) WHERE len(list_intersect(t, b)) >= needed GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(
    coalesce(base.labels, []::VARCHAR[]) || coalesce(found.labels, []::VARCHAR[]))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM held LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""


NEGATIVES = """
WITH rows AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS r FROM scores WHERE same
  ) WHERE r <= 5
), negatives AS (
  SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM positives JOIN scores USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 10
"""

ORACLE: dict[str, str] = {
    "op5_licenses": _licenses(),
    "op6_substring": SUBSTRING,
    "op10_decontaminate": LEAKS,
    "op12_negatives": NEGATIVES,
}
