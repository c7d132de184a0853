"""The queries that SQL can express, in DuckDB's SQL over the given tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM base, unnest(range(1, len(words) - 6)) AS u(i) WHERE len(words) >= 8),
repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (
  SELECT doc_id, sum(least(8, i - before)) AS n FROM (
    SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) AS before FROM repeated) GROUP BY doc_id),
measured AS (
  SELECT b.doc_id, lang, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN covered c USING (doc_id)),
defects AS (
  SELECT *, CASE WHEN word_chars > 0 THEN 10000 * n_symbols // word_chars ELSE 0 END AS symbol_share,
         CASE WHEN n_lines > 0 THEN 10000 * n_dup_lines // n_lines ELSE 0 END AS dup_line_share,
         CASE WHEN n_words > 0 THEN 10000 * n_repeat_words // n_words ELSE 0 END AS repeat_share
  FROM measured),
rules AS (UNPIVOT defects ON symbol_share, dup_line_share, repeat_share INTO NAME rule VALUE defect),
bins AS (
  SELECT lang, rule, defect, sum((g = 1)::INT) AS good, sum((g <> 1)::INT) AS bad
  FROM rules JOIN (SELECT doc_id, min(quality) AS g FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id) USING (doc_id)
  GROUP BY ALL),
counted AS (
  SELECT *, sum(good) OVER (PARTITION BY lang, rule ORDER BY defect DESC) - good AS good_over,
         sum(bad) OVER (PARTITION BY lang, rule ORDER BY defect DESC) - bad AS bad_over,
         sum(good) OVER (PARTITION BY lang, rule) AS n_good, sum(bad) OVER (PARTITION BY lang, rule) AS n_bad
  FROM bins),
sizes AS (SELECT DISTINCT lang, n_good AS n, 0.05 / (3 * (SELECT count(*) FROM (SELECT DISTINCT lang FROM bins))) AS level FROM counted),
tails AS (
  SELECT lang, level, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.01) + (n - k) * ln(0.99)))
           OVER (PARTITION BY lang ORDER BY k) AS cdf
  FROM sizes, unnest(range(0, least(ceil(n * 0.01), n - 1)::BIGINT + 1)) AS u(k) WHERE n > 0),
limits AS (SELECT lang, max(k) AS k FROM tails WHERE cdf <= level GROUP BY lang),
chosen AS (
  SELECT c.lang, rule, arg_max(defect, (round(bad_over / greatest(n_bad, 1) - 5 * good_over / greatest(n_good, 1), 9), defect)) AS cut
  FROM counted c JOIN limits l ON c.lang IS NOT DISTINCT FROM l.lang
  WHERE good_over <= k AND bad_over / greatest(n_bad, 1) - 5 * good_over / greatest(n_good, 1) > 0
  GROUP BY c.lang, rule),
cuts AS (
  SELECT lang, max(cut) FILTER (rule = 'symbol_share') AS s, max(cut) FILTER (rule = 'dup_line_share') AS d, max(cut) FILTER (rule = 'repeat_share') AS r
  FROM chosen GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR coalesce(symbol_share > s, false)
            OR coalesce(dup_line_share > d, false) OR coalesce(repeat_share > r, false)) AS kept
FROM defects x LEFT JOIN cuts c ON x.lang IS NOT DISTINCT FROM c.lang
"""

MIXING = rf"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, ('0x' || substr(md5('7:' || doc_id), 1, 15))::BIGINT AS h FROM documents),
sources AS (
  SELECT source, sum(size) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sizes GROUP BY source),
rounds(i, level, weights) AS (
  SELECT 0, 1.5 * sum(source_size) / sum(weight), sum(weight)::DOUBLE FROM sources
  UNION ALL
  SELECT i + 1, (1.5 * total - clamped) / nullif(remaining, 0), remaining FROM (
    SELECT r.i, r.weights, sum(source_size) AS total, sum(CASE WHEN 2 * source_size < weight * r.level THEN 2 * source_size ELSE 0 END) AS clamped,
           sum(CASE WHEN 2 * source_size < weight * r.level THEN 0 ELSE weight END)::DOUBLE AS remaining
    FROM rounds r, sources GROUP BY r.i, r.weights, r.level) WHERE remaining <> weights),
targets AS (
  SELECT source, source_size::BIGINT AS source_size,
         least(2.0 * source_size, weight * (SELECT arg_max(level, i) FROM rounds WHERE level IS NOT NULL))::DOUBLE AS target
  FROM sources),
ordered AS (
  SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
         sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, round(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken
FROM ordered
"""

SHARDING = """
WITH sizes AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
tried AS (
  SELECT doc_id, bytes, h, d, sum(bytes) OVER (PARTITION BY d, h >> (60 - d)) AS shard_bytes
  FROM sizes, unnest(range(0, 61)) AS u(d) WHERE bytes <= 1048576),
placed AS (SELECT doc_id, bytes, h, shard_bytes, d FROM tried WHERE shard_bytes <= 1048576 OR d = 60
           QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d) = 1)
SELECT doc_id, bytes,
       CASE WHEN d = 0 THEN '' ELSE lpad(to_base(h >> (60 - d), 2), d::INT, '0') END || CASE WHEN shard_bytes > 1048576 THEN '!' ELSE '' END AS shard,
       d::INT AS depth, shard_bytes::BIGINT AS shard_bytes
FROM placed
UNION ALL
SELECT doc_id, bytes, lpad(to_base(h, 2), 60, '0') || '!', 60, bytes FROM sizes WHERE bytes > 1048576
"""

ORACLES = {
    "op3_quality_rules": QUALITY,
    "op4_water_filling": MIXING,
    "op7_extendible_hashing": SHARDING,
}
