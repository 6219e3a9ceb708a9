"""SQL twins of the queries that SQL can express, for another engine to run."""

from __future__ import annotations

from fleetlens.llm.mixing import MOST, SHARE, WEIGHTS

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORD = r"[^\x20\x09-\x0D]+"

MIXING = rf"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
           CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:15] AS BIGINT) AS draw
    FROM documents
), per_source AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           {list(WEIGHTS)}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight
    FROM sized GROUP BY source
), level AS (
    SELECT *, row_number() OVER filling AS nth,
           ({SHARE} * sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER (filling ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (filling ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM per_source WINDOW filling AS (ORDER BY source_size / weight, source NULLS LAST)
), aims AS (
    SELECT source, source_size,
           least({MOST}.0 * source_size, coalesce((SELECT arg_min(level, nth) FROM level WHERE level * weight <= {MOST}.0 * source_size) * weight, {MOST}.0 * source_size)) AS target
    FROM level
), split AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM aims
), drawn AS (
    SELECT d.*, source_size, target, passes, target - passes * source_size AS budget,
           coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY draw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS up_to,
           sum(d.size) OVER (PARTITION BY d.source, draw) AS tied
    FROM sized d JOIN split s ON d.source IS NOT DISTINCT FROM s.source
), bounds AS (
    SELECT source, arg_min(draw, draw) FILTER (up_to > budget) AS edge,
           arg_min((budget - (up_to - tied)) * 2 > tied, draw) FILTER (up_to > budget) AS nearer
    FROM drawn GROUP BY source
)
SELECT doc_id, d.source, size, source_size, target, passes + more AS copies, CAST((passes + more) * size AS BIGINT) AS taken
FROM (
    SELECT d.*, CASE WHEN draw < edge OR (draw = edge AND nearer) THEN 1 ELSE 0 END AS more
    FROM drawn d JOIN bounds b ON d.source IS NOT DISTINCT FROM b.source
) d
"""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

LINE_DEDUP = f"""
WITH lines AS (
    SELECT doc_id, text, row, pos, line,
           translate(trim(line, {SPACES}), '{UPPER}', '{UPPER.lower()}') AS key
    FROM (
        SELECT doc_id, text, row, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, text, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
    )
), shared AS (
    SELECT key FROM lines WHERE length(key) >= 1
    GROUP BY key HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'none')) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(s.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (s.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN shared s ON l.key = s.key
GROUP BY row, doc_id
"""

FILTER_AUDIT = rf"""
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
           min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
    FROM documents
), failing AS (
    SELECT doc_id, part,
           CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
           + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
           + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN least < doc_id THEN 16 ELSE 0 END AS mask
    FROM texts
), known AS (
    SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), masks AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM failing LEFT JOIN known USING (doc_id) GROUP BY part, mask
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
    SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(list_sum(bits[1:step - 1]) AS BIGINT) AS prefix
    FROM orders, range(1, 6) t(step)
), counted AS (
    SELECT part, filter_order, step, bit,
           CAST(coalesce(sum(n) FILTER (mask & (coalesce(prefix, 0) | bit) = 0), 0) AS BIGINT) AS kept,
           CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & coalesce(prefix, 0) = 0), 0) AS BIGINT) AS removed,
           CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & coalesce(prefix, 0) > 0), 0) AS BIGINT) AS redundant,
           CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
           CAST(coalesce(sum(good) FILTER (mask & bit > 0 AND mask & coalesce(prefix, 0) = 0), 0) AS BIGINT) AS good_lost,
           CAST(coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & coalesce(prefix, 0) = 0), 0) AS BIGINT) AS toxic_lost
    FROM masks, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley, letter AS filter
FROM counted JOIN letters USING (bit)
"""

TWINS = {"op2_mixing": MIXING, "op10_line_dedup": LINE_DEDUP, "op11_filter_audit": FILTER_AUDIT}
