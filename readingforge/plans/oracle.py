"""DuckDB SQL for the queries, in plain relational form."""

from __future__ import annotations

READINGS = """
cells0 AS (SELECT strftime(l_shipdate, '%Y-%m') AS sheet_id, CAST(day(l_shipdate) AS INT) AS day, CAST(l_suppkey % 8 + 1 AS INT) AS point,
  CASE WHEN l_linenumber % 2 = 0 THEN 'temperature' ELSE 'humidity' END AS reading_type, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM lineitem GROUP BY ALL),
cells AS (SELECT *, printf('day_%02d_point_%02d_%s.png', day, point, reading_type) AS filename,
  day * 7 + point * 3 + CAST(substr(sheet_id, 6, 2) AS INT) + CASE WHEN reading_type = 'temperature' THEN 1 ELSE 0 END AS mark FROM cells0)"""

SPELLED = READINGS + """,
plain AS (SELECT *, CAST(CAST(value AS BIGINT) AS VARCHAR) || '.' || CAST(mark % 10 AS VARCHAR) AS p FROM cells),
spelled AS (SELECT * EXCLUDE (p), CASE mark % 13 WHEN 0 THEN replace(p, '.', '') WHEN 1 THEN p || '5' WHEN 2 THEN '' WHEN 3 THEN '0' || p ELSE p END AS text FROM plain)"""


def _validated(table: str, text: str, allow: str, out: str) -> str:
    """`table` with blank, shaped, numeric_value, inside and the outcome of the value rule."""
    return f"""
{out}0 AS (SELECT *, {text} AS t, {allow} AS allow_blank, regexp_full_match({text}, '-?[0-9]+\\.[0-9]') AS shaped,
  CASE WHEN reading_type = 'temperature' THEN 10.0 ELSE 0.0 END AS lo, CASE WHEN reading_type = 'temperature' THEN 50.0 ELSE 100.0 END AS hi FROM {table}),
{out}1 AS (SELECT *, t = '' AS empty, CASE WHEN shaped THEN CAST(t AS DOUBLE) END AS num FROM {out}0),
{out} AS (SELECT *, CASE WHEN shaped AND num BETWEEN lo AND hi THEN regexp_replace(t, '^(-?)0+([0-9])', '\\1\\2') END AS normalized_value,
  CASE WHEN empty THEN allow_blank ELSE shaped END AS format_is_valid, CASE WHEN empty THEN allow_blank ELSE coalesce(shaped AND num BETWEEN lo AND hi, false) END AS within_absolute_limits,
  CASE WHEN empty AND allow_blank THEN NULL WHEN empty THEN 'Enter a value or mark the cell as blank.'
    WHEN NOT shaped AND (regexp_full_match(t, '[0-9]{{4,}}') OR regexp_full_match(t, '[0-9]+\\.[0-9]{{2,}}')) THEN 'Too many digits or decimal places; verify the handwritten value.'
    WHEN NOT shaped THEN 'Use exactly one decimal place, such as 22.0 or 53.3.'
    WHEN num NOT BETWEEN lo AND hi THEN 'The value must be within ' || printf('%.1f', lo) || ' to ' || printf('%.1f', hi) || '.' END AS error FROM {out}1)"""


def _anomalies(table: str, value: str, out: str) -> str:
    """The neighbourhood by a self-join, its median and MAD by two aggregations."""
    return f"""
{out}_peers AS (SELECT a.sheet_id, a.filename, any_value(a.{value}) AS v, any_value(a.reading_type) AS kind, median(b.{value}) AS med, count(*) AS n
  FROM {table} a JOIN {table} b ON a.sheet_id = b.sheet_id AND a.reading_type = b.reading_type AND a.filename <> b.filename
   AND (a.day = b.day OR (a.point = b.point AND abs(a.day - b.day) <= 2)) AND a.{value} IS NOT NULL AND b.{value} IS NOT NULL GROUP BY a.sheet_id, a.filename),
{out}_mad AS (SELECT a.sheet_id, a.filename, median(abs(b.{value} - p.med)) AS mad
  FROM {out}_peers p JOIN {table} a ON a.sheet_id = p.sheet_id AND a.filename = p.filename JOIN {table} b ON a.sheet_id = b.sheet_id AND a.reading_type = b.reading_type AND a.filename <> b.filename
   AND (a.day = b.day OR (a.point = b.point AND abs(a.day - b.day) <= 2)) AND a.{value} IS NOT NULL AND b.{value} IS NOT NULL GROUP BY a.sheet_id, a.filename),
{out} AS (SELECT c.*, coalesce(p.n, 0) AS context_size, CASE WHEN p.n >= 4 THEN p.med END AS context_median, CASE WHEN p.n >= 4 THEN m.mad END AS context_mad,
  CASE WHEN p.n >= 4 THEN greatest(CASE WHEN c.reading_type = 'temperature' THEN 4.0 ELSE 12.0 END, 3.5 * 1.4826 * m.mad) END AS threshold
  FROM {table} c LEFT JOIN {out}_peers p ON c.sheet_id = p.sheet_id AND c.filename = p.filename LEFT JOIN {out}_mad m ON c.sheet_id = m.sheet_id AND c.filename = m.filename)"""


RESULTS = SPELLED + """,
results AS (SELECT sheet_id, filename, day, point, reading_type, mark, text, mark % 11 = 0 AS is_blank, mark % 5 = 0 AS human_verified, CASE WHEN mark % 4 = 3 THEN 2 ELSE 3 END AS agreement,
  (80 + mark % 20) / 100 AS confidence, CASE WHEN mark % 4 = 3 THEN regexp_replace(text, '[0-9]$', '') || CAST((mark + 1) % 10 AS VARCHAR) ELSE text END AS third FROM spelled)"""


def _verified(table: str = "results") -> str:
    return (
        "," + _validated(table, "CASE WHEN is_blank THEN '' ELSE text END", "is_blank", "val")
        + ", valued AS (SELECT *, CASE WHEN error IS NULL THEN num END AS clean_num FROM val),"
        + _anomalies("valued", "clean_num", "anom")
        + """,
judged0 AS (SELECT *, coalesce(abs(clean_num - context_median) > threshold, false) AS is_anomaly,
  min(is_blank) OVER row_w <> max(is_blank) OVER row_w AS has_blank_mismatch,
  CASE WHEN reading_type <> 'temperature' OR num IS NULL THEN 'not applicable' WHEN num < 25 THEN 'normal' WHEN num < 30 THEN 'alert' WHEN num <= 35 THEN 'alarming' ELSE 'critical' END AS severity,
  NOT is_blank AND agreement = 2 AND confidence >= 0.85 AND error IS NULL AND num IS NOT NULL AND TRY_CAST(third AS DOUBLE) IS NOT NULL
    AND abs(TRY_CAST(third AS DOUBLE) - num) <= 0.1 + 1e-9 AND abs(TRY_CAST(third AS DOUBLE) - num) > 1e-9 AS minor,
  CASE WHEN is_blank THEN 0 ELSE CAST(agreement < 3 AS INT) + CAST(confidence < 0.85 AS INT) END AS material
  FROM anom WINDOW row_w AS (PARTITION BY sheet_id, day, point)),
judged1 AS (SELECT *, NOT is_blank AND empty AS missing, NOT (NOT is_blank AND empty) AND NOT format_is_valid AS malformed,
  NOT (NOT is_blank AND empty) AND format_is_valid AND NOT within_absolute_limits AS outside, severity IN ('alert', 'alarming', 'critical') AS warned FROM judged0),
judged2 AS (SELECT *, CAST(missing OR malformed OR outside AS INT) + CAST(has_blank_mismatch AS INT) AS n_blocking_errors,
  CASE WHEN minor THEN 0 ELSE material END + CAST(is_anomaly AS INT) AS n_required_confirmation_reasons, CAST(warned AS INT) AS n_operational_warnings, CAST(minor AS INT) AS n_informational_notices FROM judged1),
verified AS (SELECT *, n_blocking_errors > 0 OR (n_required_confirmation_reasons > 0 AND NOT human_verified) AS blocks_export, minor OR material > 0 AS ocr_uncertain,
  CASE WHEN is_blank THEN '' ELSE coalesce(normalized_value, text) END AS final_value,
  list_filter([CASE WHEN missing OR malformed THEN 'format' END, CASE WHEN outside THEN 'absolute_range' END, CASE WHEN minor OR material > 0 THEN 'ocr_uncertainty' END,
    CASE WHEN warned THEN 'operational_warning' END, CASE WHEN is_anomaly THEN 'anomaly' END, CASE WHEN has_blank_mismatch THEN 'blank_mismatch' END], lambda x: x IS NOT NULL) AS categories FROM judged2)"""
    )


VERIFIED = "WITH " + RESULTS + _verified()
CONFIRMED = """
confirmed AS (SELECT strftime(o_orderdate, '%Y-%m') AS sheet_id, CAST(day(o_orderdate) AS INT) AS day FROM orders GROUP BY ALL HAVING min(o_orderkey) % 3 <> 0)"""

_METRICS = """count(*) AS cell_count, count(*) FILTER (final_value_correct) AS final_correct, round(count(*) FILTER (final_value_correct) / count(*), 6) AS final_accuracy,
  round(count(*) FILTER (consensus_correct) / count(*), 6) AS consensus_accuracy, round(count(*) FILTER (postprocessing_correct) / count(*), 6) AS postprocessing_accuracy,
  count(*) FILTER (NOT needs_review AND final_value_correct) AS correct_automatic_acceptances, count(*) FILTER (NOT needs_review AND NOT final_value_correct) AS unsafe_automatic_acceptances,
  count(*) FILTER (needs_review) AS review_count, round(count(*) FILTER (needs_review) / count(*), 6) AS review_rate,
  round(count(*) FILTER (needs_review AND NOT final_value_correct) / nullif(count(*) FILTER (needs_review), 0), 6) AS review_precision, count(*) FILTER (needs_review AND final_value_correct) AS false_review_count,
  count(*) FILTER (expected_blank) AS expected_blank_count, count(*) FILTER (predicted_blank) AS predicted_blank_count,
  round(count(*) FILTER (expected_blank AND predicted_blank) / nullif(count(*) FILTER (predicted_blank), 0), 6) AS blank_precision,
  round(count(*) FILTER (expected_blank AND predicted_blank) / nullif(count(*) FILTER (expected_blank), 0), 6) AS blank_recall, count(*) FILTER (crop_alignment_failure) AS crop_alignment_failures"""
JUDGED = """WITH judged AS (SELECT CAST(doc_id AS VARCHAR) AS filename, lang, source, (quality = 1) = (n_chars > 800) AS final_value_correct, (quality = 1) = (n_chars > 400) AS consensus_correct,
  (quality = 1) = (n_chars > 1600) AS postprocessing_correct, n_chars % 5 = 0 AS needs_review, toxic = 1 AS expected_blank, n_chars % 9 = 0 AS predicted_blank, n_chars % 17 = 0 AS crop_alignment_failure
  FROM documents JOIN labels USING (doc_id))"""

_GATES = JUDGED + """, m AS (SELECT source, expected_blank, predicted_blank, needs_review, unnest(['f', 'c', 'h']) AS mode, unnest([final_value_correct, postprocessing_correct, consensus_correct]) AS ok,
  unnest([crop_alignment_failure, crop_alignment_failure AND needs_review, crop_alignment_failure AND NOT needs_review]) AS fail FROM judged),
g AS (SELECT mode, coalesce(source, '') AS s, count(*) FILTER (ok) AS r, count(*) FILTER (NOT needs_review AND NOT ok) AS u, count(*) FILTER (fail) AS x, count(*) FILTER (expected_blank) AS eb, count(*) FILTER (predicted_blank) AS pb,
  round(count(*) FILTER (expected_blank AND predicted_blank) / nullif(count(*) FILTER (predicted_blank), 0), 6) AS bp, round(count(*) FILTER (expected_blank AND predicted_blank) / nullif(count(*) FILTER (expected_blank), 0), 6) AS br
  FROM m GROUP BY GROUPING SETS ((mode), (mode, source)) HAVING grouping(source) = 1 OR source IS NOT NULL)"""
_JOINED = " CROSS JOIN ".join(f"(SELECT * FROM g WHERE mode = '{m}' AND s = '{'' if k is None else f'src{k}'}') {m}{'' if k is None else k}" for m in "fch" for k in (None, 0, 1, 2))

METHODS = """WITH raw AS (SELECT strftime(l_shipdate, '%Y-%m') AS sheet_id, strftime(l_shipdate, '%Y-%m') || '_' || day(l_shipdate) || '_' || l_suppkey % 8 AS filename, l_returnflag AS flag, CAST(l_quantity AS BIGINT) AS q, l_orderkey AS k FROM lineitem),
mc AS (SELECT sheet_id, filename, coalesce(CAST(sum(q) FILTER (flag = 'N') AS BIGINT), 0) AS n, coalesce(CAST(sum(q) FILTER (flag <> 'N') AS BIGINT), 0) AS r, min(k) AS k FROM raw GROUP BY ALL),
dr AS (SELECT sheet_id, sum(r) / sum(n + r) AS drift FROM mc GROUP BY sheet_id),
ab AS (SELECT sheet_id, filename, n AS ax, r AS bx, (n + k) % 3 <> 0 AS a_ok, (r + k) % 3 <> 0 AS b_ok, n % 4 = 0 AS a_review, r % 4 = 0 AS b_review, n % 6 = 0 AS a_block, r % 6 = 0 AS b_block,
  n % 4 <> 0 AND n % 6 <> 0 AS a_auto, r % 4 <> 0 AND r % 6 <> 0 AS b_auto FROM mc)"""
HYBRID = METHODS + """,
hy0 AS (SELECT ab.*, CASE WHEN drift >= 0.30 THEN 'calibrated' ELSE 'fixed' END AS selected_geometry, ax <> bx AS value_disagreement, (ax = 0) <> (bx = 0) AS blank_disagreement,
  (a_block AND b_auto) OR (b_block AND a_auto) AS blocking_disagreement, drift >= 0.30 AS geometry_confirmation FROM ab JOIN dr USING (sheet_id)),
hy AS (SELECT *, value_disagreement OR blank_disagreement OR blocking_disagreement OR geometry_confirmation AS needs_confirmation FROM hy0)"""

SERIES = "WITH s AS (SELECT user_id, event_id, round(value, 2) AS value FROM events)"

def _patched() -> str:
    """Cells folded over their patches one by one: st has a row for each cell and step."""
    return "WITH RECURSIVE " + RESULTS + "," + f"""
pt0 AS (SELECT strftime(o_orderdate, '%Y-%m') AS sheet_id, CAST(o_orderkey AS INT) AS seq, printf('day_%02d_point_%02d_%s.png', day(o_orderdate), o_custkey % 8 + 1, CASE WHEN o_orderkey % 2 = 0 THEN 'temperature' ELSE 'humidity' END) AS filename,
  o_orderkey % 4 < 2 AS has_value, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 60) || '.' || (o_orderkey % 10) WHEN 1 THEN CAST(o_orderkey % 600 AS VARCHAR) END AS v,
  CASE o_orderkey % 7 WHEN 0 THEN true WHEN 1 THEN false END AS pb, CASE WHEN o_orderkey % 3 = 0 THEN true END AS pv FROM orders),
pt AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, filename ORDER BY seq) AS k FROM pt0),
st AS (
  SELECT sheet_id, filename, reading_type, day, CAST(0 AS BIGINT) AS k, CAST(NULL AS INT) AS seq, text AS value, is_blank AS blank, human_verified AS verified, false AS changed, false AS touched, CAST(NULL AS VARCHAR) AS error FROM results
  UNION ALL
  SELECT sheet_id, filename, reading_type, day, k, seq, CASE WHEN error IS NULL THEN nv ELSE value END, CASE WHEN error IS NULL THEN nb ELSE blank END, CASE WHEN error IS NULL THEN nver ELSE verified END,
    changed OR (error IS NULL AND (nv <> value OR nb <> blank)), touched OR (error IS NULL AND (nv <> value OR nb <> blank OR nver <> verified)), error
  FROM (SELECT *, CASE WHEN nb THEN '' WHEN has_value THEN regexp_replace(v, '^0+([0-9])', '\\1') ELSE value END AS nv, coalesce(pv, verified) AS nver,
      CASE WHEN nb THEN NULL WHEN has_value AND NOT regexp_full_match(v, '-?[0-9]+\\.[0-9]') THEN CASE WHEN regexp_full_match(v, '[0-9]{{4,}}') THEN 'Too many digits or decimal places; verify the handwritten value.' ELSE 'Use exactly one decimal place, such as 22.0 or 53.3.' END
        WHEN has_value AND reading_type = 'temperature' AND CAST(v AS DOUBLE) NOT BETWEEN 10 AND 50 THEN 'The value must be within 10.0 to 50.0.'
        WHEN has_value AND reading_type = 'humidity' AND CAST(v AS DOUBLE) NOT BETWEEN 0 AND 100 THEN 'The value must be within 0.0 to 100.0.'
        WHEN NOT has_value AND blank THEN 'A value is needed to unmark a blank cell.' END AS error
    FROM (SELECT st.* EXCLUDE (k, seq, error), pt.k, pt.seq, pt.has_value, pt.v, pt.pv, coalesce(pt.pb, st.blank) AS nb FROM st JOIN pt ON st.sheet_id = pt.sheet_id AND st.filename = pt.filename AND pt.k = st.k + 1))),
fin AS (SELECT sheet_id, filename, any_value(reading_type) AS reading_type, arg_max(value, k) AS value, arg_max(blank, k) AS blank, arg_max(verified, k) AS verified, arg_max(changed, k) AS changed, arg_max(touched, k) AS touched, any_value(day) AS day FROM st GROUP BY ALL)"""


_CORRECT = r"""
WITH p AS (SELECT p_partkey, p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'temperature' ELSE 'humidity' END AS reading_type FROM part),
t AS (SELECT *, CASE k % 6 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN CAST(k % 900 + 100 AS VARCHAR) WHEN 2 THEN (k % 70) || '.' || (k % 10) WHEN 3 THEN (k % 70) || '.' || (k % 100 + 100)
  WHEN 4 THEN (k % 100) || '.' ELSE (k % 10) || '-' END AS text, CASE WHEN reading_type = 'temperature' THEN 10.0 ELSE 0.0 END AS lo, CASE WHEN reading_type = 'temperature' THEN 50.0 ELSE 100.0 END AS hi FROM p),
c AS (SELECT *, CASE WHEN length(text) >= 2 AND regexp_full_match(text, '[0-9]+') THEN text[:-2] || '.' || text[-1:] END AS c1,
  CASE WHEN length(text) >= 3 AND regexp_full_match(text[2:], '[0-9]+') THEN text[2:-2] || '.' || text[-1:] END AS c2,
  CASE WHEN length(text) >= 3 AND regexp_full_match(text[:-2], '[0-9]+') THEN text[:-3] || '.' || text[-2:-2] END AS c3, regexp_extract(text, '^([^.]*\.[0-9])', 1) AS cut FROM t),
f AS (SELECT *, list_sort(list_distinct(list_filter([text[2:], c1, c2, c3], lambda x: x IS NOT NULL AND regexp_full_match(x, '-?[0-9]+\.[0-9]') AND TRY_CAST(x AS DOUBLE) BETWEEN lo AND hi))) AS found,
  regexp_full_match(text, '-?[0-9]+\.[0-9]') AND TRY_CAST(text AS DOUBLE) BETWEEN lo AND hi AS fine, regexp_full_match(cut, '-?[0-9]+\.[0-9]') AND TRY_CAST(cut AS DOUBLE) BETWEEN lo AND hi AS cut_fine,
  coalesce(TRY_CAST(c1 AS DOUBLE) BETWEEN lo AND hi, false) AS c1_fine FROM c),
s AS (SELECT *, CASE WHEN text = '' THEN 'empty_prediction' WHEN regexp_full_match(text, '-?[0-9]*\.[0-9]{2,}') THEN 'extra_decimal_digits' WHEN fine THEN 'valid_unchanged'
  WHEN regexp_full_match(text, '[0-9]{3}') AND c1_fine THEN 'decimal_inferred' WHEN regexp_full_match(text, '[0-9]{3}') THEN 'three_digit_inference_invalid' WHEN contains(text, '.') THEN 'malformed_with_decimal'
  WHEN regexp_full_match(text, '[0-9]{4,}') THEN 'too_many_digits' WHEN len(found) = 1 THEN 'proposed_correction' WHEN len(found) > 1 THEN 'multiple_interpretations' ELSE 'no_safe_correction' END AS status FROM f)
"""

SQL: dict[str, str] = {
    "reading_anomaly": "WITH " + READINGS + "," + _anomalies("cells", "value", "x") + """
SELECT sheet_id, day, point, reading_type, value, CAST(context_size AS INT) AS context_size, context_median, context_mad, threshold, coalesce(abs(value - context_median) > threshold, false) AS is_anomaly FROM x""",
    "reading_validate": "WITH " + SPELLED + "," + _validated("spelled", "text", "mark % 2 = 0", "v") + """
SELECT sheet_id, day, point, reading_type, normalized_value, num AS numeric_value, format_is_valid, within_absolute_limits, error FROM v""",
    "reading_normalize": r"""
WITH raw AS (SELECT doc_id, regexp_replace(translate(coalesce(x, ''), 'OoQIl|,·•_', '000111....'), '[^0-9.\-]', '', 'g') AS t, k FROM
  (SELECT doc_id, text AS x, 1 AS k FROM documents UNION ALL SELECT doc_id, '-' || doc_id || ',5.2-', 2 FROM documents)),
dig AS (SELECT *, replace(t, '-', '') AS d FROM raw),
one AS (SELECT doc_id, k, CASE WHEN t LIKE '-%' THEN '-' ELSE '' END || CASE WHEN contains(d, '.') THEN split_part(d, '.', 1) || '.' || replace(substr(d, strpos(d, '.') + 1), '.', '') ELSE d END AS n FROM dig)
SELECT doc_id, max(n) FILTER (k = 1) AS head, max(n) FILTER (k = 2) AS number FROM one GROUP BY doc_id""",
    "reading_correct": _CORRECT + r"""SELECT p_partkey, text, CASE status WHEN 'decimal_inferred' THEN c1 WHEN 'proposed_correction' THEN found[1] ELSE text END AS corrected_text, status IN ('decimal_inferred', 'proposed_correction') AS changed,
  status <> 'valid_unchanged' AS needs_review, status,
  CASE WHEN status = 'extra_decimal_digits' AND cut_fine THEN cut WHEN status = 'decimal_inferred' THEN c1 WHEN status IN ('too_many_digits', 'proposed_correction', 'multiple_interpretations') THEN array_to_string(found, '|') ELSE '' END AS candidates FROM s""",
    "severity_bands": """
SELECT CASE WHEN event_id % 10 = 0 THEN 'not applicable' WHEN value / 10 < 25 THEN 'normal' WHEN value / 10 < 30 THEN 'alert' WHEN value / 10 <= 35 THEN 'alarming' ELSE 'critical' END AS severity, count(*) AS n FROM events GROUP BY 1""",
    "consensus_vote": """
WITH f AS (SELECT user_id, day(ts) AS day, event_type, arg_min(value, event_id) AS value FROM events GROUP BY ALL),
v AS (SELECT user_id, CAST(day AS INT) AS day, CAST(list_position(['view', 'click', 'purchase', 'signup', 'error'], event_type) AS INT) AS ord, CAST(CAST(floor(value) AS BIGINT) % 4 AS VARCHAR) AS text, CAST(round(value / 500, 4) AS DECIMAL(6,4)) AS c FROM f),
t AS (SELECT user_id, day, text, count(*) AS votes, sum(c) / count(*) AS mean, sum(CAST(c * 10000 AS BIGINT)) AS tenths, min(ord) AS first FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY votes DESC, tenths * 60 // votes DESC, first) AS k, count(*) OVER (PARTITION BY user_id, day, votes) AS tied FROM t)
SELECT user_id, day, text AS consensus, CAST(votes AS INT) AS agreement_count, round(tenths / votes / 10000, 6) AS average_confidence, tied > 1 AS ambiguous FROM r WHERE k = 1""",
    "variant_accuracy": """
WITH r AS (SELECT event_type AS variant, (event_id % 3) || '.' || (user_id % 2) AS text, CASE WHEN event_id % 5 = 0 THEN (event_id % 3) || '' || (user_id % 2) ELSE (event_id % 2) || '.0' END AS expected, event_id % 100 / 100 AS confidence FROM events)
SELECT variant, count(*) AS n, count(*) FILTER (text = expected) AS correct, round(count(*) FILTER (text = expected) / count(*), 6) AS accuracy,
  count(*) FILTER (text <> expected AND replace(text, '.', '') = replace(expected, '.', '')) AS decimal_errors, round(avg(confidence), 6) AS mean_confidence,
  round(coalesce(avg(confidence) FILTER (text = expected), 0), 6) AS mean_confidence_correct, round(coalesce(avg(confidence) FILTER (text <> expected), 0), 6) AS mean_confidence_wrong FROM r GROUP BY variant""",
    "pair_rows": "WITH " + READINGS + """
SELECT sheet_id, day, point, max(value) FILTER (reading_type = 'temperature') AS temperature_value, max(filename) FILTER (reading_type = 'temperature') AS temperature_filename,
  max(value) FILTER (reading_type = 'humidity') AS humidity_value, max(filename) FILTER (reading_type = 'humidity') AS humidity_filename,
  count(*) FILTER (reading_type = 'temperature') AS n_temperature, count(*) FILTER (reading_type = 'humidity') AS n_humidity FROM cells GROUP BY ALL""",
    "pair_violations": "WITH " + READINGS + """
SELECT s.sheet_id, CAST(d.day AS INT) AS day, CAST(p.point AS INT) AS point, count(*) FILTER (reading_type = 'temperature') AS n_temperature, count(*) FILTER (reading_type = 'humidity') AS n_humidity
FROM (SELECT DISTINCT sheet_id FROM cells) s CROSS JOIN range(1, 32) d(day) CROSS JOIN range(1, 9) p(point) LEFT JOIN cells c ON c.sheet_id = s.sheet_id AND c.day = d.day AND c.point = p.point
GROUP BY ALL HAVING n_temperature <> 1 OR n_humidity <> 1""",
    "missing_grid": "WITH " + READINGS + """
SELECT s.sheet_id, CAST(d.day AS INT) AS day, CAST(p.point AS INT) AS point, k.reading_type FROM (SELECT DISTINCT sheet_id FROM cells) s CROSS JOIN range(1, 32) d(day) CROSS JOIN range(1, 9) p(point)
CROSS JOIN (VALUES ('temperature'), ('humidity')) k(reading_type) WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.sheet_id = s.sheet_id AND c.day = d.day AND c.point = p.point AND c.reading_type = k.reading_type)""",
    "blank_mismatch": "WITH " + RESULTS + """, pairs AS (SELECT sheet_id, day, point, count(*) AS n, count(DISTINCT is_blank) AS states FROM results GROUP BY ALL)
SELECT sheet_id, CAST(coalesce(sum(n) FILTER (states = 2), 0) AS BIGINT) AS cells, count(*) FILTER (states = 2) AS rows FROM pairs GROUP BY sheet_id""",
    "verify_cells": VERIFIED + """
SELECT sheet_id, day, point, reading_type, final_value, format_is_valid, within_absolute_limits, severity AS operational_severity, is_anomaly AS is_statistical_anomaly, has_blank_mismatch, ocr_uncertain, blocks_export,
  blocks_export AS needs_review, array_to_string(categories, ',') AS categories, n_blocking_errors, n_required_confirmation_reasons, n_operational_warnings, n_informational_notices,
  n_blocking_errors + n_required_confirmation_reasons + n_operational_warnings + n_informational_notices AS n_verification_reasons FROM verified""",
    "category_counts": VERIFIED + """
SELECT n.category, count(v.c) AS n FROM (VALUES ('format'), ('absolute_range'), ('ocr_uncertainty'), ('operational_warning'), ('anomaly'), ('blank_mismatch')) n(category)
LEFT JOIN (SELECT unnest(categories) AS c FROM verified) v ON v.c = n.category GROUP BY n.category""",
    "table_filters": VERIFIED + """
SELECT filter, count(*) FILTER (CASE filter WHEN 'All' THEN true WHEN 'Unresolved' THEN blocks_export WHEN 'Blocking' THEN n_blocking_errors > 0 WHEN 'Confirmations' THEN n_required_confirmation_reasons > 0
  WHEN 'Warnings' THEN n_operational_warnings > 0 WHEN 'Notices' THEN n_informational_notices > 0 WHEN 'Blank mismatches' THEN has_blank_mismatch ELSE blocks_export OR len(categories) > 0 END) AS n
FROM verified CROSS JOIN (VALUES ('All'), ('Unresolved'), ('Blocking'), ('Confirmations'), ('Warnings'), ('Notices'), ('Blank mismatches'), ('Detailed')) f(filter) GROUP BY filter""",
    "row_status": VERIFIED + """, w AS (SELECT sheet_id, day, point, max(final_value) FILTER (reading_type = 'temperature') AS temperature_final_value, max(final_value) FILTER (reading_type = 'humidity') AS humidity_final_value,
  bool_or(blocks_export) AS blocked, coalesce(bool_or(warned) FILTER (reading_type = 'temperature'), false) AS has_operational_warning, bool_or(minor) AS noticed,
  coalesce(any_value(categories) FILTER (reading_type = 'temperature'), []) AS tc, coalesce(any_value(categories) FILTER (reading_type = 'humidity'), []) AS hc FROM verified GROUP BY ALL)
SELECT sheet_id, day, point, temperature_final_value, humidity_final_value, CASE WHEN blocked THEN 'Blocked' WHEN has_operational_warning THEN 'Operational warning' WHEN noticed THEN 'Ready with notice' ELSE 'Ready' END AS row_status,
  has_operational_warning, array_to_string(tc || list_filter(hc, lambda x: NOT list_contains(tc, x)), ',') AS categories FROM w""",
    "display_status": VERIFIED + """
SELECT reading_type, CASE WHEN (missing OR malformed) THEN 'Blocking format error' WHEN n_blocking_errors > 0 THEN 'Blocking error' WHEN is_blank THEN 'Blank'
  WHEN n_required_confirmation_reasons > 0 AND NOT human_verified THEN 'Needs attention' WHEN warned THEN 'Operational warning'
  WHEN human_verified OR n_required_confirmation_reasons + n_informational_notices = 0 THEN 'Confirmed' ELSE 'Needs attention' END AS status, count(*) AS n FROM verified GROUP BY ALL""",
    "readiness_summary": VERIFIED + "," + CONFIRMED + """, f AS (SELECT sheet_id, count(*) FILTER (n_blocking_errors > 0) AS blocking_cells, count(*) FILTER (n_required_confirmation_reasons > 0 AND NOT human_verified) AS unverified_confirmations,
  count(*) FILTER (NOT format_is_valid OR NOT within_absolute_limits) AS invalid_values, count(*) FILTER (blocks_export) AS blocked_cells, count(DISTINCT (day, point)) FILTER (has_blank_mismatch) AS mismatch_rows FROM verified GROUP BY sheet_id),
u AS (SELECT f.*, 31 - (SELECT count(*) FROM confirmed c WHERE c.sheet_id = f.sheet_id) AS unconfirmed_days FROM f)
SELECT *, unconfirmed_days + blocking_cells + unverified_confirmations + invalid_values + blocked_cells + mismatch_rows = 0 AS ready FROM u""",
    "day_confirmable": "WITH " + RESULTS.replace("mark % 5 = 0 AS human_verified", "true AS human_verified") + _verified() + """
SELECT sheet_id, day, count(*) = 16 AND bool_and(format_is_valid AND within_absolute_limits AND NOT blocks_export AND NOT has_blank_mismatch) AS confirmable FROM verified GROUP BY ALL""",
    "next_day": "WITH " + CONFIRMED + """, cur AS (SELECT * FROM confirmed),
o AS (SELECT cur.sheet_id, cur.day, CAST(d.d AS INT) AS d FROM cur CROSS JOIN range(1, 32) d(d) WHERE d.d <> cur.day AND NOT EXISTS (SELECT 1 FROM confirmed c WHERE c.sheet_id = cur.sheet_id AND c.day = d.d))
SELECT cur.sheet_id, cur.day, coalesce((SELECT arg_min(o.d, (o.d - cur.day - 1 + 31) % 31) FROM o WHERE o.sheet_id = cur.sheet_id AND o.day = cur.day), cur.day) AS next, greatest(cur.day - 1, 1) AS previous FROM cur""",
    "apply_patches": _patched() + """
SELECT fin.sheet_id, fin.day, r.point, fin.reading_type, fin.value AS final_value, fin.blank AS is_blank, fin.verified AS human_verified, CASE WHEN fin.changed THEN 'manually_corrected' ELSE 'valid_unchanged' END AS postprocessing_status, fin.touched
FROM fin JOIN results r ON r.sheet_id = fin.sheet_id AND r.filename = fin.filename""",
    "patch_errors": _patched() + """
SELECT sheet_id, filename, seq, error FROM st WHERE error IS NOT NULL
UNION ALL SELECT sheet_id, filename, seq, 'Unknown cell.' FROM pt WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.sheet_id = pt.sheet_id AND r.filename = pt.filename)""",
    "invalidated_days": _patched() + "," + CONFIRMED + """
SELECT sheet_id, day FROM confirmed c WHERE NOT EXISTS (SELECT 1 FROM fin WHERE fin.touched AND fin.sheet_id = c.sheet_id AND fin.day = c.day)""",
    "label_errors": "WITH " + SPELLED + """,
lab AS (SELECT sheet_id || '__' || filename AS filename, reading_type, text AS v, mark % 11 = 0 AS b FROM spelled),
ids AS (SELECT s.sheet_id || '__' || printf('day_%02d_point_%02d_%s.png', d.d, p.p, k.k) AS filename FROM (SELECT DISTINCT sheet_id FROM spelled) s CROSS JOIN range(1, 32) d(d) CROSS JOIN range(1, 9) p(p) CROSS JOIN (VALUES ('temperature'), ('humidity')) k(k))
SELECT filename, 'missing' AS error FROM ids WHERE filename NOT IN (SELECT filename FROM lab)
UNION ALL SELECT filename, 'unknown' FROM lab WHERE filename NOT IN (SELECT filename FROM ids) UNION ALL SELECT filename, 'repeated' FROM lab GROUP BY filename HAVING count(*) > 1
UNION ALL SELECT filename, 'value and blank' FROM lab WHERE b AND v <> '' UNION ALL SELECT filename, 'no label' FROM lab WHERE NOT b AND v = ''
UNION ALL SELECT filename, 'invalid value' FROM lab WHERE NOT b AND v <> '' AND NOT (regexp_full_match(v, '-?[0-9]+\\.[0-9]') AND TRY_CAST(v AS DOUBLE) BETWEEN CASE WHEN reading_type = 'temperature' THEN 10 ELSE 0 END AND CASE WHEN reading_type = 'temperature' THEN 50 ELSE 100 END)""",
    "quality_metrics": JUDGED + f" SELECT source, {_METRICS} FROM judged GROUP BY source",
    "quality_grouping_sets": JUDGED + f""" SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(lang) = 0 THEN 'lang' ELSE 'overall' END AS dimension, coalesce(source, lang) AS value, {_METRICS}
FROM judged GROUP BY GROUPING SETS ((), (source), (lang))""",
    "blank_confusion": JUDGED + """, l AS (SELECT lang AS mode, filename, expected_blank, unnest(['before', 'after']) AS stage, unnest([predicted_blank, predicted_blank AND final_value_correct]) AS blank FROM judged)
SELECT mode, stage, count(*) FILTER (expected_blank AND blank) AS true_blanks, round(count(*) FILTER (expected_blank AND blank) / nullif(count(*) FILTER (blank), 0), 6) AS blank_precision,
  round(count(*) FILTER (expected_blank AND blank) / nullif(count(*) FILTER (expected_blank), 0), 6) AS blank_recall, coalesce(string_agg(filename, ',' ORDER BY filename) FILTER (blank AND NOT expected_blank), '') AS false_blanks,
  coalesce(string_agg(filename, ',' ORDER BY filename) FILTER (NOT blank AND expected_blank), '') AS missed_blanks FROM l GROUP BY ALL""",
    "ab_compare": METHODS + """
SELECT CASE WHEN a_ok AND b_ok THEN 'both_correct' WHEN b_ok THEN 'improved' WHEN a_ok THEN 'regressed' ELSE 'both_wrong' END AS outcome,
  CASE WHEN a_review AND NOT b_review THEN 'review_to_automatic' WHEN NOT a_review AND b_review THEN 'automatic_to_review' WHEN a_review THEN 'review' ELSE 'automatic' END AS disposition,
  count(*) AS n, count(*) FILTER (ax <> bx) AS changed FROM ab GROUP BY ALL""",
    "hybrid_policy": HYBRID + """
SELECT filename, sheet_id, selected_geometry, CAST(CASE WHEN geometry_confirmation THEN bx ELSE ax END AS VARCHAR) AS final_value, CASE WHEN geometry_confirmation THEN bx = 0 ELSE ax = 0 END AS predicted_blank,
  needs_confirmation OR CASE WHEN geometry_confirmation THEN b_block ELSE a_block END AS blocks_export, NOT needs_confirmation AND CASE WHEN geometry_confirmation THEN b_auto ELSE a_auto END AS automatic_acceptance,
  value_disagreement, blank_disagreement, blocking_disagreement, geometry_confirmation, needs_confirmation FROM hy""",
    "hybrid_counters": HYBRID + """
SELECT count(*) FILTER (selected_geometry = 'fixed') AS fixed_selected, count(*) FILTER (selected_geometry = 'calibrated') AS calibrated_selected, count(*) FILTER (value_disagreement) AS value_disagreement,
  count(*) FILTER (blank_disagreement) AS blank_disagreement, count(*) FILTER (blocking_disagreement) AS blocking_disagreement, count(*) FILTER (geometry_confirmation) AS geometry_confirmation FROM hy""",
    "release_gates": JUDGED + f""", m AS (SELECT lang, {_METRICS} FROM judged GROUP BY lang),
g AS (SELECT lang, coalesce(final_accuracy >= 0.5, false) AS accurate, coalesce(unsafe_automatic_acceptances <= 60, false) AS safe, coalesce(review_rate < 0.3, false) AS reviews, coalesce(blank_recall > 0.05, false) AS blanks FROM m)
SELECT *, accurate AND safe AND reviews AND blanks AS passed FROM g""",
    "label_template": """
WITH d AS (SELECT doc_id, source AS sheet_id, CAST(doc_id AS VARCHAR) AS filename FROM documents),
j AS (SELECT d.*, CASE WHEN quality = 1 THEN '22.0' END AS ev, toxic = 1 AS eb, CASE WHEN item_id IS NOT NULL THEN '30.5' END AS tv FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id)
SELECT sheet_id, filename, CASE WHEN coalesce(eb, false) OR ev IS NOT NULL THEN ev WHEN tv IS NOT NULL THEN tv END AS expected_value, CASE WHEN coalesce(eb, false) OR ev IS NOT NULL THEN eb WHEN tv IS NOT NULL THEN false END AS expected_blank,
  CASE WHEN coalesce(eb, false) OR ev IS NOT NULL THEN 'existing' WHEN tv IS NOT NULL THEN 'trusted' ELSE 'missing' END AS label_source FROM j""",
    "percentile_summary": SERIES + " SELECT user_id, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max FROM s GROUP BY user_id",
    "spacing_summary": SERIES + """, g AS (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM s)
SELECT user_id, count(g) AS n, round(avg(g), 6) AS mean_gap, round(stddev_pop(g), 6) AS gap_deviation, round(stddev_pop(g) / nullif(avg(g), 0), 6) AS gap_variation FROM g GROUP BY user_id""",
    "drift_summary": SERIES + " SELECT user_id, round(arg_max(value, event_id) - arg_min(value, event_id), 6) AS drift FROM s GROUP BY user_id",
    "boundary_summary": """
WITH r AS (SELECT CAST(user_id % 50 AS VARCHAR) AS sheet_id, event_type AS axis, CASE WHEN event_id % 7 <> 0 THEN abs(round(value, 2) - 50.0) END AS e, event_id % 8 / 8 AS c FROM events),
b AS (SELECT sheet_id, axis, count(*) AS boundaries, count(e) AS detected, round(quantile_cont(e, 0.5), 6) AS error_p50, round(quantile_cont(e, 0.95), 6) AS error_p95, round(max(e), 6) AS error_max,
  round(quantile_cont(e / 37.0, 0.5), 6) AS normalised_p50, round(quantile_cont(e / 37.0, 0.95), 6) AS normalised_p95, round(max(e / 37.0), 6) AS normalised_max, round(avg(c), 6) AS continuity FROM r GROUP BY ALL)
SELECT *, round(100 * (0.35 * greatest(0, least(1, detected / boundaries)) + 0.25 * greatest(0, least(1, continuity)) + 0.25 * (1 - greatest(0, least(1, normalised_p50 / 0.35))) + 0.15 * 0.5), 2) AS score FROM b""",
    "nearest_sample": SERIES + """, t AS (SELECT user_id, event_id AS target FROM s WHERE event_id % 10 = 3), p AS (SELECT * FROM s WHERE event_id % 10 <> 3),
r AS (SELECT t.user_id, t.target, p.event_id, p.value, row_number() OVER (PARTITION BY t.user_id, t.target ORDER BY abs(p.event_id - t.target), p.event_id) AS k FROM t LEFT JOIN p ON t.user_id = p.user_id)
SELECT user_id, target, CAST(event_id AS DOUBLE) AS nearest_at, value AS nearest_value FROM r WHERE k = 1""",
    "interpolate_gaps": SERIES + """, k AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM s),
w AS (SELECT user_id, event_id, v, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER lo AS p0, last_value(v IGNORE NULLS) OVER lo AS v0,
  first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER hi AS p1, first_value(v IGNORE NULLS) OVER hi AS v1 FROM k
  WINDOW lo AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), hi AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, round(coalesce(v, v0 + (v1 - v0) * (event_id - p0) / nullif(p1 - p0, 0), v0, v1), 6) AS filled FROM w""",
    "isolated_peaks": SERIES + """
SELECT user_id, event_id, coalesce(abs(value - (lag(value) OVER w + lead(value) OVER w) / 2) > 100.0, false) AS is_peak FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "curve_bends": SERIES + """, b AS (SELECT user_id, abs(lag(value) OVER w - 2 * value + lead(value) OVER w) / 400.0 AS b FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, round(max(b), 6) AS bend, coalesce(max(b) > 0.30, false) AS too_curved FROM b GROUP BY user_id""",
    "mapping_audit": VERIFIED + """, r AS (SELECT DISTINCT sheet_id, day, point FROM verified)
SELECT r.sheet_id, r.day, r.point, k.reading_type, v.final_value AS value, v.is_blank, chr(CAST(66 + 2 * (r.point - 1) + k.o AS INT)) || (r.day + 6) AS address
FROM r CROSS JOIN (VALUES ('temperature', 0), ('humidity', 1)) k(reading_type, o) LEFT JOIN verified v ON v.sheet_id = r.sheet_id AND v.day = r.day AND v.point = r.point AND v.reading_type = k.reading_type""",
    "stage_totals": """
WITH t AS (SELECT CAST(user_id AS VARCHAR) AS sheet_id, event_id % 12 AS s, CAST(CAST(round(value, 2) AS DECIMAL(18,2)) AS DOUBLE) AS v FROM events)
SELECT sheet_id, """ + ", ".join(f"round(coalesce(sum(v) FILTER (s = {k}), 0), 4) AS {n}" for k, n in enumerate((
        "upload_decoding_seconds", "document_table_detection_seconds", "perspective_warp_seconds", "measurement_cell_extraction_seconds", "blank_detection_seconds", "ocr_preprocessing_seconds", "ocr_prediction_seconds",
        "postprocessing_seconds", "verification_seconds", "monitoring_record_construction_seconds", "ui_thumbnail_preparation_seconds", "model_construction_seconds"))) + """,
  round(sum(v), 4) AS total_sheet_processing_seconds FROM t GROUP BY sheet_id""",
    "drift_distribution": SERIES + """, d AS (SELECT user_id, abs(round(arg_max(value, event_id) - arg_min(value, event_id), 6)) AS d FROM s GROUP BY user_id)
SELECT user_id % 50 AS sheet_id, round(quantile_cont(d, 0.5), 6) AS drift_p50, round(quantile_cont(d, 0.95), 6) AS drift_p95, round(max(d), 6) AS drift_max FROM d GROUP BY ALL""",
    "correction_summary": _CORRECT + r""", o AS (SELECT *, CASE status WHEN 'decimal_inferred' THEN c1 WHEN 'proposed_correction' THEN found[1] ELSE text END AS v, status <> 'valid_unchanged' AS review, (k % 70) || '.' || (k % 10) AS want FROM s)
SELECT reading_type, count(*) AS total, count(*) FILTER (text = want) AS consensus_correct, count(*) FILTER (v = want) AS corrected_correct, count(*) FILTER (status IN ('decimal_inferred', 'proposed_correction')) AS changed, count(*) FILTER (review) AS review,
  count(*) FILTER (NOT review) AS accepted, count(*) FILTER (NOT review AND v = want) AS correct_accepts, count(*) FILTER (NOT review AND v <> want) AS unsafe_accepts, round(count(*) FILTER (NOT review AND v = want) / nullif(count(*) FILTER (NOT review), 0), 6) AS accept_accuracy
FROM o GROUP BY reading_type""",
    "production_summary": JUDGED + """
SELECT source, count(*) AS total, count(*) FILTER (final_value_correct) AS correct, round(count(*) FILTER (final_value_correct) / count(*), 6) AS accuracy, count(*) FILTER (NOT needs_review) AS accepted,
  count(*) FILTER (NOT needs_review AND final_value_correct) AS correct_accepts, round(count(*) FILTER (NOT needs_review AND final_value_correct) / nullif(count(*) FILTER (NOT needs_review), 0), 6) AS accept_accuracy,
  count(*) FILTER (NOT needs_review AND NOT final_value_correct) AS unsafe_accepts, count(*) FILTER (needs_review) AS review FROM judged GROUP BY source""",
    "calibrated_gates": _GATES + """
SELECT c.r >= f.r AS accuracy_kept, c.u <= f.u AS unsafe_not_increased, c0.r >= f0.r AND c0.u <= f0.u AS sample_kept, c.x < f.x AS alignment_failures_fewer, c1.r > f1.r AS first_month_better, c2.r > f2.r AS second_month_better,
  accuracy_kept AND unsafe_not_increased AND sample_kept AND alignment_failures_fewer AND first_month_better AND second_month_better AS passed FROM """ + _JOINED,
    "hybrid_gates": _GATES + """
SELECT h.u <= f.u AS no_new_unsafe, h0.r >= 14 AS sample_right, coalesce(h.bp = 1.0, false) AS blank_precision_whole, coalesce(h.eb = 16 AND h.pb > 7 AND h.br > 7 / 16, false) AS blank_recall_better, round(CASE WHEN c1.r > f1.r THEN greatest(0, h1.r - f1.r) / (c1.r - f1.r) ELSE 1.0 END, 6) >= 0.80 AS gain_retained,
  h2.u <= f2.u AS second_month_safe, h.x <= f.x AS alignment_failures_not_more, round(CASE WHEN c1.r > f1.r THEN greatest(0, h1.r - f1.r) / (c1.r - f1.r) ELSE 1.0 END, 6) AS gain_kept,
  no_new_unsafe AND sample_right AND blank_precision_whole AND blank_recall_better AND gain_retained AND second_month_safe AND alignment_failures_not_more AS passed FROM """ + _JOINED,
    "variant_rates": "WITH " + RESULTS + """, v AS (SELECT *, CASE WHEN is_blank THEN 0 ELSE 3 END AS k, NOT is_blank AND text = third AS same FROM results)
SELECT sheet_id, reading_type, count(*) AS cell_count, round(count(*) FILTER (same) / count(*), 6) AS original_accuracy, round(count(*) FILTER (same) / count(*), 6) AS grayscale_accuracy,
  round(count(*) FILTER (NOT is_blank) / count(*), 6) AS contrast_accuracy, CAST(sum(k) AS BIGINT) AS ocr_input_count, round(sum(k) / count(*), 6) AS average_ocr_inputs_per_cell, CAST(0 AS BIGINT) AS ocr_inputs_saved FROM v GROUP BY ALL""",
    "geometry_warnings": "WITH " + SPELLED + """,
ids AS (SELECT s.sheet_id, printf('day_%02d_point_%02d_%s.png', d.d, p.p, k.k) AS filename FROM (SELECT DISTINCT sheet_id FROM spelled) s CROSS JOIN range(1, 32) d(d) CROSS JOIN range(1, 9) p(p) CROSS JOIN (VALUES ('temperature'), ('humidity')) k(k))
SELECT sheet_id, CASE WHEN mark IS NULL THEN 'Extracted crop is missing for this reading.' WHEN mark % 7 = 0 THEN 'Calibrated crop rejected: reason ' || mark % 3
  WHEN mark % 5 = 0 THEN 'Calibrated extraction uses one or more fixed fallback boundaries.' ELSE '' END AS geometry_warning, count(*) AS n FROM ids LEFT JOIN spelled USING (sheet_id, filename) GROUP BY ALL""",
    "preflight_summary": "WITH " + SPELLED + """,
f AS (SELECT sheet_id, count(*) AS n, count(*) FILTER (mark % 97 = 0) AS inv, count(*) FILTER (mark % 89 = 0) AS fb, count(*) FILTER (mark % 83 = 0) AS low FROM spelled GROUP BY sheet_id),
w AS (SELECT *, list_filter([CASE WHEN n % 3 = 0 AND n % 2 = 0 THEN 'The printed rows were not clear enough, so the form''s row span was kept: too few lines' END, CASE WHEN inv > 0 THEN inv || ' calibrated cell(s) failed the geometry checks and use fixed crops.' END,
  CASE WHEN fb > 0 THEN fb || ' boundary estimate(s) use the fixed position.' END, CASE WHEN low > 0 THEN low || ' boundary estimate(s) have low confidence.' END], lambda x: x IS NOT NULL) AS ws FROM f)
SELECT sheet_id, CASE WHEN n % 3 <> 0 AND n = 496 AND inv = 0 THEN 'calibrated' ELSE 'fixed' END AS recommended, coalesce(array_to_string(ws, '|'), '') AS warnings,
  coalesce(array_to_string(list_filter([CASE WHEN n % 3 <> 0 THEN 'The grid follows the printed rows of all days (' || n % 33 || '/32 strong bounds).' END,
    CASE WHEN len(ws) = 0 THEN 'No rejected, fixed or uncertain cell was found; a look at the crops is still needed.' END], lambda x: x IS NOT NULL), '|'), '') AS notices FROM w""",
    "representative_pairs": "WITH " + READINGS + """, c6 AS (SELECT *, count(*) OVER (PARTITION BY sheet_id) AS n FROM cells WHERE day IN (1, 16, 31) AND point = 4)
SELECT sheet_id, day, CASE day WHEN 1 THEN 'Top' WHEN 16 THEN 'Middle' ELSE 'Bottom' END AS position, reading_type, filename, value AS fixed, -value AS calibrated FROM c6 WHERE n = 6""",
    "structure_check": "WITH " + READINGS + """
SELECT sheet_id, count(*) AS cells, count(*) FILTER (reading_type = 'temperature') AS temperature, count(*) FILTER (reading_type = 'humidity') AS humidity, count(DISTINCT filename) AS names FROM cells GROUP BY sheet_id
HAVING cells <> 496 OR temperature <> 248 OR humidity <> 248 OR names <> 496""",
    "review_filters": VERIFIED + """
SELECT filter, count(*) FILTER (CASE filter WHEN 'All unresolved' THEN true WHEN 'Blocking errors' THEN n_blocking_errors > 0 WHEN 'Required confirmations' THEN n_required_confirmation_reasons > 0 AND NOT human_verified
  WHEN 'OCR uncertainty' THEN list_contains(categories, 'ocr_uncertainty') WHEN 'Anomalies' THEN list_contains(categories, 'anomaly') ELSE list_contains(categories, 'blank_mismatch') END) AS n
FROM (SELECT * FROM verified WHERE blocks_export) CROSS JOIN (VALUES ('All unresolved'), ('Blocking errors'), ('Required confirmations'), ('OCR uncertainty'), ('Anomalies'), ('Blank mismatch')) f(filter) GROUP BY filter""",
    "editor_rows": VERIFIED + """, t AS (SELECT * FROM verified WHERE reading_type = 'temperature'), h AS (SELECT * FROM verified WHERE reading_type = 'humidity')
SELECT sheet_id, day, point, 'crop of ' || t.filename AS temperature_crop, t.final_value AS temperature, t.is_blank AS temperature_blank, 'crop of ' || h.filename AS humidity_crop, h.final_value AS humidity, h.is_blank AS humidity_blank,
  CASE WHEN t.blocks_export OR h.blocks_export THEN 'Blocked' WHEN t.warned THEN 'Operational warning' WHEN t.minor OR h.minor THEN 'Ready with notice' ELSE 'Ready' END AS status FROM t JOIN h USING (sheet_id, day, point)""",
    "diagnostic_rows": VERIFIED + """, j AS (SELECT *, '{"contrast":"' || third || '","grayscale":"' || text || '","original":"' || text || '"}' AS js FROM verified)
SELECT sheet_id, filename, is_blank, js AS raw_predictions_json, js AS normalized_predictions_json, '{"contrast":0.9,"grayscale":0.9,"original":0.9}' AS confidences_json, agreement AS agreement_count, final_value AS proposed_final_value,
  '[]' AS candidate_interpretations_json, CASE WHEN len(categories) = 0 THEN '[]' ELSE '["' || array_to_string(categories, '","') || '"]' END AS review_categories_json, human_verified, blocks_export AS needs_review FROM j""",
    "verification_audit": VERIFIED + "," + CONFIRMED + """, f AS (SELECT sheet_id, count(*) FILTER (n_blocking_errors > 0) AS blocking, count(*) FILTER (n_required_confirmation_reasons > 0 AND NOT human_verified) AS attention,
  count(*) FILTER (NOT format_is_valid OR NOT within_absolute_limits) AS invalid, count(*) FILTER (blocks_export) AS blocked, count(DISTINCT (day, point)) FILTER (has_blank_mismatch) AS mismatch, count(*) FILTER (warned) AS warned_n FROM verified GROUP BY sheet_id),
g AS (SELECT f.*, coalesce((SELECT list_sort(list(c.day)) FROM confirmed c WHERE c.sheet_id = f.sheet_id), []) AS done FROM f), e AS (SELECT *, list_filter(range(1, 32), lambda d: NOT list_contains(done, CAST(d AS INT))) AS left_days FROM g)
SELECT sheet_id, '{"schema_version":1,"sheet_fingerprint":"' || sheet_id || '","geometry_mode":"fixed","confirmed_days":[' || coalesce(array_to_string(done, ','), '') || '],"unconfirmed_days":[' || coalesce(array_to_string(left_days, ','), '')
  || '],"blocking_cell_count":' || blocking || ',"attention_item_count":' || attention || ',"blank_mismatch_count":' || mismatch || ',"operational_warning_count":' || warned_n || ',"invalid_final_value_count":' || invalid
  || ',"export_ready":' || CASE WHEN len(left_days) + blocking + attention + mismatch + invalid + blocked = 0 THEN 'true' ELSE 'false' END || '}' AS audit FROM e""",
    "export_guards": """
WITH u AS (SELECT CAST(user_id % 200 AS VARCHAR) AS sheet_id, count(*) AS k FROM events GROUP BY ALL),
r AS (SELECT sheet_id, k, CAST(d.d AS INT) AS day, CAST(p.p AS INT) AS point FROM u CROSS JOIN range(1, 32) d(d) CROSS JOIN range(1, 9) p(p) WHERE k % 5 <> 0 OR d.d * 8 + p.p <> 100),
e AS (SELECT * FROM r WHERE NOT (k % 11 = 0 AND day = 4 AND point = 1) AND NOT (k % 7 = 0 AND day = 9 AND point = 8) UNION ALL SELECT * FROM r WHERE k % 7 = 0 AND day = 3 AND point = 2
  UNION ALL SELECT sheet_id, k, 40, point FROM r WHERE k % 11 = 0 AND day = 4 AND point = 1),
s AS (SELECT *, CASE WHEN k % 13 = 0 AND day = 5 THEN NULL ELSE k % 3 = 0 AND day = 6 END AS b FROM e),
n AS (SELECT sheet_id, day, point, count(*) AS n FROM s GROUP BY ALL),
lack AS (SELECT u.sheet_id, min((CAST(d.d AS INT), CAST(p.p AS INT))) AS m FROM u CROSS JOIN range(1, 32) d(d) CROSS JOIN range(1, 9) p(p) WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.sheet_id = u.sheet_id AND n.day = d.d AND n.point = p.p) GROUP BY ALL),
f AS (SELECT sheet_id, count(*) AS c, count(*) FILTER (b) AS blocked, count(*) FILTER (b IS NULL) AS unknown FROM s GROUP BY sheet_id),
o AS (SELECT sheet_id, min((day, point)) AS m FROM n WHERE day NOT BETWEEN 1 AND 31 GROUP BY ALL), t AS (SELECT sheet_id, min((day, point)) AS m FROM n WHERE n > 1 GROUP BY ALL),
v AS (SELECT f.sheet_id, CASE WHEN c <> 248 THEN c || ' rows instead of 248' WHEN unknown > 0 THEN 'rows without an export state' WHEN blocked > 0 THEN blocked || ' blocked rows'
  WHEN o.m IS NOT NULL THEN 'not on the form: Day ' || o.m[1] || ', Point ' || o.m[2] WHEN t.m IS NOT NULL THEN 'repeated: Day ' || t.m[1] || ', Point ' || t.m[2]
  WHEN lack.m IS NOT NULL THEN 'missing: Day ' || lack.m[1] || ', Point ' || lack.m[2] END AS violation FROM f LEFT JOIN o USING (sheet_id) LEFT JOIN t USING (sheet_id) LEFT JOIN lack USING (sheet_id))
SELECT * FROM v WHERE violation IS NOT NULL""",
    "boundary_positions": """
WITH a AS (SELECT p_partkey AS k, CAST(p_partkey % 60 - 10 AS DOUBLE) AS x, CAST(p_partkey % 7 AS DOUBLE) AS y0, CAST(p_partkey % 11 AS DOUBLE) AS y1, CAST(p_partkey % 13 AS DOUBLE) AS y2, CAST(p_partkey % 17 AS DOUBLE) AS y3 FROM part)
SELECT k AS p_partkey, round(CASE WHEN x <= 0 THEN y0 WHEN x <= 10 THEN y0 + (y1 - y0) * x / 10 WHEN x <= 20 THEN y1 + (y2 - y1) * (x - 10) / 10 WHEN x <= 40 THEN y2 + (y3 - y2) * (x - 20) / 20 ELSE y3 END, 6) AS position,
  CASE k % 4 WHEN 0 THEN 'detected' WHEN 1 THEN 'fixed_fallback' ELSE 'interpolated' END AS source, round((k % 5 - k % 3) / greatest(k % 5 + k % 3, 1e-6), 6) AS difference FROM a""",
    "queue_stream": """
SELECT CAST(user_id AS VARCHAR) AS owner_id, event_type AS sheet_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS state, CASE WHEN event_type = 'error' THEN 0 ELSE count(*) END AS processed_count FROM events GROUP BY user_id, event_type""",
    "page_slice": "WITH " + READINGS + """, o AS (SELECT *, row_number() OVER (ORDER BY day, point, CASE WHEN reading_type = 'temperature' THEN 0 ELSE 1 END) AS k, least(3, greatest(1, ceil(count(*) OVER () / 40))) AS page
  FROM cells WHERE sheet_id = '1995-03') SELECT sheet_id, day, point, reading_type, value FROM o WHERE k > 40 * (page - 1) AND k <= 40 * page""",
    "context_view": "WITH " + READINGS + """ SELECT sheet_id, day, point, reading_type, value FROM cells WHERE sheet_id = '1995-03' AND reading_type = 'humidity' AND (day = 10 OR (point = 4 AND day BETWEEN 8 AND 12))""",
}
