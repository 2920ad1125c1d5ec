"""DuckDB SQL for the queries, written from their contracts and not from the operators."""

from __future__ import annotations

import re

from . import licenses, mixing

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NOT_BLANK = r"[^\x20\x09-\x0D]+"

OP5 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(content) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS content FROM documents)
WINDOW same AS (PARTITION BY content)
"""

def _leaks(docs: str = "documents") -> str:
    return f"""
WITH d AS (SELECT doc_id, {_words("text", _ALNUM)} AS w FROM {docs}),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text", _ALNUM)} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _mix(docs: str = "documents", seed: int = 17) -> str:
    """All quotients of all sources and shards are listed and ranked."""
    key = f"md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '~'))"
    return f"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_NOT_BLANK}')) AS BIGINT) AS size, {key} AS key FROM {docs}),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM sized GROUP BY source),
s1 AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap,
              CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(n) OVER () AS BIGINT) AS all_rows FROM s0),
s2 AS (SELECT *, (total - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
       FROM s1 WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT arg_min(level, place) AS level FROM (SELECT level, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place, cap, weight FROM s2) WHERE cap >= level * weight),
s3 AS (SELECT s2.source, source_size, total, n, CASE WHEN lev.level IS NOT NULL AND lev.level * weight <= cap THEN lev.level * weight ELSE CAST(cap AS DOUBLE) END AS target,
              greatest(1, least({mixing.BLOCK_TOKENS}, total // {mixing.MIN_BLOCKS})) AS block,
              greatest({mixing.MIN_SHARD_ROWS}, ceil(all_rows / {mixing.MAX_SHARDS})) AS shard_rows FROM s2 LEFT JOIN lev ON true),
won AS (SELECT source, count(*) AS quota FROM (
         SELECT source, total // block AS seats, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST) AS place
         FROM (SELECT *, unnest(range(0, CAST(ceil(target / block) AS BIGINT) + 2)) AS k FROM s3 WHERE target > 0)) WHERE place <= seats GROUP BY source),
s4 AS (SELECT s3.*, coalesce(quota, 0) AS quota, CAST(greatest(1, ceil(n / shard_rows)) AS BIGINT) AS shards FROM s3 LEFT JOIN won ON s3.source IS NOT DISTINCT FROM won.source),
dealt AS (SELECT sized.*, source_size, target, block, quota, CAST('0x' || substr(key, 1, 8) AS BIGINT) % shards AS shard
          FROM sized JOIN s4 ON sized.source IS NOT DISTINCT FROM s4.source),
p0 AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS length, any_value(block) AS block, any_value(quota) AS seats FROM dealt GROUP BY source, shard),
p1 AS (SELECT source, shard, count(*) AS quota FROM (
         SELECT source, shard, seats, row_number() OVER (PARTITION BY source ORDER BY length / (2 * k + 1) DESC, shard) AS place
         FROM (SELECT *, unnest(range(0, 3 * CAST(ceil(length / block) AS BIGINT) + 4)) AS k FROM p0 WHERE length > 0)) WHERE place <= seats GROUP BY source, shard),
p2 AS (SELECT p0.source, p0.shard, length, least(coalesce(p1.quota, 0) * block, 3 * length) AS take,
              CASE WHEN length > 0 THEN CAST('0x' || substr(md5('{seed}:' || coalesce(p0.source, '~') || ':' || p0.shard), 9, 8) AS BIGINT) % length ELSE 0 END AS start
       FROM p0 LEFT JOIN p1 ON p0.shard = p1.shard AND p0.source IS NOT DISTINCT FROM p1.source),
laid AS (SELECT dealt.*, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM dealt),
cut AS (SELECT laid.*, length, start, CASE WHEN length > 0 THEN take // length ELSE 0 END AS whole, CASE WHEN length > 0 THEN start + take % length ELSE 0 END AS stop
        FROM laid JOIN p2 ON laid.shard = p2.shard AND laid.source IS NOT DISTINCT FROM p2.source)
SELECT doc_id, size, source_size, target, CAST(whole * size
       + greatest(0, least(a + size, stop, length) - greatest(a, start)) + greatest(0, least(a + size, stop - length) - a) AS BIGINT) AS taken
FROM cut
"""


def _near(docs: str = "documents") -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words("text", _NOT_BLANK)} AS w FROM {docs}),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared_n FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared_n >= 75 * (x.n + y.n - shared_n)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN low USING (doc_id)
"""


def _sentence_pattern(sentence: str) -> str:
    """Words that a space or a pause parts, or also a stop where the sentence has one itself."""
    parts = re.split("([a-z0-9]+)", sentence.lower())
    out = parts[1]
    for gap, word in zip(parts[2::2], parts[3::2]):
        out += (r"[ \x01\x02]" if re.search(r"[.!?]+\s", gap) else r"[ \x02]") + word
    return out


def _licenses() -> str:
    """The published sentences are looked for in texts whose ends of sentences are \\x01 (stops) and
    \\x02 (pauses, over which a sentence may go on); the rules replace their sequences in order."""
    every = [(s, name) for kind in (licenses.SENTENCES, licenses.HEADINGS) for name, own in kind.items() for s in own]
    pattern = "|".join(sorted({_sentence_pattern(s) for s, _ in every}, key=lambda x: (-len(re.sub(r"\[[^]]*\]", " ", x)), x)))
    quoted = lambda s: s.replace("'", "''")
    known = ", ".join(f"('{quoted(s)}', '{name}')" for s, name in every)
    marks = " OR ".join(f"contains(n, '{m}')" for m in licenses.MARKS)
    line = "line"
    for name, rule in licenses.RULES + licenses.HEADING_RULES:
        line = f"replace({line}, '{''.join(f'<{r}>' for r in rule)}', '={name}=')"
    names = ", ".join(f"CASE WHEN contains(line, '={n}=') THEN '{n}' END" for n in dict.fromkeys(n for n, _ in licenses.RULES))
    text = "translate(text, chr(1) || chr(2), '  ')"
    for _ in range(4):  # expressions of up to five licences
        text = rf"regexp_replace({text}, '(?i)(SPDX-License-Identifier:[ \t(]*[\w.+-]+(?:[ \t]+WITH[ \t]+[\w.-]+)?[ \t)]+)(?:OR|AND)([ \t(])', '\1' || chr(10) || chr(10) || 'SPDX-License-Identifier:\2', 'g')"
    steps = [
        (r"[.;:!?]*[.!?][.;:!?]*[ \t\n\v\f\r]+", "chr(1)"), (r"[ \t\v\f\r]*\n[ \t\v\f\r]*\n[ \t\n\v\f\r]*", "chr(1)"), (r"[:;]+[ \t\n\v\f\r]+", "chr(2)"),
        (r"[ \t\n\v\f\r]*\n[ \t\n\v\f\r]*", "chr(2)")]
    for what, end in steps:
        text = f"regexp_replace({text}, '{what}', {end}, 'g')"
    text = rf"regexp_replace(lower({text}), '[^a-z0-9\x01\x02]+', ' ', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, ' ?([\x01\x02]) ?', '\1', 'g'), '\x02{{2,}}', chr(1), 'g')"
    return rf"""
WITH known AS (SELECT DISTINCT trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS n, name FROM (VALUES {known}) v(s, name)),
parts AS (SELECT doc_id, regexp_extract_all(trim({text}) || chr(1), '(?:{pattern})[]|[^]+[]') AS p FROM documents WHERE text IS NOT NULL),
sentences AS (SELECT doc_id, i, trim(translate(p[i], chr(1) || chr(2), '  ')) AS n FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
named AS (SELECT doc_id, i, coalesce(known.name, 'unknown') AS name FROM sentences LEFT JOIN known USING (n) WHERE {marks}),
lines AS (SELECT doc_id, string_agg(name, ',' ORDER BY i) AS sentences, string_agg('<' || name || '>', '' ORDER BY i) AS line, count(*) FILTER (name = 'unknown') AS n_unknown FROM named GROUP BY doc_id),
matched AS (SELECT doc_id, sentences, n_unknown, {line} AS line FROM lines)
SELECT doc_id, coalesce(sentences, '') AS sentences, coalesce(array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ','), '') AS licenses, coalesce(n_unknown, 0) AS n_unknown
FROM documents LEFT JOIN matched USING (doc_id)
"""


#: The corpus pipeline: each stage on what the one before it kept.
PIPELINE = f"""
WITH s1 AS (SELECT * FROM documents WHERE regexp_matches(coalesce(text, ''), '\\p{{L}}')),
s2 AS (SELECT * FROM s1 QUALIFY doc_id = max(doc_id) OVER (PARTITION BY text)),
s3 AS (SELECT s2.* FROM s2 JOIN ({_near("s2")}) near USING (doc_id) WHERE near.kept),
s4 AS (SELECT s3.* FROM s3 JOIN ({_leaks("s3")}) leak USING (doc_id) WHERE NOT leak.contaminated)
SELECT doc_id, source, size, source_size, target, taken FROM ({_mix("s4")}) mix JOIN (SELECT doc_id, source FROM s4) USING (doc_id) WHERE taken > 0
"""

SQL = {
    "op2_license_scan": _licenses(),
    "op5_exact_dedup": OP5,
    "op8_decontamination": _leaks(),
    "op9_source_mix": _mix(),
    "op10_near_dedup": _near(),
}
