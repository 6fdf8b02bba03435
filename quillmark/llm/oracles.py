"""DuckDB SQL for the queries that SQL can express. The others are held against brute force in tests/llm."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

#: The curriculum's knots in mixing.Curriculum, inverted by hand: class 0 falls from 1.5 to .5, class 1 is flat, class 2 rises from .25 by .75 to 2.25.
_POSITION = """round(CASE cls WHEN 0 THEN 2 * {u} / (1.5 + sqrt(1.5 * 1.5 - 2 * {u})) WHEN 1 THEN {u}
ELSE CASE WHEN {u} <= 0.25 THEN 2 * {u} / (0.25 + sqrt(0.25 * 0.25 + 2 * {u})) ELSE 0.5 + 2 * ({u} - 0.25) / (0.75 + sqrt(0.75 * 0.75 + 6 * ({u} - 0.25))) END END, 9)"""

OP4 = f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS okey FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY skey) - 1) % 3 AS INT) AS cls FROM s),
f AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][cls + 1] AS w, source_size * 3 AS most FROM w),
r AS (SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(most) OVER b AS BIGINT), 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS rate, row_number() OVER (ORDER BY most / w, skey) AS rn FROM f WINDOW b AS (ORDER BY most / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, arg_min(rate, rn) FILTER (rate <= most / w) OVER () AS level FROM r),
t AS (SELECT skey, source_size, cls, coalesce(least(CAST(most AS DOUBLE), level * w), CAST(most AS DOUBLE)) AS target FROM l),
c AS (SELECT d.*, source_size, cls, target, CAST(round(target) AS BIGINT) AS total, coalesce(CAST(sum(size) OVER (PARTITION BY skey ORDER BY okey, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM d JOIN t USING (skey)),
q AS (SELECT *, CASE WHEN source_size > 0 THEN total // source_size ELSE 0 END AS whole FROM c),
k AS (SELECT *, whole * size + greatest(0, least(size, total - whole * source_size - before)) AS taken FROM q),
n AS (SELECT *, CASE WHEN size > 0 THEN CAST(ceil(taken / size) AS BIGINT) ELSE 0 END AS copies FROM k),
-- The words of a source's rounds lie end to end: a use's middle word is after all rounds before it.
v AS (SELECT *, least(1.0, (before + least(size, taken) / 2) / greatest(target, 1.0)) AS u1, least(1.0, (source_size * (copies - 1) + before + (taken - size * (copies - 1)) / 2) / greatest(target, 1.0)) AS u2 FROM n)
SELECT doc_id, size, source_size, target, taken, copies, CASE WHEN taken > 0 THEN {_POSITION.format(u='u1')} END AS position, CASE WHEN taken > 0 THEN {_POSITION.format(u='u2')} END AS last_position FROM v
"""


def _escape(c: str) -> str:
    return f"replace(replace(replace(replace(replace({c}, '\\', '\\b'), '<s>', '\\ls>'), '</s>', '\\l/s>'), '[INST', '\\sINST'), '[/INST', '\\s/INST')"


OP6 = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) x(conv_id, turn, role, text)),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p, length({_escape('text')}) + length(replace({_escape('role')}, ']', '\\e')) + length('[INST role=][/INST]') AS n FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(n) + length('<s></s>') AS BIGINT) AS formatted_chars,
bool_and(CASE coalesce(p, '') WHEN '' THEN p IS NULL AND role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END) AS valid
FROM o GROUP BY conv_id
"""

OP7 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) x(k) GROUP BY doc_id),
m AS (SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS k FROM b GROUP BY host),
p AS (SELECT least(greatest(avg(k / n), 0.001), 0.999) AS mean, var_pop(k / n) AS v FROM h),
s AS (SELECT mean, CASE WHEN v IS NULL OR v = 0 THEN 1000.0 ELSE least(greatest(mean * (1 - mean) / v - 1, 1), 1000) END AS st FROM p),
z AS (SELECT host, (k + mean * st) / (n + st) AS rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rate > 0.5 AS kept, round(rate, 6) AS host_rate FROM b JOIN z USING (host)
"""

#: Every order is walked by itself: which documents are left before and after each step, by their failing filters as bits of `fails`.
OP11 = f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
y AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
+ CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS fails FROM w LEFT JOIN y USING (doc_id)),
p AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
f AS (SELECT chr(CAST(65 + i AS INT)) AS f, CAST(1 << i AS BIGINT) AS bit FROM range(5) r(i)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS BIGINT) AS before FROM o, range(1, 6) r(k)),
x AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit > 0), 0) AS removed, coalesce(sum(n) FILTER (fails & before > 0 AND fails & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (fails = bit), 0) AS unique_fails,
coalesce(sum(good) FILTER (fails & before = 0 AND fails & bit > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & bit > 0), 0) AS toxic_lost FROM p, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM x
"""

ORACLES = {"op4_mix_sources": OP4, "op6_chat_format": OP6, "op7_quality_rules": OP7, "op11_filter_audit": OP11}
