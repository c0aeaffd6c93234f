"""DuckDB SQL of the queries that SQL can express. The others are held against brute force in tests/llm."""

from __future__ import annotations

OP9 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS n_chars, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM d),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""


#: References of all languages with 5000 words: shares of character classes and of the 64 commonest words; then each
#: document against all of them. Limits are squares: 0.30 and 0.47, with room for sampling of (bins - 1) / (32 n ln 2).
OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, regexp_replace(t, '[^\p{Lu}0-9#*$%&|<>]+', '', 'g') AS marks FROM d),
m AS (SELECT *, len(words) AS n, length(t) AS chars, list_sum([0] || list_transform(words, lambda x: length(x))) AS word_chars, list_transform(words, lambda x: lower(x)) AS lowered,
  length(marks) AS n_marks, length(regexp_replace(marks, '[^0-9]+', '', 'g')) AS digit, length(regexp_replace(marks, '[^#*$%&|<>]+', '', 'g')) AS symbol,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
lw AS (SELECT lang, unnest(list_filter(string_split_regex(lower(t), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS word FROM d WHERE lang <> ''),
wc AS (SELECT lang, word, count(*) AS n FROM lw GROUP BY lang, word),
lt AS (SELECT lang, sum(n) AS n, sum(n * length(word)) AS in_words FROM wc GROUP BY lang HAVING sum(n) >= 5000),
rw AS (SELECT wc.lang, wc.word, wc.n / lt.n AS share FROM wc JOIN lt ON wc.lang = lt.lang QUALIFY row_number() OVER (PARTITION BY wc.lang ORDER BY wc.n DESC, wc.word) <= 64),
rr AS (SELECT lang, 1 - sum(share) AS rest FROM rw GROUP BY lang),
rm AS (SELECT m.lang, sum(m.chars) AS chars, sum(n_marks) AS marks, sum(n_marks - digit - symbol) AS upper, sum(digit) AS digit, sum(symbol) AS symbol FROM m JOIN lt ON m.lang = lt.lang GROUP BY m.lang),
rc AS (SELECT rm.lang, [greatest(upper, 0) / chars, greatest(digit, 0) / chars, greatest(symbol, 0) / chars, greatest(chars - in_words, 0) / chars, greatest(in_words - marks, 0) / chars] AS q FROM rm JOIN lt ON rm.lang = lt.lang),
sh AS (SELECT rid, [(n_marks - digit - symbol) / greatest(chars, 1), digit / greatest(chars, 1), symbol / greatest(chars, 1), (chars - word_chars) / greatest(chars, 1), (word_chars - n_marks) / greatest(chars, 1)] AS p FROM m),
cp AS (SELECT sh.rid, rc.lang, unnest(sh.p) AS p, unnest(rc.q) AS q FROM sh CROSS JOIN rc),
cd AS (SELECT rid, lang, greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0) AS far FROM cp GROUP BY rid, lang),
dw AS (SELECT rid, n, unnest(lowered) AS word FROM m),
dc AS (SELECT rid, max(n) AS n, word, count(*) AS k FROM dw GROUP BY rid, word),
hits AS (SELECT dc.rid, rw.lang, sum(k) AS k, sum(share) AS q, sum(k / n * log2(2 * k / n / (k / n + share)) + share * log2(2 * share / (k / n + share))) AS far FROM dc JOIN rw ON dc.word = rw.word GROUP BY dc.rid, rw.lang),
wp AS (SELECT m.rid, rr.lang, m.n, 1 - coalesce(hits.k, 0) / greatest(m.n, 1) AS p, greatest(rr.rest, 0) AS q, coalesce(hits.far, 0) AS far, 1 - rr.rest - coalesce(hits.q, 0) AS unseen FROM m CROSS JOIN rr LEFT JOIN hits ON hits.rid = m.rid AND hits.lang = rr.lang),
wd AS (SELECT rid, lang, greatest((far + CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END + unseen) / 2, 0) AS far FROM wp),
near AS (SELECT m.rid, bool_or(cd.far <= 0.09 + 4 / (32 * ln(2)) / greatest(m.chars / 8, 1)) AS chars_near, bool_or(wd.far <= 0.47 * 0.47 + 64 / (32 * ln(2)) / greatest(m.n, 1)) AS words_near
  FROM m JOIN cd ON cd.rid = m.rid JOIN wd ON wd.rid = m.rid AND wd.lang = cd.lang GROUP BY m.rid),
pl AS (SELECT rid, n, words, unnest(range(1, n - 1)) AS i FROM m WHERE n >= 3),
tri AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS times FROM pl),
rep AS (SELECT rid, count(DISTINCT place) AS k FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS place FROM tri WHERE times > 1) GROUP BY rid),
b AS (SELECT m.*, coalesce(rep.k, 0) AS k, m.n < 50 OR 100 * coalesce(rep.k, 0) > 50 * m.n AS failed, near.chars_near, near.words_near, m.lang <> '' AND m.lang NOT IN (SELECT lang FROM lt) AS unknown FROM m LEFT JOIN rep ON rep.rid = m.rid LEFT JOIN near ON near.rid = m.rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(symbol AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(k AS BIGINT) AS n_repeat_words, failed AS base_failed,
  NOT failed AND (words_near IS NULL OR ((n < 80 OR unknown OR words_near) AND (chars < 200 OR unknown OR chars_near))) AS kept
FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_divergence_rules": OP4, "op9_bloom_dedup": OP9}
