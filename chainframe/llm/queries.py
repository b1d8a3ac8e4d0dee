"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_trees, decontamination, html_text, mixing, near_dedup, pii, quality_rules, substring_dedup, suffix_dedup, url_filter
from .common import ready, table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, operator: Callable[..., DataFrame], *more: str) -> Query:
    return lambda spark, sf_dir: operator(*(table(ready(spark), sf_dir, t) for t in (name, *more)))


def queries() -> dict[str, Query]:
    return {
        "op1_html_text": _over("pages", html_text.digest),
        "op2_decontamination": _over("documents", decontamination.digest, "benchmark"),
        "op3_near_dedup": _over("documents", near_dedup.digest),
        "op4_suffix_dedup": _over("documents", suffix_dedup.digest),
        "op5_mixing": _over("documents", mixing.digest),
        "op6_quality_rules": _over("documents", quality_rules.digest),
        "op7_url_filter": _over("pages", url_filter.digest),
        "op8_pii": _over("documents", pii.digest),
        "op9_substring_dedup": _over("documents", substring_dedup.digest),
        "op10_chat_trees": _over("conversations", chat_trees.digest),
    }


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"

_OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
il AS (SELECT *, least(10, len(ws)) AS l FROM i WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item, l, array_to_string(ws[p:p + l - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - l + 2)) AS p FROM il)),
dl AS (SELECT doc_id, ws, l FROM d, (SELECT DISTINCT l FROM il) WHERE len(ws) >= l),
dw AS (SELECT doc_id, l, p, array_to_string(ws[p:p + l - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - l + 2)) AS p FROM dl)),
hit AS (SELECT dw.doc_id, dw.p, dw.l, iw.item FROM dw JOIN iw ON dw.l = iw.l AND dw.k = iw.k),
words AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(w.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.s, '')) AS items_sha256, coalesce(w.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words w USING (doc_id) LEFT JOIN items t USING (doc_id)
"""

_OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_SPACED}) AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + least(5, len(ws)) - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_have x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""

_OP6 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
w AS (SELECT doc_id, p, array_to_string(ws[p:p + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM d)),
again AS (SELECT doc_id, k FROM w GROUP BY 1, 2 HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM w JOIN again USING (doc_id, k)) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
  FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (100 * n_symbols > 20 * n_words)::INT
  + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT
  + 32 * (100 * n_upper > 50 * word_chars)::INT AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b
"""

_HOST_RULES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in url_filter.HOST_RULES)
_BLOCKED = " OR ".join(f"regexp_matches(low, '{r.pattern}')" for r in url_filter.PATTERN_RULES)
_OP7 = rf"""
WITH u AS (SELECT page_id, {_LOWER.format("coalesce(url, '')")} AS low, {_LOWER.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, h, p) AS (VALUES {_HOST_RULES}),
fit AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN fit USING (page_id)
"""

_OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws FROM documents),
w AS (SELECT doc_id, p, array_to_string(ws[p:p + 49], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS p FROM d)),
f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k),
c AS (SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM w JOIN f USING (k) WHERE doc_id > first) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN qs IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(qs, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""

_OP10 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g') || ': ' || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || ' </turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    """op1, op4 and op8 have no SQL form; tests hold them against plain Python."""
    return {
        "op2_decontamination": _OP2,
        "op3_near_dedup": _OP3,
        "op5_mixing": mixing.ORACLE.format(documents="documents"),
        "op6_quality_rules": _OP6,
        "op7_url_filter": _OP7,
        "op9_substring_dedup": _OP9,
        "op10_chat_trees": _OP10,
    }
