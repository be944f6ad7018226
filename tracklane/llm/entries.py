"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tracklane.llm.jaccard_join import op8_jaccard_join
from tracklane.llm.language_model import op3_language_model
from tracklane.llm.merkle import op1_fingerprints
from tracklane.llm.mixing import op9_mixing
from tracklane.llm.packing import op7_packing
from tracklane.llm.quality_classifier import op5_quality_classifier
from tracklane.llm.quality_rules import op6_quality_rules
from tracklane.llm.secret_scan import BASE, MORE, Rule, op10_secret_scan
from tracklane.llm.sharding import op4_sharding
from tracklane.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_toxicity": op2_toxicity,
    "op3_language_model": op3_language_model,
    "op4_sharding": op4_sharding,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_mixing": op9_mixing,
    "op10_secret_scan": op10_secret_scan,
}
_WORD = r"[^\x20\x09-\x0D]+"
_SPLIT = f"""texts AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents)"""
_MEASURES = f"""{_SPLIT},
placed AS (SELECT doc_id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i FROM texts),
windows AS (
  SELECT doc_id, i, w || chr(31) || lead(w, 1) OVER o || chr(31) || lead(w, 2) OVER o || chr(31) || lead(w, 3) OVER o || chr(31) || lead(w, 4) OVER o || chr(31)
         || lead(w, 5) OVER o || chr(31) || lead(w, 6) OVER o || chr(31) || lead(w, 7) OVER o AS g
  FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM windows WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
gaps AS (SELECT doc_id, least(8, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 8)) AS gap FROM again),
repeats AS (SELECT doc_id, sum(gap) AS n FROM gaps GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM texts),
measures AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(text, '[^!]', '', 'g')) AS n_shouts
  FROM texts JOIN lines USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measures)"""



def _spans_sql() -> str:
    """Every rule's matches, placed by the lengths of what lies between them."""

    def of(order: int, rule: Rule) -> str:
        p = rule.pattern.decode().replace("'", "''")
        return f"""SELECT doc_id, '{rule.kind}' AS kind, {order} AS place, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(regexp_extract_all(text, '{p}', {rule.group})) AS g,
  unnest(regexp_split_to_array(text, '{p}')) AS gap, unnest(generate_series(1, len(regexp_split_to_array(text, '{p}')))) AS i FROM texts WHERE regexp_matches(text, '{p}')"""

    found = " UNION ALL ".join(f"SELECT * FROM ({of(i, r)}) WHERE m IS NOT NULL" for i, r in enumerate(BASE + MORE))
    least = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in BASE + MORE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    return f"""WITH {_SPLIT}, found AS ({found}),
placed AS (
  SELECT *, sum(length(gap)) OVER o + coalesce(sum(length(m)) OVER before, 0) AS a FROM found
  WINDOW o AS (PARTITION BY doc_id, kind ORDER BY i ROWS UNBOUNDED PRECEDING), before AS (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kept AS (SELECT *, kind || ':' || a || ':' || (a + length(m)) AS span FROM placed WHERE length(g) >= CASE kind {least} END),
listed AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY a, place) FILTER (kind IN ({base})) AS base, string_agg(span, ',' ORDER BY a, place) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN listed USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op10_secret_scan": _spans_sql(),
    "op6_quality_rules": f"""WITH {_MEASURES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT base_failed AND 10 * n_symbols <= n_words AND 10 * n_shouts <= n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words AS kept FROM based""",
    "op8_jaccard_join": f"""WITH RECURSIVE {_SPLIT},
lowered AS (SELECT doc_id, list_transform(ws, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM texts),
placed AS (SELECT doc_id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i FROM lowered),
triples AS (SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
features AS (
  SELECT DISTINCT doc_id, g FROM triples WHERE g IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM lowered WHERE len(ws) IN (1, 2)),
sizes AS (SELECT doc_id, count(*) AS n FROM features GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM features a JOIN features b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 90 * (x.n + y.n - c.n)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN reached r ON r.a = d.doc_id GROUP BY d.doc_id, s.n""",
    "op9_mixing": f"""WITH {_SPLIT},
sized AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS size, md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM texts),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sized GROUP BY source),
filling AS (
  SELECT *, (1.5::DOUBLE * sum(s) OVER () - coalesce(sum(2 * s) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS unit
  FROM sources WINDOW before AS (ORDER BY 2 * s::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT min(unit) AS unit FROM (SELECT unit FROM filling WHERE unit * w <= 2 * s ORDER BY 2 * s::DOUBLE / w, source NULLS LAST LIMIT 1)),
aims AS (SELECT source, s, CASE WHEN level.unit * w > 2 * s THEN CAST(2 * s AS DOUBLE) ELSE level.unit * w END AS target FROM sources, level),
quotas AS (SELECT *, CAST(round_even(target, 0) AS BIGINT) AS q FROM aims),
chosen AS (
  SELECT z.doc_id, z.size, q.s AS source_size, q.target, CASE WHEN q.s = 0 THEN 0 ELSE q.q // q.s END AS passes,
         q.s > 0 AND q.q % greatest(q.s, 1) > 0 AND sum(z.size) OVER (PARTITION BY z.source ORDER BY z.place, z.size ROWS UNBOUNDED PRECEDING) - z.size / 2.0::DOUBLE <= q.q % greatest(q.s, 1) AS more
  FROM sized z JOIN quotas q ON q.source IS NOT DISTINCT FROM z.source)
SELECT doc_id, size, source_size, target, CAST(size * (passes + CASE WHEN more THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM chosen""",
}
