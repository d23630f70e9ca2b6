"""DuckDB SQL fragments mirroring the Column functions (used by the oracle SQL).

Each helper returns the DuckDB spelling of one Column function of this
package, so an oracle query reads like the Spark plan it checks.
"""

from __future__ import annotations

from assay.functions.lexicon import HEDGING_WINDOW, REFUSAL_WINDOW, lexicon_values_sql
from assay.functions.numeric import round_even_sql
from assay.functions.tokens import TOKEN_PATTERN, WORD_PATTERN


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{TOKEN_PATTERN}')"


def words_sql(text: str) -> str:
    t = f"coalesce({text}, '')"
    t = f"regexp_replace({t}, '(?i)\\b(can)(not)\\b', '\\1 \\2', 'g')"
    t = f"regexp_replace({t}, '(?i)(\\p{{L}})(n''t)\\b', '\\1 \\2', 'g')"
    t = f"regexp_replace({t}, '(?i)(\\p{{L}})(''(?:s|m|d|ll|re|ve))\\b', '\\1 \\2', 'g')"
    pat = WORD_PATTERN.replace("'", "''")
    return f"regexp_extract_all(lower({t}), '{pat}')"


def set_f1_sql(a: str, b: str, digits: int = 4) -> str:
    da, db = f"list_distinct({a})", f"list_distinct({b})"
    inter = f"len(list_intersect({da}, {db}))"
    p, r = f"({inter} / len({da}))", f"({inter} / len({db}))"
    return (f"CASE WHEN len({da}) = 0 OR len({db}) = 0 OR {inter} = 0 THEN 0.0 "
            f"ELSE {round_even_sql(f'2.0 * ({p} * {r}) / ({p} + {r})', digits)} END")


def length_ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({b}) = 0 THEN NULL ELSE {round_even_sql(f'len({a}) / len({b})')} END"


def lexicon_flags_sql(src: str, key: str, text: str, lexicon_rows, prefix: str = "lx") -> str:
    """CTE chain ending in ``{prefix}_flags(key, refusal_detection, refusal_language,
    hedging_detection, hedging_count)`` for responses with at least one hit."""
    vals = lexicon_values_sql(lexicon_rows)
    return f"""{prefix}_lex(language, role, stem, word) AS (VALUES
    {vals}
),
{prefix}_w AS (SELECT {key}, {words_sql(text)} AS w FROM {src}),
{prefix}_ex AS (SELECT {key}, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM {prefix}_w),
{prefix}_hits AS (
  SELECT e.{key}, e.pos, l.language, l.role, l.stem FROM {prefix}_ex e JOIN {prefix}_lex l ON e.word = l.word
),
{prefix}_rh AS (
  SELECT *, max(CASE WHEN role = 'capability' THEN 1 ELSE 0 END) OVER (
      PARTITION BY {key}, language ORDER BY pos RANGE BETWEEN {REFUSAL_WINDOW} PRECEDING AND {REFUSAL_WINDOW} FOLLOWING) AS near_cap
  FROM {prefix}_hits WHERE role IN ('negation', 'capability', 'self_negating')
),
{prefix}_rl AS (
  SELECT {key}, language, bool_or(role = 'self_negating' OR (role = 'negation' AND near_cap = 1)) AS fires
  FROM {prefix}_rh GROUP BY {key}, language
),
{prefix}_ref AS (
  SELECT {key}, true AS refusal_detection,
         arg_min(language, CASE language WHEN 'english' THEN 0 WHEN 'portuguese' THEN 1 WHEN 'spanish' THEN 2 ELSE 3 END) AS refusal_language
  FROM {prefix}_rl WHERE fires GROUP BY {key}
),
{prefix}_hh AS (
  SELECT *, max(CASE WHEN role = 'subject' THEN 1 ELSE 0 END) OVER (
      PARTITION BY {key}, language ORDER BY pos RANGE BETWEEN {HEDGING_WINDOW} PRECEDING AND {HEDGING_WINDOW} FOLLOWING) AS near_subj
  FROM {prefix}_hits WHERE role IN ('solo', 'verb', 'subject')
),
{prefix}_hm AS (
  SELECT DISTINCT {key}, language, stem, CASE WHEN role = 'solo' THEN 'solo' ELSE 'verb+subject' END AS type
  FROM {prefix}_hh WHERE role = 'solo' OR (role = 'verb' AND near_subj = 1)
),
{prefix}_hm2 AS (
  SELECT m.* FROM {prefix}_hm m
  WHERE m.type = 'solo' OR NOT EXISTS (
      SELECT 1 FROM {prefix}_hm s WHERE s.type = 'solo' AND s.{key} = m.{key}
        AND s.language = m.language AND s.stem = m.stem)
),
{prefix}_hed AS (
  SELECT {key}, true AS hedging_detection, count(*) AS hedging_count FROM {prefix}_hm2 GROUP BY {key}
),
{prefix}_flags AS (
  SELECT coalesce(r.{key}, h.{key}) AS {key}, r.refusal_detection, r.refusal_language,
         h.hedging_detection, h.hedging_count
  FROM {prefix}_ref r FULL OUTER JOIN {prefix}_hed h ON r.{key} = h.{key}
)"""


def rouge_l_sql(src: str, key: str, a: str, b: str, prefix: str = "rl") -> str:
    """CTE chain ending in ``{prefix}(key, rouge_l)``; needs WITH RECURSIVE. The longest common
    subsequence goes diagonal by diagonal, so that a cell reads only the two before."""
    return f"""{prefix}_ids AS (
  SELECT {key}, len({a}) AS n, len({b}) AS m, list_transform({a}, lambda x: coalesce(list_position({b}, x), 0)) AS a,
         list_transform({b}, lambda x: list_position({b}, x)) AS b FROM {src}
),
{prefix}_dp AS (
  SELECT {key}, n, m, a, b, 1 AS d, list_transform(range(n + 1), lambda i: 0) AS before, list_transform(range(n + 1), lambda i: 0) AS last
  FROM {prefix}_ids WHERE n > 0 AND m > 0
  UNION ALL
  SELECT {key}, n, m, a, b, d + 1, last, list_transform(range(n + 1), lambda i:
           CASE WHEN i = 0 OR i > d OR d + 1 - i > m THEN 0 WHEN a[i] = b[d + 1 - i] THEN before[i] + 1 ELSE greatest(last[i], last[i + 1]) END)
  FROM {prefix}_dp WHERE d < n + m
),
{prefix} AS (
  SELECT i.{key}, CASE WHEN coalesce(t.last[t.n + 1], 0) = 0 THEN 0.0
      ELSE CAST(printf('%.4f', 2 * (t.last[t.n + 1] / t.n) * (t.last[t.n + 1] / t.m) / (t.last[t.n + 1] / t.n + t.last[t.n + 1] / t.m)) AS DOUBLE) END AS rouge_l
  FROM {prefix}_ids i LEFT JOIN {prefix}_dp t ON t.{key} = i.{key} AND t.d = t.n + t.m
)"""
