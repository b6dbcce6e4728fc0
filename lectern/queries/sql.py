"""Common table expressions of the DuckDB twins."""

from __future__ import annotations

from ..functions.text import ABBREVIATIONS

PARAS = """lines AS (SELECT doc_id, regexp_replace(t, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') AS text, i FROM
  (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
numbered AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM lines WHERE text <> ''),
paras AS (SELECT doc_id, CAST(k // 20 AS INTEGER) AS c, CAST(k % 20 AS INTEGER) AS p, text, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS pwc FROM numbered)"""

_ABBR = ", ".join(f"'{a}'" for a in ABBREVIATIONS)

#: Candidates end at any run of terminal marks before white space; a candidate stays a sentence of its own if the rule lets it end.
SENTENCES = f"""cand AS (SELECT doc_id, c, p, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM
  (SELECT doc_id, c, p, string_split(regexp_replace(text, '([.!?…]+["''”’)\\]»]*\\s+)', '\\1' || chr(1), 'g'), chr(1)) AS x FROM paras)),
judged AS (SELECT *, lag(t) OVER w AS prev FROM cand WHERE t <> '' WINDOW w AS (PARTITION BY doc_id, c, p ORDER BY i)),
parts AS (SELECT *, regexp_extract(prev, '([.!?…]+)["''”’)\\]»]*\\s+$', 1)[1] AS mark, regexp_extract(prev, '([A-Za-z]*)[.!?…]+["''”’)\\]»]*\\s+$', 1) AS word, t[1] AS nxt FROM judged),
breaks AS (SELECT *, CASE WHEN prev IS NULL THEN 0
   WHEN mark = '.' THEN CASE WHEN regexp_matches(nxt, '[A-Z0-9"''“‘(\\[«]') AND NOT (lower(word) IN ({_ABBR}) OR regexp_full_match(word, '[A-Z]')) THEN 1 ELSE 0 END
   WHEN regexp_matches(nxt, '[a-z]') THEN 0 ELSE 1 END AS b FROM parts),
islands AS (SELECT *, CAST(sum(b) OVER (PARTITION BY doc_id, c, p ORDER BY i) AS INTEGER) AS s FROM breaks),
raw AS (SELECT doc_id, c, p, s, string_agg(t, '' ORDER BY i) AS t FROM islands GROUP BY ALL),
sentences AS (SELECT doc_id, c, p, s, CAST(coalesce(sum(length(t)) OVER w, 0) AS INTEGER) AS start, rtrim(t) AS text, CAST(len(regexp_extract_all(t, '\\S+')) AS INTEGER) AS n_words,
   CAST(coalesce(sum(len(regexp_extract_all(t, '\\S+'))) OVER w, 0) AS INTEGER) AS word_start FROM raw WINDOW w AS (PARTITION BY doc_id, c, p ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

OFFSETS = """offs AS (SELECT doc_id, c, p, pwc, CAST(coalesce(sum(pwc) OVER (PARTITION BY doc_id ORDER BY c, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS g, CAST(sum(pwc) OVER (PARTITION BY doc_id) AS BIGINT) AS total FROM paras)"""


def norm(x: str) -> str:
    """DuckDB's form of functions.text.normalize."""
    x = f"lower(strip_accents(coalesce({x}, '')))"
    x = f"translate({x}, '‘’‚‛`“”„‟«»‐‑‒–—―', '''''''''''\"\"\"\"\"\"------')"
    x = f"replace(replace(replace({x}, 'æ', 'ae'), 'œ', 'oe'), 'ß', 'ss')"
    x = f"regexp_replace({x}, '[^a-z0-9\\s''-]', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, '[''-]', '', 'g'), '\\s+', ' ', 'g'))"


def syllables(x: str) -> str:
    letters = f"regexp_replace(lower({x}), '[^a-z]', '', 'g')"
    stem = f"regexp_replace(regexp_replace({letters}, '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', '')"
    return f"CAST(CASE WHEN {letters} = '' THEN 0 WHEN length({letters}) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all({stem}, '[aeiouy]{{1,2}}'))) END AS INTEGER)"


def js_round(x: str, places: int = 0) -> str:
    return f"floor(({x}) * {10**places} + 0.5) / {float(10**places)}" if places else f"CAST(floor(({x}) + 0.5) AS BIGINT)"
