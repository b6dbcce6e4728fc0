"""DuckDB SQL for phrase collocations: every phrase counted as it stands."""

from __future__ import annotations


def phrase_sql(least: int = 30, top: int = 2000, within: int = 80) -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i : i + {k - 1}], ' '))) AS phrase, {k} AS size FROM w WHERE len(ws) >= {k}"
        for k in (1, 2, 3, 4)
    )
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
     f AS MATERIALIZED (SELECT lang, phrase, size, count(*) AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
     n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
     c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
     cuts AS (SELECT lang, phrase, size, a, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS rest, k FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
     scores AS (SELECT cuts.lang, cuts.phrase, cuts.size, cuts.a, k, x.a AS l, y.a AS r, (CAST(2000000 AS HUGEINT) * cuts.a) // (CAST(x.a AS HUGEINT) + y.a) AS score
                FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
     lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     spans AS (SELECT lang, a, unnest(list_transform(range(1, size - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM (SELECT *, unnest(range(2, size)) AS k FROM c WHERE size > 2)),
     longer AS (SELECT lang, phrase, max(a) AS most FROM spans GROUP BY ALL),
     kept AS (SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR CAST(100 AS HUGEINT) * most < CAST({within} AS HUGEINT) * a),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= {top}"""
