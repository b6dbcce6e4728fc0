"""DuckDB SQL of the URL queries: rules, and the closure over declared links."""

from __future__ import annotations

from .url_filter import RULES, TEXT_ONLY

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rule_case(what: int) -> str:
    """CASE over the rules, longest first: the verdict (0) or the rule (1)."""
    cases = []
    for rule in sorted(RULES, key=lambda r: (len(r[1]), r[1]), reverse=True):
        host, _, prefix = rule[1].partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{prefix}') THEN '{rule[what]}'")
    return f"CASE {' '.join(cases)} END"


def _parts(url: str) -> str:
    rest = f"CASE WHEN instr(coalesce({url}, ''), '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    return f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path"


def _resolved(target: str, base: str) -> str:
    """As resolved(), but for dot segments, which tests compare with the standard library."""
    at, rest = f"instr({base}, '://')", f"substr({base}, instr({base}, '://') + 3)"
    host, path = f"regexp_extract({rest}, '^([^/?#]*)', 1)", f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    scheme = f"substr({base}, 1, {at} - 1)"
    top = f"{scheme} || '://' || {host}"
    return rf"""CASE WHEN regexp_matches({target}, '(?i)^[a-z][a-z0-9+.-]*://') THEN {target} WHEN regexp_matches({target}, '(?i)^[a-z][a-z0-9+.-]*:') OR {at} <= 1 OR {target} = '' THEN ''
      WHEN starts_with({target}, '//') THEN {scheme} || ':' || {target} WHEN starts_with({target}, '/') THEN {top} || {target}
      WHEN starts_with({target}, '#') THEN {top} || {path} || regexp_extract({rest}, '^[^?#]*(\?[^#]*)', 1) || {target} WHEN starts_with({target}, '?') THEN {top} || {path} || {target}
      ELSE {top} || CASE WHEN contains({path}, '/') THEN regexp_extract({path}, '^(.*/)', 1) ELSE '/' END || {target} END"""


def _unescaped(x: str) -> str:
    for name, char in (("&#38;", "&"), ("&#x26;", "&"), ("&#47;", "/"), ("&#x2F;", "/"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def _node(url: str) -> str:
    """As node_of(), beside _parts(url)."""
    scheme = f"translate(substr({url}, 1, instr({url}, '://') - 1), '{_UPPER}', '{_LOWER}')"
    return rf"CASE WHEN host <> '' THEN {scheme} || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(regexp_extract({url}, '(?s)^([^#]*)', 1), '(?s)^[^?]*(\?.*)$', 1) END"


def _attribute(tag: str, name: str) -> str:
    """The value of the first attribute of that name, without quotes and blanks around it; null where there is none."""
    pattern = r"""([^\s"''<>/=]+)\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)"""
    value = f"list_filter(list_zip(regexp_extract_all({tag}, '{pattern}', 1), regexp_extract_all({tag}, '{pattern}', 2)), lambda x: lower(x[1]) = '{name}')[1][2]"
    return f"trim(trim({value}, '\"'''), ' ' || chr(9) || chr(10) || chr(12) || chr(13))"


def url_sql(pages: str) -> str:
    """filter_pages over the rows of `pages` (page_id, url, html)."""
    rest = r"""\b(?:[^>"'']+|"[^"]*"|''[^'']*'')*>"""
    return rf"""
WITH RECURSIVE src AS ({pages}), p AS (SELECT *, {_node('url')} AS node FROM (SELECT page_id, url, html, {_parts('url')} FROM src)),
     m AS (SELECT url, node, regexp_replace(coalesce(html, ''), '{TEXT_ONLY}', ' ', 'gis') AS html FROM p WHERE node IS NOT NULL),
     tags AS (SELECT url, node, regexp_extract(html, '(?is)(<base{rest})', 1) AS base, unnest(regexp_extract_all(html, '(?is)<(?:link|meta){rest}')) AS tag FROM m),
     said AS (SELECT url, node, {_attribute('base', 'href')} AS base, {_attribute('tag', 'rel')} AS rel, {_attribute('tag', 'href')} AS href, {_attribute('tag', 'http-equiv')} AS equiv, {_attribute('tag', 'content')} AS content, lower(tag[2:5]) AS kind FROM tags),
     aimed AS (SELECT url, node, coalesce(base, '') AS base, CASE WHEN kind = 'link' THEN CASE WHEN list_contains(regexp_split_to_array(lower(rel), '\s+'), 'canonical') THEN href END
               WHEN lower(equiv) = 'refresh' THEN trim(regexp_extract(content, '(?is)^[^;,]*[;,]\s*url\s*=\s*(.*)$', 1), '"''') END AS target FROM said),
     named AS (SELECT url, node, {_unescaped('base')} AS base, {_unescaped('trim(target)')} AS target FROM aimed WHERE target IS NOT NULL),
     based AS (SELECT node, target, coalesce(nullif({_resolved('base', 'url')}, ''), url) AS base FROM named),
     ends AS (SELECT node, u, {_parts('u')} FROM (SELECT node, {_resolved('target', 'base')} AS u FROM based)),
     edges AS (SELECT a, b, host, path FROM (SELECT node AS a, {_node('u')} AS b, host, path FROM ends) WHERE b IS NOT NULL),
     pairs AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
     nodes AS (SELECT b AS n, host, path FROM edges UNION SELECT node, host, path FROM p WHERE node IN (SELECT a FROM pairs)),
     hit AS (SELECT n FROM nodes WHERE {_rule_case(0)} = 'block' UNION SELECT pairs.b FROM hit JOIN pairs ON pairs.a = hit.n),
     j AS (SELECT page_id, host, path, {_rule_case(1)} AS rule, {_rule_case(0)} AS own, node IS NOT NULL AND node IN (SELECT n FROM hit) AS alias FROM p)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN alias THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN own IS NOT NULL THEN 'rule' WHEN alias THEN 'alias' ELSE 'default' END AS verdict_by FROM j"""


def _made(n: str) -> str:
    return f"'http://h' || ({n}) % 5 || '.com/' || CASE ({n}) % 7 WHEN 0 THEN 'de/' WHEN 3 THEN 'fr/' ELSE 'x/' END || ({n})"


#: As made_pages().
MADE_PAGES = f"""SELECT page_id, {_made('page_id')} || CASE WHEN page_id % 5 = 4 THEN '' ELSE '?a=1&b=2#top' END AS url, '<html><head>'
  || CASE page_id % 9 WHEN 0 THEN '<!-- <link rel=canonical href="http://h0.com/de/0"> -->' WHEN 3 THEN '<script>"<link rel=canonical href=http://h0.com/de/0>"</script>' WHEN 6 THEN '<link rel=alternate title=" rel=canonical" href="http://h0.com/de/0">' ELSE '' END
  || CASE WHEN page_id % 5 = 4 THEN ''
  WHEN page_id % 2 = 0 THEN '<link data-href="http://h0.com/de/0" rel=''nofollow canonical'' href=''' || replace({_made('page_id + 1')}, 'http:', '') || '?a=1&amp;b=2''>' ELSE '<meta http-equiv="refresh" content="0; url=' || {_made('page_id + 1')} || '?a=1&b=2">' END || '</head></html>' AS html FROM pages"""
