"""URL rules, and block decisions that redirects and canonical links carry to aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .work import as_text, boxed, stored, unboxed

#: (verdict, rule): the rule is a host, a slash and a path prefix.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ://."""
    url = as_text(url)
    return _lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """What aliases are told apart by: the whole url, its query included, without its fragment; scheme and host in lower case, and a
    bare host as its root. Null without a host."""
    host, path = host_and_path(url)
    url = as_text(url)
    scheme, query = _lower(F.regexp_extract(url, "(?s)^(.*?)://", 1)), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), query))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits. Of rules with one length the one that sorts last wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones win
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{prefix}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _plain_path(path: Column) -> Column:
    """A rooted path without . and .. segments."""
    parts, none = F.split(path, "/"), F.array().cast("array<string>")
    up = lambda acc: F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
    kept = F.aggregate(parts, none, lambda acc, x: F.when(x == ".", acc).when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))


def resolved(target: Column, base: Column) -> Column:
    """The absolute url that target means on a page at base; empty where it has none (mailto:, or a base without ://). Absolute ones stay as they are."""
    scheme, host, path = (F.regexp_extract(base, f"(?s)^{p}", 1) for p in ("(.*?)://", ".*?://([^/?#]*)", ".*?://[^/?#]*([^?#]*)"))
    own, more = F.regexp_extract(target, r"^([^?#]*)", 1), F.regexp_extract(target, r"^[^?#]*(.*)", 1)
    rooted = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(path.contains("/"), F.regexp_extract(path, r"^(.*/)", 1)).otherwise("/"), own))
    there = F.concat(scheme, F.lit("://"), host, F.when(own == "", F.concat(path, F.when(target.startswith("#"), F.regexp_extract(base, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)).otherwise(""))).otherwise(_plain_path(rooted)), more)
    absolute, other = target.rlike(r"^(?i)[a-z][a-z0-9+.-]*://"), target.rlike(r"^(?i)[a-z][a-z0-9+.-]*:")
    return F.when(absolute, target).when(other | (scheme == "") | (target == ""), "").when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).otherwise(there)


def unescaped(value: Column) -> Column:
    """An attribute's value with the entities that urls in markup need."""
    for name, char in (("&#38;", "&"), ("&#x26;", "&"), ("&#47;", "/"), ("&#x2F;", "/"), ("&amp;", "&")):
        value = F.replace(value, F.lit(name), F.lit(char))
    return value


#: What is not markup: comments, and elements whose content is text. What is not closed reaches to the end.
TEXT_ONLY = "|".join([r"<!--.*?(?:-->|\z)", *[rf"<{name}\b[^>]*>.*?(?:</{name}\s*>|\z)" for name in ("script", "style", "textarea", "title")]])
#: The rest of a tag; quoted values may hold what would end it.
_REST = r"""\b(?:[^>"']+|"[^"]*"|'[^']*'){0,500}>"""
#: An attribute: its name and its value, with quotes if it has them.
_ATTRIBUTE = r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, without quotes and blanks around it; null where there is none."""
    names, values = (F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(k)) for k in (1, 2))
    at = F.array_position(F.transform(names, F.lower), name)
    value = F.when(at > 0, F.try_element_at(values, F.when(at > 0, at).otherwise(1).cast("int")))
    return F.regexp_replace(F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2"), r"^\s+|\s+$", "")


def declared_edges(pages: DataFrame) -> DataFrame:
    """(a, b): urls of pages and those that their canonical links and refresh redirects name, resolved against the page's <base> or url.

    Comments and the contents of scripts, styles, titles and text areas declare nothing. Attributes are found by their whole name; rel is
    a list of words, one of which must be canonical. Values may hold blanks inside quotes.
    """
    html = as_text(F.col("html"))
    markup = F.regexp_replace(F.when(html.rlike(r"(?i)canonical|refresh"), html), rf"(?is){TEXT_ONLY}", " ")
    found = F.regexp_extract_all("markup", F.lit(rf"(?is)(<(?:link|meta){_REST})"), F.lit(1))
    base = F.regexp_extract("markup", rf"(?is)(<base{_REST})", 1)
    tags = pages.select(F.col("url").alias("a"), markup.alias("markup")).select("a", base.alias("base"), F.explode(found).alias("tag"))
    tag = F.col("tag")
    canonical = F.when(F.array_contains(F.split(F.lower(attribute(tag, "rel")), r"\s+"), "canonical"), attribute(tag, "href"))
    goes = F.regexp_extract(attribute(tag, "content"), r"(?is)^[^;,]*[;,]\s*url\s*=\s*(.*)$", 1)
    refresh = F.when(F.lower(attribute(tag, "http-equiv")) == "refresh", F.regexp_replace(goes, r"""(?s)^(["'])(.*?)(\1.*)?$""", "$2"))
    target = unescaped(F.trim(F.when(tag.rlike(r"(?i)^<link"), canonical).otherwise(refresh)))
    own = resolved(unescaped(F.coalesce(attribute(F.col("base"), "href"), F.lit(""))), F.col("a"))
    against = F.when(own != "", own).otherwise(F.col("a"))
    # Written in between: filters would else be pushed through both steps, and the expression would grow with their product.
    named = stored(tags.select("a", against.alias("base"), target.alias("target")), "declared")
    return named.select("a", resolved(F.col("target"), F.col("base")).alias("b")).filter("a is not null and b != ''")


def filter_urls(urls: DataFrame, edges: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, url_col: str = "url") -> DataFrame:
    """All columns of urls, then host, path, rule, verdict and verdict_by (rule, alias or default). edges: url pairs a and b.

    A url that a rule fits has the rule's verdict: an explicit allow is never overridden by an alias's block. Other urls are
    blocked if any url that redirect or canonical edges connect them with, over any number of steps and in either direction, is
    blocked by a rule; else they are allowed. Aliases are whole urls without their fragment (see node_of): pages of one path that differ
    in the query are no aliases. Urls that occur in edges alone take part with their own rules. Null urls, and those without ://, have
    empty parts, no rule and no aliases. Columns of urls must not be named host, path, rule, verdict or verdict_by (ValueError); any
    other names are free, since the rows travel as one struct. Repeated rows come out repeated.
    """
    if clash := {"host", "path", "rule", "verdict", "verdict_by"} & set(urls.columns):
        raise ValueError(f"columns {sorted(clash)} are already there")
    host, path = host_and_path(F.col("url"))
    rule, own = rule_of(F.col("host"), F.col("path"), rules)
    rows = urls.select(boxed(urls.columns), F.col(f"`{url_col}`").cast("string").alias("url"))
    rows = rows.select("row", "url", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), own.alias("own"))
    edges = stored(edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")).filter("a is not null and b is not null").distinct(), "url-edges")
    if edges.isEmpty():
        rows = rows.withColumn("hit", F.lit(False))
    else:
        members = connected_components(edges)
        nodes = members.select("node", host_and_path(F.col("node"))[0].alias("host"), host_and_path(F.col("node"))[1].alias("path"), "component")
        blocked = nodes.filter(own == "block").select("component").distinct()
        aliases = members.join(blocked, "component", "left_semi").select("node", F.lit(True).alias("hit"))
        # Only urls without a rule of their own can be changed by an alias; the others meet no key.
        rows = rows.withColumn("node", F.when(F.col("own").isNull(), node_of(F.col("url")))).join(aliases, "node", "left")
    hit = F.coalesce("hit", F.lit(False))
    verdict = F.coalesce("own", F.when(hit, "block"), F.lit("allow"))
    by = F.when(F.col("own").isNotNull(), "rule").when(hit, "alias").otherwise("default")
    return rows.select(*unboxed(urls.columns), "host", "path", "rule", verdict.alias("verdict"), by.alias("verdict_by"))


def filter_pages(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """filter_urls over the urls of pages, with the edges that the pages themselves declare."""
    return filter_urls(pages.select("page_id", "url"), declared_edges(pages.select("url", "html")), rules)


def made_pages(pages: DataFrame) -> DataFrame:
    """Pages by rule, to try aliases on tables that declare none: each links to the next one in chains of five, by protocol-relative
    canonical links with an escaped query and by refresh redirects in turn. The last url of a chain lacks the query that the link to it has.
    Pages also name another page where that declares nothing: in a comment, in a script, or by another attribute."""
    k = F.col("page_id")

    def url(n: Column) -> Column:
        folder = F.when(n % 7 == 0, "de/").when(n % 7 == 3, "fr/").otherwise("x/")
        return F.concat(F.lit("http://h"), (n % 5).cast("string"), F.lit(".com/"), folder, n.cast("string"))

    target = F.concat(url(k + 1), F.lit("?a=1&b=2"))
    canonical = F.concat(F.lit("<link data-href=\"http://h0.com/de/0\" rel='nofollow canonical' href='"), F.replace(F.replace(target, F.lit("http:"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("'>"))
    refresh = F.concat(F.lit('<meta http-equiv="refresh" content="0; url='), target, F.lit('">'))
    link = F.when(k % 5 == 4, "").when(k % 2 == 0, canonical).otherwise(refresh)
    idle = F.when(k % 9 == 0, '<!-- <link rel=canonical href="http://h0.com/de/0"> -->').when(k % 9 == 3, '<script>"<link rel=canonical href=http://h0.com/de/0>"</script>')
    idle = idle.when(k % 9 == 6, '<link rel=alternate title=" rel=canonical" href="http://h0.com/de/0">').otherwise("")
    own = F.when(k % 5 == 4, url(k)).otherwise(F.concat(url(k), F.lit("?a=1&b=2#top")))
    return pages.select("page_id", own.alias("url"), F.concat(F.lit("<html><head>"), idle, link, F.lit("</head></html>")).alias("html"))
