"""Answers of four kinds of book catalogues as one kind of row, and what is wrong with those that cannot be read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where each catalogue's answer has its records, and those of their fields that are used. Fields that may hold one value or
#: several are read as JSON text, see several().
RECORDS = {
    "openlibrary": ("docs", "key string, title string, author_name array<string>, first_publish_year int, subject string, ia array<string>, ebook_access string, number_of_pages_median int, ratings_average double, language string"),
    "archive": ("response.docs", "identifier string, title string, creator string, year string, downloads long, subject string, language string, collection string"),
    "gutenberg": ("results", "id long, title string, authors array<struct<name:string>>, subjects array<string>, bookshelves array<string>, languages array<string>, download_count long"),
    "google": ("items", "id string, volumeInfo struct<title:string,subtitle:string,authors:array<string>,publishedDate:string,categories:array<string>,pageCount:int,averageRating:double,language:string>, accessInfo struct<publicDomain:boolean,epub:struct<downloadLink:string>>"),
}
ROW = ["id", "source", "title", "author", "year", "subjects", "languages", "downloads", "pages", "rating", "full_text"]
_BROKEN = "_broken"


def several(field: Column) -> Column:
    """A field that holds one value or an array, as an array of strings; empty where there is none."""
    text = F.trim(field)
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.isNotNull() & (text != ""), F.array(field)).otherwise(F.array().cast("array<string>"))


def _schema(source: str) -> str:
    path, fields = RECORDS[source]
    outer, _, inner = path.partition(".")
    return f"{outer} struct<{inner}:array<struct<{_types(fields)}>>>, {_BROKEN} string" if inner else f"{outer} array<struct<{_types(fields)}>>, {_BROKEN} string"


def _types(fields: str) -> str:
    """name kind, name kind, … as the inside of a struct type."""
    out, depth, part = [], 0, ""
    for char in fields + ",":
        depth += (char == "<") - (char == ">")
        if char == "," and not depth:
            name, _, kind = part.strip().partition(" ")
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += char
    return ",".join(out)


def _list(field: Column) -> Column:
    return F.coalesce(field, F.array().cast("array<string>"))


def _joined(names: Column) -> Column:
    return F.array_join(_list(names), ", ")


def _year(text: Column) -> Column:
    return F.try_to_number(F.regexp_extract(F.substring(text, 1, 4), r"^(\d{1,4})$", 1), F.lit("9999")).cast("int")


def _row(source: str) -> list[Column]:
    """The common columns of a record `d` of a catalogue, but source."""
    d, none = lambda c: F.col(f"d.{c}"), lambda kind: F.lit(None).cast(kind)
    title = lambda c: F.coalesce(F.when(F.trim(c) != "", c), F.lit("Untitled"))
    made = {
        "openlibrary": lambda: (F.concat(F.lit("ol:"), d("key")), title(d("title")), _joined(d("author_name")), d("first_publish_year"), several(d("subject")), several(d("language")), none("long"), d("number_of_pages_median"), d("ratings_average"), (d("ebook_access") == "public") & (F.size(_list(d("ia"))) > 0)),
        "archive": lambda: (F.concat(F.lit("ia:"), d("identifier")), F.coalesce(F.get(several(d("title")), F.lit(0)), d("identifier")), _joined(F.slice(several(d("creator")), 1, 2)), _year(F.get(several(d("year")), F.lit(0))), F.flatten(F.transform(several(d("subject")), lambda s: F.split(s, r"\s*;\s*"))), several(d("language")), F.coalesce(d("downloads"), F.lit(0)), none("int"), none("double"), F.lit(True)),
        "gutenberg": lambda: (F.concat(F.lit("pg:"), d("id")), title(d("title")), _joined(F.transform(d("authors"), lambda a: a["name"])), none("int"), F.concat(_list(d("subjects")), _list(d("bookshelves"))), _list(d("languages")), F.coalesce(d("download_count"), F.lit(0)), none("int"), none("double"), F.lit(True)),
        "google": lambda: (F.concat(F.lit("gb:"), d("id")), F.concat(title(d("volumeInfo.title")), F.when(d("volumeInfo.subtitle") != "", F.concat(F.lit(": "), d("volumeInfo.subtitle"))).otherwise("")), _joined(d("volumeInfo.authors")), _year(d("volumeInfo.publishedDate")), _list(d("volumeInfo.categories")), several(d("volumeInfo.language")), none("long"), d("volumeInfo.pageCount"), d("volumeInfo.averageRating"), F.coalesce(d("accessInfo.publicDomain"), F.lit(False)) & d("accessInfo.epub.downloadLink").isNotNull()),
    }[source]()
    names = [c for c in ROW if c != "source"]
    full = F.coalesce(made[-1], F.lit(False))
    return [c.alias(name) for name, c in zip(names, (*made[:-1], full), strict=True)]


def _parsed(answers: DataFrame, source: str) -> DataFrame:
    """(answer, a, error): a source's answers (source, answer, payload) parsed; error where there is none or it is no JSON."""
    rows = answers.filter(F.col("source") == source)
    a = F.from_json("payload", _schema(source), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})
    parsed = rows.select("answer", "payload", a.alias("a"))
    error = F.when(F.col("payload").isNull() | (F.trim("payload") == ""), "no answer").when(F.col(f"a.{_BROKEN}").isNotNull() | F.col("a").isNull(), "not JSON of this catalogue")
    return parsed.select("answer", "a", error.alias("error"))


def records(answers: DataFrame) -> DataFrame:
    """All catalogues' records as rows of one kind (ROW), from answers (source, answer, payload).

    What one answer is broken in costs that answer alone, see errors(). Records without an id are left out; subjects and languages may come as one
    value or several; unknown sources are errors.
    """
    parts = []
    for source in RECORDS:
        path = RECORDS[source][0]
        found = _parsed(answers, source).filter("error IS NULL").select(F.explode(F.col(f"a.{path}")).alias("d")).filter("d IS NOT NULL")
        parts.append(found.select(*_row(source)).filter("id IS NOT NULL").select("id", F.lit(source).alias("source"), *ROW[2:]))
    return reduce(lambda a, b: a.unionByName(b), parts)


def errors(answers: DataFrame) -> DataFrame:
    """(source, answer, error) of the answers that give no records because they are broken, missing or of no known catalogue."""
    known = [_parsed(answers, source).filter("error IS NOT NULL").select(F.lit(source).alias("source"), "answer", "error") for source in RECORDS]
    strange = answers.filter(~F.coalesce(F.col("source").isin(list(RECORDS)), F.lit(False))).select("source", "answer", F.lit("unknown catalogue").alias("error"))
    return reduce(lambda a, b: a.unionByName(b), [*known, strange])


def item_files(items: DataFrame) -> DataFrame:
    """(item, name, format, size, how) of items (item, metadata, files_xml): from the JSON if it names files, else from the XML list; a row with
    how = 'error' and no name for items that neither tells. Sizes are bytes, 0 where they are not told."""
    meta = F.from_json("metadata", "files array<struct<name:string,format:string,size:string>>")
    xml = F.from_xml(F.col("files_xml"), "file array<struct<_name:string,format:string,size:string>>", {"attributePrefix": "_", "rowTag": "files"})
    from_meta = F.when(F.size(F.coalesce(meta["files"], F.array())) > 0, meta["files"])
    from_list = F.transform(xml["file"], lambda f: F.struct(f["_name"].alias("name"), f["format"].alias("format"), f["size"].alias("size")))
    rows = items.select("item", F.coalesce(from_meta, from_list).alias("files"), F.when(from_meta.isNotNull(), "json").when(F.size(F.coalesce(from_list, F.array())) > 0, "xml").otherwise("error").alias("how"))
    each = rows.select("item", "how", F.explode_outer("files").alias("f")).filter((F.col("how") == "error") | (F.coalesce(F.col("f.name"), F.lit("")) != ""))
    size = F.coalesce(F.try_to_number(F.regexp_extract("f.size", r"^(\d{1,18})$", 1), F.lit("9" * 18)).cast("long"), F.lit(0).cast("long"))
    return each.select("item", F.col("f.name").alias("name"), F.coalesce("f.format", F.lit("")).alias("format"), size.alias("size"), "how")
