"""Language identification: text, declared markup, address suffix and host priors as one Bayesian decision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .words import buffers, steps
from .work import TEXTS, as_text, ascii_lower, boxed, dealt, quoted, stored, unboxed

#: Hashed byte trigrams.
GRAMS = 1 << 16
#: Parts in which a language's counts travel to be added up, so that no task gets all of one.
PARTS = 64
#: Trigrams overlap and repeat each other's evidence, so their sum counts by a factor: of these, the one that explains best the labels of
#: the rows held out from the first count (one in HELD_OUT). It is the same for texts of any length.
TEMPERS, HELD_OUT = (1.0, 1 / 2, 1 / 3, 1 / 4, 1 / 6, 1 / 10, 1 / 16, 1 / 30), 5
#: Share of labels that may be wrong, so that a few such rows do not choose the factor.
LABEL_NOISE = 0.02
#: Share of trigrams that any text may owe to noise (numbers, codes, names); so a few odd strings don't outweigh a short text's words.
NOISE = 0.5
#: How often a declared language, and a country suffix that goes with one, is right.
MARKUP_RIGHT, SUFFIX_RIGHT = 0.9, 0.8
#: Pseudo-counts with which a host leans on its domain, and a domain on the whole.
LEAN = 5.0
#: Country suffixes that go with a language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}
#: Names below which registries sell domains under a country suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gov", "net", "nom", "or", "org")
UNKNOWN = "und"
#: Bytes of text whose trigrams a task looks up at a time.
STEP = 2_000_000


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of bytes with A-Z lower-cased and blank runs' bytes as one class, and each text's number of them.

    Trigrams without a letter (ASCII letter or part of a wider character) carry no evidence and are left out."""
    data, docs = buffers(texts)
    data = np.where((data - np.uint8(65)) < 26, data + np.uint8(32), data)
    data = np.where(data <= 32, np.uint8(32), data)
    if len(data) < 3:
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    letter = (data >= 128) | ((data - np.uint8(97)) < 26)
    wide = data.astype(np.uint32)
    hashed = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA6B) + wide[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F) >> np.uint32(16)
    use = letter[:-2] | letter[1:-1] | letter[2:]
    for back in (1, 2):  # trigrams that reach into the next text
        at = docs[1:] - back
        use[at[(at >= 0) & (at < len(use))]] = False
    kept = np.concatenate([[0], np.cumsum(use)])
    edges = np.minimum(docs, len(use))
    return hashed[use].astype(np.int64), np.diff(kept[edges])


class TextModel:
    """log P(trigram | language): add-half smoothed shares, mixed with noise; arrays of a fixed size per language."""

    def __init__(self, languages: list[str], counts: np.ndarray, temper: float = 1 / 3) -> None:
        self.temper = temper
        shares = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * GRAMS)
        self.languages, self.log_p = languages, np.log((1 - NOISE) * shares + NOISE / GRAMS).astype(np.float32)

    def sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text and language the log-likelihood of all its trigrams, and the number of trigrams."""
        ids, sizes = grams(texts)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            run = np.concatenate([[0.0], np.cumsum(self.log_p[k][ids], dtype=np.float64)])
            out[:, k] = run[upto[1:]] - run[upto[:-1]]
        return out, sizes


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", most_rows: int | None = None) -> TextModel:
    """Counts trigrams per language over all labelled rows, whole texts. Null labels are left out; repeated rows count as often as they come.

    Each task adds up its own rows, and sums of tasks are added in PARTS of a language's counts: what travels grows with the number of
    tasks, not of texts. most_rows: if a caller wants no more than about so many rows of each language, those whose hash (of all columns)
    lies under the share wanted of the label, and the row of least hash always: each label of the table is in the model, however rare.
    """
    rows = labelled.select(as_text(F.col(text_col)).alias("text"), F.col(label_col).cast("string").alias("lang"), F.xxhash64(*[F.col(quoted(c)) for c in labelled.columns]).alias("hash")).filter("lang is not null")
    if most_rows is not None:
        bounds = []
        for lang, n, least in rows.groupBy("lang").agg(F.count("*"), F.min("hash")).collect():
            bounds.append((lang, 2**63 - 1 if n <= most_rows else max(least, int(most_rows / n * 2**64) - 2**63)))
        # One row for each language of the model, which the driver holds anyway.
        wanted = F.broadcast(labelled.sparkSession.createDataFrame(bounds, "lang string, bound long"))
        rows = rows.join(wanted, "lang").filter("hash <= bound")
    rows = dealt(rows.select("text", "lang", (F.pmod(F.pmod("hash", F.lit(1_000_003)), F.lit(HELD_OUT)) == 0).alias("out")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, bool], np.ndarray] = {}
        for batch in batches:
            names, kind = np.unique(np.array(batch.column(1).to_pylist(), str), return_inverse=True)
            cell = kind * 2 + batch.column(2).to_numpy(zero_copy_only=False)
            for at, texts in steps(batch.column(0), STEP):
                ids, sizes = grams(texts)
                here, place = np.unique(cell[at : at + len(texts)], return_inverse=True)
                sums = np.bincount(np.repeat(place, sizes) * GRAMS + ids, minlength=len(here) * GRAMS).reshape(-1, GRAMS)
                for k, own in zip(here.tolist(), sums, strict=True):
                    key = (str(names[k // 2]), bool(k % 2))
                    total[key] = total.get(key, 0) + own
        for (lang, out), sums in total.items():
            parts = pa.array([x.astype("<i8").tobytes() for x in np.split(sums, PARTS)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * PARTS), pa.array([out] * PARTS), pa.array(np.arange(PARTS), pa.int32()), parts], names=["lang", "out", "part", "counts"])

    def merge(group: pa.Table) -> pa.Table:
        total = np.zeros(GRAMS // PARTS, np.int64)
        for x in group["counts"]:
            total += np.frombuffer(x.as_py(), "<i8")
        return pa.table({**{c: group[c].slice(0, 1) for c in ("lang", "out", "part")}, "counts": pa.array([total.tobytes()], pa.binary())})

    sums: dict[tuple[str, bool], np.ndarray] = {}
    kind = "lang string, out boolean, part int, counts binary"
    for r in stored(rows.mapInArrow(count, kind), "gram-counts", TEXTS).groupBy("lang", "out", "part").applyInArrow(merge, kind).toLocalIterator():
        own = np.frombuffer(r["counts"], "<i8")
        sums.setdefault((r["lang"], r["out"]), np.zeros(GRAMS, np.int64))[r["part"] * len(own) : (r["part"] + 1) * len(own)] = own
    languages = sorted({lang for lang, _ in sums})
    none = np.zeros(GRAMS, np.int64)
    counted, held = (np.array([sums.get((x, out), none) for x in languages], np.float64).reshape(len(languages), GRAMS) for out in (False, True))
    first = TextModel(languages, counted)

    def loss(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(TEMPERS))
        for batch in batches:
            for at, texts in steps(batch.column(0), STEP):
                right = np.array([languages.index(x) for x in batch.column(1).slice(at, len(texts)).to_pylist()])
                fit_, _ = first.sums(texts)
                for k, temper in enumerate(TEMPERS):
                    log = fit_ * temper
                    log = log - log.max(axis=1, keepdims=True)
                    share = np.exp(log[np.arange(len(right)), right]) / np.exp(log).sum(axis=1)
                    total[k] -= np.log((1 - LABEL_NOISE) * share + LABEL_NOISE / len(languages)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(TEMPERS), pa.array(total)], names=["temper", "lost"])

    lost: dict[float, float] = {}
    if len(languages) > 1:
        found = stored(rows.filter("out").mapInArrow(loss, "temper double, lost double"), "losses", TEXTS).groupBy("temper").agg(F.sum("lost").alias("lost"))
        lost = {r["temper"]: round(r["lost"], 6) for r in found.collect()}
    return TextModel(languages, counted + held, min(TEMPERS, key=lambda t: (lost[t], t)) if lost else TEMPERS[2])


def evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    """rows (row, text, markup, suffix, …) without text, markup and suffix, plus fits, best (language of the text alone), ev, the
    log-evidence of each language, and own, what it comes to as shares (zeros where fits is false).

    fits is false when even noise (all trigrams alike) explains the text better than the best language; without trigrams there is no
    evidence from the text.
    """
    columns = [c for c in rows.columns if c not in ("text", "markup", "suffix")]
    languages = model.languages

    def stated(values: list, right: float, table: dict[str, str] | None = None) -> np.ndarray:
        names = [table.get(v) if table else v for v in values]
        n = max(2, len(languages))
        out = np.zeros((len(values), len(languages)))
        for row, name in enumerate(names):
            if name in languages:
                out[row] = np.log((1 - right) / (n - 1))
                out[row, languages.index(name)] = np.log(right)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = {name: k for k, name in enumerate(batch.schema.names)}
            for at, texts in steps(batch.column(place["text"])):
                part = batch.slice(at, len(texts))
                sums, sizes = model.sums(texts)
                best = sums.max(axis=1, initial=-np.inf)
                fits = (sizes > 0) & (best > -np.log(GRAMS) * sizes)
                ev = sums * model.temper
                ev = ev - ev.max(axis=1, keepdims=True, initial=-np.inf) if len(languages) else ev
                ev = np.where(fits[:, None], ev, 0.0)
                ev += stated(part.column(place["markup"]).to_pylist(), MARKUP_RIGHT) + stated(part.column(place["suffix"]).to_pylist(), SUFFIX_RIGHT, SUFFIXES)
                own = np.exp(ev - ev.max(axis=1, keepdims=True, initial=-np.inf)) if len(languages) else ev
                own = own / own.sum(axis=1, keepdims=True)
                top = [languages[k] if ok else UNKNOWN for k, ok in zip(sums.argmax(axis=1) if len(languages) else sizes, fits, strict=True)]
                ends = pa.array(np.arange(len(ev) + 1) * len(languages), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (ev, np.where(fits[:, None], own, 0.0))]
                yield pa.RecordBatch.from_arrays([*(part.column(place[c]) for c in columns), pa.array(fits), pa.array(top, pa.string()), *lists], names=[*columns, "fits", "best", "ev", "own"])

    more = StructType().add("fits", "boolean").add("best", "string").add("ev", ArrayType(DoubleType())).add("own", ArrayType(DoubleType()))
    return rows.mapInArrow(run, StructType([rows.schema[c] for c in columns] + more.fields))


def identify(rows: DataFrame, model: TextModel, text: Column, host: Column | None = None, domain: Column | None = None, markup: Column | None = None, suffix: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """All columns of rows (or those in keep), then language, confidence and text_language.

    A language's score adds the tempered log-likelihood of the whole text, of the declared language, of the country suffix, and a
    prior. The prior is the share of the language among the host's other rows by their own evidence, smoothed towards that among its
    domain's, and that towards the whole table's; a row's own evidence is taken out of all three, so that no row confirms itself. Rows
    without a host use the whole table's. Languages are those of the model. A row is `und` when its text holds no letters, or fits no
    language better than noise: declarations do not outvote that. Null texts are empty, hence und; null declarations say nothing; ties go
    to the language that sorts first; repeated rows are decided each and alike. Columns named language, confidence or text_language in
    rows raise ValueError; any other names are free, since rows travel as one struct. An empty table gives an empty result.
    """
    own = ("language", "confidence", "text_language")
    keep = rows.columns if keep is None else keep
    if clash := set(own) & set(keep):
        raise ValueError(f"columns {sorted(clash)} are already there")
    if not model.languages:  # nothing to choose from
        return rows.select(*[F.col(quoted(c)) for c in keep], F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("confidence"), F.lit(UNKNOWN).alias("text_language"))
    none = F.lit(None).cast("string")
    named = {"text": as_text(text), "markup": markup, "suffix": suffix, "host": host, "domain": host if domain is None else domain}
    wide = rows.select(boxed(keep), *[(none if column is None else column.cast("string")).alias(name) for name, column in named.items()])
    seen = stored(evidence(wide, model), "evidence", TEXTS)
    n = len(model.languages)
    soft = seen.filter("fits").select("host", "domain", "own")
    hosts = stored(soft.groupBy("host", "domain").agg(*[F.sum(F.col("own")[k]).alias(f"h{k}") for k in range(n)]), "hosts")
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(f"h{k}") for k in range(n)]).alias("of_domain"))
    total = hosts.agg(*[F.sum(f"h{k}").alias(f"g{k}") for k in range(n)]).first()
    whole = F.array(*[F.lit(float(x or 0.0)) for x in total])
    known = hosts.filter("host is not null and domain is not null").select("host", "domain", F.array(*[f"h{k}" for k in range(n)]).alias("of_host")).join(domains, "domain")
    joined = seen.join(stored(known, "priors"), ["host", "domain"], "left")
    none_here = F.array(*[F.lit(0.0)] * n)
    one = F.when(F.col("fits"), 1.0).otherwise(0.0)  # the row's own shares add up to this

    def size(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)

    # Sums first, as columns of their own: the shares below are then one pass over the languages.
    joined = joined.select("*", F.coalesce("of_host", none_here).alias("hs"), F.coalesce("of_domain", none_here).alias("ds"))
    sums = F.struct((size(F.col("hs")) - one + LEAN).alias("h"), (size(F.col("ds")) - one + LEAN).alias("d"), (F.lit(float(sum(x or 0.0 for x in total) + n)) - one).alias("w"))

    def score(k: Column, sums: Column) -> Column:
        """Evidence and log-prior of a language; a row's own share is taken out of each level."""
        rest = lambda counts: F.greatest(F.lit(0.0), F.get(counts, k) - F.get("own", k))
        w = (rest(whole) + 1) / sums["w"]
        d = (rest(F.col("ds")) + LEAN * w) / sums["d"]
        h = (rest(F.col("hs")) + LEAN * d) / sums["h"]
        return F.get("ev", k) + F.log(F.when(F.col("of_host").isNotNull(), h).otherwise(w))

    def once(x: Column, use) -> Column:
        """use(x) with x worked out once for a row, however often it occurs in it."""
        return F.get(F.transform(F.array(x), use), F.lit(0))

    scores = once(sums, lambda z: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: score(k, z)))
    found = once(scores, lambda s: once(F.array_max(s), lambda m: F.struct(F.array_position(s, m).cast("int").alias("at"), (1 / F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x - m))).alias("p"))))
    joined = joined.withColumn("found", F.when(F.col("fits"), found))
    names = F.array(*[F.lit(x) for x in model.languages]).cast("array<string>")
    language = F.coalesce(F.element_at(names, F.col("found.at")), F.lit(UNKNOWN))
    return joined.select(*unboxed(keep), language.alias("language"), F.coalesce("found.p", F.lit(0.0)).alias("confidence"), F.col("best").alias("text_language"))


def page_text(html: Column) -> Column:
    """What a page shows: without comments, scripts, styles and tags."""
    html = F.regexp_replace(as_text(html), r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return F.regexp_replace(html, r"<[^>]*>", " ")


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """(page_id, host, markup_language, language, confidence, text_language) of pages (page_id, url, html)."""
    host = ascii_lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    markup = ascii_lower(F.regexp_extract(as_text(F.col("html")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))
    rows = pages.select("page_id", F.nullif(host, F.lit("")).alias("host"), F.nullif(markup, F.lit("")).alias("markup_language"), page_text(F.col("html")).alias("shown"))
    second = "|".join(SECOND_LEVEL)
    domain, suffix = F.regexp_extract("host", rf"([^.]+\.(?:(?:{second})\.[a-z]{{2}}|[^.]+))$", 1), F.regexp_extract("host", r"([^.]+)$", 1)
    return identify(rows, model, F.col("shown"), F.col("host"), domain, F.col("markup_language"), suffix, ["page_id", "host", "markup_language"])
