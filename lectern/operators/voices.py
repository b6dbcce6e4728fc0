"""Which voice speaks: by hints and labels, by chains of choices, and catalogues in the order of families."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a ready-made voice is worth beside one label, and the families from best to last.
READY_MADE = 0.2
FAMILIES = ("Chirp 3 HD", "Studio", "Neural2", "WaveNet")
#: Labels that personas may ask for in all: they go to every task as one list.
MOST_LABELS = 10_000


def _first(rows: DataFrame, *order: str) -> DataFrame:
    """(persona, voice): the first row of each persona in the given order."""
    return rows.groupBy("persona").agg(F.min(F.struct(*order, "voice")).alias("b")).select("persona", "b.voice")


def by_hints(personas: DataFrame, voices: DataFrame) -> DataFrame:
    """(persona, voice): the first hint that a voice's name begins with, whatever the case, and of such voices the first.

    personas (persona, hints); voices (voice, ord, name). Names meet hints as prefixes of the hints' lengths: an equi-join, of the first voice of
    each prefix.
    """
    asked = personas.select("persona", F.posexplode("hints").alias("nth", "hint")).select("persona", "nth", F.lower("hint").alias("hint"))
    lengths = asked.select(F.length("hint").alias("size")).distinct().agg(F.collect_set("size").alias("sizes"))  # one row
    named = voices.select("voice", "ord", F.lower("name").alias("name")).join(F.broadcast(lengths))
    prefixes = named.select("voice", "ord", F.explode(F.array_distinct(F.transform(F.filter("sizes", lambda n: n <= F.length("name")), lambda n: F.substr("name", F.lit(1), n)))).alias("hint"))
    firsts = prefixes.groupBy("hint").agg(F.min(F.struct("ord", "voice")).alias("f")).select("hint", "f.ord", "f.voice")
    return _first(asked.join(firsts, "hint"), "nth", "ord")


def kinds(held: DataFrame) -> DataFrame:
    """(kind, voice, ord, extra, held): of voices that hold the same labels and have the same extra, which score alike, the first."""
    return held.groupBy("held", "extra").agg(F.min(F.struct("ord", "voice")).alias("f")).select(F.struct("held", "extra").alias("kind"), "f.voice", "f.ord", "extra", "held")


def by_labels(personas: DataFrame, voices: DataFrame) -> DataFrame:
    """(persona, voice): the voice whose labels and name hold most of the persona's labels, a ready-made one ahead of others with as many; the
    first of equals. Personas whose labels no voice has get the first ready-made voice, or the first of all.

    personas (persona, labels); voices (voice, ord, name, labels, category). Lists of labels meet kinds of voices, never persons voices: what
    meets grows with how many lists and kinds there are.
    """
    asked = personas.select("persona", F.array_sort("labels").alias("asked"))
    wanted = asked.select("asked").distinct().select("asked", F.explode("asked").alias("label"))
    every = wanted.select("label").distinct()
    if (count := every.count()) > MOST_LABELS:
        raise ValueError(f"{count} labels; at most {MOST_LABELS} can be asked for")
    listed = F.broadcast(every.agg(F.collect_list("label").alias("all")))  # one row of at most MOST_LABELS
    text = F.concat(F.array_join(F.transform(F.coalesce("labels", F.array().cast("array<string>")), F.lower), " "), F.lit(" "), F.lower("name"))
    extra = F.when(F.col("category") == "premade", READY_MADE).otherwise(0.0)
    facts = voices.select("voice", "ord", text.alias("text"), extra.alias("extra")).join(listed)
    held = kinds(facts.select("voice", "ord", "extra", F.array_sort(F.filter("all", lambda x: F.contains(F.col("text"), x))).alias("held")))
    scores = wanted.join(held.select("kind", "voice", "ord", "extra", F.explode("held").alias("label")), "label").groupBy("asked", "kind", "voice", "ord").agg((F.count("*") + F.first("extra")).alias("score"))
    best = scores.groupBy("asked").agg(F.min(F.struct(-F.col("score"), "ord", "voice")).alias("b")).select("asked", "b.voice")
    fallback = facts.agg(F.min_by("voice", F.struct(-F.col("extra"), F.col("ord"))).alias("fallback"))
    return asked.join(best, "asked", "left").join(F.broadcast(fallback)).select("persona", F.coalesce("voice", "fallback").alias("voice"))


def resolve(personas: DataFrame, voices: DataFrame) -> DataFrame:
    """(persona, voice, why): a persona's own choice, else its first hint that fits, else its labels; no voice where there are no voices."""
    hinted, labelled = by_hints(personas, voices).withColumnRenamed("voice", "hinted"), by_labels(personas, voices).withColumnRenamed("voice", "labelled")
    rows = personas.select("persona", "override").join(hinted, "persona", "left").join(labelled, "persona", "left")
    why = F.when(F.col("override").isNotNull(), "choice").when(F.col("hinted").isNotNull(), "hint").when(F.col("labelled").isNotNull(), "labels")
    return rows.select("persona", F.coalesce("override", "hinted", "labelled").alias("voice"), why.alias("why"))


def for_language(wanted: DataFrame, chosen: DataFrame, defaults: DataFrame, home: str = "en") -> DataFrame:
    """wanted (id, persona, language, persona_choice, persona_voice) with voice and why.

    In the home language the persona's choice counts, then its own voice; else the choice for the language (chosen: language, voice); else
    the language's first default (defaults: language, ord, voice); else the home language's.
    """
    first = defaults.groupBy("language").agg(F.min_by("voice", F.struct("ord", "voice")).alias("usual"))
    rest = F.broadcast(first.filter(F.col("language") == home).agg(F.max("usual").alias("last")))  # one row
    rows = wanted.join(chosen.select("language", F.col("voice").alias("picked")), "language", "left").join(first, "language", "left").join(rest)
    own = lambda c: F.when(F.col("language") == home, F.col(c))
    steps = (("persona choice", own("persona_choice")), ("persona", own("persona_voice")), ("language choice", F.col("picked")), ("language", F.col("usual")), ("home", F.col("last")))
    why = F.coalesce(*[F.when(c.isNotNull(), name) for name, c in steps])
    return rows.select("id", F.coalesce(*[c for _, c in steps]).alias("voice"), why.alias("why"))


def in_families(voices: DataFrame, by: list[str]) -> DataFrame:
    """voices (…, family, name) with place, from 1 within `by`: families in their order, then names; unknown families come first."""
    rank = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family"))
    return voices.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(rank, "name")))
