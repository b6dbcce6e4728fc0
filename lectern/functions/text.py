"""Text expressions: words, sentences, normal form, syllables. All of them stay in Catalyst."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations after which a full stop does not end a sentence.
ABBREVIATIONS = (
    "mr mrs ms dr prof sr jr st mt vs etc no col gen lt capt sgt rev hon esq inc ltd co fig vol ch pp ed eds approx dept est "
    "jan feb mar apr jun jul aug sep sept oct nov dec messrs mme mlle bros rt viz cf ibid op"
).split()
#: Marks that end sentences, that may follow them, and that may open the next.
TERMINAL, CLOSING, OPENING = ".!?…", "\"'”’)\\]»", "\"'“‘(\\[«"
#: A boundary mark that no text holds.
CUT = "\u0001"

#: The mark comes first and what may not stand before it is asked afterwards: asked at each place of a text it takes ten times as long.
_BREAK = (
    rf"(\.(?<![{TERMINAL}]\.)(?<!(?<![A-Za-z])[A-Z]\.)(?<!(?<![A-Za-z])(?i:{'|'.join(ABBREVIATIONS)})\.)[{TERMINAL}]*[{CLOSING}]*\s+)(?=[A-Z0-9{OPENING}])"
    rf"|([!?…](?<![{TERMINAL}][!?…])[{TERMINAL}]*[{CLOSING}]*\s+)(?=[^a-z\s])"
)


def js_round(x: Column, places: int = 0) -> Column:
    """Rounds half up towards plus infinity."""
    k = float(10**places)
    return F.floor(x * k + 0.5) / k if places else F.floor(x + 0.5)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), 0)


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


#: What quotes and dashes become, and letters that are two.
QUOTES, DASHES, TWO = "‘’‚‛`“”„‟«»", "‐‑‒–—―", (("æ", "ae"), ("œ", "oe"), ("ß", "ss"))


@cache
def folds() -> tuple[str, str, dict[str, str]]:
    """By the rule of compatible decomposition without marks: characters, what each becomes where that is one character that normal forms
    keep (marks come last and become nothing), and those that become several, of which some are kept."""
    marks = "".join(map(chr, range(0x300, 0x370)))
    kept = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'-æœßÆŒ" + QUOTES + DASHES)
    one, many = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if not unicodedata.decomposition(char):
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if c not in marks)
        if len(plain) == 1 and plain in kept:
            one[char] = plain
        elif kept & set(plain):
            many[char] = plain
    return "".join(one) + marks, "".join(one.values()), many


def decomposed(text: Column) -> Column:
    """Compatible characters (ligatures, wide and small forms, numbers in circles) and letters with marks as plain ones, as far as normal
    forms keep them. Pure ASCII stays as it is; texts with characters that become several are taken apart, others translated."""
    chars, plain, many = folds()
    table = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
    some = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c > "~", F.coalesce(F.element_at(table, c), c)).otherwise(c)), "")
    # Most texts hold nothing but Latin letters and common marks: a short table does for them, and a long class is not asked.
    usual = [(c, p) for c, p in zip(chars, plain) if c <= "ÿ"]
    rare = text.rlike("[¼-¾[^\\x00-ÿŒœ‐-‟…]]")
    whole = F.when(text.rlike("[" + "".join(many) + "]"), some).otherwise(text)
    short = F.translate(text, "".join(c for c, _ in usual), "".join(p for _, p in usual))
    return F.when(F.octet_length(text) == F.char_length(text), text).when(rare, F.translate(whole, chars, plain)).otherwise(short)


def normalize(text: Column) -> Column:
    """Lower case, without accents, compatible forms as plain ones, apostrophes, hyphens and dashes gone; other marks become spaces."""
    out = F.lower(decomposed(F.coalesce(text, F.lit(""))))
    # One replacement for each mark that goes: they look for bytes, which costs far less than a table or a class of wide characters.
    for wide, narrow in (*TWO, *((mark, "") for mark in "'-" + QUOTES[:5] + DASHES)):
        out = F.replace(out, F.lit(wide), F.lit(narrow))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def norm_words(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda w: w != "")


def sentence_pieces(paragraph: Column) -> Column:
    """Sentences with the white space that follows them; their concatenation is the paragraph."""
    return F.filter(F.split(F.regexp_replace(paragraph, _BREAK, f"$1$2{CUT}"), CUT), lambda s: F.trim(s) != "")


def syllables(word: Column) -> Column:
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    # Endings that are not sounded, which define the counts.
    stem = F.regexp_replace(F.regexp_replace(letters, "(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), "^y", "")
    return F.when(letters == "", 0).when(F.length(letters) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(stem, F.lit("[aeiouy]{1,2}")))).cast("int")


def syllable_marks(text: Column) -> Column:
    """text with its words told apart by white space and written so that a word has a mark, SOUNDS, for each of its syllables: all words at
    once by the rule of syllables(), which takes a word at a time. Words without letters are gone."""
    letters = F.regexp_replace(F.lower(text), r"(?U)[^a-z\s]+", "")
    short = F.regexp_replace(letters, r"(?<![a-z])[a-z]{1,3}(?![a-z])", "1")
    # Endings that are not sounded, as in syllables(); a first y that is not sounded leaves a 0 behind.
    stem = F.regexp_replace(F.regexp_replace(short, "(?:[b-df-hjkmnp-tv-xz]es|ed|[b-df-hjkmnp-tv-xz]e)(?![a-z])", ""), "(?<![a-z])y", "0")
    return F.regexp_replace(stem, "(?<![0a-z])[0b-df-hj-np-tv-xz]+(?![0a-z])", "1")


#: In marks: a syllable, and a word of three or more.
SOUNDS, LONG = "[aeiouy]{1,2}|1", "(?<![0a-z])[0b-df-hj-np-tv-xz]*+(?:[aeiouy]{1,2}+[0b-df-hj-np-tv-xz]*+){3}"


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the text's characters (UTF-16 units inside the basic plane)."""
    units = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, u: (h.bitwiseXOR(u) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long"))
    return F.when(text == "", F.lit(2166136261).cast("long")).otherwise(F.aggregate(units, F.lit(2166136261).cast("long"), step))


def any_of(column: Column, *patterns: str) -> Column:
    return reduce(lambda a, b: a | b, [column.rlike(p) for p in patterns])
