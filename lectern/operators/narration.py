"""Narration: chunks, units, sentence groups, word times, learned pace, voices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentence_pieces, words
from ..shipping import ship

UNIT_CHARS = {"cloud": 2400, "device_fast": 900, "device": 320, "multilingual": 700}
GROUP_CHARS, GROUP_LEAST, GROUP_SHORT, GROUP_CUT = 380, 60, 40, 420


def word_weight(word: Column) -> Column:
    """What a word weighs in time: its length, and pauses after marks."""
    return F.length(word) + 1 + F.when(word.rlike("[,;:]$"), 2.5).when(word.rlike("[.!?…][\"”’)]*$"), 5.0).otherwise(0.0)


#: Bytes of a list column that are worked on at once, if a row does not hold more by itself.
BLOCK = 1 << 18


def by_size(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch by the size of a column of lists, so that what a task holds does not grow with its batches."""
    lists = batch.column(column)
    sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    each = max(1, lists.nbytes // max(1, int(sizes.sum())))
    upto, at = np.cumsum(sizes * each), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, "right")))
        yield batch.slice(at, to - at)
        at = to


def _by_paragraph(paras: DataFrame, fold: Callable[[list[str]], list[tuple]], names: list[str]) -> DataFrame:
    """(doc_id, c, p, …integers): what fold makes of each paragraph's sentences, one row per tuple. No shuffle, one step a sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fold([s.rstrip(" ") for s in pieces]) for pieces in batch.column(3).to_pylist()]
            of = pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made]))
            table = np.array([row for m in made for row in m], np.int32).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in range(3)), *(pa.array(table[:, k]) for k in range(len(names)))], names=["doc_id", "c", "p", *names])

    ship(paras.sparkSession)
    kind = paras.schema["doc_id"].dataType.simpleString()
    rows = paras.select("doc_id", F.col("c").cast("int").alias("c"), F.col("p").cast("int").alias("p"), sentence_pieces(F.col("text")).alias("x"))
    return rows.mapInArrow(run, f"doc_id {kind}, c int, p int, " + ", ".join(f"{n} int" for n in names))


def pack_lengths(lens: list[int], joins: Callable[[int, int], bool]) -> list[tuple[int, int, int]]:
    """(first, end, characters) of runs of sentences; joins(characters so far, next length) says whether the run goes on."""
    out: list[tuple[int, int, int]] = []
    begin = total = 0
    for k, n in enumerate(lens):
        if k and joins(total, n):
            total += 1 + n
            continue
        if k:
            out.append((begin, k, total))
        begin, total = k, n
    return [*out, (begin, len(lens), total)] if lens else out


def unit_texts(paras: DataFrame, most: int = UNIT_CHARS["cloud"]) -> DataFrame:
    """units() with `texts`, the unit's sentences with the white space behind them: all that its words need, so they never leave its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in by_size(batch, 3):
                lists = block.column(3).to_pylist()
                runs = [pack_lengths([len(s.rstrip(" ")) for s in texts], lambda so_far, n: so_far + 1 + n <= most) for texts in lists]
                of = pa.array(np.repeat(np.arange(len(runs)), [len(r) for r in runs]))
                spans = np.array([(k, *r) for found in runs for k, r in enumerate(found)], np.int32).reshape(-1, 4)
                texts = pa.array([own[a:b] for own, found in zip(lists, runs, strict=True) for a, b, _ in found], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*(block.column(k).take(of) for k in range(3)), *(pa.array(spans[:, k]) for k in range(4)), texts], names=["doc_id", "c", "p", "unit", "s_start", "s_end", "chars", "texts"])

    ship(paras.sparkSession)
    kind = paras.schema["doc_id"].dataType.simpleString()
    rows = paras.select("doc_id", F.col("c").cast("int").alias("c"), F.col("p").cast("int").alias("p"), sentence_pieces(F.col("text")).alias("x"))
    return rows.mapInArrow(run, f"doc_id {kind}, c int, p int, unit int, s_start int, s_end int, chars int, texts array<string>")


def units(paras: DataFrame, most: int = UNIT_CHARS["cloud"]) -> DataFrame:
    """(doc_id, c, p, unit, s_start, s_end, chars): sentences packed greedily while they fit `most` characters, at least one each."""

    def fold(texts: list[str]) -> list[tuple]:
        return [(k, *run) for k, run in enumerate(pack_lengths([len(t) for t in texts], lambda so_far, n: so_far + 1 + n <= most))]

    return _by_paragraph(paras, fold, ["unit", "s_start", "s_end", "chars"])


def sentence_groups(paras: DataFrame) -> DataFrame:
    """(doc_id, c, p, grp, s_start, s_end, part, chars): short sentences join their neighbours so that a call is neither tiny nor long; what is
    longer than GROUP_CUT all the same (one long sentence) comes in parts of at most GROUP_CHARS."""

    def joins(so_far: int, n: int) -> bool:
        return so_far + 1 + n <= GROUP_CHARS and (so_far < GROUP_LEAST or n < GROUP_SHORT)

    def fold(texts: list[str]) -> list[tuple]:
        out = []
        for k, (a, b, chars) in enumerate(pack_lengths([len(t) for t in texts], joins)):
            cut = [chars] if chars <= GROUP_CUT else [len(x) for x in chunks(" ".join(texts[a:b]), GROUP_CHARS)]
            out += [(k, a, b, part, n) for part, n in enumerate(cut)]
        return out

    return _by_paragraph(paras, fold, ["grp", "s_start", "s_end", "part", "chars"])


def spread_times(paras: DataFrame, cps: float = 15.0) -> DataFrame:
    """(doc_id, c, p, w, start, end): a paragraph's words share its duration, max(1, chars / cps) seconds, by weight.

    Paragraphs are dealt out before they are taken apart, so the running sums need no shuffle of words and long paragraphs cost no more
    than their sort.
    """
    by = ["doc_id", "c", "p"]
    dealt = paras.select(*by, F.greatest(F.lit(1.0), F.length("text") / cps).alias("dur"), words(F.col("text")).alias("ws")).repartition(*by)
    flat = dealt.select(*by, "dur", F.posexplode("ws").alias("w", "word")).select(*by, "dur", "w", word_weight(F.col("word")).alias("wt"))
    group = Window.partitionBy(*by)
    upto, total = F.sum("wt").over(group.orderBy("w")), F.sum("wt").over(group)
    return flat.select(*by, "w", ((upto - F.col("wt")) / total * F.col("dur")).alias("start"), (upto / total * F.col("dur")).alias("end"))


#: Marks after which a long sentence may be cut.
CUT_MARKS = ("; ", ", ", ": ", " — ", "—")


def chunks(text: str, most: int) -> list[str]:
    """Pieces of at most `most` characters, cut after the last mark of the window, or after its last space where that is too early."""
    out, at = [], 0
    while at < len(text):
        to = min(at + most, len(text))
        if to < len(text):
            mark = max(text.rfind(m, at, to) for m in CUT_MARKS)
            if mark - at < 0.4 * most:
                mark = text.rfind(" ", at, to)
            to = mark + 1 if mark > at else to
        out.append(text[at:to])
        at = to
    return [x for x in out if x.strip(" ")]


def chunk_text(text: Column, most: int) -> Column:
    """chunks() over a column, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else chunks(t, most))

    return cut(text)


def coalesce_cues(cues: DataFrame, by: str, order: str, most: int = 450) -> DataFrame:
    """(by, para, text): equal neighbours collapse, then cues join until over `most` characters and a final mark.

    Cues are sorted by key and order and streamed: a task holds the paragraph that it is at, however long a key's list is.
    """
    kind = cues.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, para, parts, size, started = None, None, 0, [], 0, False
        for batch in batches:
            rows: list[tuple] = []
            for now, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not started or now != key:
                    if parts:
                        rows.append((key, para, " ".join(parts)))
                    key, last, para, parts, size, started = now, None, 0, [], 0, True
                if text == last:
                    continue
                size += len(text) + bool(parts)
                last = text
                parts.append(text)
                if size > most and text[-1] in ".!?…\"”":
                    rows.append((key, para, " ".join(parts)))
                    para, parts, size = para + 1, [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.types[0]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=[by, "para", "text"])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([key], batch.schema.types[0]), pa.array([para], pa.int32()), pa.array([" ".join(parts)])], names=[by, "para", "text"])

    clean = cues.select(by, F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), order).filter("text != ''")
    return clean.repartition(by).sortWithinPartitions(by, order).select(by, "text").mapInArrow(run, f"{by} {kind}, para int, text string")


def learned_rate(observed: DataFrame, by: str, order: list[str], start: float = 15.5) -> DataFrame:
    """(by, cps): the pace after all accepted observations (chars, seconds), each moving it by three tenths.

    That is a weighted sum: an observation that n others follow weighs 0.3 * 0.7^n, and the start 0.7^all; so places are all it takes.
    """
    seen = F.col("chars") / F.col("seconds")
    ok = observed.filter((F.col("seconds") > 0.5) & (F.col("chars") > 20) & (seen > 5) & (seen < 40))
    later = F.row_number().over(Window.partitionBy(by).orderBy(*[F.col(c).desc() for c in order])) - 1
    weighed = ok.select(by, (seen * 0.3 * F.pow(F.lit(0.7), later)).alias("x"))
    return weighed.groupBy(by).agg((F.sum("x") + F.lit(start) * F.pow(F.lit(0.7), F.count("*"))).alias("cps"))


def choose_voice(wanted: DataFrame, voices: DataFrame) -> DataFrame:
    """wanted (id, language, override) with voice: the override if there is one of that name, else the language's best, else the best English one, else any.

    voices (voice, lang, quality) is a catalogue of fixed kind; the best has the highest quality, then the first name.
    """
    best = lambda rows, by: rows.groupBy(*by).agg(F.min_by("voice", F.struct(-F.col("quality"), F.col("voice"))).alias("best"))
    by_lang = best(voices, ["lang"])
    named = voices.select(F.col("voice").alias("override")).distinct().withColumn("known", F.lit(True))
    rest = voices.agg(F.min_by(F.when(F.col("lang") == "en", F.col("voice")), F.struct(F.col("lang") != "en", -F.col("quality"), F.col("voice"))).alias("english"), F.min_by("voice", F.struct(-F.col("quality"), F.col("voice"))).alias("any"))
    rows = wanted.join(named, "override", "left").join(by_lang.withColumnRenamed("lang", "language"), "language", "left").join(F.broadcast(rest))  # one row
    return rows.select("id", F.coalesce(F.when(F.col("known"), F.col("override")), "best", "english", "any").alias("voice"))
