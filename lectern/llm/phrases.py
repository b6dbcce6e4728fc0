"""Phrase collocations: candidates by upper bounds of a sketch, exact counts by Aho-Corasick automata, then thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import buffers, cut, lowered
from .work import TEXTS, as_text, stored

#: Bytes of texts in a block; a longer text is a block of its own.
BLOCK = 8_000_000
#: Cells of a segment of the sketch, as a power of two. Segments grow in number with the corpus: a cell stands for about one word.
SEGMENT_BITS = 22
#: Phrases of which a task holds counts, before and after it has added them up.
HELD = 1_000_000
#: Words of the longest phrase.
LONGEST = 4
#: What ends a piece, and what stands between words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

_CELLS = "array<struct<segment:int,cells:binary,counts:binary>>"
_ARROW_CELLS = pa.list_(pa.struct([("segment", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())]))


def piece_words(texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All words with A-Z lower-cased, and for each whether it follows the word before it in one piece of one text."""
    data, docs = buffers(texts)
    data = lowered(data)
    kind = np.zeros(256, np.uint8)
    kind[list(BLANKS)], kind[list(BREAKS)] = 1, 2
    kinds = kind[data]
    words, at = cut(data, docs, kinds == 0)
    ended = np.cumsum(kinds == 2, dtype=np.int64)[at] + np.searchsorted(docs, at, side="right")
    follows = np.zeros(len(at), np.bool_)
    follows[1:] = ended[1:] == ended[:-1]
    return words, follows


def word_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of the texts of one language, as numbers into the block's own list of words.

    follows: bits, whether a word follows the one before it; counts: occurrences of each word of the list.
    """

    def blocks(langs: pa.Array, texts: pa.Array) -> Iterator[tuple]:
        for lang in pc.unique(langs).to_pylist():
            words, follows = piece_words(texts.filter(pc.equal(langs, lang)))
            coded = words.dictionary_encode()
            ids = coded.indices.to_numpy().astype(np.uint32)
            yield lang, coded.dictionary, ids, follows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            for lang, words, ids, follows in blocks(*(c.chunk(0) for c in table.columns)):
                columns = [pa.array([block]), pa.array([lang]), pa.array([words.to_pylist()], pa.list_(pa.string())), pa.array([np.bincount(ids, minlength=len(words)).tolist()], pa.list_(pa.int64())), pa.array([ids.tobytes()]), pa.array([np.packbits(follows).tobytes()])]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "lang", "words", "counts", "ids", "follows"])
                block += 1

        size = 0
        for batch in batches:
            wide = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
            at = 0
            while at < batch.num_rows:
                before = wide[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(wide, before + max(0, BLOCK - size), side="right")))
                held.append(batch.slice(at, to - at))
                size += int(wide[to - 1] - before)
                if size >= BLOCK or to < batch.num_rows:
                    yield from flush()
                    size = 0
                at = to
        if held:
            yield from flush()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), as_text(F.col("text")).alias("text"))
    return rows.mapInArrow(run, "block long, lang string, words array<string>, counts array<long>, ids binary, follows binary")


def _hashes(words: list[str], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w.encode(), seed) for w in words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each `size` consecutive words, wherever they stand."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def inside(follows: np.ndarray, size: int) -> np.ndarray:
    """Whether each `size` consecutive words are of one piece, by their first word."""
    n = max(0, len(follows) - size + 1)
    out = np.ones(n, np.bool_)
    for k in range(1, size):
        out &= follows[k : k + n]
    return out


def _cell_rows(keys: np.ndarray, least: int, bits: int) -> list[dict]:
    """The sketch of a block: its cells by segment, and how often each is hit, up to `least`."""
    if not len(keys):
        return []
    cells, counts = np.unique(keys, return_counts=True)
    counts = np.minimum(counts, least).astype("<u4" if least > 255 else "u1")
    segments = (cells >> np.uint64(bits)).astype(np.int64)
    low = (cells & np.uint64((1 << bits) - 1)).astype("<u4")
    edges = np.flatnonzero(np.diff(segments, prepend=-1))
    return [{"segment": int(segments[a]), "cells": low[a:b].tobytes(), "counts": counts[a:b].tobytes()} for a, b in zip(edges, [*edges[1:], len(cells)], strict=True)]


def _heavy(least: int, bits: int):
    """Adds up a segment of the sketch and tells each block which of its cells are hit at least `least` times.

    Counts that stop at `least` are enough: if one block reaches it, so does the sum.
    """

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << bits, np.uint32)
        kind = "<u4" if least > 255 else "u1"
        cells = [np.frombuffer(x.as_py(), "<u4") for x in table["cells"]]
        for mine, counts in zip(cells, table["counts"], strict=True):
            total[mine] = np.minimum(total[mine] + np.frombuffer(counts.as_py(), kind), least)
        heavy = [mine[total[mine] >= least] for mine in cells]
        some = [k for k, x in enumerate(heavy) if len(x)]
        return pa.table({
            "block": table["block"].take(pa.array(some, pa.int64())).combine_chunks().cast(pa.int64()),
            "segment": table["segment"].take(pa.array(some, pa.int64())).combine_chunks().cast(pa.int32()),
            "heavy": pa.array([heavy[k].tobytes() for k in some], pa.binary()),
        })

    return run


def _exchanged(cells: DataFrame, least: int, bits: int, name: str) -> DataFrame:
    """(block, heavy): for each block its cells that are hit often enough in all blocks together."""
    rows = cells.select("block", F.inline("sketch"))
    heavy = stored(rows.groupBy("segment").applyInArrow(_heavy(least, bits), "block long, segment int, heavy binary"), name)
    return heavy.groupBy("block").agg(F.collect_list(F.struct("segment", "heavy")).alias("heavy"))


def _heavy_keys(rows: list[dict] | None, bits: int) -> np.ndarray:
    parts = [np.frombuffer(r["heavy"], "<u4").astype(np.uint64) | np.uint64(r["segment"] << bits) for r in rows or []]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _found(keys: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    if not len(heavy):
        return np.zeros(len(keys), np.bool_)
    return heavy[np.minimum(np.searchsorted(heavy, keys), len(heavy) - 1)] == keys


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        row = {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)}
        row["ids"] = np.frombuffer(row["ids"], np.uint32)
        row["follows"] = np.unpackbits(np.frombuffer(row["follows"], np.uint8), count=len(row["ids"])).astype(np.bool_)
        yield row


def _pair_cells(shift: int, least: int, bits: int):
    """The sketch of pairs of words, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                keys = gram_hashes(_hashes(row["words"], row["lang"])[row["ids"]], 2)[inside(row["follows"], 2)] >> np.uint64(shift)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([_cell_rows(keys, least, bits)], _ARROW_CELLS)], names=["block", "sketch"])

    return run


def _long_keys(hashes: np.ndarray, follows: np.ndarray, shift: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Cells of phrases of three words and more, and where each of those begins, by size."""
    places = [np.flatnonzero(inside(follows, size)) for size in range(3, LONGEST + 1)]
    keys = [gram_hashes(hashes, size)[at] >> np.uint64(shift) for size, at in zip(range(3, LONGEST + 1), places, strict=True)]
    return np.concatenate(keys), places


def _runs(shift: int, least: int, bits: int):
    """Of each block the runs of words in which every pair is heavy, and the sketch of their longer phrases. Nothing else can be part of a
    phrase that is frequent enough, as a phrase is no more frequent than its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                hashes = _hashes(row["words"], row["lang"])[row["ids"]]
                pairs = inside(row["follows"], 2)
                pairs &= _found(gram_hashes(hashes, 2) >> np.uint64(shift), _heavy_keys(row["heavy"], bits))
                follows = np.zeros(len(hashes), np.bool_)
                follows[1:] = pairs
                used = follows.copy()
                used[:-1] |= pairs
                follows, hashes = follows[used], hashes[used]
                old, ids = np.unique(row["ids"][used], return_inverse=True)
                keys, _ = _long_keys(hashes, follows, shift)
                columns = [pa.array([row["block"]]), pa.array([row["lang"]]), pa.array([[row["words"][k] for k in old.tolist()]], pa.list_(pa.string())), pa.array([ids.astype(np.uint32).tobytes()]), pa.array([np.packbits(follows).tobytes()]), pa.array([_cell_rows(keys, least, bits)], _ARROW_CELLS)]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "lang", "words", "ids", "follows", "sketch"])

    return run


def _candidates(row: dict, shift: int, bits: int) -> tuple[list[str], np.ndarray]:
    """The different phrases of a block whose upper bound is high enough, and their hashes. Phrases are told apart by their words."""
    words, ids, follows = row["words"], row["ids"].astype(np.uint64), row["follows"]
    hashes = _hashes(words, row["lang"])[row["ids"]]
    keys, places = _long_keys(hashes, follows, shift)
    good = np.split(_found(keys, _heavy_keys(row["heavy"], bits)), [len(places[0])])
    out, marks, code = [], [], ids
    for size in range(2, LONGEST + 1):
        n = max(0, len(ids) - size + 1)
        _, first, code = np.unique(code[:n] << np.uint64(32) | ids[size - 1 :], return_index=True, return_inverse=True)
        code = code.astype(np.uint64)
        chosen = np.zeros(n, np.bool_)
        if size == 2:
            chosen[inside(follows, 2)] = True
        else:
            chosen[places[size - 3][good[size - 3]]] = True
        kinds = np.unique(code[chosen])
        # The first place of a kind may cross a border of pieces; its words are the same.
        begin = first[kinds.astype(np.int64)]
        marks.append(gram_hashes(hashes, size)[begin])
        out += [" ".join([words[k] for k in phrase]) for phrase in row["ids"][begin[:, None] + np.arange(size)].tolist()]
    return out, np.concatenate(marks)


def count_phrases(phrases: list[str], text: str) -> np.ndarray:
    """How often each of different phrases stands in a text whose words have a blank on either side, overlapping ones included."""
    automaton = ahocorasick.Automaton()
    for k, phrase in enumerate(phrases):
        automaton.add_word(f" {phrase} ", k)
    if not phrases:
        return np.zeros(0, np.int64)
    automaton.make_automaton()
    return np.bincount(np.fromiter((k for _, k in automaton.iter(text)), np.int64), minlength=len(phrases))


def _summed(parts: list[pa.Table]) -> pa.Table:
    """Counts of equal phrases of a language added up."""
    total = pa.concat_tables(parts).group_by(["lang", "phrase", "mark"]).aggregate([("a", "sum")])
    return total.rename_columns(["lang", "phrase", "mark", "a"])


def _scan(shift: int, bits: int):
    """Counts each block's candidates in its runs by one automaton, and adds up the counts of the blocks of a task.

    A row has the phrases of a language in one segment: sums travel as lists.
    """
    segments = 64 - shift - bits

    def emitted(total: pa.Table) -> Iterator[pa.RecordBatch]:
        langs = total["lang"].combine_chunks().dictionary_encode()
        segment = (total["mark"].to_numpy() >> np.uint64(64 - segments)).astype(np.int64) if segments else np.zeros(len(total), np.int64)
        lang = langs.indices.to_numpy().astype(np.int64)
        order = np.lexsort((lang, segment))
        phrases, counts = total["phrase"].combine_chunks().take(pa.array(order)), total["a"].combine_chunks().take(pa.array(order))
        edges = np.flatnonzero(np.diff(segment[order], prepend=-1) | np.diff(lang[order], prepend=-1))
        offsets = pa.array(np.append(edges, len(order)).astype(np.int32))
        first = order[edges]
        yield pa.RecordBatch.from_arrays(
            [pa.array(segment[first]), langs.dictionary.take(pa.array(lang[first])), pa.ListArray.from_arrays(offsets, phrases), pa.ListArray.from_arrays(offsets, counts)],
            names=["segment", "lang", "phrases", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for row in _rows(batch):
                phrases, marks = _candidates(row, shift, bits)
                spaced = np.array([f"{w} " for w in row["words"]] + [f"\n {w} " for w in row["words"]], object)
                text = "".join(spaced[row["ids"] + np.where(row["follows"], 0, len(row["words"])).astype(np.uint32)])
                counts = count_phrases(phrases, text)
                held.append(pa.table({"lang": pa.array([row["lang"]] * len(phrases), pa.string()), "phrase": pa.array(phrases, pa.string()), "mark": pa.array(marks, pa.uint64()), "a": pa.array(counts, pa.int64())}))
                if sum(map(len, held)) > HELD:
                    held = [_summed(held)]
                    if len(held[0]) > HELD // 2:
                        yield from emitted(held.pop())
        if sum(map(len, held)):
            yield from emitted(_summed(held))

    return run


def _frequent(least: int):
    """Adds up the counts of a segment; phrases with at least `least` are left."""

    def run(table: pa.Table) -> pa.Table:
        sizes = pc.list_value_length(table["phrases"]).to_numpy()
        langs = table["lang"].combine_chunks().take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        flat = pa.table({"lang": langs, "phrase": table["phrases"].combine_chunks().flatten(), "a": table["counts"].combine_chunks().flatten()})
        total = flat.group_by(["lang", "phrase"]).aggregate([("a", "sum")]).rename_columns(["lang", "phrase", "a"])
        return total.filter(pc.greater_equal(total["a"], least))

    return run


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def phrase_counts(blocks: DataFrame, least: int = 30, bits: int = SEGMENT_BITS) -> DataFrame:
    """(lang, phrase, a): all phrases of 2 to 4 words that occur at least `least` times, with exact counts.

    A counting sketch of all pairs bounds their counts from above; what it leaves is cut to runs of possible pairs, whose longer phrases
    go through a second sketch. Each block compiles the phrases that are left into an automaton, a blank on either side of every word, and
    counts overlapping matches in its own runs; the sums over blocks, made in the task and then by segments of hashes, are exact. The sketch has about a cell a word, in segments: blocks
    send each segment the cells they hit and get back those that are hit often enough, so that no task holds the sketch as a whole.
    """
    tokens = blocks.select(F.sum(F.octet_length("ids") / 4)).first()[0] or 0
    segments = max(0, int(np.ceil(np.log2(max(1, tokens)))) - bits)
    shift = 64 - bits - segments
    base = blocks.select("block", "lang", "words", "ids", "follows")
    pairs = stored(base.mapInArrow(_pair_cells(shift, least, bits), f"block long, sketch {_CELLS}"), "phrase-pairs")
    joined = base.join(_exchanged(pairs, least, bits, "phrase-heavy"), "block")
    runs = stored(joined.mapInArrow(_runs(shift, least, bits), f"block long, lang string, words array<string>, ids binary, follows binary, sketch {_CELLS}"), "phrase-runs")
    long = _exchanged(runs.select("block", "sketch"), least, bits, "phrase-long")
    counted = runs.drop("sketch").join(long, "block", "left").mapInArrow(_scan(shift, bits), "segment long, lang string, phrases array<string>, counts array<long>")
    return counted.groupBy("segment").applyInArrow(_frequent(least), "lang string, phrase string, a long")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, within: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases.

    Texts are lower-cased in A-Z, cut into pieces at .,;:!? and line ends, and these into words at blanks and tabs. A phrase is 2 to 4 words
    of one piece; a counts it, n all words of the language. Of its cuts into two parts with counts l and r, the one with the lowest
    floor(2000000 a / (l + r)) counts, ties to the shorter first part. Phrases inside a longer one that has at least `within` percent of
    their occurrences go. Order: score and a descending, phrase ascending by UTF-8 bytes.

    A null lang is "und", a null text is empty; texts without words, and empty tables, give no rows. Repeated rows count each. Columns of
    other names are not read. A language that holds most rows is many blocks; its phrases meet as sums, and its top is found from the
    tops of partitions.
    """
    blocks = stored(word_blocks(docs), "phrase-blocks", TEXTS)
    # For every language's n and all single words: sums of the blocks' own counts.
    sizes = blocks.groupBy("lang").agg(F.sum(F.octet_length("ids") / 4).cast("long").alias("n"))
    singles = blocks.select("lang", F.inline(F.arrays_zip("words", "counts"))).groupBy("lang", F.col("words").alias("phrase")).agg(F.sum("counts").alias("a"))
    phrases = stored(phrase_counts(blocks, least), "phrases")
    known = stored(phrases.unionByName(singles.filter(F.col("a") >= least)), "phrase-counts")
    words = F.split("phrase", " ", -1)
    part = lambda a, b: F.array_join(F.slice(words, a, b), " ")
    size = F.size(words)
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, size - F.col("k"))})
    count_of = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cuts = cuts.join(count_of("left", "l"), ["lang", "left"]).join(count_of("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr("cast(a as decimal(38,0)) * 2000000bd div (cast(l as decimal(38,0)) + cast(r as decimal(38,0)))"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda w: F.transform(F.sequence(F.lit(1), size - w + 1), lambda s: F.array_join(F.slice(words, s, w), " "))))
    longer = phrases.filter(size > 2).select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (_whole(F.col("longer")) * 100 < _whole(F.col("a")) * within))
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").join(sizes, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
