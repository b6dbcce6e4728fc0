import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm.arrow_files import ListReader, read_arrow, write_arrow
from lectern.llm.packing import best_fit_packing, best_fit_plan, pack
from lectern.llm.tokens import Encoder
from lectern.llm.work import fresh_path
from tests.llm.helpers import frame, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
OURS = Encoder(PATH)


def ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t  \u0085　\x1caB.é'ßs1²日“-,<|>endoftx", max_size=16), max_size=6))
def test_encoder(some):
    got = []
    for flat, counts in OURS.encode(pa.array(some, pa.string())):
        ends = np.cumsum(counts)
        got += [flat[b - n : b].tolist() for n, b in zip(counts, ends, strict=True)]
    assert got == [ids(t) for t in some]


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  <|endoftext|>\n<|endoftext|> z", "a. <|endoftext|>!", "<|endoftext", "\n<|endoftext|>\n"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "a", "word", "é", ".", "<|", "'s", "\u3000"]), max_size=9).map("".join), max_size=5))
def test_special_strings(some):
    """The strings of special tokens are these tokens, as in the library."""
    for texts_ in (some, SPECIAL):
        got = []
        for flat, counts in OURS.encode(pa.array(texts_, pa.string())):
            ends = np.cumsum(counts)
            got += [flat[b - n : b].tolist() for n, b in zip(counts, ends, strict=True)]
        assert got == [ids(t) for t in texts_]


def test_other_files():
    """Files of another kind are known as such, and encoded whole."""
    from lectern.llm.tokens import in_units

    said = json.load(open(PATH, encoding="utf-8"))
    assert in_units(said)
    assert not in_units(said | {"normalizer": {"type": "Lowercase"}})
    assert not in_units(said | {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}})
    assert not in_units(said | {"added_tokens": [{"id": 1, "content": "MASK", "single_word": False, "lstrip": False, "rstrip": False}]})
    other = public_tokenizers.path("word_bpe_49k.json")
    ours, library = Encoder(other), Tokenizer.from_file(other)
    assert not ours.in_units
    some = ["Some  words, here", "", "été <|endoftext|> x"]
    (flat, counts), = ours.encode(pa.array(some))
    assert flat.tolist() == [x for t in some for x in library.encode(t, add_special_tokens=False).ids] and len(counts) == 3


def test_wide_ids():
    from lectern.llm.arrow_files import id_kind

    assert id_kind(65_535).itemsize == 2 and id_kind(65_536).itemsize == 4


def test_plan():
    r = random.Random(2)
    for _ in range(30):
        counts = {r.randint(1, 64): r.randint(1, 200) for _ in range(r.randint(1, 40))}
        plan = best_fit_plan(counts, 64)
        used, ranks = defaultdict(list), defaultdict(int)
        for length, lo, hi, seq, each, off in plan.tolist():
            assert ranks[length] == lo
            ranks[length] = hi
            for k in range(hi - lo):
                used[seq + k // each].append((off + k % each * length, length))
        assert dict(ranks) == counts
        for places in used.values():
            at = 0
            for off, length in sorted(places):
                assert off == at
                at += length
            assert at <= 64
        free = []  # best-fit decreasing, one item at a time
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fits = [x for x in free if x >= length]
                if fits:
                    free.remove(min(fits))
                    free.append(min(fits) - length)
                else:
                    free.append(64 - length)
        assert len(used) == len(free)


def test_packing(spark):
    rows = texts()
    got = best_fit_packing(frame(spark, rows), PATH, capacity=64).collect()
    want = []
    for doc, text, *_ in rows:
        tokens = ids(text) + [2]
        parts = -(-len(tokens) // 64)
        at = 0
        for piece in range(parts):
            to = len(tokens) - 64 * (parts - 1 - piece)
            want.append((doc, piece, at, to - at, zlib.crc32(np.array(tokens[at:to], "<u4").tobytes())))
            at = to
    key = lambda r: (r[0] is None, r)
    assert sorted([tuple(x)[:5] for x in got if x[0] is not None]) == sorted(x for x in want if x[0] is not None)
    assert len(got) == len(want)
    used = defaultdict(list)
    for x in got:
        used[x.sequence_id].append((x.offset, x.length))
    for places in used.values():
        at = 0
        for off, length in sorted(places):
            assert off == at
            at += length
        assert at <= 64
    assert len(used) <= 1.02 * sum(x[3] for x in want) / 64 + 2
    assert best_fit_packing(frame(spark, []), PATH).count() == 0
    again = {tuple(x) for x in pack(spark.createDataFrame([(7, 0, 0, 3), (7, 0, 0, 3)], "doc_id long, piece int, start long, length long"), ("doc_id", "piece", "start"), capacity=8).collect()}
    assert {x[5] for x in again} == {0, 3}


def test_arrow_files(spark):
    rows = texts()
    manifest = write_arrow(frame(spark, rows), fresh_path(spark, "t"), PATH, sequence=16)
    got = [tuple(x) for x in read_arrow(manifest).orderBy("start").collect()]
    rows += [(5, "one id, another text", "en", "a"), (None, "and no id", "en", "a")]
    manifest = write_arrow(frame(spark, rows).repartition(3), fresh_path(spark, "t"), PATH, sequence=16)
    got = [tuple(x) for x in read_arrow(manifest).orderBy("start").collect()]
    again = write_arrow(frame(spark, rows[::-1]).repartition(2), fresh_path(spark, "t"), PATH, sequence=16)
    assert got == [tuple(x) for x in read_arrow(again).orderBy("start").collect()]
    ties = {(x.doc_id, x.text): x.h for x in frame(spark, rows).selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[0], r[1]]))
    start, want = 0, []
    for doc, text, *_ in order:
        t = ids(text) + [0]
        want.append((doc, start, len(t), zlib.crc32(np.array(t, "<u4").tobytes())))
        start += len(t)
    assert got == want
    one = manifest.orderBy("shard").first()
    reader = ListReader(one.path)
    batch = reader.file.get_batch(0)
    assert batch.schema.field("input_ids").type.list_size == 16 and batch.schema.field("mask").type.list_size == 16
    filled = sum(sum(v.as_py()) for k in range(reader.file.num_record_batches) for v in reader.file.get_batch(k)["mask"])
    assert filled == one.n_tokens
    assert read_arrow(write_arrow(frame(spark, []), fresh_path(spark, "t"), PATH)).count() == 0
