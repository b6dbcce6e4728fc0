"""Whole texts to token ids with the tokenizers library, each distinct word once per worker."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bytes of text that are encoded at a time; a longer text is a step of its own.
_STEP = 4_000_000
#: Distinct units that a worker remembers; when there are more it starts anew.
_ROOM = 300_000
#: Marks that often end a word; with the letters before them they are two pre-tokens. No apostrophe, which may start a contraction.
_MARKS = ".,!?;:%*#$&|()[]-\"/@"
_ENCODERS: dict = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file of a byte-level tokenizer."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _byte_letters() -> dict[int, str]:
    """Byte-level tokenizers write each byte as a visible letter: itself where it is visible in Latin-1, else the next from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(other)}


def unit_starts(data: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where units start: each text's start, and each space or line feed between two visible characters.

    The byte-level pattern always starts a pre-token at such a place, whatever stands around it, so units can be encoded apart.
    In doubt (near bytes that may belong to Unicode white space) no unit starts, which is right as well. docs: starts and the end.
    """
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at > 2) & (at < len(data) - 2)]
    p1, n1 = data[at - 1], data[at + 1]
    odd = (p1 <= 32) | (n1 <= 32) | (p1 == 127) | (n1 == 127)
    wide = np.flatnonzero((p1 | n1) >= 0x80)
    p1, n1, p2, p3, n2 = p1[wide], n1[wide], data[at[wide] - 2], data[at[wide] - 3], data[at[wide] + 2]
    blank = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0)) | (n1 == 0xC2) & ((n2 == 0x85) | (n2 == 0xA0))
    blank |= (p3 - np.uint8(0xE1) <= 2) & ((p2 == 0x80) | (p2 == 0x81) | (p2 == 0x9A)) | (n1 - np.uint8(0xE1) <= 2) & ((n2 == 0x80) | (n2 == 0x81) | (n2 == 0x9A))
    odd[wide] |= blank
    begins = np.zeros(len(data) + 1, np.bool_)
    begins[at[~odd]] = True
    begins[docs[1:] - 1] = False  # a text's last byte
    begins[docs[:-1]] = True
    return np.flatnonzero(begins[:-1])


def in_units(said: dict) -> bool:
    """Whether a tokenizer file is one whose texts may be encoded unit by unit: the plain byte-level pattern, and no added token that a
    word could hold or that takes in blanks."""
    split = said.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    model = said.get("model") or {}
    rest = said.get("normalizer") or said.get("truncation") or said.get("padding") or model.get("dropout")
    added = said.get("added_tokens") or []
    whole = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip")) and not any(c.isspace() for c in t["content"]) and not t["content"].rstrip(_MARKS).isalpha() for t in added)
    return bool(plain and model.get("type") == "BPE" and not rest and whole)


class Encoder:
    """encode() gives the ids that the library gives for each whole text with add_special_tokens=False; the strings of special tokens
    become these tokens, as they do there. Files of another kind than in_units() knows are encoded text by text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.in_units = in_units(json.load(file))
        self.highest = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> list[int]:
        """The ids of one pre-token."""
        letters = piece.encode().decode("latin-1").translate(self.letters)
        return [x.id for x in self.tokenizer.model.tokenize(letters)]

    def _unit(self, unit: str) -> bytes:
        lead, body = (unit[0], unit[1:]) if unit[:1] in (" ", "\n") else ("", unit)
        stem = body.rstrip(_MARKS)
        if stem.isalpha():
            ids = self._piece(" " + stem) if lead == " " else (self._piece("\n") if lead else []) + self._piece(stem)
            if len(stem) < len(body):
                ids += self._piece(body[len(stem) :])
        else:
            ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.tokenizer.encode(t.as_py(), add_special_tokens=False).ids for t in texts]
        return np.fromiter((x for one in ids for x in one), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _step(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.in_units:
            return self._whole(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        docs = (offsets - offsets[0]).astype(np.int64)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        starts = unit_starts(data, docs)
        ends = np.append(starts, len(data)).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
        known = self.known
        if len(known) > _ROOM:
            known.clear()
        parts = []
        for unit in units.dictionary.to_numpy(zero_copy_only=False):
            ids = known.get(unit)
            if ids is None:
                ids = known[unit] = self._unit(unit)
            parts.append(ids)
        index = units.indices.to_numpy()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat = np.frombuffer(b"".join(parts), np.uint32)
        begin = (np.cumsum(sizes) - sizes)[index]
        sizes = sizes[index]
        upto = np.cumsum(sizes)
        tokens = flat[np.repeat(begin - (upto - sizes), sizes) + np.arange(upto[-1])]
        of_docs = np.concatenate([[0], upto])[np.searchsorted(starts, docs)]
        return tokens, np.diff(of_docs)

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields, for consecutive texts, their ids one after another (uint32) and each text's number of ids."""
        wide = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, at = np.cumsum(wide), 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] - wide[at] + _STEP, side="right")))
            yield self._step(texts.slice(at, to - at))
            at = to
