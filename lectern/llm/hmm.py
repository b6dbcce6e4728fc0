"""A hidden Markov language model over suffix classes, with smoothed word probabilities inside a class."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ascii_words, steps
from .work import as_text, stored

STATES, CLASSES = 6, 4096
#: Rounds of training at most; it ends sooner when a round gains less than so much log10-likelihood a token.
ROUNDS, GAIN = 5, 1e-4
#: Tokens of a piece, and tokens whose pieces are worked on at a time. Neither changes a result.
PIECE, WORK = 128, 400_000
#: Classes of the end of a text and of words that training has not seen, after those of words.
END, UNSEEN = CLASSES, CLASSES + 1
#: Weight of the corpus distribution in each state's emissions, in tokens.
PRIOR = 50.0
_BLOCK = "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, ids binary, words array<string>, trained array<long>, classes array<int>"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def word_class(word: str) -> int:
    """The class of a word by its last three characters; the empty word stands for the end of a text."""
    return zlib.crc32(word[-3:].encode()) % CLASSES if word else END


def _pack(ids: np.ndarray) -> bytes:
    """All low halves, then all high halves: frequent words have small numbers, so the second part is nearly all zero."""
    return ids.astype("<u4").view("<u2").reshape(-1, 2).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    low, high = np.frombuffer(data, "<u2").reshape(2, -1)
    return low | high.astype(np.uint32) << np.uint32(16)


def token_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of texts as numbers into the block's own list of words; `trained` counts a word in the block's training texts.

    A block holds about 8 MB of text (one longer text is a block of its own). Each text ends in the token "".
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, texts in steps(batch.column(1), 8_000_000):
                words, sizes = ascii_words(texts)
                coded = words.dictionary_encode()
                names = [*coded.dictionary.to_numpy(zero_copy_only=False), ""]
                ids = np.insert(coded.indices.to_numpy().astype(np.uint32), np.cumsum(sizes), len(names) - 1)
                doc_ids = batch.column(0).slice(at, len(texts)).to_pylist()
                held = np.array([held_out(d) for d in doc_ids])
                trained = np.bincount(ids[np.repeat(~held, sizes + 1)], minlength=len(names))
                row = {"block": [block], "doc_ids": [doc_ids], "held": [held.tolist()], "sizes": [(sizes + 1).tolist()], "ids": [_pack(ids)], "words": [names], "trained": [trained], "classes": [[word_class(w) for w in names]]}
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))
                block += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text(F.col("text")).alias("text")).mapInArrow(run, _BLOCK)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x classes
    fits: list[float] = field(default_factory=list)


def first_model(share: np.ndarray, states: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    emit = share * rng.gamma(2.0, 0.5, (states, len(share)))
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95)
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def _norm(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=1, keepdims=True)


@dataclass
class Pieces:
    """Texts as pieces of at most PIECE tokens, text after text: where each begins, how long it is and its place in its text."""

    begin: np.ndarray
    wide: np.ndarray
    nth: np.ndarray
    count: np.ndarray  # of each text
    first: np.ndarray  # each text's first piece


def pieces(sizes: np.ndarray, width: int) -> Pieces:
    count = -(-sizes // width)
    first = np.cumsum(count) - count
    of = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(of)) - first[of]
    return Pieces((np.cumsum(sizes) - sizes)[of] + nth * width, np.minimum(width, sizes[of] - nth * width), nth, count, first)


def _products(move: np.ndarray, emit: np.ndarray, sequences: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """For each full piece the product of its steps' matrices (a move, then an emission), up to a factor."""
    states = len(move)
    out = np.empty((len(begin), states, states), np.float32)
    for a in range(0, len(begin), WORK // width):
        at = begin[a : a + WORK // width]
        x = np.broadcast_to(np.eye(states, dtype=np.float32), (len(at), states, states))
        for t in range(width):
            x = (x.reshape(-1, states) @ move).reshape(len(at), states, states)
            x *= emit.take(sequences[at + t], axis=0)[:, None, :]
            if t % 4 == 3 or t == width - 1:
                x = x / x.sum(axis=(1, 2))[:, None, None]
        out[a : a + len(at)] = x
    return out


def borders(model: Model, move: np.ndarray, emit: np.ndarray, sequences: np.ndarray, sizes: np.ndarray, cut: Pieces, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What the whole text says at the edges of each piece: the scaled alpha at the last token before it (unused for first pieces), and the
    scaled beta at its own last token. Products of step matrices carry both from piece to piece, so nothing is cut off."""
    states, n = len(move), len(cut.wide)
    before, after = np.zeros((n, states), np.float32), np.ones((n, states), np.float32)
    many = np.flatnonzero(cut.count > 1)
    if not len(many):
        return before, after
    many = many[np.argsort(-cut.count[many], kind="stable")]
    first, count = cut.first[many], cut.count[many]
    begin = cut.begin[first]
    now = _norm(model.start.astype(np.float32) * emit[sequences[begin]])
    for t in range(1, width):
        now = _norm((now @ move) * emit[sequences[begin + t]])
    before[first + 1] = now
    last = first + count - 1
    order = np.argsort(-cut.wide[last], kind="stable")
    wide, begin = cut.wide[last][order], cut.begin[last][order]
    told = np.ones((len(many), states), np.float32)
    for t in range(int(wide[0]) - 1, -1, -1):
        k = np.searchsorted(-wide, -t, side="left")  # pieces that reach step t
        told[:k] = _norm((told[:k] * emit[sequences[begin[:k] + t]]) @ move.T)
    after[last[order] - 1] = told
    inner = np.flatnonzero((cut.nth > 0) & (np.append(cut.nth[1:], 0) > cut.nth))
    row = np.zeros(n, np.int64)
    row[inner] = np.arange(len(inner))
    steps_ = _products(move, emit, sequences, cut.begin[inner], width)
    for j in range(1, int(count[0]) - 1):
        k = np.searchsorted(-count, -(j + 1), side="left")  # texts in which piece j is not the last
        at = first[:k] + j
        before[at + 1] = _norm(np.einsum("ns,nsz->nz", before[at], steps_[row[at]]))
    for j in range(int(count[0]) - 2, 0, -1):
        k = np.searchsorted(-count, -(j + 1), side="left")
        at = first[:k] + j
        after[at - 1] = _norm(np.einsum("nsz,nz->ns", steps_[row[at]], after[at]))
    return before, after


def expected_counts(model: Model, sequences: np.ndarray, sizes: np.ndarray, width: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts over whole texts: starts, moves, emissions, and the log10-likelihood.

    sequences: classes, one text after another; sizes: their lengths. Memory is bounded by pieces: their edges are worked out first, then
    each piece is walked once forwards and backwards between them. A text of any length counts as one sequence.
    """
    top = model.emit.max(axis=0)
    top[top == 0] = 1
    emit, move = np.ascontiguousarray((model.emit / top).T.astype(np.float32)), model.move.astype(np.float32)
    cut = pieces(sizes, width)
    before, after = borders(model, move, emit, sequences, sizes, cut, width)
    states, kinds = len(move), model.emit.shape[1]
    starts, moves, emits, fit = np.zeros(states), np.zeros((states, states)), np.zeros((states, kinds)), 0.0
    order = np.argsort(-cut.wide, kind="stable")
    ends = np.searchsorted(np.cumsum(cut.wide[order]), np.arange(1, 2 + int(cut.wide.sum()) // WORK) * WORK, side="left") + 1
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        some = order[a:b]
        if not len(some):
            continue
        wide, begin, head = cut.wide[some], cut.begin[some], cut.nth[some] == 0
        live = np.searchsorted(-wide, -np.arange(1, int(wide[0]) + 1), side="right")  # pieces that reach each step
        into = before[some]
        now = np.where(head[:, None], model.start.astype(np.float32), into @ move)
        alphas, scales, seen, told = [], [], [], []
        ones = np.ones(states, np.float32)
        for t, k in enumerate(live):
            seen.append(sequences[begin[:k] + t])
            here = emit.take(seen[-1], axis=0)
            now = (now[:k] @ move if t else now) * here
            total = now @ ones
            now /= total[:, None]
            here /= total[:, None]
            alphas.append(now)
            scales.append(total)
            told.append(here)
        beta = after[some]
        for t in range(len(live) - 1, -1, -1):
            k, m = live[t], (live[t + 1] if t + 1 < len(live) else 0)
            if m:
                ahead = beta[:m] * told[t + 1]
                moves += alphas[t][:m].T @ ahead
                beta[:m] = ahead @ move.T
            if k > m:  # pieces that end here
                beta[m:k] /= ((alphas[t][m:] * beta[m:k]) @ ones)[:, None]
            if not t:
                ahead = (beta * told[0])[~head]
                moves += into[~head].T @ ahead
                starts += (alphas[0] * beta)[head].sum(axis=0)
            alphas[t] *= beta[:k]
        gamma, flat = np.concatenate(alphas), np.concatenate(seen)
        for z in range(states):
            emits[z] += np.bincount(flat, weights=gamma[:, z], minlength=kinds)
        fit += float(np.log10(np.concatenate(scales), dtype=np.float64).sum()) + float(np.log10(top)[flat].sum())
    return starts, moves * model.move, emits, fit


def forward(model: Model, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 of each whole text's probability as a sequence of classes, by the scaled forward recursion."""
    order = np.argsort(-sizes, kind="stable")
    begin, wide = (np.cumsum(sizes) - sizes)[order], sizes[order]
    live = np.searchsorted(-wide, -np.arange(1, int(wide[0]) + 1), side="right") if len(wide) else []
    out, emit = np.zeros(len(sizes)), np.ascontiguousarray(model.emit.T)
    now = np.broadcast_to(model.start, (len(sizes), len(model.start)))
    for t, k in enumerate(live):
        now = (now[:k] @ model.move if t else now) * emit[classes[begin[:k] + t]]
        total = now.sum(axis=1)
        out[:k] += np.log10(total)
        now = now / total[:, None]
    back = np.empty_like(out)
    back[order] = out
    return back


def _columns(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    for k in range(batch.num_rows):
        yield {name: batch.column(c)[k] for c, name in enumerate(names)}


def train(blocks: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = ROUNDS, seed: int = 5) -> Model:
    """Baum-Welch over all training texts. Each task sums its expected counts; sums meet by state in two steps; the driver gets
    states x classes numbers, whatever the size of the corpus. share: the corpus distribution of classes. model.fits has the
    log10-likelihood of the training classes before each round; training ends when a round has gained less than GAIN a token."""
    unseen = share[UNSEEN]
    seen = share.copy()
    seen[UNSEEN] = 0
    seen /= max(seen.sum(), 1e-300)
    model = first_model(seen, states, seed)
    model.emit = np.hstack([model.emit[:, :UNSEEN] * (1 - unseen), np.full((states, 1), unseen)])
    used = blocks.select("held", "sizes", "ids", "classes")
    fits: list[float] = []
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for row in _columns(batch):
                    sizes = row["sizes"].values.to_numpy().astype(np.int64)
                    use = ~row["held"].values.to_numpy(zero_copy_only=False)
                    classes = row["classes"].values.to_numpy()[_unpack(row["ids"].as_py())]
                    classes, sizes = classes[np.repeat(use, sizes)], sizes[use]
                    if not len(sizes):
                        continue
                    got = expected_counts(model, classes, sizes)
                    total = got if total is None else tuple(x + y for x, y in zip(total, got, strict=True))
            if total is not None:
                rows = [total[0], *total[1], *total[2], np.array([total[3]])]
                part = TaskContext.get().partitionId() % 64
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([x.tobytes() for x in rows], pa.binary())], names=["row", "part", "sums"])

        def merge(group: pa.Table) -> pa.Table:
            sums = np.sum([np.frombuffer(x.as_py(), np.float64) for x in group["sums"]], axis=0)
            return pa.table({"row": pa.array([group["row"][0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

        kind = "row int, part int, sums binary"
        merged = used.mapInArrow(count, kind).groupBy("row", "part").applyInArrow(merge, kind).groupBy("row").applyInArrow(merge, kind)
        rows = {r["row"]: np.frombuffer(r["sums"], np.float64) for r in merged.collect()}
        if not rows:
            break
        fits.append(float(rows[1 + 2 * states][0]))
        if len(fits) > 1 and fits[-1] - fits[-2] < GAIN * rows_total(rows, states):
            break
        starts = rows[0] + 1
        moves = np.array([rows[1 + z] for z in range(states)]) + 1
        emits = np.array([rows[1 + states + z] for z in range(states)]) + PRIOR * seen
        emits[:, UNSEEN] = 0
        emits *= (1 - unseen) / emits.sum(axis=1, keepdims=True)
        emits[:, UNSEEN] = unseen
        model = Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emits)
    model.fits = fits
    return model


def rows_total(rows: dict[int, np.ndarray], states: int) -> float:
    """Tokens that the emission rows of a round stand for."""
    return float(sum(rows[1 + states + z].sum() for z in range(states)))


def score_documents(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, seed: int = 5) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    Training texts are those whose crc32(doc_id as text) mod 7 is not 2 (a null id counts as an empty text). base_score is the add-one
    unigram score. score is log10 of the text's probability under the model: a hidden Markov chain emits a word class at each
    step (classes by suffix, a class for the end, one for unseen words with the mass of words seen once), and the word is drawn
    within its class by add-one counts; an unseen word is one of as many as the counts of words seen once and twice let expect (Chao's
    estimate). Training and scoring take each text as one sequence, however long. Null and empty texts consist of their end alone.
    Repeated rows are scored each. If no row is for training, all tokens are unseen and score is base_score. Columns of other names
    are not read. An empty table gives an empty result.
    """
    blocks = stored(token_blocks(docs), "blocks")
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "trained")).alias("at", "w")).select("block", "at", "w.words", "w.trained")
    own_class = F.when(F.col("words") == "", END).otherwise(F.pmod(F.crc32(F.encode(F.right("words", F.lit(3)), "UTF-8")), F.lit(CLASSES)))  # as word_class
    counts = stored(words.groupBy("words").agg(F.sum("trained").alias("c")).withColumn("class", own_class.cast("int")), "counts")
    seen = counts.filter("c > 0")
    by_class = seen.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).collect()
    tokens, types, once, twice = (sum(r[k] for r in by_class) for k in ("n", "v", "once", "twice"))
    missing = max(1.0, once * (once - 1) / (2 * (twice + 1)))
    weight = np.zeros(CLASSES + 2)
    for r in by_class:
        weight[r["class"]] = r["n"] + r["v"]
    total = tokens + types + 1
    share = weight / max(1, tokens + types)
    share[UNSEEN] = max(once / max(1, tokens), 1 / total)
    model = train(blocks, share, states, rounds, seed) if tokens else None
    # Two lists in one order: a block has as many entries as it has words.
    back = words.join(counts.select("words", "c"), "words").groupBy("block").agg(F.collect_list("at").alias("places"), F.collect_list("c").alias("found"))
    coded = blocks.select("block", "doc_ids", "held", "sizes", "ids", "classes").join(back, "block")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _columns(batch):
                sizes, ids = row["sizes"].values.to_numpy().astype(np.int64), _unpack(row["ids"].as_py())
                classes = row["classes"].values.to_numpy()
                c = np.empty(len(classes), np.int64)
                c[row["places"].values.to_numpy()] = row["found"].values.to_numpy()
                begin = np.cumsum(sizes) - sizes
                base = np.add.reduceat(np.log10((c + 1) / total)[ids], begin)
                known = np.add.reduceat((c > 0)[ids].astype(np.int64), begin)
                full = base
                if model is not None:
                    classes = np.where(c > 0, classes, UNSEEN)
                    inside = np.where(c > 0, np.log10((c + 1) / np.maximum(1, weight[classes])), -np.log10(missing))
                    full = forward(model, classes[ids], sizes) + np.add.reduceat(inside[ids], begin)
                columns = [row["doc_ids"].values, row["held"].values, pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), tokens)), pa.array(base), pa.array(full)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
