"""Near duplicates by the Jaccard similarity of word shingles, all of them.

SimHash fingerprints and the Gray-order index find the closest pairs first; whole sets confirm them, and what they join needs no further
comparison. Fingerprints alone would miss most pairs of a similarity of 0.8 (they differ in ten bits of 64 on average, where random pairs
differ in 32 and an index can prune for two or three), so shared prefixes then find all pairs that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .gray_index import near_links
from .simhash import bit_counts, majority
from .words import ascii_words, steps
from .work import TEXTS, as_text, stored

WORDS = 5
#: The least similarity, as a fraction: integers decide without rounding.
OVER, UNDER = 4, 5
#: Texts that tell which shingles are common: so many at least, and this share of a larger table.
COMMON_ROWS, COMMON_SHARE = 10_000, 1 / 64
#: Shingles known as common at most. They only order prefixes: a longer list saves work and changes no result.
COMMON_MOST = 500_000
#: Texts with one prefix shingle up to which all their pairs are listed; larger groups are narrowed by parities and compared where their sets meet.
LISTED = 32
#: Differing bits up to which the index of fingerprints looks for pairs.
RADIUS = 2


#: Odd numbers by which the words of a shingle are told apart, and by which sums are mixed.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * _MIX
    return x ^ x >> np.uint64(29)


def batch_shingles(texts: pa.Array) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes; a text of fewer words is one shingle, one without words has none.

    Words are runs of anything but the six ASCII blanks, A-Z lower-cased. Each distinct word of the batch is hashed once (XXH64); a shingle
    is the mixed sum of its words' hashes, each times the number of its place.
    """
    words, sizes = ascii_words(texts)
    coded = words.dictionary_encode()
    each = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    own = each[coded.indices.to_numpy()]
    sums = np.zeros(len(own), np.uint64)
    for k in range(min(WORDS, len(own))):
        sums[: len(own) - k] += own[k:] * _PLACES[k]
    sums = _mixed(sums)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= WORDS:
            found = np.unique(sums[at : at + n - WORDS + 1])
        elif n:
            found = _mixed((own[at : at + n] * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + np.array([n], np.uint64) * _MIX)
        else:
            found = np.empty(0, np.uint64)
        out.append(np.sort(found.view(np.int64)))
        at += n
    return out


def shingles(text: str) -> np.ndarray:
    return batch_shingles(pa.array([text], pa.large_string()))[0]


def prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles, rare ones first, of which two similar sets share at least one, whatever the order of all shingles is."""
    n, weight = len(own), np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        weight = np.where(common[at] == own, rank[at], 0)
    return own[np.lexsort((own, weight))[: n - -(-OVER * n // UNDER) + 1]]


def parity(own: np.ndarray) -> bytes:
    """Whether the number of shingles in each class is odd, in at least two classes a shingle; larger ones fold to smaller ones."""
    bits = max(64, 1 << (2 * len(own) - 1).bit_length()) if len(own) else 64
    return np.packbits((np.bincount(own & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def surely_apart(x: bytes, y: bytes, n: int, m: int) -> bool:
    """Two sets differ in at least as many shingles as their parities do in classes."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (a, b))
    return int(np.bitwise_count(a ^ b).sum()) * (UNDER + OVER) > (n + m) * (UNDER - OVER)


def similar(shared: int, n: int, m: int) -> bool:
    return UNDER * shared >= OVER * (n + m - shared)


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of three or more of the sampled texts, sorted, and in how many each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in steps(batch.column(0)):
                for own in batch_shingles(texts):
                    yield pa.RecordBatch.from_arrays([pa.array(own)], names=["token"])

    share = max(COMMON_SHARE, COMMON_ROWS / max(1, docs.count()))
    some = docs if share >= 1 else docs.filter(F.xxhash64("text") <= int(share * 2**64) - 2**63)
    counts = some.select("text").mapInArrow(run, "token long").groupBy("token").count().filter("count > 2")
    found = counts.orderBy(F.desc("count"), "token").limit(COMMON_MOST).toArrow().sort_by("token")
    return found.column(0).to_numpy(), found.column(1).to_numpy()


def _profiles(common: np.ndarray, rank: np.ndarray):
    """Texts to what stands for their sets: a digest, the size, the parities and the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [own for _, texts in steps(batch.column(1)) for own in batch_shingles(texts)]
            digests = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            starts = pa.array([prefix(s, common, rank) if len(s) else s for s in sets], pa.list_(pa.int64()))
            prints = np.array([majority(bit_counts(s.view(np.uint64)), len(s)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests), pa.array([len(s) for s in sets], pa.int32()), pa.array([parity(s) for s in sets], pa.binary()), starts, pa.array(prints)], names=["doc_id", "fp", "n", "bits", "start", "print"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (token, fp, n and pos, joined): pairs (a, b) of small groups of one token; (a, null, token) for each member of a large one.

    A pair is left out where both are joined already, or where its sizes, or what comes after the token on both sides, leave too little
    to share: at the first token that a similar pair shares neither is so. Groups that are all joined already need nothing.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64())])
    held = np.empty((4, 0), np.int64)

    def found(rows: np.ndarray) -> pa.RecordBatch:
        pairs, large = [np.empty((2, 0), np.int64)], [np.empty((2, 0), np.int64)]
        cuts = np.flatnonzero(np.diff(rows[0])) + 1
        begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [rows.shape[1]]])
        two = begin[end - begin == 2]  # most groups are pairs
        x, y = rows[:, two], rows[:, two + 1]
        n, m = x[2] >> 32, y[2] >> 32
        rest = np.minimum(n - (x[2] & 0xFFFFFFFF), m - (y[2] & 0xFFFFFFFF))
        fits = (x[1] != y[1]) & (x[3] != y[3]) & ((UNDER + OVER) * rest >= OVER * (n + m))
        pairs.append(np.stack([np.minimum(x[1], y[1]), np.maximum(x[1], y[1])])[:, fits])
        for k in np.flatnonzero(end - begin > 2):
            token, fp, both, joined = rows[:, begin[k] : end[k]]
            if (joined == joined[0]).all():
                continue
            fp, first = np.unique(fp, return_index=True)
            n, joined = (both >> 32)[first], joined[first]
            rest = n - (both & 0xFFFFFFFF)[first]
            if len(fp) > LISTED:
                large.append(np.stack([fp, token[: len(fp)]]))
                continue
            i, j = np.triu_indices(len(fp), 1)
            fits = ((UNDER + OVER) * np.minimum(rest[i], rest[j]) >= OVER * (n[i] + n[j])) & (joined[i] != joined[j])
            pairs.append(np.stack([fp[i], fp[j]])[:, fits])
        (a, b), (c, t) = np.hstack(pairs), np.hstack(large)
        none = pa.nulls
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, c])), pa.concat_arrays([pa.array(b), none(len(c), pa.int64())]), pa.concat_arrays([none(len(a), pa.int64()), pa.array(t)])], schema=schema)

    for batch in batches:
        held = np.hstack([held, np.vstack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])])
        if held.shape[1]:
            done = int(np.searchsorted(held[0], held[0, -1]))
            if done:
                yield found(held[:, :done])
                held = held[:, done:]
    if held.shape[1]:
        yield found(held)


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
        yield batch.filter(pa.array([not surely_apart(x, y, n, m) for n, x, m, y in rows], pa.bool_())).select(["a", "b"])


def unpruned(n: np.ndarray, bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs, as places in n sorted ascending, that neither their sizes nor their parities rule out."""
    sizes = np.array([len(x) for x in bits])
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for size in np.unique(sizes):  # similar sets have parities of one size, or of one twice the other
        at = np.flatnonzero((sizes == size) | (sizes == 2 * size))
        rows = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[k], np.uint8).reshape(-1, size), axis=0) for k in at])
        for i in range(int((sizes[at] == size).sum())):
            upto = int(np.searchsorted(n[at] * OVER, n[at[i]] * UNDER, "right"))
            differ = np.bitwise_count(rows[i + 1 : upto] ^ rows[i]).sum(axis=1, dtype=np.int64)
            near = at[i + 1 : upto][differ * (UNDER + OVER) <= (n[at[i + 1 : upto]] + n[at[i]]) * (UNDER - OVER)]
            left.append(np.full(len(near), at[i]))
            right.append(near)
    return np.concatenate(left), np.concatenate(right)


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (token, fp, n, bits, joined) of large groups: pairs (a, b) that may be similar and are not joined yet, or, of a group with
    many such, its members that have any."""
    now, members = None, []

    def made() -> pa.RecordBatch:
        members.sort(key=lambda m: (m[1], m[0]))
        fp = np.array([m[0] for m in members], np.int64)
        i, j = unpruned(np.array([m[1] for m in members], np.int64), [m[2] for m in members])
        joined = np.array([m[3] for m in members], np.int64)
        i, j = i[joined[i] != joined[j]], j[joined[i] != joined[j]]
        if len(i) <= LISTED * len(fp) // 4:
            a, b, token = np.minimum(fp[i], fp[j]), pa.array(np.maximum(fp[i], fp[j])), pa.nulls(len(i), pa.int64())
        else:
            a = fp[np.union1d(i, j)]
            b, token = pa.nulls(len(a), pa.int64()), pa.array(np.full(len(a), now, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a), b, token], names=["a", "b", "token"])

    for batch in batches:
        for token, *member in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if token != now:
                if members:
                    yield made()
                now, members = token, []
            members.append(member)
    if members:
        yield made()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [own.tobytes() for _, texts in steps(batch.column(1)) for own in batch_shingles(texts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["fp", "own"])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)
            links.append(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
        yield batch.filter(pa.array(links, pa.bool_())).select(["a", "b"])


def spanning(members: list[tuple[int, set]]) -> list[tuple[int, int]]:
    """Links that join just the components of all similar pairs: whoever is joined already is not compared again."""
    parts: list[list[tuple[int, set]]] = []
    links = []
    for fp, own in sorted(members, key=lambda m: (len(m[1]), m[0])):
        mine, others = [(fp, own)], []
        for part in parts:
            for other, theirs in reversed(part):
                least = min(len(own), len(theirs))
                if UNDER * least >= OVER * max(len(own), len(theirs)) and similar(len(own & theirs), len(own), len(theirs)):
                    links.append((fp, other))
                    mine = part + mine
                    break
            else:
                others.append(part)
        parts = [*others, mine]
    return links


def _span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (token, fp, own) of large groups to links."""
    now, members = None, []

    def made(links: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        for token, fp, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if token != now:
                yield made(spanning(members))
                now, members = token, []
            members.append((fp, set(np.frombuffer(own.as_py(), np.int64).tolist())))
    yield made(spanning(members))


def _links_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (fp, own) are similar."""
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("fp").alias(end), F.col("own").alias(f"own_{end}")), end)
    return pairs.select("a", "b", "own_a", "own_b").mapInArrow(_decide, "a long, b long")


def _close_links(classes: DataFrame, sets_of) -> DataFrame:
    """Links between sets whose fingerprints lie within RADIUS bits: each set against the first one of its fingerprint, and these against
    each other wherever the index finds their fingerprints near."""
    first = stored(classes.groupBy("print").agg(F.min("fp").alias("fp")), "print-classes")
    same = classes.select("print", F.col("fp").alias("b")).join(first.withColumnRenamed("fp", "a"), "print").filter("a != b").select("a", "b")
    near = near_links(first.select(F.col("print").alias("fp")), RADIUS) if not first.isEmpty() else same.limit(0)
    for end in ("a", "b"):
        near = near.join(first.select(F.col("print").alias(end), F.col("fp").alias(f"fp_{end}")), end)
    pairs = stored(same.union(near.select("fp_a", "fp_b")), "close-pairs")
    return stored(_links_of(pairs, sets_of(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")))), "close-links", TEXTS)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): one row per input row; component_id is the smallest doc_id reachable over links.

    Documents link when the distinct five-word shingles of their texts (A-Z lower-cased) have a Jaccard similarity of 0.8 or more.
    No link is lost: two such sets share one of their first shingles in any one order of all, so only texts that share one are
    compared, unless the index of fingerprints has joined them before; the order puts common shingles last. Parities rule out what surely
    differs too much, whole sets decide the rest. Shingles and sets count as equal when their 64-bit hashes are. Texts without words
    are alike. A doc_id must name one text. Null texts are empty. Repeated rows come out repeated; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), as_text(F.col(text_col)).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.mapInArrow(_profiles(*_common(docs)), f"doc_id {kind}, fp long, n int, bits binary, start array<long>, print long")
    profiles = stored(made, "profiles", TEXTS)
    classes = stored(profiles.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("print").alias("print")), "set-classes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(fp, own): the whole sets of some classes, each from one of its documents."""
        named = stored(classes.join(wanted.distinct(), "fp", "left_semi").select("fp", F.col("least").alias("doc_id")), "wanted")
        return stored(docs.join(named, "doc_id").select("fp", "text").mapInArrow(_sets, "fp long, own binary"), "sets", TEXTS).dropDuplicates(["fp"])

    close = _close_links(classes, sets_of)
    joined = stored(connected_components(close).select(F.col("node").alias("fp"), F.col("component").alias("joined")), "joined")
    with_joined = lambda rows: rows.join(joined, "fp", "left").withColumn("joined", F.coalesce("joined", "fp"))
    both = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long"))
    tokens = with_joined(profiles.select("fp", "n", "start")).select(F.posexplode("start").alias("pos", "token"), "fp", "n", "joined").select("token", "fp", both.alias("both"), "joined")
    found = stored(tokens.repartition("token").sortWithinPartitions("token").mapInArrow(_groups, "a long, b long, token long"), "near-groups")
    large = found.filter("b is null").select("token", F.col("a").alias("fp"))
    pairs = found.filter("b is not null").select("a", "b").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("fp").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}")), end)
    listed = pairs.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(_possible, "a long, b long")
    large = with_joined(large.join(classes.select("fp", "n", "bits"), "fp")).select("token", "fp", "n", "bits", "joined").repartition("token").sortWithinPartitions("token")
    narrowed = stored(large.mapInArrow(_narrow, "a long, b long, token long"), "near-members")
    large = narrowed.filter("b is null").select("token", F.col("a").alias("fp"))
    possible = stored(listed.union(narrowed.filter("b is not null").select("a", "b")).distinct(), "possible")
    sets = sets_of(possible.select(F.col("a").alias("fp")).union(possible.select("b")).union(large.select("fp")))
    spans = large.join(sets, "fp").select("token", "fp", "own").repartition("token").sortWithinPartitions("token").mapInArrow(_span, "a long, b long")
    links = stored(_links_of(possible, sets).union(spans).union(close), "near-links", TEXTS)
    members = classes.select("fp", "least").join(connected_components(links).withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    return profiles.select("doc_id", "fp").join(members.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "component_id")
