"""Token ids as Arrow files of fixed-size lists, with an index of documents."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import LocalFileSystem
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark import TaskContext

from .files import folder, opened
from .tokens import encoder
from .work import TEXTS, as_text, spread, stored

SEQUENCE = 1024
#: Sequences in a record batch; a reader holds one batch at a time.
BATCH = 256
MANIFEST = "shard long, path string, index string, n_docs long, n_tokens long"


def id_kind(highest: int) -> np.dtype:
    """The width of ids in the files: 16 bits where all fit, else 32."""
    return np.dtype("<u2" if highest < 1 << 16 else "<u4")


def list_schema(sequence: int, kind: np.dtype) -> pa.Schema:
    """input_ids and mask: lists of exactly `sequence` unsigned ids and booleans (false where the shard's last list is filled up)."""
    return pa.schema([pa.field("input_ids", pa.list_(pa.from_numpy_dtype(kind), sequence), False), pa.field("mask", pa.list_(pa.bool_(), sequence), False)])


class Lists:
    """Writes a stream of ids as equal-length lists."""

    def __init__(self, uri: str, sequence: int, kind: np.dtype) -> None:
        store, path = opened(uri)
        self.sequence, self.kind, self.schema = sequence, kind, list_schema(sequence, kind)
        self.sink = store.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[bytes] = []
        self.bytes = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.bytes += len(ids)
        if self.bytes >= self.kind.itemsize * BATCH * self.sequence:
            self._write(False)

    def _write(self, last: bool) -> None:
        data = b"".join(self.held)
        whole = self.kind.itemsize * BATCH * self.sequence
        cut = len(data) if last else len(data) // whole * whole
        for at in range(0, cut, whole):
            ids = np.frombuffer(data[at : min(at + whole, cut)], self.kind)
            rows = -(-len(ids) // self.sequence)
            mask = np.arange(rows * self.sequence) < len(ids)
            ids = np.pad(ids, (0, rows * self.sequence - len(ids)))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.held, self.bytes = [data[cut:]], len(data) - cut

    def close(self) -> None:
        self._write(True)
        self.writer.close()
        self.sink.close()


def write_arrow(docs: DataFrame, to: str, tokenizer: str, end_id: int = 0, sequence: int = SEQUENCE) -> DataFrame:
    """Writes all documents' ids, each closed with end_id, in ascending doc_id order; returns the manifest of what was written.

    One shard for each range of ids: `path` holds the lists, `index` each document's id, start in the shard and number of ids. Names
    are unique to a task attempt and only the manifest makes a file part of the output, so lost or doubled attempts do no harm.
    Null texts are empty (the end id alone), null ids come first. Rows of one id stand next to each other in the order of their texts'
    hashes, so that reruns agree, and may lie in several shards. Ids take 16 bits, or 32 where the vocabulary is larger.
    """
    folder(to)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        wide = id_kind(max(end_id, enc.highest))
        shard = TaskContext.get().partitionId()
        lists, n_docs, at = None, 0, 0
        store, index_path = opened(index := f"{to}/docs-{shard:06d}-{uuid.uuid4().hex}.arrow")
        path = index.replace("/docs-", "/ids-")
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            if lists is None:
                lists, sink = Lists(path, sequence, wide), store.open_output_stream(index_path)
                writer = pa.ipc.new_file(sink, schema)
            at_doc = 0
            for ids, counts in enc.encode(batch.column(1)):
                lists.add(np.insert(ids.astype(wide), np.cumsum(counts), end_id).tobytes())
                ends = at + np.cumsum(counts + 1)
                writer.write_table(pa.table([batch.column(0).slice(at_doc, len(counts)), ends - counts - 1, counts + 1], schema=schema))
                at, n_docs, at_doc = int(ends[-1]), n_docs + len(counts), at_doc + len(counts)
        if lists is not None:
            lists.close()
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "index": index, "n_docs": n_docs, "n_tokens": at}])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text(F.col("text")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = ["doc_id", "tie", "text"]
    return stored(rows.repartitionByRange("doc_id", "tie").sortWithinPartitions(*order).mapInArrow(write, MANIFEST), "manifest", TEXTS)


class ListReader:
    """Random access to a shard's stream of ids: only the batches that hold the asked-for ids are touched.

    On a file system of the machine's own the file is mapped, and ids() yields views of the map without any copy; from other stores
    each batch that is asked for is read once.
    """

    def __init__(self, uri: str) -> None:
        store, path = opened(uri)
        self.file = pa.ipc.open_file(pa.memory_map(path) if isinstance(store, LocalFileSystem) else store.open_input_file(path))
        self.sequence = self.file.schema.field("input_ids").type.list_size
        self.span = BATCH * self.sequence
        self.at = -1

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        while n:
            k, off = divmod(start, self.span)
            if k != self.at:
                batch = self.file.get_batch(k)
                self.at, self.now = k, batch.column(0).flatten().to_numpy(zero_copy_only=True)
            got = self.now[off : off + n]
            yield got
            start, n = start + len(got), n - len(got)


def read_arrow(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read from the files; start counts all ids of documents before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = ListReader(row["path"])
                store, path = opened(row["index"])
                index = pa.ipc.open_file(store.open_input_file(path))
                for k in range(index.num_record_batches):
                    docs = index.get_batch(k)
                    starts, sizes = docs["start"].to_numpy(), docs["n_tokens"].to_numpy()
                    crcs = []
                    for start, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                        crc = 0
                        for ids in reader.ids(start, n):
                            crc = zlib.crc32(ids.astype("<u4"), crc)
                        crcs.append(crc)
                    columns = [docs["doc_id"], pa.array(starts + row["base"]), docs["n_tokens"], pa.array(crcs, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread(placed).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
