"""WARC archives: a deterministic sharded writer and a checking reader."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import folder, opened
from .work import TEXTS, as_text, spread, stored

ROLL_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard long, part long, held string, path string, records long, bytes long, sha1 string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page}')}>"


def address(page: object, url: str | None) -> str:
    """A header value is one line; a url is kept percent-encoded where it holds controls or blanks."""
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or f"urn:page:{page}")


def record(page: object, url: str | None, payload: bytes, refers_to: object = None, refers_url: str | None = None, date: str = DATE) -> bytes:
    """One record with fresh headers and digests. A revisit names the response by id, url and date, and keeps the payload's digest and
    length but not the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Target-URI: {address(page, url)}", f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Page-ID: {'' if page is None else page}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Target-URI: {address(refers_to, refers_url)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member without time or name, so equal records give equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Roller:
    """Files of one task; a new one begins when the compressed size reaches the limit."""

    def __init__(self, to: str, shard: int, roll: int) -> None:
        self.to, self.shard, self.roll, self.part, self.sink, self.rows = to, shard, roll, 0, None, []
        self.attempt = uuid.uuid4().hex

    def add(self, data: bytes) -> None:
        if self.sink is None:
            self.held = f"{self.to}/_temporary/{self.shard:06d}-{self.part:05d}-{self.attempt}"
            store, path = opened(self.held)
            self.sink, self.bytes, self.records, self.sum = store.open_output_stream(path, compression=None), 0, 0, hashlib.sha1()
        self.sink.write(data)
        self.sum.update(data)
        self.bytes, self.records = self.bytes + len(data), self.records + 1
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            name = f"{self.to}/part-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.rows.append({"shard": self.shard, "part": self.part, "held": self.held, "path": name, "records": self.records, "bytes": self.bytes, "sha1": self.sum.hexdigest()})
            self.sink, self.part = None, self.part + 1


def originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, tie, refers_to, refers_url) of the rows that revisit another: an equal payload of at least min_bytes with a smaller page_id."""
    rows = pages.select("page_id", "tie", "url", F.sha2("html", 256).alias("key"), F.octet_length("html").alias("size"))
    first = rows.filter(F.col("size") >= min_bytes).groupBy("key", "size").agg(F.min("page_id").alias("refers_to"), F.min_by("url", F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("refers_url"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.select("page_id", "tie", "key", "size").join(first, ["key", "size"]).filter("page_id > refers_to").select("page_id", "tie", "refers_to", "refers_url").distinct()


def write_warc(pages: DataFrame, to: str, min_bytes: int = 0, roll: int = ROLL_BYTES, level: int = 6) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) in page_id order; returns the manifest (one row per file).

    One shuffle range-sorts rows, by id and the payload's hash, together with the revisit decisions; null ids, and one id of many
    payloads, spread over ranges. Tasks write under temporary names that are unique to an attempt; the manifest is stored, then the files
    that it lists get their final names, and it is kept beside them under _manifest. So a lost or doubled attempt leaves nothing but an
    unlisted temporary file. Null html is an empty payload; a null url becomes urn:page:<id>. Payloads are equal when SHA-256 and length
    are. Rows that repeat the smallest page_id of a payload are all responses; other repeats are all revisits. Null ids sort first and are
    responses. Other columns are not read. An empty table writes no file. A payload is held in memory one at a time.
    """
    folder(f"{to}/_temporary")
    html = as_text(F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.xxhash64(html).alias("tie"))
    none = lambda kind: F.lit(None).cast(kind)
    marks = originals(rows, min_bytes).select("page_id", "tie", F.lit(0).alias("kind"), none("string").alias("url"), none("string").alias("html"), "refers_to", "refers_url")
    both = rows.select("page_id", "tie", F.lit(1).alias("kind"), "url", "html", none("long").alias("refers_to"), none("string").alias("refers_url")).union(marks)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Roller(to, TaskContext.get().partitionId(), roll)
        marked, target = None, (None, None)
        for batch in batches:
            for page, tie, kind, url, body, refers, refers_url in zip(*(batch.column(k) for k in range(7)), strict=True):
                own = (page.as_py(), tie.as_py())
                if not kind.as_py():
                    marked, target = own, (refers.as_py(), refers_url.as_py())
                    continue
                response = target if own == marked else (None, None)
                files.add(member(record(own[0], url.as_py(), body.as_py().encode("utf-8", "surrogatepass"), *response), level))
        files.close()
        if files.rows:
            yield pa.RecordBatch.from_pylist(files.rows)

    # Range partitioning sends equal keys to one partition, so a mark stands right before its rows.
    manifest = stored(both.repartitionByRange("page_id", "tie").sortWithinPartitions("page_id", "tie", "kind", "url", "html").mapInArrow(write, MANIFEST), "warc-manifest", TEXTS)

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, held = opened(row["held"])
                path = opened(row["path"])[1]
                if store.get_file_info(held).is_file:  # else an earlier attempt has renamed it
                    store.move(held, path)
                if store.get_file_info(path).size != row["bytes"]:
                    raise OSError(f"{row['path']} does not have the size that the manifest lists")
            yield batch

    spread(manifest).mapInArrow(commit, MANIFEST).write.parquet(f"{to}/_manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{to}/_manifest")


def _members(uri: str, step: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    store, path = opened(uri)
    with store.open_input_stream(path, compression=None) as source:
        unpack, out, data = zlib.decompressobj(31), io.BytesIO(), source.read(step)
        while data:
            out.write(unpack.decompress(data))
            data = unpack.unused_data
            if unpack.eof:
                yield out.getvalue()
                unpack, out = zlib.decompressobj(31), io.BytesIO()
            if not data:
                data = source.read(step)
        if out.tell():
            raise OSError(f"{uri} ends within a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; the block's digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"digest of {headers['WARC-Record-ID']} does not fit")
    return headers, block


def read_warc(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) from the files of a manifest.

    Block digests are checked, and for responses the payload's digest and length.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[dict] = []
                held = 0
                for data in _members(path):
                    headers, block = parse(data)
                    kind, body = headers["WARC-Type"], block.partition(b"\r\n\r\n")[2]
                    stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(headers["X-Payload-Length"])
                    if kind == "response" and (digest(body) != stated or len(body) != size):
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not fit its headers")
                    page, refers = headers["X-Page-ID"], headers.get("X-Refers-To-Page")
                    row = {"page_id": int(page) if page else None, "url": headers["WARC-Target-URI"], "payload_bytes": size, "payload_digest": stated, "record_type": kind, "refers_to": int(refers) if refers else None}
                    rows.append(row | ({"payload": body if kind == "response" else None} if payloads else {}))
                    held += len(body) if payloads else 1000
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(fields + [("payload", pa.binary())] * payloads)
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return spread(manifest.select("path")).mapInArrow(read, ddl)
