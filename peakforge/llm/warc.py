"""WARC archives: one gzip member per record, written and read by Spark tasks.

The reader is sequential: it inflates a member step by step, takes header lines up to the blank line, then exactly
Content-Length bytes of block, and checks the payload digest on the way. Memory holds one header and one chunk, and
the payload only if it is asked for.

Defined cases: a null payload is an empty one; null ids and URIs are written as empty header values and read back as
null; records of fewer than ``min_revisit_bytes`` never become revisits; records with the smallest id of their
payload (repeated ids included) are responses; empty input gives no archive and no rows; other columns of the input
are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.llm.common import new_path, open_fs, written

CHUNK = 1 << 16
MAX_HEADER = 1 << 20
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, n_records long, n_bytes long"
RECORD = (
    "record_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, "
    "refers_to long, path string, offset long, payload binary"
)


class WarcError(ValueError):
    """An archive that breaks the format, or a payload that differs from its digest."""


def _line(value) -> str:
    """A header value: control characters would break the framing, so they are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", "" if value is None else str(value))


def _unline(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def encode_record(record_id, uri, payload: bytes | None, digest: str, n_bytes: int, refers_to=None) -> bytes:
    """One record as a gzip member. A revisit (``refers_to`` given) carries the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    body = b"" if refers_to is not None else payload or b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:record:{'' if record_id is None else record_id}>",
        f"WARC-Date: {DATE}",
        *([] if uri is None else [f"WARC-Target-URI: {_line(uri)}"]),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(http + body).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(body)}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:record:{refers_to}>",
        ]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n") + z.flush()


class MemberReader:
    """Inflates consecutive gzip members of a stream, a chunk at a time."""

    def __init__(self, stream):
        self.stream, self.raw, self.at = stream, b"", 0

    def start(self) -> bool:
        """Go to the next member; False at the end of the archive."""
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
        if not self.raw:
            return False
        self.inflater, self.buffer, self.offset = zlib.decompressobj(31), b"", self.at
        return True

    def _more(self) -> bool:
        if self.inflater.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
            if not self.raw:
                raise WarcError(f"the archive ends inside the record at byte {self.offset}")
        before = len(self.raw)
        try:
            self.buffer += self.inflater.decompress(self.raw, CHUNK)
        except zlib.error as e:
            raise WarcError(f"bad gzip data in the record at byte {self.offset}: {e}") from e
        self.raw = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
        self.at += before - len(self.raw)
        return True

    def until(self, mark: bytes) -> bytes:
        while mark not in self.buffer:
            if len(self.buffer) > MAX_HEADER or not self._more():
                raise WarcError(f"no end of header in the record at byte {self.offset}")
        head, _, self.buffer = self.buffer.partition(mark)
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self._more():
                raise WarcError(f"the record at byte {self.offset} is shorter than its Content-Length")
            piece, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(piece)
            if piece:
                yield piece

    def finish(self) -> None:
        """What is left of the member must be the two line ends that close a record."""
        while len(self.buffer) <= 4 and self._more():
            pass
        if self.buffer != b"\r\n\r\n":
            raise WarcError(f"the record at byte {self.offset} is longer than its Content-Length")


def _headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode().split("\r\n")[1:])}


def _id(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:record:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def read_records(stream, *, with_payload: bool = False) -> Iterator[dict]:
    """The records of one archive, in order; raises WarcError at the first that is broken."""
    reader = MemberReader(stream)
    while reader.start():
        head = _headers(reader.until(b"\r\n\r\n"))
        left = int(head["content-length"])
        http, block = b"", hashlib.sha256()
        for piece in reader.take(left):
            http += piece
            block.update(piece)
            left -= len(piece)
            if b"\r\n\r\n" in http:
                break
        http, _, first = http.partition(b"\r\n\r\n")
        kind, named = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
        size, digest, kept = len(first), hashlib.sha256(first), [first]
        for piece in reader.take(left):
            size += len(piece)
            digest.update(piece)
            block.update(piece)
            if with_payload:
                kept.append(piece)
        reader.finish()
        if block.hexdigest() != head["warc-block-digest"].removeprefix("sha256:"):
            raise WarcError(f"the record at byte {reader.offset} differs from its block digest")
        stated = int(_headers(http)["content-length"])
        if kind == "response" and (digest.hexdigest() != named or size != stated):
            raise WarcError(f"the record at byte {reader.offset} differs from its payload digest or length")
        yield {
            "record_id": _id(head.get("warc-record-id")),
            "record_type": kind,
            "target_uri": _unline(head["warc-target-uri"]) if "warc-target-uri" in head else None,
            "payload_bytes": stated,
            "payload_digest": named,
            "refers_to": _id(head.get("warc-refers-to")),
            "offset": reader.offset,
            "payload": b"".join(kept) if with_payload and kind == "response" else None,
        }


def with_revisits(df: DataFrame, *, id_col: str, payload_col: str, uri_col: str, min_revisit_bytes: int) -> DataFrame:
    """(record_id, uri, payload, digest, n_bytes, refers_to), payload null for revisits.

    Payloads that occur twice are found on digests alone; that table is written, so Spark knows its size and sends
    it to all tasks if it is small, or else joins by a shuffle whose large partitions it splits.
    """
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("long").alias("record_id"), F.col(uri_col).cast("string").alias("uri"), body.alias("payload")
    ).withColumns({"digest": F.sha2(F.encode("payload", "UTF-8"), 256), "n_bytes": F.octet_length("payload").cast("long")})
    repeated = written(
        rows.where(F.col("n_bytes") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.min("record_id").alias("first_id"), F.count("*").alias("copies"))
        .where((F.col("copies") > 1) & F.col("first_id").isNotNull())
        .select("digest", "first_id"),
        "warc-repeated",
    )
    later = F.col("first_id").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first_id"))
    return (
        rows.join(repeated, "digest", "left")
        .withColumn("refers_to", F.when(later, F.col("first_id")))
        .select("record_id", "uri", F.when(~later, F.col("payload")).alias("payload"), "digest", "n_bytes", "refers_to")
    )


def write_warc(
    df: DataFrame,
    out_dir: str | None = None,
    *,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 100,
    max_archive_bytes: int = 128 << 20,
) -> DataFrame:
    """Write ``df`` as ``*.warc.gz`` in ``out_dir`` (in the shared folder by default); returns the manifest.

    Each attempt of a task writes files of its own name; the manifest, itself a written table, names those of the
    attempts that succeeded, so a lost executor leaves at most files that nobody reads. A task starts a new archive
    beyond ``max_archive_bytes``.
    """
    out_dir = out_dir or new_path(df.sparkSession, "warc")
    rows = with_revisits(df, id_col=id_col, payload_col=payload_col, uri_col=uri_col, min_revisit_bytes=min_revisit_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(out_dir)
        task, out, done = TaskContext.get(), None, []
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    path = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                    fs.create_dir(folder, recursive=True)
                    out, n, size = fs.open_output_stream(path), 0, 0
                payload = None if r["payload"] is None else r["payload"].encode()
                member = encode_record(r["record_id"], r["uri"], payload, r["digest"], r["n_bytes"], r["refers_to"])
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= max_archive_bytes:
                    out.close()
                    done.append((f"{out_dir}/{path.rpartition('/')[2]}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{out_dir}/{path.rpartition('/')[2]}", n, size))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "n_records", "n_bytes"), x, strict=True)) for x in done], SCHEMA)

    return written(rows.mapInArrow(write, MANIFEST), "warc-manifest")


SCHEMA = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
RECORD_SCHEMA = pa.schema(
    [
        ("record_id", pa.int64()),
        ("record_type", pa.string()),
        ("target_uri", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("path", pa.string()),
        ("offset", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def read_warc(manifest: DataFrame, *, with_payload: bool = False, batch_bytes: int = 16 << 20) -> DataFrame:
    """Read the archives that ``manifest`` (column path) names, each by one task; a broken one fails the job."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = open_fs(path)
                held, size = [], 0
                with fs.open_input_stream(name) as stream:
                    for r in read_records(stream, with_payload=with_payload):
                        held.append(r | {"path": path})
                        size += 200 + len(r["payload"] or b"")
                        if size > batch_bytes:
                            yield pa.RecordBatch.from_pylist(held, RECORD_SCHEMA)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, RECORD_SCHEMA)

    paths = manifest.select("path")
    found = paths.repartition(max(1, paths.count())).mapInArrow(read, RECORD)
    return checked_revisits(found) if not with_payload else found


def checked_revisits(records: DataFrame) -> DataFrame:
    """``records`` with digest and length of each revisit held against the response that it names; a difference fails the job.

    Each response that is named is looked up once: its number of revisits doesn't matter to the join.
    """
    records = written(records, "warc-records")
    named = records.where("record_type = 'revisit'").select("refers_to", "payload_digest", "payload_bytes").distinct()
    known = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n")).distinct()
    right = (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("n"))
    bad = named.join(known, "refers_to", "left").groupBy("refers_to", "payload_digest", "payload_bytes").agg(F.max(F.coalesce(right, F.lit(False))).alias("right"))
    wrong = bad.where(~F.col("right")).first()
    if wrong is not None:
        raise WarcError(f"a revisit of record {wrong['refers_to']} differs from it in digest or length")
    return records


