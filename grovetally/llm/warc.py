"""WARC archives: one gzip member per record, written and read by executors.

``write_warc`` turns rows into ``response`` records and, for payloads already
held by another row, into ``revisit`` records that name the response.
``read_warc`` streams archives back: incremental zlib decompression, records
framed by Content-Length, block and payload digests verified as bytes pass.

Defined cases.  A null payload counts as empty, a null url leaves out the target
header, a null page id leaves out the id header.  Rows with equal payloads share
one response: the smallest page id, nulls last; rows repeated with that id are
all responses.  Payloads shorter than ``min_revisit`` bytes never become revisits.
An empty table writes no archive and reads back as no rows.  Extra columns are
ignored.  Damaged members give a row whose ``error`` says why, and reading goes on
with the next member; only past a broken gzip stream is an archive not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import tidy
from .workspace import Workspace

#: Copies of one payload are spread over this many join keys, so none is a hot key.
SALTS = 16
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, error string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def with_revisits(pages: DataFrame, ws: Workspace, min_revisit: int = 0) -> DataFrame:
    """page_id, url, payload (binary) and refers_to (null for responses).

    The digests are counted in the JVM with map-side combining; only those that
    occur twice are kept, and that table is joined back by digest and salt.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    shared = (
        rows.filter(F.octet_length("payload") >= min_revisit)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND first_id IS NOT NULL")
        .select("digest", "first_id")
    )
    shared = ws.keep(shared, "shared")
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    found = salted.join(shared, ["digest", "salt"], "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")), F.col("first_id"))
    return found.select("page_id", "url", "payload", refers.alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}').urn}>"


def encode_record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One record as one gzip member."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    head += [
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    raw = "\r\n".join(head).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def write_warc(rows: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", roll_bytes: int = 64 << 20) -> DataFrame:
    """Archives below ``folder``; a lazy manifest of them, to be kept before reading.

    Every attempt of a task writes files of its own names and only the manifest of
    the attempt that succeeded is kept, so retries leave no record twice.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        done: list[tuple[str, int, int]] = []
        out, name, records, size = None, "", 0, 0
        for batch in tidy(batches):
            for page_id, url, payload, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                member = encode_record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), date)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= roll_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["path", "records", "bytes"])

    return rows.select("page_id", "url", "payload", "refers_to").mapInArrow(write, MANIFEST)


class _Members:
    """The decompressed bytes of a file of gzip members, a member at a time."""

    def __init__(self, source: io.RawIOBase, chunk: int = 1 << 16):
        self.source, self.chunk, self.left = source, chunk, b""
        self.unpack, self.ready = None, b""

    def next_member(self) -> bool:
        if not self.left:
            self.left = self.source.read(self.chunk)
        self.unpack, self.ready = zlib.decompressobj(31), b""
        return bool(self.left)

    def read(self, most: int) -> bytes:
        """Up to ``most`` bytes of the current member; empty at its end."""
        while not self.ready and not self.unpack.eof:
            if not self.left:
                self.left = self.source.read(self.chunk)
                if not self.left:
                    raise EOFError("the gzip member ends early")
            self.ready = self.unpack.decompress(self.left, self.chunk)
            self.left = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
        out, self.ready = self.ready[:most], self.ready[most:]
        return out

    def upto(self, mark: bytes) -> bytes:
        """All before ``mark``, which is taken too; as long as the member is."""
        got, seen = bytearray(), 0
        while (at := got.find(mark, seen)) < 0:
            seen = max(0, len(got) - len(mark) + 1)
            more = self.read(self.chunk)
            if not more:
                raise ValueError("no end of the header")
            got += more
        self.ready = bytes(got[at + len(mark) :]) + self.ready
        return bytes(got[:at])

    def skip(self) -> None:
        """To the end of the current member."""
        while self.read(self.chunk):
            pass


def read_records(source, with_payload: bool = False) -> Iterator[dict]:
    """The records of one archive, in order; memory follows the longest header unless payloads are asked for."""
    members = _Members(source)
    while True:
        row = dict.fromkeys(("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"))
        try:
            if not members.next_member():
                return
            lines = members.upto(b"\r\n\r\n").decode("ascii").split("\r\n")
            head = dict(line.split(": ", 1) for line in lines[1:])
            row |= {"record_type": head.get("WARC-Type"), "payload_digest": head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None}
            row["url"] = unquote(head["WARC-Target-URI"]) if "WARC-Target-URI" in head else None
            row["page_id"] = int(head["X-Page-ID"]) if "X-Page-ID" in head else None
            row["refers_to"] = int(head["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in head else None
            left = int(head["Content-Length"])
            inner = members.upto(b"\r\n\r\n")
            left -= len(inner) + 4
            block, payload, kept, size = hashlib.sha1(inner + b"\r\n\r\n"), hashlib.sha1(), [], 0
            while left > 0:
                part = members.read(min(left, 1 << 16))
                if not part:
                    raise ValueError("the block is shorter than Content-Length")
                block.update(part)
                payload.update(part)
                size, left = size + len(part), left - len(part)
                if with_payload:
                    kept.append(part)
            tail = b""
            while part := members.read(16):
                tail += part
            http = dict(line.split(": ", 1) for line in inner.decode("ascii").split("\r\n")[1:])
            row["payload_bytes"] = int(http["Content-Length"])
            b32 = lambda h: base64.b32encode(h.digest()).decode("ascii")
            if tail != b"\r\n\r\n":
                row["error"] = "the record does not end after its block"
            elif f"sha1:{b32(block)}" != head.get("WARC-Block-Digest"):
                row["error"] = "block digest"
            elif row["record_type"] == "response" and (b32(payload) != row["payload_digest"] or size != row["payload_bytes"]):
                row["error"] = "payload digest"
            if with_payload and row["record_type"] == "response":
                row["payload"] = b"".join(kept)
            yield row
        except (EOFError, zlib.error) as e:
            yield row | {"error": f"{type(e).__name__}: {e}"}
            return
        except (ValueError, KeyError) as e:
            yield row | {"error": f"{type(e).__name__}: {e}"}
            try:
                members.skip()
            except (EOFError, zlib.error):
                return


def read_warc(manifest: DataFrame, files: int, with_payload: bool = False) -> DataFrame:
    """All records of the manifest's archives; about one task for each of ``files``."""
    schema = RECORD + (", payload binary" if with_payload else "")
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(f.strip().split(" ")[0], kinds[f.strip().split(" ")[1]]) for f in schema.split(",")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for path in batch.column("path").to_pylist():
                system, inside = pafs.FileSystem.from_uri(path)
                with system.open_input_stream(inside, compression=None) as source:
                    rows, held = [], 0
                    for row in read_records(source, with_payload):
                        rows.append({n: row.get(n) for n in names})
                        held += len(row.get("payload") or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return manifest.select("path").repartition(max(1, files), "path").mapInArrow(read, schema)


def archive_pages(spark: SparkSession, pages: DataFrame, min_revisit: int = 0, with_payload: bool = False) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read every record back."""
    ws = Workspace(spark, "warc")
    manifest = ws.keep(write_warc(with_revisits(pages, ws, min_revisit), ws.path("archives")), "manifest")
    return read_warc(manifest, manifest.count(), with_payload)
