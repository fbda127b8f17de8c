"""WARC archives as a chunked record table.

A payload travels as rows of (record, chunk number, bytes), so neither a writer nor a reader ever holds a whole record:
the writer of a partition streams the chunks, in order, into one gzip member per record, the reader streams them out
again, and both carry the payload's SHA-256 from chunk to chunk. Of records with equal payloads (of ``REVISIT_BYTES`` at
least) only the first is stored, the others are ``revisit`` records that refer to it.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import new_path, saved

CHUNK = 64 * 1024
REVISIT_BYTES = 100
LEVEL = 3
#: Repeated digests (some 100 bytes each) that are broadcast at most.
BROADCAST_ROWS = 100_000
DATE = "2024-01-01T00:00:00Z"

CHUNKS = "record_id string, chunk_no int, data binary, bytes_so_far long, sha256_so_far string"
RECORDS = "record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string"


def plan_records(df: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = REVISIT_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``record_id``, ``url``, ``record_type``, ``refers_to``, ``payload_bytes``, ``payload_digest``, ``payload``.

    A null body is empty, a body of text is its UTF-8. The response of a group of equal payloads is the row with the
    smallest id; rows that repeat that id with that payload are responses too. A null id is never the response of others:
    its row is a response of its own.

    No payload is sent to a task because of its digest, so one that a million pages share is no hot spot: repeated digests
    are found from ids and digests alone. Where they are at most ``broadcast_rows`` (counted first) they are broadcast and
    payloads are not shuffled at all; else the rows that revisit are joined by id and digest, which spreads the copies.
    """
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).cast("string").alias("record_id"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    named = rows.where((F.col("payload_bytes") >= least) & F.col("id").isNotNull()).select("id", "payload_digest")
    first = saved(named.groupBy("payload_digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first != last").select("payload_digest", "first"), "repeated")
    if first.count() <= broadcast_rows:
        got = rows.join(F.broadcast(first), "payload_digest", "left").withColumn("first", F.when(F.col("id") != F.col("first"), F.col("first")))
    else:
        again = named.join(first, "payload_digest").where("id != first").distinct()
        got = rows.join(again, ["id", "payload_digest"], "left")
    again = F.col("first").isNotNull()
    return got.select("record_id", "url", F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("first").cast("string").alias("refers_to"), "payload_bytes", "payload_digest", F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"))


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row per chunk of ``payload``, a record's chunks one after another in order: ``chunk_no`` from 0, ``data``; an empty payload has one empty chunk. The source's row holds its payload, and so does this array of slices; from here on no row is longer than a chunk."""
    last = F.greatest(F.ceil(F.octet_length("payload") / chunk) - 1, F.lit(0)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("payload"), i * chunk + 1, F.lit(chunk)))
    return records.select(*[c for c in records.columns if c != "payload"], F.posexplode(pieces).alias("chunk_no", "data"))


def _head(name: str | None, url: str | None, kind: str, refers: str | None, size: int, digest: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = len(http) + (size if kind == "response" else 0)
    fields = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if name is None else name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    fields += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {body}"]
    if kind == "revisit":
        fields += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + http


def write(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes chunk rows as ``.warc.gz`` files, one per partition, into ``folder`` (any URI that pyarrow opens) and returns the manifest (``path``, ``records``), which is a saved table.

    A file's name holds a random part, so a task that is tried again, or twice at once, never touches another attempt's
    file; only files named in the manifest count. An empty partition writes no file.
    """

    def run(batches):
        fs, top = FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        path, out, records = f"{top}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", None, 0
        pack = sha = digest = None

        def finish():
            if pack is not None:
                if sha is not None and sha.hexdigest() != digest:
                    raise ValueError("a payload's chunks do not give its digest")
                out.write(pack.compress(b"\r\n\r\n") + pack.flush())

        for b in batches:
            for r in b.to_pylist():
                if r["chunk_no"] == 0:
                    if out is None:
                        out = fs.open_output_stream(path)
                    finish()
                    records += 1
                    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    sha, digest = (hashlib.sha256() if r["record_type"] == "response" else None), r["payload_digest"]
                    out.write(pack.compress(_head(r["record_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"], digest)))
                if sha is not None and r["data"]:
                    sha.update(r["data"])
                    out.write(pack.compress(r["data"]))
        if out is not None:
            finish()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], names=["path", "records"])

    return saved(chunks.mapInArrow(run, "path string, records long"), "warc_manifest")


class _Stream:
    """The bytes of a file of gzip members, read and inflated a piece at a time."""

    def __init__(self, f, piece: int = CHUNK):
        self.f, self.piece, self.got, self.at, self.left, self.z = f, piece, b"", 0, b"", None

    def _more(self) -> bool:
        while True:
            if not self.left:
                self.left = self.f.read(self.piece)
                if not self.left:
                    return False
            if self.z is None:
                self.z = zlib.decompressobj(31)
            data = self.z.decompress(self.left, self.piece)
            self.left = self.z.unconsumed_tail
            if self.z.eof:
                self.left, self.z = self.z.unused_data, None
            if data:
                self.got, self.at = self.got[self.at :] + data, 0
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (k := self.got.find(mark, self.at)) < 0:
            if not self._more():
                return None
        out, self.at = self.got[self.at : k], k + len(mark)
        return out

    def take(self, most: int) -> bytes:
        if self.at == len(self.got) and not self._more():
            raise EOFError("a record is cut off")
        out = self.got[self.at : self.at + most]
        self.at += len(out)
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}


def _records(f):
    """For each record of an open file: its fields, the payload's length, and an iterator over pieces of the stored payload."""
    s = _Stream(f)
    while (head := s.until(b"\r\n\r\n")) is not None:
        fields = _fields(head)
        http = s.until(b"\r\n\r\n")
        size = int(_fields(http)["content-length"])
        left = [int(fields["content-length"]) - len(http) - 4]

        def pieces():
            while left[0]:
                piece = s.take(min(left[0], CHUNK))
                left[0] -= len(piece)
                yield piece

        yield fields, size, pieces()
        for _ in pieces():
            pass
        s.until(b"\r\n\r\n")


def _name(value: str | None) -> str | None:
    return (value[len("<urn:page:") : -1] or None) if value else None


def _files(manifest: DataFrame, folder: str) -> DataFrame:
    return manifest.select("path").repartition(max(1, manifest.count()))


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of the manifest's files (RECORDS; ``url`` as stored, with spaces and control characters percent-encoded), payloads digested as they stream by; a payload that does not have the digest of its header is an error."""

    def run(batches):
        fs, _ = FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(path) as f:
                    for fields, size, pieces in _records(f):
                        digest, kind, url = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"], fields.get("warc-target-uri")
                        if kind == "response":
                            sha, n = hashlib.sha256(), 0
                            for p in pieces:
                                sha.update(p)
                                n += len(p)
                            if n != size or sha.hexdigest() != digest:
                                raise ValueError(f"{path}: a payload does not have its digest")
                        rows.append((_name(fields["warc-record-id"]), url, kind, _name(fields.get("warc-refers-to")), size, digest))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    def _batch(rows):
        kinds = (pa.string(),) * 4 + (pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names=["record_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"])

    return _files(manifest, folder).mapInArrow(run, RECORDS)


def read_chunks(manifest: DataFrame, folder: str) -> DataFrame:
    """The chunk table of stored payloads (CHUNKS): each row with the payload's length and digest up to and with it, so that the last row of a record has the payload's own. An empty payload has no row."""

    def run(batches):
        fs, _ = FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_stream(path) as f:
                    for fields, _, pieces in _records(f):
                        sha, n = hashlib.sha256(), 0
                        for k, p in enumerate(pieces):
                            sha.update(p)
                            n += len(p)
                            yield pa.RecordBatch.from_arrays([pa.array([_name(fields["warc-record-id"])], pa.string()), pa.array([k], pa.int32()), pa.array([p], pa.binary()), pa.array([n], pa.int64()), pa.array([sha.copy().hexdigest()])], names=["record_id", "chunk_no", "data", "bytes_so_far", "sha256_so_far"])

    return _files(manifest, folder).mapInArrow(run, CHUNKS)


def archive(df: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes a record per row of ``df`` (an empty table gives no file) and returns the manifest and the folder. Other columns are not read."""
    folder = folder or new_path(df.sparkSession, "warc")
    return write(chunked(plan_records(df, id_col, url_col, body_col)), folder), folder
