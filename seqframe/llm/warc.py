"""WARC archives as chunked record tables.

Archives are written by tasks, one gzip member a record, and read back as a stream: a record becomes rows of at most ``CHUNK``
payload bytes with its identifier and a chunk number, each carrying the length and SHA-1 digest so far. No task holds a whole
archive, and a reader never holds a whole payload.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.functions.scratch import materialize, shared_dir

CHUNK = 1 << 20

#: Equal payloads shorter than this are stored each time.
REVISIT_BYTES = 1000

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"

CHUNKS = (
    "file string, record_no long, chunk_no int, record_id string, warc_type string, target_uri string, refers_to string, "
    "declared_bytes long, declared_digest string, bytes_so_far long, digest_so_far string, last boolean, data binary"
)


def plan_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES
) -> DataFrame:
    """One row a record: id, url, payload (UTF-8), n_bytes, sha1, record_type and refers_to.

    Of records with equal payloads of at least ``revisit_bytes`` bytes, the one of the largest id is the response and the others are
    revisits of it; rows that repeat that id are responses too, as is every row without an id. A NULL payload is empty, a NULL
    url is ``about:blank``. Equal payloads are told by SHA-1 and length; only the largest id of each is combined and shuffled.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    url = F.regexp_replace(F.coalesce(F.nullif(F.col(url_col), F.lit("")), F.lit("about:blank")), r"\s", "%20")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    last = rows.where(F.col("n_bytes") >= revisit_bytes).groupBy("sha1", "n_bytes").agg(F.max("id").alias("of"), F.count("*").alias("times"))
    last = last.where("times > 1 and of is not null").drop("times")
    again = F.col("of").isNotNull() & F.col("id").isNotNull() & (F.col("of") != F.col("id"))
    return rows.join(last, ["sha1", "n_bytes"], "left").select(
        "id", "url", "payload", "n_bytes", "sha1", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("of")).alias("refers_to")
    )


def _head(page: int | None, url: str, sha1: str, n: int, refers: int | None, date: str, uid: str) -> bytes:
    """WARC and HTTP header of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    kind = "response" if refers is None else "revisit"
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_ID}{page}>" if page is not None else f"WARC-Record-ID: <urn:uuid:{uid}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (n if refers is None else 0)}",
    ]
    if refers is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(records: DataFrame, folder: str, date: datetime | None = None) -> DataFrame:
    """Write one archive a partition of ``records`` (see :func:`plan_records`) and return file, n_records, n_bytes (of the file).

    A task writes under a name of its own and moves the file into place when it is whole, so a task that is run again replaces
    its file by an equal one. A partition without rows writes no file. The folder must be reachable by all executors.
    """
    stamp = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        final, own = f"{base}/part-{part:06d}.warc.gz", f"{base}/_{uuid.uuid4().hex}"
        n, out, size = 0, None, 0
        for batch in batches:
            data = batch.column(2)
            for k in range(batch.num_rows):
                page, url, n_bytes, sha1, refers = (batch.column(i)[k].as_py() for i in (0, 1, 3, 4, 6))
                if out is None:
                    out = fs.open_output_stream(own)
                member = zlib.compressobj(1, zlib.DEFLATED, 31)
                uid = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{part}/{n}"))
                out.write(member.compress(_head(page, url, sha1, n_bytes, refers, stamp, uid)))
                if refers is None:
                    view = memoryview(data[k].as_buffer())
                    for a in range(0, len(view), CHUNK):
                        out.write(member.compress(view[a : a + CHUNK]))
                out.write(member.compress(b"\r\n\r\n"))
                out.write(member.flush())
                n += 1
        if out is not None:
            size = out.tell()
            out.close()
            fs.move(own, final)
            yield pa.RecordBatch.from_pydict({"file": pa.array([f"{folder}/part-{part:06d}.warc.gz"]), "n_records": pa.array([n]), "n_bytes": pa.array([size])})

    picked = records.select("id", "url", "payload", "n_bytes", "sha1", "record_type", "refers_to")
    return picked.mapInArrow(run, "file string, n_records long, n_bytes long")


class _Inflated(io.RawIOBase):
    """The bytes of a stream of gzip members, or of a plain stream."""

    def __init__(self, raw, chunk: int):
        self.raw, self.chunk, self.z, self.rest = raw, chunk, None, raw.read(2)
        self.plain = self.rest != b"\x1f\x8b"

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            data, self.rest = self.rest or self.raw.read(self.chunk), b""
            if self.plain:
                buffer[: len(data[: len(buffer)])] = data[: len(buffer)]
                self.rest = data[len(buffer) :]
                return min(len(data), len(buffer))
            if not data and self.z is None:
                return 0
            if self.z is None:
                self.z = zlib.decompressobj(31)
            out = self.z.decompress(data, len(buffer))
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, None
            else:
                self.rest = self.z.unconsumed_tail
                if not data and not out:
                    raise ValueError("archive ends inside a gzip member")
            if out:
                buffer[: len(out)] = out
                return len(out)


def _fields(stream: io.BufferedReader) -> dict[str, str]:
    """Header lines up to an empty one, names in lower case."""
    out: dict[str, str] = {}
    while True:
        line = stream.readline(1 << 16)
        if line in (b"\r\n", b"\n", b""):
            return out
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()


def _hex(digest: str) -> str | None:
    """A labelled digest as bare hexadecimal."""
    value = digest.partition(":")[2] or digest
    if not value:
        return None
    return base64.b32decode(value).hex() if len(value) == 32 else value.lower()


def _records(stream: io.BufferedReader, chunk: int, with_data: bool) -> Iterator[dict]:
    number = -1
    while True:
        line = stream.readline(1 << 16)
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = _fields(stream)
        number += 1
        left = int(head.get("content-length", 0))
        kind, declared = head.get("warc-type", ""), None
        if head.get("content-type", "").startswith("application/http"):
            http = b""
            while left and not http.endswith(b"\r\n\r\n"):
                line = stream.readline(min(left, 1 << 16))
                if not line:
                    raise ValueError("record ends early")
                http += line
                left -= len(line)
                if line.lower().startswith(b"content-length:"):
                    declared = int(line.partition(b":")[2])
                if line in (b"\r\n", b"\n"):
                    break
        row = {
            "record_no": number,
            "record_id": head.get("warc-record-id", "").strip("<>"),
            "warc_type": kind,
            "target_uri": head.get("warc-target-uri"),
            "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
            "declared_bytes": declared,
            "declared_digest": _hex(head.get("warc-payload-digest", "")),
        }
        sha, size, k = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(left, chunk))
            if left and not data:
                raise ValueError("record ends early")
            left -= len(data)
            size += len(data)
            sha.update(data)
            yield row | {"chunk_no": k, "bytes_so_far": size, "digest_so_far": sha.copy().hexdigest(), "last": left == 0, "data": data if with_data else None}
            k += 1
            if not left:
                break


def read_chunks(spark: SparkSession, files: DataFrame, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The records of the archives named in ``files.file`` as rows of at most ``chunk`` payload bytes (columns: ``CHUNKS``).

    record_no counts the records of a file. Every record has a chunk 0, empty if it has no payload; the chunk marked ``last``
    carries the digest and length of the whole payload. Of HTTP records the payload follows the HTTP header, whose
    length field is declared_bytes. A truncated archive is an error. Without ``with_data`` data is NULL.
    """
    import pyspark.sql.pandas.types as pt

    schema = pt.to_arrow_schema(spark.createDataFrame([], CHUNKS).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(name, compression=None) as raw:
                    rows, size = [], 0
                    for row in _records(io.BufferedReader(_Inflated(raw, 1 << 18), 1 << 18), chunk, with_data):
                        rows.append(row | {"file": path})
                        size += len(row["data"] or b"") + 500
                        if size > 8 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file").where("file is not null").repartition(parts, "file").mapInArrow(run, CHUNKS)


def record_table(chunks: DataFrame) -> DataFrame:
    """One row a record: id, payload_bytes, payload_digest, record_type, refers_to; of the whole payload also for revisits.

    A response's figures come from its bytes. A revisit holds no payload: its HTTP header gives the length and
    its WARC header the digest. A response whose bytes do not match the digest it declares is an error.
    """
    whole = chunks.where("last")
    own = F.col("warc_type") == "revisit"
    digest = F.when(own, F.col("declared_digest")).when(
        F.col("declared_digest").isNull() | (F.col("declared_digest") == F.col("digest_so_far")), F.col("digest_so_far")
    ).otherwise(F.raise_error(F.concat(F.lit("digest mismatch in "), F.col("record_id"))))
    id_of = lambda c: F.when(F.startswith(c, F.lit(_ID)), F.substring(c, len(_ID) + 1, 30).cast("long"))
    return whole.select(
        id_of(F.col("record_id")).alias("id"),
        F.when(own, F.col("declared_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        id_of(F.col("refers_to")).alias("refers_to"),
    )


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all pages to archives in the shared folder and return the manifest (file, n_records, n_bytes), stored."""
    return materialize(write_archives(plan_records(pages, id_col, url_col, payload_col), shared_dir(pages.sparkSession)))
