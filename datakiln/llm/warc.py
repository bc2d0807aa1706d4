"""WARC archives: a writer with identical-payload revisits and a sequential reader.

Writing: one gzip member per record. A page becomes a response record whose block is an HTTP response with the page's HTML
in UTF-8 as payload. Of pages with equal payloads of LEAST bytes or more, the one with the smallest page_id is stored and
the others are revisit records that refer to it. Each task writes files of its own under a temporary name and renames
them when they are whole; a repeated task writes the same files again.

Reading: a file is a stream. Members are decompressed a block at a time; the header gives the content length, which frames
the block; payload and block digests are computed while bytes pass and must match; a member must hold exactly one record.

Defined results: a null html is the empty payload. A null page_id is written as null and comes after all others in the
choice of a response; of repeated rows one is the response. A null url is written as about:blank. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.llm.common import new_folder, numbered, saved, table

LEAST = 100
#: Compressed bytes after which a task begins another file, and bytes read or decompressed at once.
FILE_BYTES, BLOCK = 256 << 20, 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload_bytes: int
    payload_digest: str
    payload: bytes | None = None


def _value(text: str) -> str:
    """A header value: control characters cannot stand in one."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record_bytes(record_id: str, url: str | None, payload: bytes, refers_to: str | None = None, date: str = DATE) -> bytes:
    """One record as a gzip member; with refers_to a revisit, which has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
    block = http if refers_to else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_value(url or 'about:blank')}",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + END + block + END) + packer.flush()


class _Members:
    """Bytes of one gzip member after the other, decompressed as they are asked for."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.out, self.unzip = stream, b"", b"", None

    def next_member(self) -> bool:
        """Goes to the next member; False at the end of the file. The last one must be used up."""
        if self.unzip is not None and (self.out or self.take(1)):
            raise ValueError("a gzip member holds more than its record")
        if not self.raw:
            self.raw = self.stream.read(BLOCK)
        self.unzip = zlib.decompressobj(31)
        return bool(self.raw)

    def _more(self) -> bool:
        while not self.unzip.eof:
            self.raw = self.raw or self.stream.read(BLOCK)
            if not self.raw:
                raise ValueError("the file ends inside a gzip member")
            got = self.unzip.decompress(self.raw, BLOCK)
            self.raw = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
            if got:
                self.out += got
                return True
        return False

    def take(self, n: int) -> bytes:
        """Up to n bytes, at least one unless the member has ended."""
        if not self.out:
            self._more()
        got, self.out = self.out[:n], self.out[n:]
        return got

    def until(self, mark: bytes) -> bytes:
        """The bytes before mark, which may be many: a header is as long as its target."""
        start = 0
        while (at := self.out.find(mark, start)) < 0:
            start = max(0, len(self.out) - len(mark) + 1)  # what was searched needn't be again
            if not self._more():
                raise ValueError("a record header does not end")
        got, self.out = self.out[:at], self.out[at + len(mark) :]
        return got


def _fields(header: bytes, first: str) -> dict[str, str]:
    lines = header.decode().split("\r\n")
    if not lines[0].startswith(first):
        raise ValueError(f"a record does not begin with {first}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_records(stream, keep_payload: bool = True) -> Iterator[Record]:
    """Records of a WARC file of one gzip member each; a damaged one raises ValueError."""
    members = _Members(stream)
    while members.next_member():
        headers = _fields(members.until(END), "WARC/1.")
        left = int(headers["content-length"])
        block, head = hashlib.sha256(), b""
        while END not in head and left:
            got = members.take(min(left, BLOCK))
            if not got:
                raise ValueError("a block is shorter than its content length")
            block.update(got)
            head += got
            left -= len(got)
        http, _, body = head.partition(END)
        payload, n, kept = hashlib.sha256(body), len(body), [body]
        while left:
            got = members.take(min(left, BLOCK))
            if not got:
                raise ValueError("a block is shorter than its content length")
            block.update(got)
            payload.update(got)
            n += len(got)
            left -= len(got)
            if keep_payload:
                kept.append(got)
        if members.until(END):
            raise ValueError("a block is longer than its content length")
        fields = _fields(http, "HTTP/")
        if f"sha256:{block.hexdigest()}" != headers["warc-block-digest"]:
            raise ValueError(f"{headers['warc-record-id']}: the block does not match its digest")
        digest = headers["warc-payload-digest"].removeprefix("sha256:")
        if headers["warc-type"] == "revisit":
            n = int(fields["content-length"])  # of the payload that it refers to
        elif payload.hexdigest() != digest or n != int(fields["content-length"]):
            raise ValueError(f"{headers['warc-record-id']}: the payload does not match its digest")
        yield Record(headers, fields, n, digest, b"".join(kept) if keep_payload else None)


def write_archives(pages: DataFrame, path: str, least: int = LEAST) -> DataFrame:
    """Writes (page_id, url, html) rows as .warc.gz files below path; returns the written manifest: file, n_records, n_bytes."""
    rows = numbered(pages.select("page_id", "url", "html")).withColumn("html", F.coalesce("html", F.lit("")))
    slim = saved(
        rows.select("row", "page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("n")).where(F.col("n") >= least),
        "payloads",
    )
    firsts = slim.groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("first"), F.count("*").alias("copies")
    ).where("copies > 1")
    refers = slim.select("row", "digest").join(firsts, "digest").where("row <> first.row").select(
        "row", F.struct("first.page_id", "first.row").alias("refers")
    )
    schema = "file string, n_records long, n_bytes long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        name = f"part-{context.partitionId():06d}"
        out, temp, records, size, done = None, "", 0, 0, []

        def close() -> None:
            out.close()
            final = f"{name}-{len(done):04d}.warc.gz"
            if fs.get_file_info(f"{base}/{final}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{base}/{final}")  # of an earlier attempt of this task
            fs.move(temp, f"{base}/{final}")
            done.append({"file": f"{path}/{final}", "n_records": records, "n_bytes": size})

        for batch in batches:
            for page_id, url, html, row, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "row", "refers"))):
                page_id, row, refers = page_id.as_py(), row.as_py(), refers.as_py()
                if out is None:
                    temp, records, size = f"{base}/.{name}-{len(done):04d}.{context.taskAttemptId()}", 0, 0
                    out = fs.open_output_stream(temp, compression=None)
                member = record_bytes(
                    _name(page_id, row), url.as_py(), html.as_py().encode(), _name(refers["page_id"], refers["row"]) if refers else None
                )
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist(
            done, schema=pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
        )

    return saved(
        rows.join(refers, "row", "left").select("page_id", "url", "html", "row", "refers").mapInArrow(write, schema),
        "manifest",
        f"{path}/manifest",
    )


def _name(page_id: int | None, row: dict[str, int]) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}:{row['file']}:{row['at']}"


RECORDS = "page_id long, record string, payload_bytes long, payload_digest string, record_type string, refers string"


def read_archives(files: DataFrame) -> DataFrame:
    """A row of RECORDS per record of the files named in column file; n_records there is checked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("page_id", pa.int64()),
                ("record", pa.string()),
                ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()),
                ("record_type", pa.string()),
                ("refers", pa.string()),
            ]
        )
        for batch in batches:
            for file, expected in zip(batch.column("file").to_pylist(), batch.column("n_records").to_pylist()):
                fs, inside = pafs.FileSystem.from_uri(file)
                rows, count = [], 0
                with fs.open_input_stream(inside, compression=None) as stream:
                    for r in read_records(stream, keep_payload=False):
                        record = r.headers["warc-record-id"].strip("<>")
                        page = record.split(":")[2]
                        rows.append(
                            {
                                "page_id": None if page == "null" else int(page),
                                "record": record,
                                "payload_bytes": r.payload_bytes,
                                "payload_digest": r.payload_digest,
                                "record_type": r.headers["warc-type"],
                                "refers": r.headers.get("warc-refers-to", "").strip("<>") or None,
                            }
                        )
                        count += 1
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                if count != expected:
                    raise ValueError(f"{file} holds {count} records, {expected} were written")

    return files.select("file", "n_records").repartition(
        files.sparkSession.sparkContext.defaultParallelism, "file"
    ).mapInArrow(read, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Records with refers_to: the page_id of the response, which must exist and have the revisit's payload digest and length."""
    responses = records.where("record_type = 'response'").select(
        F.col("record").alias("target"),
        F.col("page_id").alias("refers_to"),
        F.col("payload_digest").alias("d"),
        F.col("payload_bytes").alias("b"),
    )
    met = records.join(responses, F.col("refers") == F.col("target"), "left")
    sound = F.col("refers").isNull() | (F.col("d").eqNullSafe(F.col("payload_digest")) & F.col("b").eqNullSafe(F.col("payload_bytes")))
    digest = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error("a revisit refers to no equal payload").cast("string"))
    return met.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return resolved(saved(read_archives(manifest), "records"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, row_number() OVER w AS rn, first_value(page_id) OVER w AS first FROM q
      WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN rn > 1 AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN rn > 1 AND payload_bytes >= 100 THEN first END AS refers_to
FROM r
"""
