"""WARC archives written and read as a table of record chunks, so that no record needs to be in memory as a whole."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portage.llm.common import in_tasks, ship, staged, table
from portage.session import new_work_dir

#: Bytes of payload in one chunk at most. Larger payloads are segmented: continuation records follow the first.
CHUNK = 64 * 1024

#: What stands after a record, and between its header and its block.
END = b"\r\n\r\n"

#: The digits of base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

CHUNK_SCHEMA = (
    "record_id string, page_id long, chunk_no int, n_bytes long, record_type string, refers_to long, digest_so_far string, "
    "said_digest string, total_bytes long, last boolean, data binary"
)


def base32(hexadecimal: Column) -> Column:
    """Base 32 of 160 bits given as 40 hex digits: five hex digits make four base-32 digits."""
    out = []
    for i in range(0, 40, 5):
        number = F.conv(F.substring(hexadecimal, i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def with_record_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``html`` (null as empty), ``payload_digest``, ``record_type`` and ``refers_to`` of every row.

    Of rows with equal payloads of ``least_bytes`` or more the one with the largest page_id is the response, and the
    others refer to it; rows that share that page_id are responses all. Null ids count as smaller than all others;
    where all ids are null each row is a response. Only digests and ids are shuffled, unless payloads that occur more
    than once are too many to send to every task.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    digest = base32(F.sha1(F.col("html").cast("binary")))
    rows = rows.withColumns({"payload_digest": digest, "bytes": F.octet_length("html").cast("long")})
    found = rows.where(F.col("bytes") >= least_bytes).select("page_id", "payload_digest", "bytes")
    shared = staged(
        found.groupBy("payload_digest", "bytes").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and keeper is not null").select("payload_digest", "bytes", "keeper"), "shared-payloads",
    )
    refers = F.col("keeper").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("keeper"), F.lit(False))
    return rows.join(shared, ["payload_digest", "bytes"], "left").select(
        "page_id", "url", "html", "payload_digest", F.when(refers, "revisit").otherwise("response").alias("record_type"),
        F.when(refers, F.col("keeper")).alias("refers_to"),
    )


def record_id(page_id: int | None, digest: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{number}')}>"


def _cut(payload: bytes, size: int) -> Iterator[bytes]:
    """The payload in pieces of at most ``size`` bytes that each are whole UTF-8 characters."""
    at = 0
    while True:
        to = min(len(payload), at + size)
        while to < len(payload) and payload[to] & 0xC0 == 0x80:
            to -= 1
        yield payload[at:to]
        at = to
        if at >= len(payload):
            return


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, size: int) -> Iterator[bytes]:
    """The records of one page, headers and blocks: one, or one per chunk if the payload is larger than a chunk."""
    first = record_id(page_id, digest, 1)
    segmented, done = kind == "response" and len(payload) > size, 0
    for number, block in enumerate(_cut(payload, size) if kind == "response" else [b""], 1):
        done += len(block)
        head = [
            "WARC/1.1", f"WARC-Type: {kind if number == 1 else 'continuation'}",
            f"WARC-Record-ID: {record_id(page_id, digest, number)}", "WARC-Date: 2000-01-01T00:00:00Z",
        ]
        if url:
            # A header line cannot hold control characters or other white space.
            head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
        if page_id is not None:
            head.append(f"Page-ID: {page_id}")
        if number == 1:
            head.append(f"WARC-Payload-Digest: sha1:{digest}")
        if kind == "revisit":
            head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
            head.append(f"WARC-Refers-To: {record_id(refers_to, digest, 1)}")
            head.append(f"Refers-To-Page-ID: {refers_to}")
        if segmented:
            head.append(f"WARC-Segment-Number: {number}")
            if number > 1:
                head.append(f"WARC-Segment-Origin-ID: {first}")
            if done == len(payload):
                head.append(f"WARC-Segment-Total-Length: {done}")
        head.append(f"Content-Length: {len(block)}")
        yield "\r\n".join(head).encode() + END + block


def write_archives(spark: SparkSession, typed: DataFrame, path: str, size: int = CHUNK) -> None:
    """Write the records of ``with_record_types`` as gzipped WARC files, one per task, below ``path``.

    Spark's text sink writes the files: each record is a row, and the blank lines after a record are its line end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for page_id, url, html, digest, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                for record in records(page_id, url, html.encode(), digest, kind, refers_to, size):
                    out.append(record)
                    held += len(record)
                    if held > 8 << 20:
                        yield packed(out)
                        out, held = [], 0
            yield packed(out)

    def packed(out: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    rows = in_tasks(typed.select("page_id", "url", "html", "payload_digest", "record_type", "refers_to"), run, "value string")
    rows.write.mode("overwrite").option("lineSep", END.decode()).option("compression", "gzip").text(path)


class _Stream:
    """A byte stream that is fed in pieces and read by headers and blocks."""

    def __init__(self) -> None:
        self.held = bytearray()

    def header(self) -> dict[str, str] | None:
        """The next header, if all of it has come. None is empty: blank lines alone are the end of a file."""
        end = self.held.find(END)
        if end <= 0:
            return None
        lines = bytes(self.held[:end]).decode().split("\r\n")
        del self.held[: end + len(END)]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins with {lines[0][:60]!r}")
        return {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}

    def ended(self) -> bool:
        """Whether nothing is left but the blank lines that a last piece without its own is given."""
        return self.held in (b"", END)

    def block(self, size: int) -> bytes | None:
        if len(self.held) < size + len(END):
            return None
        found = bytes(self.held[:size])
        del self.held[: size + len(END)]
        return found


def read_chunks(spark: SparkSession, path: str, with_data: bool = False) -> DataFrame:
    """The chunk table of the archives below ``path``: one row per record or segment.

    ``digest_so_far`` is the base-32 SHA-1 of the payload up to and with the chunk: it is carried from chunk to chunk,
    so the last one's is that of the payload, and no payload is put together. A gzipped file is read by one task as a
    stream; text rows between blank lines are joined again and cut by the records' own lengths, so payloads may hold
    blank lines, headers and anything else.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, current, header, state = _Stream(), None, None, None
        for batch in batches:
            out: list[dict] = []
            for file, piece in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if file != current:
                    if header or not stream.ended():
                        raise ValueError(f"{current} ends within a record")
                    stream, current, state = _Stream(), file, None
                stream.held += piece + END
                while True:
                    header = header or stream.header()
                    if header is None:
                        break
                    block = stream.block(int(header["content-length"]))
                    if block is None:
                        break
                    state = _chunk(header, block, state, with_data)
                    out.append(state[0])
                    header = None
                if len(out) >= 512:
                    yield pa.RecordBatch.from_pylist(out, ARROW_SCHEMA)
                    out = []
            yield pa.RecordBatch.from_pylist(out, ARROW_SCHEMA)
        if header or not stream.ended():
            raise ValueError(f"{current} ends within a record")

    lines = spark.read.option("lineSep", END.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return in_tasks(lines, run, CHUNK_SCHEMA)


ARROW_SCHEMA = pa.schema([
    ("record_id", pa.string()), ("page_id", pa.int64()), ("chunk_no", pa.int32()), ("n_bytes", pa.int64()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("digest_so_far", pa.string()), ("said_digest", pa.string()), ("total_bytes", pa.int64()),
    ("last", pa.bool_()), ("data", pa.binary()),
])


def _chunk(header: dict[str, str], block: bytes, before: tuple | None, with_data: bool) -> tuple:
    """The chunk row of a record, with the running digest and length; ``before`` is the chunk read just before."""
    number = int(header.get("warc-segment-number", 1))
    if number == 1:
        origin, digest, total, said = header["warc-record-id"], hashlib.sha1(), 0, header["warc-payload-digest"].partition(":")[2]
        kind = header["warc-type"]
    else:
        row, digest, total = before
        if row["record_id"] != header["warc-segment-origin-id"] or row["chunk_no"] != number - 1:
            raise ValueError(f"segment {number} of {header['warc-segment-origin-id']} does not follow the one before")
        origin, said, kind = row["record_id"], row["said_digest"], row["record_type"]
    digest.update(block)
    total += len(block)
    page, refers = header.get("page-id"), header.get("refers-to-page-id")
    return {
        "record_id": origin, "page_id": int(page) if page else None, "chunk_no": number, "n_bytes": len(block), "record_type": kind,
        "refers_to": int(refers) if refers else None, "digest_so_far": base64.b32encode(digest.digest()).decode(), "said_digest": said,
        "total_bytes": total, "last": "warc-segment-number" not in header or "warc-segment-total-length" in header,
        "data": block if with_data else None,
    }, digest, total


def read_records(chunks: DataFrame) -> DataFrame:
    """One row per record: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    A response's digest and length are what was read; if its digest is not the one its header states, the job fails.
    A revisit's are those of the response that it refers to.
    """
    ends = chunks.where("last").select("page_id", "record_type", "refers_to", "said_digest", "digest_so_far", "total_bytes")
    broken = (F.col("record_type") == "response") & (F.col("said_digest") != F.col("digest_so_far"))
    checked = ends.withColumn("payload_digest", F.when(
        broken, F.raise_error(F.concat(F.lit("damaged payload of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    ).otherwise(F.col("said_digest")))
    checked = staged(checked, "records")
    responses = checked.where("record_type = 'response'").select(
        "page_id", F.col("total_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
    sizes = responses.where("page_id is not null").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    revisits = checked.where("record_type = 'revisit'").join(sizes, ["refers_to", "payload_digest"], "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
    return responses.unionByName(revisits)


def archive_and_read(spark: SparkSession, pages: DataFrame, least_bytes: int = 0, size: int = CHUNK) -> DataFrame:
    """Write every page as a WARC record, read the archives back and return one row per page.

    A null html is an empty payload, which counts like any other; see ``with_record_types`` for what is a revisit.
    Repeated rows are records of their own.
    """
    path = f"{new_work_dir(spark, 'warc')}/archives"
    write_archives(spark, with_record_types(pages, least_bytes), path, size)
    return read_records(read_chunks(spark, path))


def op5_warc(spark, sf_dir):
    return archive_and_read(spark, table(spark, sf_dir, "pages"))
