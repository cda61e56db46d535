"""WARC archives: index first, then sorted, coalesced byte-range reads of the records selected."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import open_folder
from .shared import scratch_path, with_key_columns, written

#: A new archive begins once one has this many bytes.
ARCHIVE_BYTES = 256 << 20
#: Ranges closer than this are read at once, up to the bytes of one read.
GAP_BYTES, READ_BYTES = 64 << 10, 4 << 20
#: Records of so many archive bytes make a unit of reading.
STRIDE_BYTES = 16 << 20
#: Digests that repeat are broadcast up to this many rows (64 bytes each).
BROADCAST_ROWS = 1 << 17
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def classify(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """pages with payload (binary), its size and SHA-1, record_type and refers_to.

    Of equal payloads of at least least_bytes, the row with the largest id is the response and the
    others revisit it; all others are responses. Rows that repeat the response's id are responses too,
    and so are rows without an id (nothing can tell them apart). Null payloads are empty. Other columns than
    the id, url and payload are left out, whatever they are called.

    Only keys are grouped. What is found for digests that repeat is broadcast up to BROADCAST_ROWS rows, so payloads
    stay where they are; beyond it only those of digests that hold few rows are shuffled.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), *([F.col("url").cast("string").alias("url")] if "url" in pages.columns else [F.lit(None).cast("string").alias("url")]), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    keys = ["payload_digest", "payload_bytes"]
    largest = rows.where(F.col("payload_bytes") >= least_bytes).select("page_id", *keys).groupBy(*keys).agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("copies"))
    largest = written(pages.sparkSession, largest.where("copies > 1 AND target IS NOT NULL"), "repeated-payloads")
    if largest.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(largest), keys, "left")
    else:
        joined = with_key_columns(rows, largest, keys, "copies", rows.count())
    revisit = F.col("target").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("target"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("target")).alias("refers_to"))


def _target(url: str | None, page_id: object) -> str:
    url = "".join(c for c in url or "" if c.isprintable() and c != " ")
    return url or f"urn:page:{page_id}"


def record(row: dict) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but its digest and size."""
    body = row["payload"] if row["record_type"] == "response" else b""
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_target(row['url'], row['page_id'])}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8", f"X-Page-ID: {'' if row['page_id'] is None else row['page_id']}", f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-ID: {row['refers_to']}"]
    return ("\r\n".join([*head, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length")
    return fields, rest[:n]


def write_archives(spark: SparkSession, classified: DataFrame, folder: str) -> DataFrame:
    """Writes a gzip member per record and returns the index, itself written to the shared folder.

    The index has page_id, url, payload_digest, record_type, refers_to, archive, offset and length. A task writes
    archives of names of its own, so only those of the attempt that succeeded are in the index.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                names, offsets, lengths = [], [], []
                for i in range(batch.num_rows):
                    row = {k: batch.column(k)[i].as_py() for k in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")}
                    press = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = press.compress(record(row)) + press.flush()
                    if out is None or at >= ARCHIVE_BYTES:
                        if out:
                            out.close()
                        name, at = f"{path}/{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(name, compression=None)
                    out.write(member)
                    names.append(name)
                    offsets.append(at)
                    lengths.append(len(member))
                    at += len(member)
                kept = [batch.column(k) for k in ("page_id", "url", "payload_digest", "record_type", "refers_to")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=columns)
        finally:
            if out:
                out.close()

    columns = ["page_id", "url", "payload_digest", "record_type", "refers_to", "archive", "offset", "length"]
    kind = classified.schema["page_id"].dataType.simpleString()
    index = classified.mapInArrow(write, f"page_id {kind}, url string, payload_digest string, record_type string, refers_to {kind}, archive string, offset long, length long")
    return written(spark, index, "warc-index")


def read_records(index: DataFrame, folder: str, with_payload: bool = False, strict: bool = False) -> DataFrame:
    """The records at the index's rows, read in few, sorted, coalesced ranges and held against their digests.

    Returns page_id and refers_to of the index, payload_bytes and payload_digest (hex), made anew from the payload
    of a response and as the record says for a revisit, its record_type, and the payload where wanted (null for
    revisits). With strict, a record that differs from its own header or from the index is an error; else the
    column matches tells.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(folder)
        opened, f = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in ("archive", "offset", "length", "payload_digest", "record_type"))))
            lo = 0
            while lo < len(rows):
                archive, begin, length = rows[lo][:3]
                hi, end = lo + 1, begin + length
                while hi < len(rows) and rows[hi][0] == archive and rows[hi][1] <= end + GAP_BYTES and rows[hi][1] + rows[hi][2] - begin <= READ_BYTES:
                    end = max(end, rows[hi][1] + rows[hi][2])
                    hi += 1
                if opened != archive:
                    opened, f = archive, system.open_input_file(archive)
                raw = memoryview(f.read_at(end - begin, begin))
                sizes, digests, kinds, good, bodies = [], [], [], [], []
                for _, at, n, digest, kind in rows[lo:hi]:
                    fields, body = parse(zlib.decompress(raw[at - begin : at - begin + n], 31))
                    said = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    response = fields["WARC-Type"] == "response"
                    sizes.append(len(body) if response else int(fields["X-Payload-Length"]))
                    digests.append(hashlib.sha1(body).hexdigest() if response else said)
                    kinds.append(fields["WARC-Type"])
                    good.append(digests[-1] == said == digest and kind == kinds[-1] and sizes[-1] == int(fields["X-Payload-Length"]))
                    if strict and not good[-1]:
                        raise ValueError(f"the record at {at} of {archive} is not what the index has")
                    bodies.append(body if response and with_payload else None)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(kinds, pa.string()), part.column("refers_to"), pa.array(good, pa.bool_()), pa.array(bodies, pa.binary())],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "matches", "payload"],
                )
                lo = hi

    kind = index.schema["page_id"].dataType.simpleString()
    dealt = index.withColumn("stride", F.floor(F.col("offset") / STRIDE_BYTES)).repartition("archive", "stride").sortWithinPartitions("archive", "offset").drop("stride")
    return dealt.mapInArrow(read, f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, matches boolean, payload binary")


def archive_pages(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """Writes every page to archives in the shared folder, then reads each record back through the index.

    One row a row of pages (repeated rows too, an empty table gives none), as classify() and read_records() say;
    a damaged record is an error.
    """
    folder = scratch_path(spark, "warc")
    index = write_archives(spark, classify(pages, id_col, payload_col, least_bytes), folder)
    return read_records(index, folder, strict=True).withColumnRenamed("page_id", id_col)
