"""WARC archives in Zstandard: one frame for each record, and a dictionary in the leading skippable frame.

Archives are written by the tasks, as rows of a table that holds one archive of bounded size each: any store that Spark
writes to will do, and nothing passes through the driver. They are read from such a table or from .warc.zst files."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Fixed values of the formats: magic numbers of the frame that holds a dictionary, of a plain frame, and of a dictionary.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SLICE, BATCH_BYTES = 4 << 10, 4 << 20  # of an archive that is given to the decompressor at first, and of payloads in a batch of rows
ARCHIVE_BYTES = 8 << 20  # payload of one archive at most, or one record
DICTIONARY_BYTES, DICTIONARY_SAMPLE = 16 << 10, 1 << 20  # size of a dictionary, and of what it is trained on (an archive's first records)
READ = "archive string, at long, warc_type string, record_id string, target_uri string, refers_to_id string, digest string, payload_bytes long, stored_bytes long, payload binary"


class WarcError(ValueError):
    """An archive or a record that is not as its headers say."""


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: named headers, an HTTP block, two line ends. A revisit keeps the HTTP headers, not the payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    clean = "".join(c for c in url or "" if c >= " ")  # no line end may get into a header
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {clean}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_archive(records: list[bytes]) -> bytes:
    """The dictionary in a skippable frame, itself compressed, then a frame for each record."""
    sample, size = [], 0
    for r in records:
        if size >= DICTIONARY_SAMPLE:
            break
        sample.append(r)
        size += len(r)
    try:
        own = zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=3)
    except zstandard.ZstdError:  # too few records to train on: no dictionary, no leading frame
        own = None
    out = []
    if own:
        frame = zstandard.ZstdCompressor(level=3).compress(own.as_bytes())
        out.append(struct.pack("<II", SKIPPABLE, len(frame)) + frame)
    press = zstandard.ZstdCompressor(level=3, dict_data=own, write_content_size=True, write_checksum=True)
    return b"".join(out + [press.compress(r) for r in records])


def load_dictionary(data: bytes) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame, raw or compressed, and where the records start."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE:
        return None, 0
    size = struct.unpack_from("<I", data, 4)[0]
    body = data[8 : 8 + size]
    if len(body) != size or size < 4:
        raise WarcError("the dictionary's frame is cut short")
    if struct.unpack_from("<I", body)[0] == FRAME:
        body = zstandard.ZstdDecompressor().decompress(body)
    if len(body) < 4 or struct.unpack_from("<I", body)[0] != DICTIONARY:
        raise WarcError("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(body), 8 + size


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Where each record's frame starts, and the record. Other skippable frames are passed over."""
    own, at = load_dictionary(data)
    press = zstandard.ZstdDecompressor(dict_data=own) if own else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        if len(data) - at >= 8 and struct.unpack_from("<I", data, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        one, parts, to, size = press.decompressobj(), [], at, SLICE
        try:
            while not one.eof and to < len(data):  # slices, so that what follows a frame is not copied with each
                parts.append(one.decompress(view[to : to + size]))
                to, size = min(to + size, len(data)), min(2 * size, 1 << 20)
        except zstandard.ZstdError as e:
            raise WarcError(f"no frame at byte {at}: {e}") from e
        if not one.eof:
            raise WarcError(f"the frame at byte {at} is cut short")
        yield at, b"".join(parts)
        at = to - len(one.unused_data)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's named headers in lower case, and its block; raises WarcError where headers and lengths do not agree."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] not in (b"WARC/1.0", VERSION):
        raise WarcError("no WARC version line, or no end of the headers")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name.strip():
            raise WarcError(f"not a header: {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not fields.get(name):
            raise WarcError(f"{name} is missing")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError("the block is not as long as Content-Length says")
    block = rest[:-4]
    if fields.get("warc-block-digest", "").startswith("sha1:") and fields["warc-block-digest"][5:] != hashlib.sha1(block).hexdigest():
        raise WarcError("the block does not have its digest")
    return fields, block


def parse_http(fields: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """The payload of an HTTP response block, and how long the full payload is; they differ for a revisit."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        raise WarcError("the block is no HTTP response")
    lengths = [x.split(b":", 1)[1].strip() for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    full = int(lengths[0]) if lengths and lengths[0].isdigit() else len(payload)
    if fields["warc-type"] == "response":
        if full != len(payload):
            raise WarcError("the payload is not as long as its HTTP header says")
        digest = fields.get("warc-payload-digest", "")
        if digest.startswith("sha1:") and digest[5:] != hashlib.sha1(payload).hexdigest():
            raise WarcError("the payload does not have its digest")
    return payload, full


def with_revisits(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", least: int = 1000) -> DataFrame:
    """Adds payload_digest, payload_bytes and refers_to: the largest id of the rows with an equal payload of at least `least` bytes.

    Digests are counted before the shuffle and only those met twice come back, so a payload that a third of all rows
    hold is one row to join. refers_to is null for the row with the largest id (for each, if that id is repeated)."""
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    marked = pages.withColumns({"payload_digest": F.sha1(payload), "payload_bytes": F.length(payload).cast("long")})
    again = marked.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).agg(F.max(id_col).alias("_last"), F.count("*").alias("_n")).where("_n > 1")
    joined = marked.join(again, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    return joined.withColumn("refers_to", F.when(~F.col(id_col).eqNullSafe(F.col("_last")), F.col("_last"))).drop("_digest", "_bytes", "_last", "_n")


def build_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 1000) -> DataFrame:
    """Archives of all pages: columns archive (a name) and content (its bytes), each of bounded size.

    Pages without text have an empty payload; null ids and urls are allowed; repeated rows have a record each."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def flush() -> pa.RecordBatch:
            data = build_archive(waiting)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(data).hexdigest() + ".warc.zst"]), pa.array([data], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for page, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting.append(build_record(page, url, (html or "").encode(), digest, refers))
                size += len(waiting[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    ready = with_revisits(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(text_col).cast("string").alias("html")), "page_id", "html", least)
    return ready.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(build, "archive string, content binary")


def read_archives(archives: DataFrame, name_col: str = "archive", content_col: str = "content", payloads: bool = True) -> DataFrame:
    """Records of archives: one row each, checked against their headers; a broken archive or record fails the job.

    payload_bytes is the length of the full payload, stored_bytes of what the record itself holds (0 for a revisit).
    payloads=False leaves the payload null, once it has been checked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one archive at a time
                name, rows, size = batch.column(0)[i].as_py(), [], 0
                for at, record in frames(batch.column(1)[i].as_py() or b""):
                    fields, block = parse_record(record)
                    payload, full = parse_http(fields, block)
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or hashlib.sha1(payload).hexdigest()
                    rows.append((name, at, fields["warc-type"], fields["warc-record-id"], fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, full, len(payload), payload if payloads else None))
                    size += 500 + len(payload) * payloads
                    if size >= BATCH_BYTES:
                        yield of(rows)
                        rows, size = [], 0
                yield of(rows)

    def of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(columns, r, strict=True)) for r in rows], schema=schema)

    columns = [c.split(" ")[0] for c in READ.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in READ.split(", ")])
    return archives.select(name_col, content_col).mapInArrow(read, READ)


def read_warc_files(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all .warc.zst files under a path of any store that Spark reads."""
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path), "path", "content", payloads)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write all pages as archives to the shared folder, read them back, and return what each record says.

    One row for each page: page_id, payload_bytes, payload_digest, record_type and refers_to."""
    archives = written(build_archives(pages, least=least), "warc")
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")
    return read_archives(archives, payloads=False).select(
        page(F.col("record_id")).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("warc_type").alias("record_type"), page(F.col("refers_to_id")).alias("refers_to"), "target_uri"
    )
