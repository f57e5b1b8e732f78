"""WARC archives compressed with Zstandard: one frame for each record, with a shared dictionary.

An archive begins with a skippable frame that holds the dictionary; each record is a frame of its own.
Archives are written and read by Spark's file sources, so they can lie in any store, and a lost task
leaves nothing behind. Spark's writer puts a separator behind each row; it is an empty skippable frame
here, which readers pass over.

The reader takes the dictionary from the leading frame, decodes a frame at a time and checks each
record: version line, header fields, lengths and digests. What is wrong with a record is said in its
``error``; the records before it in the archive are not touched by it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.llm.features import low_hashes
from ledgermatch.sources.rounds import RunFolder

# Fixed values of the formats.
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY_FRAME = b"\x5d\x2a\x4d\x18"
EMPTY_FRAME = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
DICTIONARY = b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

LEVEL = 9
#: Dictionary size; pages, and bytes of each, that it is trained on at most.
DICTIONARY_BYTES = 64 << 10
SAMPLE_PAGES = 400
SAMPLE_BYTES = 16 << 10
_STEP = 1 << 14


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=xxhash.xxh3_128_digest(f'page {page_id}'))}>"


def _uri(url: str | None, page_id: int | None) -> str:
    return (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str = DATE) -> bytes:
    """A record's bytes. ``first``: the page whose response it revisits, if it does."""
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url, page_id)),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(first)), ("WARC-Refers-To-Page", str(first))]
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields)])
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(pages: DataFrame, text: str = "html") -> bytes | None:
    """From a bounded sample of pages, by hash; None if there are too few to train on."""
    some = pages.where(F.octet_length(text) > 0).select(F.xxhash64(text).alias("h"), F.col(text).alias("s"))
    some = low_hashes(some, F.col("h"), SAMPLE_PAGES).select("h", F.substring("s", 1, SAMPLE_BYTES).alias("s"))
    some = some.groupBy("h").agg(F.min("s").alias("s")).orderBy("h").limit(SAMPLE_PAGES)
    data = [r.s.encode() for r in some.collect()]
    samples = [record(k, None, x, None) for k, x in enumerate(data)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if samples else None
    except zstandard.ZstdError:
        return None


def write_archives(pages: DataFrame, path: str, least: int = 0, dictionary: bytes | None = None) -> None:
    """Write page_id, url and html of each row as a record, below ``path``, an archive for each task.

    Of rows with equal html (null as empty) of at least ``least`` bytes, those with the smallest page_id
    are responses and the others revisit it; smaller ones are all responses. Rows with a null page_id
    revisit too, but are never revisited. Repeated rows of the smallest page_id are all responses. A null
    url becomes a URN. Other columns are not read.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    shared = (
        rows.where(F.octet_length("html") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    # A table of its own: the join is then a plain one, of which Spark splits a payload with very many rows.
    shared = RunFolder(pages.sparkSession).scratch(shared)
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.join(shared, "digest", "left").select("page_id", "url", "html", first.alias("first"))

    def frames(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(
            level=LEVEL,
            write_checksum=True,
            dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None,
        )
        begun = dictionary is None
        for batch in batches:
            out = [] if begun or not batch.num_rows else [_leading(dictionary)]
            begun = begun or batch.num_rows > 0
            columns = (batch.column("page_id"), batch.column("url"), batch.column("html"), batch.column("first"))
            for page_id, url, html, first in zip(*(c.to_pylist() for c in columns), strict=True):
                out.append(packer.compress(record(page_id, url, html.encode(), first)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    written = rows.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    written.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 0).text(path)


def _leading(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return DICTIONARY_FRAME + len(packed).to_bytes(4, "little") + packed


class Damaged(ValueError):
    """What is wrong with an archive or a record."""


def decode(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each frame of an archive."""
    at, dictionary = 0, None
    if data[:4] == DICTIONARY_FRAME:
        size = int.from_bytes(data[4:8], "little")
        raw = data[8 : 8 + size]
        if len(raw) < size:
            raise Damaged("dictionary cut off")
        if raw[:4] == FRAME:
            try:
                raw = zstandard.ZstdDecompressor().decompress(raw)
            except zstandard.ZstdError as e:
                raise Damaged(f"dictionary: {e}") from e
        if raw[:4] != DICTIONARY:
            raise Damaged("no dictionary in the leading frame")
        dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + size
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        if data[at + 1 : at + 4] == b"\x2a\x4d\x18" and data[at] >> 4 == 5:
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        start, parts, frame = at, [], unpacker.decompressobj()
        try:
            while not frame.eof:
                piece = data[at : at + _STEP]
                if not piece:
                    raise Damaged("frame cut off")
                parts.append(frame.decompress(piece))
                at += len(piece)
        except zstandard.ZstdError as e:
            raise Damaged(f"frame: {e}") from e
        at -= len(frame.unused_data)
        yield start, b"".join(parts)


def parse(data: bytes) -> dict[str, object]:
    """A record's fields; raises :class:`Damaged`."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] not in (b"WARC/1.0", b"WARC/1.1") or not found:
        raise Damaged("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        key, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or key.lower() in fields:
            raise Damaged(f"header field {key[:40]!r} is broken or given twice")
        fields[key.lower()] = value.strip()
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in fields:
            raise Damaged(f"no {key}")
    if not fields["content-length"].isdigit():
        raise Damaged("Content-Length is no number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise Damaged(f"Content-Length is {size}, the block has {len(rest) - 4} bytes")
    block = rest[:size]
    if fields.get("warc-block-digest", want := f"sha1:{base32_sha1(block)}") != want:
        raise Damaged("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    said = int(sizes[0]) if sizes and sizes[0].strip().isdigit() else None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response":
        if said not in (None, len(payload)):
            raise Damaged(f"HTTP Content-Length is {said}, the payload has {len(payload)} bytes")
        if digest and digest != base32_sha1(payload):
            raise Damaged("payload digest differs")
        said, digest = len(payload), base32_sha1(payload)
    elif fields["warc-type"] == "revisit" and (not digest or "warc-refers-to" not in fields):
        raise Damaged("revisit without payload digest or reference")
    return {
        "record_type": fields["warc-type"],
        "page_id": int(fields["warc-page-id"]) if "warc-page-id" in fields else None,
        "uri": fields.get("warc-target-uri"),
        "payload": payload if fields["warc-type"] == "response" else None,
        "payload_bytes": said,
        "payload_digest": digest or None,
        "refers_to": int(fields["warc-refers-to-page"]) if "warc-refers-to-page" in fields else None,
    }


_FIELDS = ("record_type", "page_id", "uri", "payload", "payload_bytes", "payload_digest", "refers_to")


def records_of(data: bytes) -> Iterator[dict[str, object]]:
    """Records of one archive; a damaged one has its offset and error only. Where a frame can't be
    decoded, the archive ends with that error."""
    frames, last = decode(data), 0
    while True:
        try:
            last, content = next(frames)
            yield {"offset": last, "error": None, **parse(content)}
        except StopIteration:
            return
        except Damaged as e:
            yield {"offset": last, "error": str(e), **dict.fromkeys(_FIELDS)}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives below ``path``: archive, offset, error, record_type,
    page_id, uri, payload, payload_bytes, payload_digest and refers_to. Sizes and digests of revisits
    are those of the full payload. An archive is decoded as a whole by one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for row in records_of(content.as_py()):
                    rows.append({"archive": path.as_py(), **row})
                    size += len(row["payload"] or b"")
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return files.mapInArrow(
        run,
        "archive string, offset bigint, error string, record_type string, page_id bigint, uri string,"
        " payload binary, payload_bytes bigint, payload_digest string, refers_to bigint",
    )


_SCHEMA = pa.schema(
    [
        ("archive", pa.string()),
        ("offset", pa.int64()),
        ("error", pa.string()),
        ("record_type", pa.string()),
        ("page_id", pa.int64()),
        ("uri", pa.string()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
    ]
)


def restored(records: DataFrame) -> DataFrame:
    """page_id and payload of all records, those of revisits from the responses that they refer to."""
    sound = records.where("error is null")
    first = sound.where("record_type = 'response' and page_id is not null").select(
        F.col("page_id").alias("first"), F.col("payload").alias("shared")
    )
    first = first.dropDuplicates(["first"])
    joined = sound.join(first, F.col("refers_to") == F.col("first"), "left")
    return joined.select("page_id", F.coalesce("payload", "shared").alias("payload"))
