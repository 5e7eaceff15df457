"""WARC archives of individually compressed records that share a Zstandard dictionary.

An archive begins with a skippable frame that embeds the dictionary, made from records all over the archive; one
Zstandard frame per record follows. Records of equal payloads become revisits of the one with the smallest id.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: the magic number of the dictionary's skippable frame, and of a Zstandard frame.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    """SHA-1 in base32, as WARC-Payload-Digest has it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(url: str) -> tuple[str, bool]:
    """The url as a header's value, and whether its control characters (and then also %) had to be percent-encoded."""
    if all(c >= " " and c != "\x7f" for c in url):
        return url, False
    return "".join(f"%{ord(c):02X}" if c < " " or c in "\x7f%" else c for c in url), True


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without the payload if refers_to is given. A null url has no header; one
    with control characters is percent-encoded, as a header of its own then says."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        target, encoded = header_value(url)
        head += [f"WARC-Target-URI: {target}"] + ["X-Target-URI-Encoding: percent"] * encoded
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers of a record, the length that its HTTP header gives, and the payload that it holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers, length, payload


def train(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from the records; from their raw content if they are too few or too much alike to train on."""
    total = sum(map(len, samples))
    if not total:
        return None
    try:
        if len(samples) < 8 or total < 8 * size:
            raise zstandard.ZstdError("too few samples")
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], size: int, level: int, sample_bytes: int) -> bytes:
    """The file's bytes: the skippable frame with the dictionary, then a frame for each record.

    The dictionary is made from every so-manieth record, about sample_bytes together, an eighth of that from one at most.
    """
    step = max(1, -(-sum(map(len, records)) // sample_bytes))
    samples = [r[: max(1, sample_bytes // 8)] for r in records[::step]]
    words = train(samples, size)
    own = words.as_bytes() if words else b""
    press = zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=True)
    return struct.pack("<II", SKIPPABLE, len(own)) + own + b"".join(map(press.compress, records))


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    own = data[8 : 8 + size]
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own) if own else None)
    view, at = memoryview(data), 8 + size
    while at < len(view):
        frame, parts, step = press.decompressobj(), [], 1 << 12
        while not frame.eof:
            piece = view[at : at + step]
            if not len(piece):
                raise ValueError("the last frame is cut off")
            parts.append(frame.decompress(piece))
            at += len(piece)
            step = min(2 * step, 1 << 20)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, payload_digest and refers_to: the smallest id of an equal payload, else null.

    A null html is an empty payload. Payloads under min_bytes refer to nothing. A row with a null id never is referred
    to and is a response; of repeated rows with the smallest id each is a response. The one row per digest is made
    before the shuffle, and Spark splits a digest that holds many rows among tasks of the join.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("payload_digest"))
    first = rows.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    refers = F.when((F.octet_length("html") >= min_bytes) & (F.col("first_id") < F.col("page_id")), F.col("first_id"))
    return rows.join(first.select("payload_digest", "first_id"), "payload_digest", "left").select(
        "page_id", "url", "html", "payload_digest", refers.alias("refers_to")
    )


def write_archives(
    pages: DataFrame, min_bytes: int = 0, archive_bytes: int = 1 << 23, dictionary_bytes: int = 1 << 16, level: int = 3, sample_bytes: int = 1 << 20
) -> DataFrame:
    """Archives of about archive_bytes of records each, a row per file: n_records, archive.

    The dictionary is made from about sample_bytes of the archive's records. export() puts the rows into files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def file() -> pa.RecordBatch:
            data = archive(held, dictionary_bytes, level, sample_bytes)
            return pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([data], pa.binary())], ["n_records", "archive"])

        for batch in batches:
            for page_id, url, html, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(page_id, url, html.encode(), base64.b32encode(sha1).decode(), refers_to))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield file()
                    held, size = [], 0
        if held:
            yield file()

    return revisits(pages, min_bytes).mapInArrow(write, "n_records long, archive binary")


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all archives; of a revisit, payload is null, and so is a url that was null. Digests are checked
    against the payloads."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def number(uri: str | None) -> int | None:
        text = (uri or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("archive").to_pylist():
                rows = []
                for head, length, payload in map(parse, records_of(data)):
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != length or digest_of(payload) != digest):
                        raise ValueError(f"damaged record {head['warc-record-id']}")
                    kept = payload if payloads and kind == "response" else None
                    url = head.get("warc-target-uri")
                    url = unquote(url) if url is not None and "x-target-uri-encoding" in head else url
                    rows.append((number(head["warc-record-id"]), url, kind, length, digest, number(head.get("warc-refers-to")), kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.select("archive").mapInArrow(read, RECORDS)


def export(archives: DataFrame, uri: str) -> None:
    """Write each archive as a .warc.zst file below uri, a folder that every executor reaches."""

    def put(rows: Iterator) -> None:
        from pyarrow import fs

        for row in rows:
            store, path = fs.FileSystem.from_uri(uri)
            name = hashlib.sha1(row.archive).hexdigest()
            with store.open_output_stream(f"{path}/{name}.warc.zst", compression=None) as f:
                f.write(row.archive)

    archives.select("archive").foreachPartition(put)
