"""WARC archives compressed with Zstandard.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, and has one frame per record after
it, so any record can be read alone. The writer gives equal payloads one response, of the smallest page_id, and makes the
others revisits of it. The reader loads the dictionary, decodes frame by frame and checks each record's version line,
mandatory headers, block length, end and payload digest.

Cases: null payloads count as empty; a null url as about:blank. With duplicate rows of the smallest page_id each is a
response. Payloads under min_bytes bytes are all responses. A null page_id never becomes the one that others refer to,
unless there is no other. No rows give no archives and no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize

# Fixed values of the formats.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

#: Uncompressed bytes after which a task begins another archive; sizes of dictionary and of what it is trained on.
ARCHIVE_BYTES, DICTIONARY_BYTES, TRAINING_BYTES = 16 << 20, 16 << 10, 1 << 20


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        """Headers and payload of the HTTP response in the block."""
        head, mark, payload = self.block.partition(b"\r\n\r\n")
        if not mark or not head.startswith(b"HTTP/"):
            raise ValueError("the block is no HTTP response")
        return fields(head.split(b"\r\n")[1:]), payload


def fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, mark, value = line.decode().partition(":")
        if not mark:
            raise ValueError(f"no header: {line[:80]!r}")
        out[name.strip()] = value.strip()
    return out


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object) -> str:
    return f"<urn:quillspark:page:{page_id}>"


def write_record(page_id: object, url: str | None, payload: bytes, own: str, refers_to: object = None) -> bytes:
    """A response record, or a revisit with the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{own}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> bytes:
    """A dictionary from the first records; where there is too little to train on, those bytes themselves."""
    samples, total = [], 0
    for r in records:
        samples.append(r[:8192])
        total += len(samples[-1])
        if total > TRAINING_BYTES:
            break
    try:
        if len(samples) >= 16:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        pass
    return b"".join(samples)[:DICTIONARY_BYTES]


def dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    if data[:4] == struct.pack("<I", FRAME):  # the frame may hold the dictionary compressed
        data = zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 27)
    kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == struct.pack("<I", DICTIONARY) else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind)


def write_archive(records: list[bytes]) -> bytes:
    words = train(records)
    press = zstandard.ZstdCompressor(level=3, dict_data=dictionary(words) if words else None, write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(words)), words, *map(press.compress, records)])


def parse_record(data: bytes) -> Record:
    """One record, with everything checked that the format promises."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ValueError(f"no WARC record: {data[:40]!r}")
    headers = fields(lines[1:])
    if missing := [h for h in MANDATORY if h not in headers]:
        raise ValueError(f"headers are missing: {missing}")
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes, its header says {size}")
    record = Record(headers, rest[:size])
    if headers["WARC-Type"] == "response":
        http, payload = record.http
        if int(http["Content-Length"]) != len(payload):
            raise ValueError("the payload's length differs from its header")
        if headers.get("WARC-Payload-Digest", "") != f"sha1:{digest(payload)}":
            raise ValueError("the payload's digest differs from its header")
    elif headers["WARC-Type"] == "revisit" and "WARC-Refers-To" not in headers:
        raise ValueError("a revisit refers to nothing")
    return record


def read_archive(data: bytes) -> Iterator[Record]:
    """Records of an archive, one frame each."""
    view, at, words = memoryview(data), 0, None
    while at + 8 <= len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == SKIPPABLE and at == 0 and size:
                words = dictionary(bytes(view[8 : 8 + size]))
            at += 8 + size
            if at > len(view):
                raise ValueError("a skippable frame is cut off")
            continue
        if magic != FRAME:
            raise ValueError(f"no frame at byte {at}")
        unpack = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
        frame = unpack.decompressobj()
        out = [frame.decompress(view[at : at + (1 << 16)])]
        to = at + (1 << 16)
        while not frame.eof:
            if to >= len(view):
                raise ValueError("a frame is cut off")
            out.append(frame.decompress(view[to : to + (1 << 20)]))
            to += 1 << 20
        at = min(to, len(view)) - len(frame.unused_data)
        yield parse_record(b"".join(out))
    if at != len(view):
        raise ValueError("bytes are left after the last frame")


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary), digest, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                payloads = [(x or "").encode() for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(payloads, pa.binary()), pa.array(list(map(digest, payloads)), pa.string()), pa.array(list(map(len, payloads)), pa.int64())], names=["page_id", "url", "payload", "digest", "size"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, payload binary, digest string, size long")


def write(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives of all pages: name and content. pages: page_id, url, html."""
    every = with_digests(pages)
    keys = materialize(every.select("page_id", "digest", "size"), "digests")
    first = materialize(keys.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    # only ids and digests meet by digest, which many pages can share; payloads meet what they refer to by their own id
    again = keys.join(first, ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("of"), F.col("digest").alias("own"), "first").distinct()
    marked = every.join(again, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("own")), "left").select("page_id", "url", "payload", "digest", F.col("first").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(records: list[bytes]) -> pa.RecordBatch:
            data = write_archive(records)
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{hashlib.sha256(data).hexdigest()[:24]}.warc.zst"]), pa.array([data], pa.binary())], names=["name", "content"])

        records, total = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                page, url, payload, own, refers = (batch.column(c)[k].as_py() for c in range(5))
                records.append(write_record(page, url, payload, own, refers))
                total += len(records[-1])
                if total > ARCHIVE_BYTES:
                    yield out(records)
                    records, total = [], 0
        if records:
            yield out(records)

    return marked.mapInArrow(run, "name string, content binary")


def read(archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Records of archives (a column content, as of Spark's binaryFile source or of write()). payload is null for revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                for r in read_archive(data.as_py() or b""):
                    http, payload = r.http
                    kind = r.headers["WARC-Type"]
                    rows.append((r.headers["WARC-Record-ID"], r.headers.get("WARC-Target-URI"), kind, int(http["Content-Length"]), r.headers["WARC-Payload-Digest"].removeprefix("sha1:"), r.headers.get("WARC-Refers-To"), payload if kind == "response" and keep_payload else None))
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return archives.select("content").mapInArrow(run, "record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back, a row per page."""
    archives = materialize(write(pages, min_bytes), "warc", "uncompressed")
    kind = dict(pages.dtypes)["page_id"]

    def page(c: str) -> Column:
        return F.regexp_extract(c, r"page:(.*)>", 1).try_cast(kind)

    return read(archives, keep_payload=False).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
