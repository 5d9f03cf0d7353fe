"""WARC archives in Zstandard frames: written and read by executors, one frame for each record, with the dictionary in a leading skippable frame.

A record is a response with the whole payload, or a revisit of the response whose payload (of at least REVISIT bytes) is equal and whose page_id is the
largest of that payload. A reader takes the dictionary from the first frame, decodes one frame for each record and checks version line, headers,
Content-Length, the closing line ends and the payload's digest; anything else raises ValueError.

Files lie in the folder that all executors share, under names of their own for each attempt; only those of committed attempts are in the manifest, so a task
that runs again leaves nothing behind that is read.

Defined cases: a null html is the empty payload. A row with a null page_id is a response and is never revisited. Rows that share the largest page_id and
the payload are all responses. URLs lose their control characters; a null url gives no WARC-Target-URI.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, new_path, small_batches, table

REVISIT, ROLL = 1000, 64 << 20
SAMPLES, SAMPLE_BYTES, DICTIONARY = 256, 4 << 20, 64 << 10  # of what a task reads first, for its dictionary
SKIPPABLE = 0x184D2A5D  # fixed value: the frame that holds a dictionary in this format
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; refers_to: the page whose response holds the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, hashlib.sha256(payload).hexdigest())}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]+", "", url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode())
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"not a header: {line[:80]!r}")
        out[name.decode("ascii").lower()] = value.strip().decode("utf-8", "replace")
    return out


def parsed(frame: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """page_id, payload length, hex digest, record type, refers_to and, for a response, the payload of the one record in frame."""
    head, gap, rest = frame.partition(b"\r\n\r\n")
    if not gap or not head.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        raise ValueError("a frame doesn't begin with a WARC version")
    h = headers(head)
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - h.keys()
    if missing:
        raise ValueError(f"missing headers: {sorted(missing)}")
    size = int(h["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {size}, the frame holds {len(rest) - 4}")
    kind = h["warc-type"]
    if kind not in ("response", "revisit"):
        raise ValueError(f"record type {kind}")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    length = int(headers(http)["content-length"])
    algorithm, _, digest = h["warc-payload-digest"].partition(":")
    raw = base64.b32decode(digest)
    if algorithm != "sha1" or len(raw) != 20 or not gap:
        raise ValueError("no SHA-1 payload digest or no HTTP head")
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).digest() != raw):
        raise ValueError("the payload isn't what its digest and length say")
    if kind == "revisit" and (payload or "warc-refers-to" not in h):
        raise ValueError("a revisit with a payload or without what it refers to")
    return _page(h["warc-record-id"]), length, raw.hex(), kind, _page(h["warc-refers-to"]) if kind == "revisit" else None, payload if kind == "response" else None


def _page(name: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name)
    return int(m[1]) if m else None


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on samples; where they are too few or too alike to train on, the samples themselves, cut to size."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY] or b"WARC/1.1\r\n"


class Writer:
    """Archives of at most about ROLL bytes in one folder."""

    def __init__(self, folder: str, samples: list[bytes]) -> None:
        self.fs, self.folder = filesystem(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.dict = dictionary(samples)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(self.dict), write_checksum=True)
        self.out, self.done = None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
            self.out, self.records = self.fs.open_output_stream(self.name, compression=None), 0
            packed = zstandard.ZstdCompressor().compress(self.dict)
            self.size = self.out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        self.size += self.out.write(self.packer.compress(data))
        self.records += 1
        if self.size >= ROLL:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.records, self.size))
            self.out = None


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"\w+:/", folder):
        return pafs.FileSystem.from_uri("file://" + folder[5:] if re.match(r"file:/[^/]", folder) else folder)
    return pafs.LocalFileSystem(), folder


def frames(stream) -> Iterator[bytes]:
    """The decoded records of an archive, one after another, with no more than one record and one block in memory."""
    block = stream.read(1 << 20)
    if len(block) < 8 or struct.unpack("<I", block[:4])[0] != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    size = struct.unpack("<I", block[4:8])[0]
    while len(block) < 8 + size:
        more = stream.read(1 << 20)
        if not more:
            raise ValueError("the dictionary frame is cut off")
        block += more
    held, block = block[8 : 8 + size], block[8 + size :]
    if held[:4] == b"\x28\xb5\x2f\xfd":
        held = zstandard.ZstdDecompressor().decompress(held)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
    while block or (block := stream.read(1 << 20)):
        one, parts = unpacker.decompressobj(), []
        while True:
            parts.append(one.decompress(block))
            if one.eof:
                block = one.unused_data
                break
            block = stream.read(1 << 20)
            if not block:
                raise ValueError("the last frame is cut off")
        yield b"".join(parts)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html) below folder; gives the manifest (file, records, bytes) of committed files."""
    small_batches(pages.sparkSession)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("key", F.sha2("payload", 256))
    equal = rows.where(f"octet_length(payload) >= {REVISIT} and page_id is not null").groupBy("key").agg(F.max("page_id").alias("held"), F.count("*").alias("n")).where("n > 1").select("key", "held")
    rows = rows.join(maybe_broadcast(table(equal, "equal-payloads")), "key", "left")
    rows = rows.select("page_id", "url", "payload", F.when(F.col("held") != F.col("page_id"), F.col("held")).alias("refers_to"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for part in parts:
            made = [record(*row) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)]
            if writer is None and made:
                sample, size = [], 0
                for m in made[:SAMPLES]:
                    sample.append(m[: SAMPLE_BYTES // SAMPLES])
                writer = Writer(folder, sample)
            for m in made:
                writer.add(m)
        if writer is not None:
            writer.close()
            names, records, sizes = zip(*writer.done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "records", "bytes"])

    return table(rows.mapInArrow(run, "file string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload of every record of the manifest's files."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for part in parts:
            for name, records in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                rows, size, seen = [], 0, 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for frame in frames(stream):
                        row = parsed(frame)
                        rows.append(row if payloads else (*row[:5], None))
                        seen += 1
                        size += len(frame) if payloads else 200
                        if size > 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if seen != records:
                    raise ValueError(f"{name} holds {seen} records, not {records}")
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    out = manifest.select("file", "records").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return out if payloads else out.drop("payload")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
