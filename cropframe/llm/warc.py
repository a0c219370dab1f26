"""WARC archives in Zstandard, one frame per record, with a dictionary in front.

An archive is a sequence of Zstandard frames. The first is a skippable frame
(magic 0x184D2A5D) that holds the dictionary, itself compressed; then each
record is a frame of its own, compressed with that dictionary, so that a reader
can start at any record. Spark's text writer puts the archives on whatever file
system the job uses: a row is a frame, and the line separator is an empty
skippable frame, which every Zstandard reader passes over.

Writing is one pass over the pages after a join that marks repeated payloads;
reading is one task per archive. Nothing passes through the driver.

Defined results
* null html: an empty payload; null url: no target URI; null page id: a record
  without a page id, never the response that others refer to, nor a revisit;
* payloads under ``min_revisit`` bytes are always written in full;
* rows that repeat a page id with the same payload: each is a record; those
  with the smallest id are all responses;
* very long payloads: one frame each, of any length the reader's limit allows;
* empty table: no archive holds a record; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
SKIPPABLE_LOW, SKIPPABLE_HIGH = 0x184D2A50, 0x184D2A5F
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
VERSION = b"WARC/1.1"

MIN_REVISIT = 100
SAMPLE_BYTES = 1 << 20
DICT_BYTES = 1 << 15
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
                 "refers_to long, payload binary")


class ArchiveError(ValueError):
    """An archive or a record that breaks the format."""


def dictionary_frame(samples: list[bytes], size: int = DICT_BYTES) -> tuple[bytes, zstandard.ZstdCompressionDict | None]:
    """The leading frame and the dictionary trained on ``samples`` (a bounded part of the archive)."""
    try:
        trained = zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:  # too few or too short samples: a raw-content dictionary of what there is
        raw = b"".join(samples)[-size:]
        if len(raw) < 8:
            return struct.pack("<II", DICTIONARY_MAGIC, 0), None
        trained = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    body = zstandard.ZstdCompressor(level=9).compress(trained.as_bytes())
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body, trained


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(" " if c in "\r\n" else c for c in value).strip()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str,
                 refers_to: int | None, date: str) -> bytes:
    """One WARC record: a response with the payload, or a revisit of another page's response."""
    head = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    revisit = refers_to is not None
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"),
              ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}')}>"),
              ("WARC-Date", date)]
    if url is not None and _clean(url):
        fields.append(("WARC-Target-URI", _clean(url)))
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))
    fields += [("Content-Type", "application/http; msgtype=response"),
               ("WARC-Payload-Digest", f"sha256:{digest}"),
               ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
               ("WARC-Payload-Length", str(len(payload)))]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE),
                   ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}')}>"),
                   ("WARC-Refers-To-Page-ID", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def split_frames(archive: bytes) -> Iterator[tuple[int, bytes]]:
    """(magic, bytes) of each frame; data frames keep their header, skippable ones give their content."""
    view, at = memoryview(archive), 0
    while at < len(view):
        if at + 4 > len(view):
            raise ArchiveError(f"{len(view) - at} stray bytes at {at}")
        magic = struct.unpack_from("<I", view, at)[0]
        if SKIPPABLE_LOW <= magic <= SKIPPABLE_HIGH:
            if at + 8 > len(view):
                raise ArchiveError(f"cut skippable frame at {at}")
            end = at + 8 + struct.unpack_from("<I", view, at + 4)[0]
            if end > len(view):
                raise ArchiveError(f"skippable frame at {at} runs past the end")
            yield magic, bytes(view[at + 8:end])
        elif magic == ZSTD_MAGIC:
            end = at + frame_length(view[at:])
            yield magic, bytes(view[at:end])
        else:
            raise ArchiveError(f"unknown magic {magic:#x} at {at}")
        at = end


def frame_length(view: memoryview) -> int:
    """Bytes of the Zstandard data frame that starts here, from its header and block headers."""
    try:
        p = zstandard.get_frame_parameters(view[:18])
        at = zstandard.frame_header_size(view[:18])
    except zstandard.ZstdError as e:
        raise ArchiveError(f"bad frame header: {e}") from e
    while True:
        if at + 3 > len(view):
            raise ArchiveError("cut frame")
        word = int.from_bytes(view[at:at + 3], "little")
        last, kind, size = word & 1, word >> 1 & 3, word >> 3
        if kind == 3:
            raise ArchiveError("reserved block type")
        at += 3 + (1 if kind == 1 else size)
        if last:
            break
    at += 4 * bool(p.has_checksum)
    if at > len(view):
        raise ArchiveError("cut frame")
    return at


def parse_record(raw: bytes) -> dict:
    """Fields and payload of one record; lengths, digests and required headers are checked."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != VERSION:
        raise ArchiveError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ArchiveError(f"bad header line {line[:80]!r}")
        fields[name.decode().lower()] = value.strip().decode()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ArchiveError(f"no {name}")
    if not fields["content-length"].isdigit():
        raise ArchiveError("bad content-length")
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ArchiveError(f"block of {n} bytes expected, {len(rest) - 4} found")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ArchiveError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    if not http.startswith(b"HTTP/1.1 "):
        raise ArchiveError("no HTTP response")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    size = int(fields.get("warc-payload-length", len(payload)))
    kind = fields["warc-type"]
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ArchiveError("payload digest or length differs")
    elif kind == "revisit":
        if payload or "warc-refers-to-page-id" not in fields or fields.get("warc-profile") != REVISIT_PROFILE:
            raise ArchiveError("bad revisit")
    else:
        raise ArchiveError(f"record type {kind}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("warc-page-id"), "url": fields.get("warc-target-uri"), "record_type": kind,
            "payload_bytes": size, "payload_digest": digest, "refers_to": number("warc-refers-to-page-id"),
            "payload": payload if kind == "response" else None}


def read_archive(archive: bytes, max_record: int = 1 << 30) -> Iterator[dict]:
    """Records of one archive. Each data frame must hold exactly one record."""
    decoder, started = zstandard.ZstdDecompressor(), False
    for magic, body in split_frames(archive):
        if magic == DICTIONARY_MAGIC and not started:
            if body:
                raw = body
                if len(body) >= 4 and struct.unpack_from("<I", body)[0] == ZSTD_MAGIC:
                    raw = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 27)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            started = True
        elif magic == ZSTD_MAGIC:
            started = True
            size = zstandard.get_frame_parameters(body[:18]).content_size
            if size in (zstandard.CONTENTSIZE_UNKNOWN, zstandard.CONTENTSIZE_ERROR) or size > max_record:
                raise ArchiveError("frame without a content size, or too long")
            try:
                raw = decoder.decompress(body)
            except zstandard.ZstdError as e:
                raise ArchiveError(f"frame can't be decoded: {e}") from e
            yield parse_record(raw)


def _write(date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, coder = [], 0, None

        def start():
            frame, trained = dictionary_frame(held)
            c = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True) if trained \
                else zstandard.ZstdCompressor(level=level, write_checksum=True)
            return c, [frame] + [c.compress(r) for r in held]

        for b in batches:
            out = []
            for page_id, url, html, digest, refers_to in zip(*(b[c].to_pylist() for c in (
                    "page_id", "url", "html", "digest", "refers_to")), strict=True):
                raw = record_bytes(page_id, url, html.encode(), digest, refers_to, date)
                if coder is None:
                    held.append(raw)
                    size += len(raw)
                    if size >= SAMPLE_BYTES:
                        coder, out = start()
                        held = []
                else:
                    out.append(coder.compress(raw))
            if out:
                yield pa.RecordBatch.from_pydict({"frame": pa.array(out, pa.binary())})
        if coder is None and held:
            yield pa.RecordBatch.from_pydict({"frame": pa.array(start()[1], pa.binary())})
    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    for b in batches:
        for archive in b["content"]:
            rows, size = [], 0
            for r in read_archive(archive.as_py()):
                rows.append(r)
                size += r["payload_bytes"]
                if size > 1 << 23:
                    yield _typed(rows, names)
                    rows, size = [], 0
            yield _typed(rows, names)


def _typed(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in RECORD_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_revisit: int = MIN_REVISIT,
                   date: str = "2024-01-01T00:00:00Z", level: int = 3) -> str:
    """Write every page as a record to archives under ``path``; repeated payloads become revisits."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"))
    # the payload is long enough and has a response to refer to
    firsts = (rows.where((F.octet_length("html") >= min_revisit) & F.col("page_id").isNotNull())
              .groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
              .where("n > 1").select("digest", "first"))
    marked = rows.join(firsts, "digest", "left").withColumn(
        "refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first")))
    frames = marked.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(
        _write(date, level), "frame binary")
    # bytes as a string column: the text writer puts them out as they are
    frames.select(F.col("frame").cast("string").alias("value")).write.option(
        "lineSep", EMPTY_FRAME).text(path)
    return path


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records under ``path``, checked: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, RECORD_SCHEMA)
