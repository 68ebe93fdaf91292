"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that are compressed independently; a skippable frame at
the end of a bundle (the seek table of the Zstandard seekable format) lists the sizes of
all frames. A manifest maps each record to its bundle, frame and offset within the
frame, so that one record is read by fetching the seek table and a single frame.

Payload digests are SHA-1. Of records with equal payloads of at least ``LEAST`` bytes
that with the largest id is a response and the others are revisits that refer to it.

Bundles are written by the tasks into the session's shared folder under names that no
other attempt uses, then renamed; a manifest row exists only for finished bundles, so a
repeated attempt leaves at most an unused file.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, saved, small_batches

LEAST = 1000
FRAME_BYTES = 1 << 20  # a frame is closed once it holds so much
BUNDLE_BYTES = 256 << 20  # and a bundle once its records make up so much
LEVEL = 3
SEEK_MAGIC, SKIP_MAGIC = 0x8F92EAB1, 0x184D2A5E
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "page_id long, record_id string, bundle string, frame int, offset long, length long"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that lists (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIP_MAGIC, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of every frame, read from the file's end."""
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    file.seek(size - 9 - count * entry)
    body, out, at = file.read(count * entry), [], 0
    for k in range(count):
        c, d = struct.unpack_from("<II", body, k * entry)
        out.append((at, c, d))
        at += c
    return out


def record(kind: str, record_id: str, uri: str, digest: str, size: int, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record. A revisit has no payload of its own; its size is kept in a field."""
    block = b"" if kind == "revisit" else payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names), block and end of the record that begins at ``at``."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    head = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    begin = end + 4
    stop = begin + int(head["content-length"])
    return head, raw[begin:stop], stop + 4


class BundleWriter:
    """Writes one bundle; ``add`` returns (frame, offset within the frame)."""

    def __init__(self, target: fs.FileSystem, path: str):
        self.target, self.path = target, path
        self.temp = f"{path}.{uuid.uuid4().hex}.tmp"
        self.out = target.open_output_stream(self.temp)
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int]] = []
        self.held, self.size, self.total = [], 0, 0

    def add(self, raw: bytes) -> tuple[int, int]:
        place = len(self.frames), self.size
        self.held.append(raw)
        self.size += len(raw)
        self.total += len(raw)
        if self.size >= FRAME_BYTES:
            self._flush()
        return place

    def _flush(self) -> None:
        if self.held:
            packed = self.pack.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.target.move(self.temp, self.path)


def _uri(url: str | None) -> str:
    return "".join(c if 32 < ord(c) != 127 else f"%{ord(c):02X}" for c in (url or "")) or "about:blank"


def _name(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Each page with payload, payload_bytes, digest and ``original`` (the id a revisit refers to, else null).

    A null html is an empty payload. Rows that repeat the largest id of a payload are
    responses all. A null id is smaller than any other; if no other has the payload,
    it is a response.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    known = rows.filter(F.col("payload_bytes") >= least).select("page_id", "digest")
    big = known.groupBy(F.col("digest").alias("k")).agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 and last is not null").select("k", "last")
    # copies of one payload meet without their payloads; those travel by page
    revisits = known.join(big, F.col("digest") == F.col("k")).filter(~F.col("last").eqNullSafe(F.col("page_id"))).select(F.col("page_id").alias("p"), "k", F.col("last").alias("original")).distinct()
    return rows.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("k")) & (F.col("payload_bytes") >= least), "left").drop("p", "k")


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write one record per page into bundles and return the manifest (a saved table).

    Needs page_id, url, html; other columns are left out. An empty table gives an empty
    manifest.
    """
    spark = pages.sparkSession
    small_batches(pages)
    where = folder or fresh_path(spark, "warc")
    planned = plan(pages).select("page_id", "url", "payload", "payload_bytes", "digest", "original")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = _open(where)
        target.create_dir(base, recursive=True)
        bundle, name, rows = None, "", []

        def finish() -> pa.RecordBatch:
            bundle.close()
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "record_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            for page, url, payload, size, digest, original in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle, rows = BundleWriter(target, f"{base}/{name}"), []
                kind = "response" if original is None else "revisit"
                raw = record(kind, _name(page), _uri(url), digest, size, payload, None if original is None else _name(original))
                frame, offset = bundle.add(raw)
                rows.append((page, _name(page), f"{where}/{name}", frame, offset, len(raw)))
                if bundle.total >= BUNDLE_BYTES:
                    yield finish()
                    bundle = None
        if bundle is not None:
            yield finish()

    return saved(planned.mapInArrow(run, MANIFEST), "manifest")


def read_record(bundle: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record: the seek table and one frame are read."""
    source, path = _open(bundle)
    with source.open_input_file(path) as f:
        start, packed, size = read_seek_table(f, f.size())[frame]
        f.seek(start)
        raw = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=size)
    head, block, _ = parse(raw, offset)
    return head, block


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """All records of the bundles in a manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A task reads runs of frames, one at a time; a response's digest is computed from the
    payload read, a revisit has no payload (null) and reports its recorded digest and size.
    """
    frames = manifest.select("bundle", "frame").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bundle", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            wanted: dict[str, list[int]] = {}
            for name, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                wanted.setdefault(name, []).append(k)
            for name, numbers in wanted.items():
                source, path = _open(name)
                with source.open_input_file(path) as f:
                    table = read_seek_table(f, f.size())
                    for k in sorted(numbers):
                        start, packed, size = table[k]
                        f.seek(start)
                        yield _rows(unpack.decompress(f.read(packed), max_output_size=size))

    return frames.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _id(name: str | None) -> int | None:
    tail = (name or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


def _rows(raw: bytes) -> pa.RecordBatch:
    out, at = [], 0
    while at < len(raw):
        head, block, at = parse(raw, at)
        kind, noted = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response":
            found = hashlib.sha1(block).hexdigest()
            if found != noted:
                raise ValueError(f"digest of {head['warc-record-id']} does not match")
            row = (len(block), found, kind, None, block)
        else:
            row = (int(head["x-payload-length"]), noted, kind, _id(head["warc-refers-to"]), None)
        out.append((_id(head["warc-record-id"]), head["warc-target-uri"], *row))
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read(pages.sparkSession, write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
