"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of some whole records, closed by a seek table in a skippable
frame (the public seekable format: magic 0x184D2A5E, a pair of sizes a frame, a nine-byte footer). An index maps each
record to its bundle, its frame, and its offset in the decompressed frame; one record is read by fetching the footer
and one frame. Any zstd tool decompresses a whole bundle to a plain WARC file.

Writing: of records whose payloads are equal and at least ``revisit_from`` bytes long, that with the largest id is the
response and the others are revisits without a body; the rest are responses. Each task writes its rows, packed until a
bundle is full, into the shared folder under a name of its own; the index, written as a table, names the bundles of
the attempts that succeeded. So a repeated or lost attempt leaves at most a file that nothing refers to.

Memory: a task holds a frame, a record, and the Arrow batch of rows it is reading, which the session's settings of
batches bound. Reading holds a frame and its records.

Defined cases: a null payload is empty; rows with a null id are written too, never as the response where an equal
payload has an id, and come back with a null id; rows repeated with the id of the response are responses too; rows of
one id, and those without, share a record id; a url that is null, empty or holds white space is written without it, or
as about:blank, and comes back as it was from a header of its own; very long payloads make a frame of their own; an
empty table makes no bundle; other columns are not written.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, functions as F

from larkspur.llm.common import new_path, written

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame int, frame_offset long, record_offset long, record_length long"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """sizes: compressed and decompressed bytes of each frame."""
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed bytes, decompressed bytes) of each frame of a bundle."""
    end = file.seek(0, io.SEEK_END)
    file.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(end - 9 - 8 * n)
    sizes, at, out = struct.iter_unpack("<II", file.read(8 * n)), 0, []
    for packed, plain in sizes:
        out.append((at, packed, plain))
        at += packed
    return out


def record(page_id, url: str | None, payload: bytes, digest: str, size: int, kind: str, refers_to) -> bytes:
    """A WARC/1.1 record; the payload's own length and digest are headers, as revisits have no body."""
    name = "none" if page_id is None else page_id
    target = "".join((url or "").split()) or "about:blank"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if target != url:
        head.append(f"X-Page-URL: {json.dumps(url)}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and body of the record at an offset, and the offset of the next."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start = end + 4
    stop = start + int(head["Content-Length"])
    return head, data[start:stop], stop + 4


class Bundles:
    """Writes records into bundles of about ``bundle_bytes`` compressed bytes."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int, level: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.out, self.frame, self.index, self.index_in_frame = None, [], [], 0

    def add(self, page_id, data: bytes) -> None:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            self.out, self.sizes, self.at = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None), [], 0
        self.index.append((page_id, self.name, len(self.sizes), self.at, self.index_in_frame, len(data)))
        self.frame.append(data)
        self.index_in_frame += len(data)
        if self.index_in_frame >= self.frame_bytes:
            self.end_frame()
            if self.at >= self.bundle_bytes:
                self.end_bundle()

    def end_frame(self) -> None:
        plain = b"".join(self.frame)
        packed = self.zstd.compress(plain)
        self.out.write(packed)
        self.sizes.append((len(packed), len(plain)))
        self.at += len(packed)
        self.frame, self.index_in_frame = [], 0

    def end_bundle(self) -> None:
        if self.out is None:
            return
        if self.frame:
            self.end_frame()
        self.out.write(seek_table(self.sizes))
        self.out.close()
        self.out = None

    def abort(self) -> None:
        if self.out is not None:
            with suppress(OSError):
                self.out.close()
                self.fs.delete_file(f"{self.folder}/{self.name}")

    def rows(self) -> pa.RecordBatch:
        rows, self.index = self.index, []
        types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in INDEX.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names)


def revisits(pages: DataFrame, revisit_from: int) -> DataFrame:
    """(page_id, url, payload, digest, size, kind, refers_to); revisits come without a payload."""
    raw = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload"))
    keyed = keyed.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    # only ids of payloads that occur again are joined back; the sums of each task come first
    again = (
        pages.select("page_id", raw.alias("payload"))
        .where(F.octet_length("payload") >= revisit_from)
        .groupBy(F.sha1("payload").alias("digest"))
        .agg(F.max(F.col("page_id").cast("long")).alias("last"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "last")
    )
    again = written(again, "warc-again")
    small = again.limit(REPEATED + 1).count() <= REPEATED
    # few enough to be sent to all tasks, else both sides are shuffled, where adaptive execution splits a hot digest
    joined = keyed.join(F.broadcast(again) if small else again, "digest", "left")
    other = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select(
        "page_id", "url", F.when(other, F.lit("").cast("binary")).otherwise(F.col("payload")).alias("payload"), "digest", "size",
        F.when(other, "revisit").otherwise("response").alias("kind"), F.when(other, F.col("last")).alias("refers_to"),
    )


#: Digests that occur again, up to which they are broadcast: 100,000 of 60 bytes.
REPEATED = 100_000


def write_archive(pages: DataFrame, folder: str | None = None, revisit_from: int = 1000, frame_bytes: int = 1 << 20, bundle_bytes: int = 64 << 20, level: int = 3) -> tuple[str, DataFrame]:
    """Write ``pages`` (page_id, url, html); returns the folder and the index of records."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Bundles(folder, frame_bytes, bundle_bytes, level)
        out.fs.create_dir(out.folder, recursive=True)
        try:
            for batch in batches:
                columns = [batch.column(i) for i in range(7)]
                for i in range(batch.num_rows):
                    page_id, url, payload, digest, size, kind, refers_to = (c[i].as_py() for c in columns)
                    out.add(page_id, record(page_id, url, payload, digest, size, kind, refers_to))
                yield out.rows()
            out.end_bundle()
        except BaseException:
            out.abort()
            raise

    return folder, written(revisits(pages, revisit_from).mapInArrow(run, INDEX), "warc-index")


READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archive(folder: str, index: DataFrame, with_payload: bool = True, frames_per_task: int = 16) -> DataFrame:
    """All records of the bundles that the index names, frame by frame; a response whose payload fails its digest raises."""
    # frames_per_task frames go to a task, neighbours of a bundle together; a given number is not coalesced for its few bytes
    frames = written(index.select("bundle", "frame").distinct(), "warc-frames")
    tasks = max(1, -(-frames.count() // frames_per_task))
    frames = frames.repartition(tasks, "bundle", (F.col("frame") / frames_per_task).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        zstd = zstandard.ZstdDecompressor()
        for batch in batches:
            wanted: dict[str, list[int]] = {}
            for name, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                wanted.setdefault(name, []).append(frame)
            for name, numbers in wanted.items():
                with fs.open_input_file(f"{base}/{name}") as file:
                    table = read_seek_table(file)
                    for n in sorted(numbers):
                        at, packed, plain = table[n]
                        file.seek(at)
                        yield records(zstd.decompress(file.read(packed), max_output_size=plain), with_payload)

    return frames.mapInArrow(run, READ)


def _id(text: str) -> int | None:
    text = text.rpartition(":")[2].rstrip(">")
    return None if text == "none" else int(text)


def records(data: bytes, with_payload: bool) -> pa.RecordBatch:
    at, rows = 0, []
    while at < len(data):
        head, body, at = parse(data, at)
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        revisit = head["WARC-Type"] == "revisit"
        if not revisit and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(head["X-Payload-Length"])):
            raise ValueError(f"record {head['WARC-Record-ID']}: the payload has another digest")
        refers = _id(head["WARC-Refers-To"]) if revisit else None
        url = json.loads(head["X-Page-URL"]) if "X-Page-URL" in head else head["WARC-Target-URI"]
        rows.append((_id(head["WARC-Record-ID"]), url, head["WARC-Type"], refers, int(head["X-Payload-Length"]), digest, body if with_payload and not revisit else None))
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names)


def fetch(folder: str, bundle: str, frame: int, record_offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: the footer and one frame are read."""
    fs, base = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{base}/{bundle}") as file:
        at, packed, plain = read_seek_table(file)[frame]
        file.seek(at)
        data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
    head, body, _ = parse(data, record_offset)
    return head, body
