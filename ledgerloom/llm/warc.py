"""Pages to WARC bundles of independent Zstandard frames with a seek table, and back by an index of records.

A bundle follows the public seekable format: Zstandard frames, each of whole records, then a skippable frame with the
compressed and decompressed size of every frame. The index maps a record to bundle, frame and offset in that frame, so
that one record costs one seek and the decompression of one frame.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.storage import file_system, new_path, small_batches, written

#: Fixed values of the seekable Zstandard format and of WARC 1.1.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records after which a frame ends, and of frames after which a bundle ends.
FRAME, BUNDLE = 256 << 10, 256 << 20
#: Payloads of fewer bytes are always written whole.
LEAST_PAYLOAD = 100
#: Salts under which rows of one payload find its response.
SALT = 16
#: The tables have no time of capture.
DATE = "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """A response with the payload, or a revisit whose HTTP head alone tells the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """WARC header, HTTP header and payload of the record there, and where it ends. Names are in lower case."""

    def fields(raw: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode().split("\r\n")[1:])}

    cut = data.index(b"\r\n\r\n", at)
    warc = fields(data[at:cut])
    end = cut + 4 + int(warc["content-length"])
    http = data.index(b"\r\n\r\n", cut + 4, end)
    return warc, fields(data[cut + 4 : http]), data[http + 4 : end], end + 4


class BundleWriter:
    """Adds records to a bundle, frame by frame; what is held is one frame."""

    def __init__(self, out):
        import zstandard

        self.out, self.zstd = out, zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.written = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """The frame and the offset in it."""
        if self.held and self.size + len(data) > FRAME:
            self._end_frame()
        at = (len(self.frames), self.size)
        self.held.append(data)
        self.size += len(data)
        return at

    def _end_frame(self) -> None:
        packed = self.zstd.compress(b"".join(self.held))
        self.out.write(packed)
        self.frames.append((len(packed), self.size))
        self.written += len(packed)
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._end_frame()
        table = b"".join(struct.pack("<2I", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<2I", SKIPPABLE, len(table)) + table)
        self.out.close()


class Bundle:
    """Reads frames of a bundle by its seek table."""

    def __init__(self, file):
        import zstandard

        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        size = file.size()
        count, _, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end")
        table = self._read(size - 9 - 8 * count, 8 * count)
        self.begin, self.sizes = [0], list(struct.iter_unpack("<2I", table))
        for packed, _ in self.sizes:
            self.begin.append(self.begin[-1] + packed)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        packed, size = self.sizes[k]
        return self.zstd.decompress(self._read(self.begin[k], packed), max_output_size=size)


_INDEX = "page_id long, bundle string, frame long, offset long, length long"


def _writes(folder: str):
    """mapInArrow function: (page_id, url, html, digest, refers_to) to the index rows of the bundles that it writes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt, seq = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        writer = name = None

        def end() -> None:
            writer.close()
            fs.move(f"{base}/.{name}.{attempt}", f"{base}/{name}")

        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is not None and writer.written > BUNDLE:
                    end()
                    writer, seq = None, seq + 1
                if writer is None:
                    name = f"pages-{part:06d}-{seq:05d}.warc.zst"
                    writer = BundleWriter(fs.open_output_stream(f"{base}/.{name}.{attempt}"))
                data = record(page_id, url, (html or "").encode(), digest, refers_to, refers_to is not None)
                rows.append((page_id, f"{folder}/{name}", *writer.add(data), len(data)))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["page_id", "bundle", "frame", "offset", "length"])
        if writer is not None:
            end()

    return of


def write_bundles(pages: DataFrame, folder: str | None = None, id_col: str = "page_id") -> DataFrame:
    """Writes a WARC record per row of (page_id, url, html) and gives the index, written as a table.

    The payload is the html in UTF-8; null counts as empty. Of rows with equal payloads of at least LEAST_PAYLOAD
    bytes those with the smallest id are responses and the others revisits of it; a row with a null id revisits too, and is
    a response if no equal one has an id. Rows that repeat an id and a payload are written as often. A null url is left
    out of the record. An empty table gives no bundle. Other columns are ignored.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    keys = rows.where(F.octet_length("html") >= LEAST_PAYLOAD).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    # however many rows one payload has, they find its response under salts
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    revisits = keys.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT))).join(salted, ["digest", "salt"]).where("not page_id <=> refers_to").select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to").distinct()
    all_ = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    index = all_.select("page_id", "url", "html", "digest", "refers_to").sortWithinPartitions("page_id").mapInArrow(_writes(folder), _INDEX)
    with small_batches(pages.sparkSession):
        return written(index, "warc-index")


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _reads(whole: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        number = lambda urn: int(x) if (x := urn.strip("<>").rpartition(":")[2]) else None
        held, bundle, frame = None, None, b""
        for batch in batches:
            out: list[tuple] = []
            for name, k, offset in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset")), strict=True):
                if held is None or held[0] != name:
                    fs, path = file_system(name)
                    bundle = Bundle(fs.open_input_file(path))
                if held != (name, k):
                    frame, held = bundle.frame(k), (name, k)
                warc, http, payload, _ = parsed(frame, offset)
                revisit = warc["warc-type"] == "revisit"
                digest = warc["warc-payload-digest"].removeprefix("sha256:")
                if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{name}, frame {k}, offset {offset}: the payload doesn't fit its digest")
                out.append((number(warc["warc-record-id"]), int(http["content-length"]), digest, warc["warc-type"], number(warc["warc-refers-to"]) if revisit else None, warc.get("warc-target-uri"), payload if whole else None))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    return of


def read_bundles(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the index names, or part of it: their headers' values, and for responses the payload.

    Rows of one frame go to one task, which decompresses it once. A payload that doesn't fit its digest is an error.
    """
    rows = index.select("bundle", "frame", "offset").repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return rows.mapInArrow(_reads(payloads), _READ)
