"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames. A skippable frame at the end of each file is the
seek table of the Zstandard seekable format (sizes of all frames, so a reader finds any frame from the
end of the file), and an index table maps record ids to file, frame and offset inside the frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, shared_path

# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 20
WARC_DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of records that one task reads, about.
TASK_BYTES = 32 << 20

INDEX = "page_id {}, file string, frame int, frame_offset long, frame_size long, record_offset long, record_size long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(urn: str, url: str | None, payload: bytes, refers_to: str | None, date: str = WARC_DATE) -> bytes:
    """One WARC/1.1 record; with refers_to a revisit, which keeps the HTTP header and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{urn}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | str | None, digest: bytes, nth: int = 0) -> str:
    """Page (text after an apostrophe), start of the payload's SHA-256, and a number for repeated rows."""
    page = "null" if page_id is None else f"'{quote(page_id, safe='')}" if isinstance(page_id, str) else str(page_id)
    return f"urn:page:{page}:{digest[:8].hex()}" + (f":{nth}" if nth else "")


def page_of(urn: str) -> int | str | None:
    part = urn.strip("<>").split(":")[2]
    return None if part == "null" else unquote(part[1:]) if part[0] == "'" else int(part)


def parse(data: bytes, at: int = 0) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record in an uncompressed frame."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        n = int(headers["Content-Length"])
        yield at, headers, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


class Bundle:
    """Writes one seekable file; the caller gets an index row per record when its frame is complete."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES, level: int = 3):
        filesystem, path = pafs.FileSystem.from_uri(uri)
        filesystem.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.uri, self.frame_bytes, self.packer = filesystem.open_output_stream(path, compression=None), uri, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.at, self.frames, self.waiting, self.filled = 0, [], [], 0
        info = b"software: ledgerspark\r\nformat: WARC File Format 1.1\r\n"
        self._frame(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:bundle:" + uri.rpartition("/")[2].encode() + f">\r\nWARC-Date: {WARC_DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")

    def _frame(self, data: bytes) -> int:
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data)))
        self.at += len(packed)
        return len(packed)

    def add(self, page_id: int | None, data: bytes) -> list[tuple]:
        self.waiting.append((page_id, data))
        self.filled += len(data)
        return self.flush() if self.filled >= self.frame_bytes else []

    def flush(self) -> list[tuple]:
        if not self.waiting:
            return []
        at, number, offset, rows = self.at, len(self.frames), 0, []
        size = self._frame(b"".join(d for _, d in self.waiting))
        for page_id, d in self.waiting:
            rows.append((page_id, self.uri, number, at, size, offset, len(d)))
            offset += len(d)
        self.waiting, self.filled = [], 0
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        return rows


def seek_table(file) -> list[tuple[int, int]]:
    """(offset, compressed size) of each frame, read from the end of an open file."""
    size = file.size()
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable Zstandard file")
    entry = 12 if flags & 0x80 else 8
    file.seek(size - 9 - n * entry)
    raw, out, at = file.read(n * entry), [], 0
    for k in range(n):
        packed = struct.unpack_from("<I", raw, k * entry)[0]
        out.append((at, packed))
        at += packed
    return out


def read_frame(file, offset: int, size: int) -> bytes:
    file.seek(offset)
    return zstandard.ZstdDecompressor().decompress(file.read(size))


def read_record(uri: str, frame: int, record_offset: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record: the footer gives the frame, the index the offset in it."""
    filesystem, path = pafs.FileSystem.from_uri(uri)
    with filesystem.open_input_file(path) as f:
        data = read_frame(f, *seek_table(f)[frame])
    _, headers, block = next(parse(data, record_offset))
    return headers, block


def write_warc(pages: DataFrame, min_revisit_bytes: int = 0, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write pages(page_id, url, html) as bundles in the shared folder; returns their index table.

    Of records whose payloads are equal and of at least min_revisit_bytes bytes, the one with the
    smallest page_id is a response and the others revisit it. Null html: an empty payload. Null url: no
    target URI. Null page_id: last in order; a record of its own. Rows that repeat both page_id and html:
    one is the response, the others revisit it and get a number in their record ids. Empty table: an
    empty index. Other columns are ignored, whatever their names. page_id is an integer or text. A very
    long html is a record like others and makes a frame of its own size.

    A task writes a file of a name of its own, and only files that the index names count: a task that
    runs twice leaves a file that nothing reads.
    """
    spark = pages.sparkSession
    root = shared_path(spark, "warc")
    kind = "string" if isinstance(pages.schema["page_id"].dataType, T.StringType) else "long"
    rows = pages.select(F.col("page_id").cast(kind).alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    slim = materialize(rows.select("page_id", "digest", F.length("payload").alias("bytes"), F.xxhash64("url").alias("site")), "warc-digests")
    # a table of its own: the join then has an exchange on either side, and a hot payload's rows can be split
    large = slim.where(F.col("bytes") >= min_revisit_bytes).select("page_id", "digest")
    firsts = materialize(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-firsts")
    refs = large.join(firsts, "digest").select(F.col("page_id").alias("_p"), F.col("digest").alias("_g"), "first").distinct()
    # rows that repeat page and payload: how many there are of each, and the number of the first
    same_url = slim.groupBy("page_id", "digest", "site").agg(F.count("*").alias("n"))
    w = Window.partitionBy("page_id", "digest")
    below = w.orderBy("site").rowsBetween(Window.unboundedPreceding, -1)
    many = same_url.withColumns({"all": F.sum("n").over(w), "nth": F.coalesce(F.sum("n").over(below), F.lit(0))}).where(F.col("all") > 1)
    many = materialize(many.select(F.col("page_id").alias("_q"), F.col("digest").alias("_d"), F.col("site").alias("_s"), "n", "nth"), "warc-repeats")

    def linked(some: DataFrame) -> DataFrame:
        # one shuffle of the payloads
        same = F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_g"))
        return some.join(refs.hint("merge"), same, "left").select("page_id", "url", "payload", "digest", "_g", "first", "nth")

    once = F.lit(0).cast("long").alias("nth")
    if many.isEmpty():
        rows = linked(rows.select("*", once))
    else:
        # of rows that repeat one is kept and dealt its number of times, so no number depends on where a row is read
        repeat = rows.withColumn("site", F.xxhash64("url"))
        hit = repeat["page_id"].eqNullSafe(many["_q"]) & (repeat["digest"] == many["_d"]) & (repeat["site"] == many["_s"])
        plain = linked(repeat.join(many, hit, "left_anti").select("page_id", "url", "payload", "digest", once))
        kept = repeat.join(many, hit).dropDuplicates(["page_id", "digest", "site"])
        numbers = F.explode(F.sequence(F.col("nth"), F.col("nth") + F.col("n") - 1)).alias("nth")
        rows = plain.unionByName(linked(kept.select("page_id", "url", "payload", "digest", numbers)))

    def write(batches):
        bundle = Bundle(f"{root}/part-{uuid.uuid4().hex}.warc.zst", frame_bytes)

        def out(index):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*index, strict=True), (pa.string() if kind == "string" else pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["page_id", "file", "frame", "frame_offset", "frame_size", "record_offset", "record_size"])

        for b in batches:
            index = []
            columns = [b.column(c) for c in ("page_id", "url", "payload", "digest", "_g", "first", "nth")]
            for k in range(b.num_rows):
                page_id, url, payload, digest, linked_to, first, nth = (c[k].as_py() for c in columns)
                refers = record_id(first, digest) if linked_to is not None and (page_id != first or nth) else None
                index += bundle.add(page_id, record(record_id(page_id, digest, nth), url, payload, refers))
            if index:
                yield out(index)
        index = bundle.close()
        if index:
            yield out(index)

    return materialize(rows.mapInArrow(write, INDEX.format(kind)), "warc-index")


def read_warc(index: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Read all records of the bundles that index names, frame by frame in parallel.

    Frames are dealt out by file and place, about task_bytes of records to a task; a task takes each
    file's seek table once. Returns (page_id, url, payload, payload_bytes, payload_digest, record_type,
    refers_to); the payload of a revisit is null, its size and digest are those of the full payload. A
    response whose payload does not have the recorded digest raises. Empty index: no rows.
    """
    frames = index.groupBy("file", "frame").agg(F.sum("record_size").alias("bytes"))
    # a number of its own, or adaptive execution would put these small rows into one task
    tasks = max(1, -(-(index.agg(F.sum("record_size")).first()[0] or 0) // task_bytes))
    frames = frames.repartitionByRange(tasks, "file", "frame").sortWithinPartitions("file", "frame").select("file", "frame")
    kind = index.schema["page_id"].dataType.simpleString()
    ids = pa.string() if kind == "string" else pa.int64()

    def read(batches):
        uri = file = table = None
        try:
            for b in batches:
                for name, frame in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if name != uri:
                        if file is not None:
                            file.close()
                        filesystem, path = pafs.FileSystem.from_uri(name)
                        uri, file = name, filesystem.open_input_file(path)
                        table = seek_table(file)
                    rows = []
                    for _, h, block in parse(read_frame(file, *table[frame])):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(http.decode().rpartition("Content-Length: ")[2])
                        digest, refers = h["WARC-Payload-Digest"].removeprefix("sha1:"), h.get("WARC-Refers-To")
                        if refers is None and (len(payload) != n or payload_digest(payload) != digest):
                            raise ValueError(f"{uri}, frame {frame}: {h['WARC-Record-ID']} is damaged")
                        rows.append((page_of(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), None if refers else payload, n, digest, h["WARC-Type"], page_of(refers) if refers else None))
                    kinds = (ids, pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), ids)
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        finally:
            if file is not None:
                file.close()

    return frames.mapInArrow(read, f"page_id {kind}, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")
