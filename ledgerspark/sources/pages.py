"""Whether a file can be read, and how many pages it has: its bytes are checked, nothing is rendered.

PNG: every chunk's check sum, from the header to the end mark. JPEG: its segments and scans up to the end mark. PDF: the
cross-reference tables or streams that the end of the file names, and the leaves of the page tree; where they cannot be
followed, the objects that the file holds, as readers do.
"""

from __future__ import annotations

import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .admission import extension


class Damaged(ValueError):
    """What is wrong with a file."""


def png_pages(data: bytes) -> int:
    if not data.startswith(b"\x89PNG\r\n\x1a\n"):
        raise Damaged("no PNG signature")
    at, kind = 8, b""
    while kind != b"IEND":
        if at + 12 > len(data):
            raise Damaged("ends within a chunk")
        size, kind = struct.unpack_from(">I4s", data, at)
        if at == 8 and kind != b"IHDR":
            raise Damaged("does not begin with its header")
        end = at + 8 + size
        if end + 4 > len(data):
            raise Damaged("ends within a chunk")
        if zlib.crc32(data[at + 4 : end]) != struct.unpack_from(">I", data, end)[0]:
            raise Damaged(f"check sum of chunk {kind.decode('latin-1')} does not match")
        at = end + 4
    return 1


#: A scan's data end at a mark that is neither a stuffed byte nor a restart.
_SCAN_END = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]", re.S)


def jpeg_pages(data: bytes) -> int:
    if not data.startswith(b"\xff\xd8"):
        raise Damaged("no JPEG signature")
    at, frame = 2, False
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 2 > len(data):
            raise Damaged("ends before its end mark")
        if data[at] != 0xFF:
            raise Damaged("no mark where a segment should begin")
        mark = data[at + 1]
        if mark == 0xD9:
            if not frame:
                raise Damaged("no frame")
            return 1
        if mark == 0x01 or 0xD0 <= mark <= 0xD7:
            at += 2
            continue
        if at + 4 > len(data):
            raise Damaged("ends within a segment")
        at += 2 + struct.unpack_from(">H", data, at + 2)[0]
        frame = frame or 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        if mark == 0xDA:
            found = _SCAN_END.search(data, at)
            if not found:
                raise Damaged("ends within a scan")
            at = found.end() - 2


class Name(str):
    """A PDF name."""


class Ref(tuple):
    """A reference to a PDF object: number and generation."""


_BLANK = re.compile(rb"(?:[\x00\t\n\f\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_REF = re.compile(rb"(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+R(?![^\x00\t\n\f\r ()<>\[\]{}/%])")
_WORD = re.compile(rb"[^\x00\t\n\f\r ()<>\[\]{}/%]+")
_HEX = re.compile(rb"<[^>]*>")
_OBJECT = re.compile(rb"(?<!\d)(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+obj(?![^\x00\t\n\f\r ()<>\[\]{}/%])")
_MOST_DEEP = 100


def pdf_value(data: bytes, at: int, deep: int = 0):
    """The value at a place and the place behind it; texts are not decoded."""
    at = _BLANK.match(data, at).end()
    if deep > _MOST_DEEP or at >= len(data):
        raise Damaged("ends within a value" if at >= len(data) else "values too deep")
    if data.startswith(b"<<", at):
        out, at = {}, at + 2
        while True:
            at = _BLANK.match(data, at).end()
            if data.startswith(b">>", at):
                return out, at + 2
            key, at = pdf_value(data, at, deep + 1)
            if not isinstance(key, Name):
                raise Damaged("a dictionary's key is no name")
            out[key], at = pdf_value(data, at, deep + 1)
    first = data[at : at + 1]
    if first == b"[":
        items, at = [], at + 1
        while True:
            at = _BLANK.match(data, at).end()
            if data.startswith(b"]", at):
                return items, at + 1
            item, at = pdf_value(data, at, deep + 1)
            items.append(item)
    if first == b"(":
        depth, end = 0, at
        while end < len(data):
            c = data[end]
            depth += (c == 40) - (c == 41)
            if not depth:
                return b"", end + 1
            end += 2 if c == 92 else 1
        raise Damaged("ends within a text")
    if first == b"<":
        m = _HEX.match(data, at)
        if not m:
            raise Damaged("ends within a text")
        return b"", m.end()
    if first == b"/":
        m = _WORD.match(data, at + 1)
        return Name(m.group().decode("latin-1") if m else ""), m.end() if m else at + 1
    m = _REF.match(data, at)
    if m:
        return Ref((int(m[1]), int(m[2]))), m.end()
    m = _NUMBER.match(data, at)
    if m:
        return (float if b"." in m.group() else int)(m.group()), m.end()
    m = _WORD.match(data, at)
    if not m:
        raise Damaged("a mark where a value should stand")
    return {b"true": True, b"false": False}.get(m.group()), m.end()


class Pdf:
    """The objects of a PDF file by number: places in the file, or in object streams."""

    def __init__(self, data: bytes):
        self.data, self.places, self.trailer, self.packed = data, {}, {}, {}
        if b"%PDF-" not in data[:1024]:
            raise Damaged("no PDF signature")
        if b"%%EOF" not in data:
            raise Damaged("no end mark")
        try:
            start = int(re.match(rb"startxref[\x00\t\n\f\r ]+(\d+)", data[data.rindex(b"startxref") :])[1])
            self._sections(start)
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise Damaged("no catalog")
        except (ValueError, TypeError, IndexError, KeyError, zlib.error, struct.error, RecursionError):
            self._all_objects()
        if self.trailer.get("Encrypt") is not None:
            raise Damaged("encrypted")

    def _sections(self, at: int) -> None:
        seen = set()
        while at is not None:
            if at in seen or at >= len(self.data):
                raise Damaged("cross references lead nowhere")
            seen.add(at)
            at = _BLANK.match(self.data, at).end()
            more = self._table(at + 4) if self.data.startswith(b"xref", at) else self._stream_section(at)
            for k, v in more.items():
                self.trailer.setdefault(k, v)
            if isinstance(more.get("XRefStm"), int):
                self._stream_section(more["XRefStm"])
            at = more.get("Prev")

    def _table(self, at: int) -> dict:
        while True:
            at = _BLANK.match(self.data, at).end()
            if self.data.startswith(b"trailer", at):
                return pdf_value(self.data, at + 7)[0]
            m = re.compile(rb"(\d+)[ \t]+(\d+)").match(self.data, at)
            if not m:
                raise Damaged("cross references end")
            first, n, at = int(m[1]), int(m[2]), m.end()
            entry = re.compile(rb"[\x00\t\n\f\r ]*(\d{1,10})[ \t]+(\d{1,5})[ \t]+([nf])")
            for k in range(n):
                m = entry.match(self.data, at)
                if not m:
                    raise Damaged("cross references end")
                at = m.end()
                if m[3] == b"n":
                    self.places.setdefault(first + k, (1, int(m[1])))

    def _stream_section(self, at: int) -> dict:
        info, data = self._object_at(at)
        widths, fields = info["W"], []
        step = sum(widths)
        index = info.get("Index", [0, info["Size"]])
        for first, n in zip(index[::2], index[1::2], strict=True):
            fields += range(first, first + n)
        for k, number in enumerate(fields):
            row, parts = data[k * step : (k + 1) * step], []
            for w in widths:
                parts.append(int.from_bytes(row[:w], "big"))
                row = row[w:]
            kind = parts[0] if widths[0] else 1
            if kind in (1, 2):
                self.places.setdefault(number, (kind, *parts[1:]))
        return info

    def _object_at(self, at: int, number: int | None = None):
        """The value of the object at a place, and its data if it is a stream."""
        m = _OBJECT.match(self.data, _BLANK.match(self.data, at).end())
        if not m or number is not None and int(m[1]) != number:
            raise Damaged("no object where one should begin")
        value, at = pdf_value(self.data, m.end())
        at = _BLANK.match(self.data, at).end()
        if not isinstance(value, dict) or not self.data.startswith(b"stream", at):
            return value, None
        at += 6 + (2 if self.data.startswith(b"\r\n", at + 6) else 1)
        size = self.get(value.get("Length"))
        end = at + size if isinstance(size, int) and self.data[at + size : at + size + 20].lstrip().startswith(b"endstream") else self.data.index(b"endstream", at)
        return value, self._decode(value, self.data[at:end])

    def _decode(self, info: dict, raw: bytes) -> bytes | None:
        """The data of a stream without a filter or deflated; null for others, which page trees do not need."""
        filters, options = self.get(info.get("Filter")), self.get(info.get("DecodeParms"))
        filters = [filters] if isinstance(filters, Name) else filters or []
        if filters == []:
            return raw
        if filters != ["FlateDecode"]:
            return None
        out = zlib.decompressobj().decompress(raw)
        options = options[0] if isinstance(options, list) and options else options or {}
        if self.get(options.get("Predictor", 1)) < 10:
            return out
        width = options.get("Columns", 1) * options.get("Colors", 1) * options.get("BitsPerComponent", 8) // 8
        rows, above = [], bytes(width)
        for k in range(0, len(out) - width, width + 1):
            kind, row = out[k], bytearray(out[k + 1 : k + 1 + width])
            if kind == 2:
                row = bytearray((a + b) & 255 for a, b in zip(row, above, strict=True))
            elif kind:
                raise Damaged("a predictor that is not used for tables")
            rows.append(bytes(row))
            above = bytes(row)
        return b"".join(rows)

    def _all_objects(self) -> None:
        """Objects and trailers wherever they stand; of one number the last counts."""
        self.places, self.trailer, self.packed = {int(m[1]): (1, m.start()) for m in _OBJECT.finditer(self.data)}, {}, {}
        for m in re.finditer(rb"trailer", self.data):
            try:
                self.trailer |= pdf_value(self.data, m.end())[0]
            except (Damaged, TypeError):
                continue
        if not isinstance(self.trailer.get("Root"), Ref):
            for number in list(self.places):
                try:
                    if self.get(Ref((number, 0))).get("Type") == "Catalog":
                        self.trailer["Root"] = Ref((number, 0))
                except (ValueError, AttributeError, KeyError, TypeError):
                    continue

    def get(self, value):
        """What a value refers to."""
        steps = 0
        while isinstance(value, Ref):
            steps += 1
            if steps > _MOST_DEEP:
                raise Damaged("references lead in a circle")
            place = self.places.get(value[0])
            if place is None:
                return None
            value = self._object_at(place[1], value[0])[0] if place[0] == 1 else self._within(place[1]).get(value[0])
        return value

    def _within(self, number: int) -> dict:
        """The objects of an object stream."""
        if number not in self.packed:
            place = self.places.get(number)
            if place is None or place[0] != 1:
                raise Damaged("an object stream is missing")
            info, data = self._object_at(place[1], number)
            if not isinstance(info, dict) or data is None:
                raise Damaged("an object stream cannot be read")
            head = [int(x) for x in data[: info["First"]].split()][: 2 * info["N"]]
            self.packed[number] = {n: pdf_value(data, info["First"] + at)[0] for n, at in zip(head[::2], head[1::2], strict=True)}
        return self.packed[number]

    def pages(self) -> int:
        """Leaves of the page tree; a branch that comes up twice counts once."""
        root = self.get(self.trailer.get("Root"))
        if not isinstance(root, dict):
            raise Damaged("no catalog")
        todo, seen, n = [root.get("Pages")], set(), 0
        while todo:
            at = todo.pop()
            if isinstance(at, Ref):
                if at in seen:
                    continue
                seen.add(at)
            node = self.get(at)
            if not isinstance(node, dict):
                raise Damaged("the page tree leads nowhere")
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                todo += kids
            elif node.get("Type") == "Pages":
                raise Damaged("a branch of the page tree has no leaves")
            else:
                n += 1
        return n


def pdf_pages(data: bytes) -> int:
    try:
        return Pdf(data).pages()
    except Damaged:
        raise
    except (ValueError, TypeError, IndexError, KeyError, AttributeError, zlib.error, struct.error, RecursionError) as e:
        raise Damaged(f"cannot be followed: {type(e).__name__}") from None


READERS = {"pdf": pdf_pages, "png": png_pages, "jpg": jpeg_pages, "jpeg": jpeg_pages}


def inspect(files: DataFrame) -> DataFrame:
    """files(file_name, content, ...) with page_count and decode_error, as admission.admit() takes them.

    Files without content, and those of other kinds, have neither. All columns but content stay; the bytes are looked at
    where they are read, a file at a time.
    """
    kept = [c for c in files.columns if c not in ("content", "page_count", "decode_error")]
    x = files.select(*kept, extension(F.col("file_name")).alias("_kind"), "content")

    def run(batches):
        for b in batches:
            counts, errors = [], []
            kinds, contents = b.column(len(kept)).to_pylist(), b.column(len(kept) + 1)
            for k, kind in enumerate(kinds):
                count = error = None
                data = contents[k].as_py()
                if data and kind in READERS:
                    try:
                        count = READERS[kind](data)
                    except Damaged as e:
                        error = str(e)
                counts.append(count)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(kept))), pa.array(counts, pa.int32()), pa.array(errors, pa.string())], names=[*kept, "page_count", "decode_error"])

    schema = files.select(*kept).schema.add("page_count", T.IntegerType()).add("decode_error", T.StringType())
    return x.mapInArrow(run, schema)
