"""Files by their bytes: whole ones have their pages, damaged and truncated ones are refused, whatever was done to them."""

import struct
import zlib
from random import Random

import pytest
from ledgerspark.plans import render
from ledgerspark.sources import pages
from ledgerspark.sources.admission import admit
from ledgerspark.sources.files import read_files


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("n", [0, 1, 3, 4, 12])
def test_pdf_pages(n, packed):
    assert pages.pdf_pages(render.pdf([f"text {k} endobj (" for k in range(n)], packed)) == n


def test_pdf_of_several_versions():
    """A later section replaces an object: the page tree has one page more."""
    data = render.pdf(["a", "b"])
    at = len(data)
    new = b"2 0 obj\n<< /Type /Pages /Count 3 /Kids [3 0 R << /Type /Pages /Kids [5 0 R 7 0 R 5 0 R] >>] /Note (a \\) b (c) ) >>\nendobj\n7 0 obj <</Type/Page>> endobj\n"
    start = int(data.rpartition(b"startxref\n")[2].split()[0])
    xref = at + len(new)
    second = at + new.index(b"7 0 obj")
    data += new + f"xref\n2 1\n{at:010d} 00000 n \n7 1\n{second:010d} 00000 n \ntrailer\n<< /Size 8 /Root 1 0 R /Prev {start} >>\nstartxref\n{xref}\n%%EOF".encode()
    assert pages.pdf_pages(data) == 3
    assert pages.pdf_pages(b"\n\n" + data) == 3  # all places are off by two: the objects are looked for
    assert pages.pdf_pages(data.replace(b"startxref\n" + str(xref).encode(), b"startxref\n99999999")) == 3


@pytest.mark.parametrize("change", [
    lambda d: d[: len(d) // 2], lambda d: d[:-8], lambda d: b"", lambda d: d[9:], lambda d: d.replace(b"/Root 1 0 R", b"/Root 9 0 R").replace(b"/Catalog", b"/Nothing"),
    lambda d: d.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt << /V 1 >>"), lambda d: d.replace(b"3 0 obj", b"3 0 xyz"), lambda d: d.replace(b"/Kids", b"/Kidz"), lambda d: d.replace(b"/Pages 2 0 R", b"/Pages 1 0 R").replace(b"/Catalog", b"/Pages  "),
])
def test_damaged_pdf(change):
    with pytest.raises(pages.Damaged):
        pages.pdf_pages(change(render.pdf(["a", "b"])))


def test_no_bytes_hang_or_crash():
    random, whole = Random(7), [render.pdf(["some text"] * 2), render.pdf(["some text"] * 2, True), render.png("pixels" * 20), render.jpeg("some of the pixels" * 9)]
    for k in range(1500):
        data = bytearray(whole[k % 4])
        for _ in range(random.randint(1, 6)):
            at = random.randrange(len(data))
            if random.random() < 0.4:
                del data[at : at + random.randint(1, 30)]
            else:
                data[at] = random.choice([0, 10, 40, 60, 91, 255, random.randrange(256)])
        try:
            assert (pages.pdf_pages, pages.pdf_pages, pages.png_pages, pages.jpeg_pages)[k % 4](bytes(data)) >= 0
        except pages.Damaged:
            pass
    with pytest.raises(pages.Damaged):
        pages.pdf_value(b"[" * 100_000, 0)
    with pytest.raises(pages.Damaged):
        pages.pdf_pages(b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj 2 0 R endobj trailer << /Root 1 0 R >> %%EOF")


def test_images():
    png, jpeg = render.png("some pixels" * 30), render.jpeg("some pixels of the scan" * 30)
    assert pages.png_pages(png) == pages.jpeg_pages(jpeg) == 1
    assert pages.png_pages(png + b"behind the end") == 1
    for k in range(8, len(png), 7):
        for bad in (png[:k], png[:k] + bytes([png[k] ^ 4]) + png[k + 1 :]):
            with pytest.raises(pages.Damaged):
                pages.png_pages(bad)
    for k in range(0, len(jpeg) - 1, 11):
        with pytest.raises(pages.Damaged):
            pages.jpeg_pages(jpeg[:k])
    with pytest.raises(pages.Damaged):
        pages.jpeg_pages(b"\xff\xd8\xff\xd9")
    with pytest.raises(pages.Damaged):
        pages.png_pages(png[:8] + png[33:])  # no header
    assert zlib.crc32(b"IEND") == struct.unpack(">I", png[-4:])[0]


def test_files_are_refused_by_their_bytes(spark, tmp_path):
    made = {"three.pdf": render.pdf(["x"] * 3, True), "four.pdf": render.pdf(["x"] * 4), "none.PDF": render.pdf([]), "cut.pdf": render.pdf(["x"])[:200], "fine.png": render.png("x"), "bad.png": render.png("x" * 50)[:-20], "fine.JPEG": render.jpeg("x"), "text.jpg": b"not a picture", "note.txt": b"words", "big.pdf": b"%PDF-" + b"x" * (10 << 20)}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    got = {r.file_name: r for r in admit(pages.inspect(read_files(spark, f"file://{tmp_path}"))).collect()}
    assert {n: (r.error_code, r.is_readable, r.page_count) for n, r in got.items()} == {
        "three.pdf": (None, True, 3), "four.pdf": ("INVALID_FILE_ERROR", True, 4), "none.PDF": ("INVALID_FILE_ERROR", True, 0), "cut.pdf": ("INVALID_FILE_ERROR", False, None),
        "fine.png": (None, True, 1), "bad.png": ("INVALID_FILE_ERROR", False, None), "fine.JPEG": (None, True, 1), "text.jpg": ("INVALID_FILE_ERROR", False, None), "note.txt": ("UNSUPPORTED_FILE_TYPE", None, None), "big.pdf": ("INVALID_FILE_ERROR", None, None),
    }
    assert "ends within a chunk" in got["bad.png"].error_message and "10 MB" in got["big.pdf"].error_message and "1 to 3 pages" in got["four.pdf"].error_message
    assert pages.inspect(read_files(spark, f"file://{tmp_path}").where("false")).count() == 0
