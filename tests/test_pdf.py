import zlib

import pytest

from doclens.sources import files, pdf


def made(objects, trailer=b"<< /Root 1 0 R >>"):
    out = b"%PDF-1.5\n"
    for n, body in objects.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    return out + b"trailer\n" + trailer + b"\n%%EOF"


def stream(data, head=b"", flate=True):
    data = zlib.compress(data) if flate else data
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if flate else b"", head, data)


CMAP = "/CIDInit begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0110> <0002> <1EC1> endbfchar 2 beginbfrange <0003> <0005> <0061> <0006> <0007> [<0020> <1EAD>] endbfrange endcmap"
FONTS = {
    20: b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding /FirstChar 32 /Widths [%s] >>" % b" ".join([b"500"] * 224),
    21: b"<< /Type /Font /Subtype /Type0 /ToUnicode 22 0 R /DescendantFonts [23 0 R] >>",
    22: stream(CMAP.encode()),
    23: b"<< /DW 500 /W [1 [600 600] 3 5 500] >>",
    24: b"<< /Font << /A 20 0 R /B 21 0 R >> /XObject << /X 25 0 R >> >>",
    25: stream(b"BT /A 10 Tf 50 100 Td (in a form) Tj ET", b"/Subtype /Form /Resources 24 0 R"),
}


def book(*pages, **more):
    kids = b" ".join(b"%d 0 R" % (10 + i) for i in range(len(pages)))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d /Resources 24 0 R >>" % (kids, len(pages)), **FONTS}
    for i, p in enumerate(pages):
        objects[10 + i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (40 + i)
        objects[40 + i] = stream(p)
    return made(objects, **more)


ONE = b"BT /A 10 Tf 50 700 Td (Caf\\351 \\(a\\)) Tj 0 -20 Td [(Two) -2000 (words) 20 (x)] TJ ET BT /B 12 Tf 1 0 0 1 50 640 Tm <00010002 0006 0003 0004 0005 0007> Tj ET"
TWO = b"q 1 0 0 1 0 50 cm BT /A 10 Tf 12 TL 50 600 Td (first) Tj T* (second) Tj (third) ' ET Q BT /A 10 Tf 300 650 Td (right) Tj ET /X Do"


def test_two_fonts_and_two_pages():
    assert pdf.text(book(ONE, TWO)) == "Café (a)\nTwo wordsx\nĐề abcậ\nfirst right\nsecond\nthird\nin a form"


def test_updates_object_streams_and_other_filters():
    data = book(b"BT /A 10 Tf 50 700 Td (old) Tj ET")
    new = b"BT /A 10 Tf 50 700 Td <4e6577> Tj ET".hex().encode() + b">"
    data += b"\n40 0 obj\n<< /Length 51 0 R /Filter [/ASCIIHexDecode] >>\nstream\n" + new + b"\nendstream\nendobj\n51 0 obj\n%d\nendobj\ntrailer\n<< /Root 1 0 R >>" % len(new)
    assert pdf.text(data) == "New"
    inner = b"1 0 2 40 24 120 ".ljust(30)
    parts = b"<< /Type /Catalog /Pages 2 0 R >>".ljust(40) + b"<< /Type /Pages /Kids [10 0 R] /Resources 24 0 R >>".ljust(80) + b"<< /Font << /A 20 0 R >> >>"
    rows = inner + parts
    objects = {30: stream(rows, b"/Type /ObjStm /N 3 /First 30"), 10: b"<< /Type /Page /Contents [40 0 R] >>", 20: FONTS[20], 40: stream(b"BT /A 10 Tf 9 9 Td (kept inside) Tj ET")}
    # Rows with PNG predictors: each one is told by its difference from the one above.
    table = bytes([2, 1, 2, 3, 2, 1, 1, 1])
    assert pdf._predicted(table, {"Predictor": 12, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4])
    assert pdf.text(made(objects, b"<< /Root 1 0 R >>")) == "kept inside"


@pytest.mark.parametrize(("data", "error"), [
    (b"no", "not a PDF"),
    (book(ONE, trailer=b"<< /Root 1 0 R /Encrypt 9 0 R >>"), "encrypted"),
    (book(b"q 1 0 0 1 0 0 cm Q"), "no text"),
    (made({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [10 0 R] >>", 10: b"<< /Contents 40 0 R >>", 40: b"<< /Length 3 /Filter /FlateDecode >>\nstream\nxyz\nendstream"}), "damaged"),
    (made({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [10 0 R] >>", 10: b"<< /Contents 40 0 R >>", 40: b"<< /Length 3 /Filter /DCTDecode >>\nstream\nxyz\nendstream"}), "DCTDecode"),
])
def test_errors(data, error):
    with pytest.raises(pdf.PdfError, match=error):
        pdf.text(data)


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(book(ONE, TWO))
    (tmp_path / "b.pdf").write_bytes(book(b""))
    got = {r.path[-5:]: (r.text, r.error) for r in files.documents(spark, str(tmp_path)).collect()}
    assert got["a.pdf"][0].startswith("Café (a)\n") and got["a.pdf"][1] is None
    assert got["b.pdf"] == (None, "PdfError: no text on any page")
