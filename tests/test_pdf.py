"""PDF files made here: plain, packed, with a map to Unicode, in object streams, encrypted, broken, too long."""

import base64
import time
import zlib

import pytest

from quillspark.operators.collections import Collections
from quillspark.sources import documents as S
from quillspark.sources import pdf as P
from quillspark.streaming import ingest


def stream(head, body, pack=True):
    body = zlib.compress(body) if pack else body
    return b"<< %s /Length %d%s >>\nstream\n%s\nendstream" % (head, len(body), b" /Filter /FlateDecode" if pack else b"", body)


def pdf(contents, font=b"<< /Type /Font /BaseFont /Helvetica >>", extra=(), trailer=b"", pack=True):
    """A file with a page for each content; object 1 catalog, 2 page tree, 3 font, then content and page in turn."""
    n = len(contents)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Resources << /Font << /F1 3 0 R >> >> /Count %d /Kids [ %s ] >>" % (n, b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(n))), font]
    for i, c in enumerate(contents):
        objects += [stream(b"", c, pack), b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i)]
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate([*objects, *extra], 1))
    return b"%PDF-1.7\n" + body + b"trailer << /Root 1 0 R " + trailer + b">>\n%%EOF"


LINES = rb"BT /F1 12 Tf 72 700 Td (Hello \(round\) w\157rld) Tj 0 -14 Td [(spa) -20 (ced) -400 (out)] TJ T* <41 42 4> Tj (next) ' ET"


def test_plain_and_packed():
    want = "Hello (round) world\nspaced out\nAB@\nnext"
    assert P.pdf_pages(pdf([LINES], pack=False)) == [want]
    assert P.pdf_pages(pdf([LINES, b"", b"BT (one) Tj 5 0 Td (line) Tj ET"])) == [want, "", "one line"]
    assert P.pdf_pages(pdf([b"BI /W 1 ID \x00 (no) Tj\n EI BT (yes) Tj ET"])) == ["yes"]


def test_a_map_to_unicode():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0010> <0012> <0627> <0020> <0021> [<0633> <0644>] endbfrange"
    font = b"<< /Type /Font /ToUnicode 6 0 R >>"
    assert P.pdf_pages(pdf([b"BT /F1 9 Tf <0010001100030020002100FF> Tj ET"], font, [stream(b"", cmap)])) == ["\u0627\u0628 \u0633\u0644"]


def test_object_streams_and_other_packings():
    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Contents [5 0 R 6 0 R] /Resources << >> >>"]
    places = [sum(len(x) + 1 for x in inner[:i]) for i in range(3)]
    heads = b" ".join(b"%d %d" % (i + 1, p) for i, p in enumerate(places)) + b" "
    packed = stream(b"/Type /ObjStm /N 3 /First %d" % len(heads), heads + b" ".join(inner))
    a85 = b"<< /Filter /ASCII85Decode >>\nstream\n" + base64.a85encode(b"BT (first) Tj ET") + b"~>\nendstream"
    hexed = b"<< /Filter [/ASCIIHexDecode] >>\nstream\n" + b"BT (second) Tj ET".hex().encode() + b">\nendstream"
    data = b"%PDF-1.5\n4 0 obj " + packed + b" endobj 5 0 obj " + a85 + b" endobj 6 0 obj " + hexed + b" endobj 7 0 obj " + stream(b"/Type /XRef /Root 1 0 R", b"xx") + b" endobj"
    assert P.pdf_pages(data) == ["first\nsecond"]


def test_bad_files(monkeypatch):
    for data, why in ((pdf([LINES], trailer=b"/Encrypt 9 0 R "), "encrypted"), (b"%PDF-1.7\nbroken", "no pages"), (b"text", "not a PDF"), (pdf([LINES] * 121), "more than 120 pages")):
        with monkeypatch.context() as m:
            m.setattr(P.Pdf, "text", lambda *a: pytest.fail("a page was read"))
            with pytest.raises(ValueError, match=why):
                P.pdf_pages(data)
    assert P.pdf_pages(pdf([b"BT (good) Tj ET", LINES]).replace(b"/FlateDecode", b"/LZWDecode  ", 1)) == ["", "Hello (round) world\nspaced out\nAB@\nnext"]
    loop = pdf([LINES]).replace(b"/Kids [ 5 0 R ]", b"/Kids [2 0 R] ")
    with pytest.raises(ValueError, match="no pages"):
        P.pdf_pages(loop)
    for cut in range(0, len(pdf([LINES])), 7):  # whatever is missing, it ends with pages or an error
        try:
            P.pdf_pages(pdf([LINES])[:cut])
        except (ValueError, zlib.error):
            pass


def test_files_become_pages(spark):
    files = [("a.pdf", pdf([LINES, b"BT (second page) Tj ET"])), ("b.pdf", pdf([LINES], trailer=b"/Encrypt 9 0 R ")), ("c.pdf", pdf([LINES] * 4)), ("d.pdf", b"%PDF-")]
    got: dict = {}
    for r in S.load(spark.createDataFrame(files, "filename string, content binary"), max_pages=3).collect():
        got.setdefault(r.filename, []).append((r.page_number, r.text and r.text[:6], r.load_error and r.load_error.split(": ")[-1]))
    assert sorted(got["a.pdf"]) == [(1, "Hello ", None), (2, "second", None)]
    assert [got[f] for f in ("b.pdf", "c.pdf", "d.pdf")] == [[(0, None, "the document is encrypted")], [(0, None, "more than 3 pages")], [(0, None, "the document has no pages")]]


def test_seeding_from_one_pdf(spark, tmp_path):
    store = Collections(spark, f"file://{tmp_path}")
    text = b"BT (The caravan brought spices and silk over the mountains to the old city.) Tj ET"
    files = spark.createDataFrame([("book.pdf", pdf([text, LINES]))], "filename string, content binary")
    ingest.ingest_batch(files, store, "book", 0)
    assert sorted((r.page_start, "caravan" in r.text) for r in store.read("book").collect()) == [(1, True), (2, False)]


def test_long_strings_are_read_in_runs():
    """Escapes, brackets and line ends between long runs of ordinary bytes; a run is one step, whatever its length."""
    run = b"x" * 3_000_000
    data = b"(" + run + b"\\)\\n(" + run + b")\\\r\ny\\053)z"
    began = time.process_time()
    text, at = P.read_object(data)
    assert time.process_time() - began < 0.5
    assert bytes(text) == run + b")\n(" + run + b")y+" and data[at:] == b"z"
