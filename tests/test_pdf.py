"""Page files: what other programs may write in them, and what is wrong with them."""

import zlib

import pytest

from claimloom.sources import pdf


def opened(data: bytes) -> pdf.File:
    return pdf.File(lambda at, n: data[at : at + n], len(data))


def classic(objects: dict[int, bytes], extra: bytes = b"") -> bytes:
    out, at = b"%PDF-1.4\n", {}
    for n, body in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%b\nendobj\n" % (n, body)
    rows = b"".join(b"%d 1\n%010d 00000 n \n" % (n, at[n]) for n in at)
    return out + b"xref\n0 1\n0000000000 65535 f \n%btrailer\n<< /Size 99 /Root 1 0 R %b >>\nstartxref\n%d\n%%%%EOF" % (rows, extra, len(out))


def stream(data: bytes, more: bytes = b"") -> bytes:
    z = zlib.compress(data)
    return b"<< /Length %d /Filter /FlateDecode %b >>\nstream\n%b\nendstream" % (len(z), more, z)


SHOWN = b"""q 2 0 0 2 10 20 cm /Fm Do Q
BT /A 10 Tf 12 TL 100 700 Td [(Rev) -20 (enue) -400 (rose)] TJ T* (by \\(five\\) 5\\045) Tj (next) ' 0 0 (line) " ET % a remark
BT /A 10 Tf 1 0 0 1 100 600 Tm (caf\\351 \\200 <) Tj /B 8 Tf <00410042> Tj ET"""
FORM = b"BT /A 5 Tf 5 5 Td (inside) Tj ET"
OBJECTS = {
    1: b"<< /Type /Catalog /Pages 2 0 R >>",
    2: b"<< /Type /Pages /Count 2 /Kids [3 0 R 4 0 R] /MediaBox [0 0 600 800] /Resources << /Font << /A 5 0 R /B 6 0 R >> /XObject << /Fm 10 0 R >> >> >>",
    3: b"<< /Type /Page /Parent 2 0 R /Contents [8 0 R 9 0 R] >>",
    4: b"<< /Type /Page /Parent 2 0 R >>",
    5: b"<< /Type /Font /Subtype /Type1 /FirstChar 0 /Widths [%b] /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [60 /fi] >> >>" % b" ".join([b"500"] * 256),
    6: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [7 0 R] /ToUnicode 11 0 R >>",
    7: b"<< /Type /Font /Subtype /CIDFontType2 /DW 1000 /W [65 [600] 66 70 700] >>",
    8: stream(SHOWN[:60]),
    9: stream(SHOWN[60:]),
    10: stream(FORM, b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 0 0]"),
    11: stream(b"1 beginbfrange <0041> <0042> <03B1> endbfrange"),
}
TEXT = "inside Revenue rose by (five) 5% next line café € ﬁαβ"


def text_of(data: bytes, page: int = 0) -> str:
    file = opened(data)
    return " ".join(w["text"] for w in pdf.page_words(file, file.pages()[page]))


def cut(where: int) -> dict[int, bytes]:
    """Contents cut at a blank, since streams of a page are joined by white space."""
    return OBJECTS | {8: stream(SHOWN[:where]), 9: stream(SHOWN[where:])}


def test_operators_fonts_and_forms():
    data = classic(cut(SHOWN.index(b"BT /A 10 Tf 12")))
    assert text_of(data) == TEXT and text_of(data, 1) == ""
    file = opened(data)
    words = pdf.page_words(file, file.pages()[0])
    first = words[0]
    assert (first["x0"], first["x1"]) == (20.0, 50.0) and (first["y0"], first["y1"]) == (762.0, 772.0)  # 6 letters of half of 5, twice as large, from 10 + 2 * 5
    revenue = words[1]
    assert revenue["text"] == "Revenue" and revenue["x0"] == 100 and revenue["x1"] == pytest.approx(135.2) and revenue["start"] == 7 and revenue["end"] == 14
    assert words[-1]["x1"] - words[-1]["x0"] == pytest.approx(5 + 8 * 1.3)


def packed() -> bytes:
    """The same file with object streams and a cross-reference stream whose rows are predicted."""
    objects = cut(SHOWN.index(b"BT /A 10 Tf 12"))
    inner = {n: b for n, b in objects.items() if b"stream" not in b}
    head, body = b"", b""
    for n, b in inner.items():
        head += b"%d %d " % (n, len(body))
        body += b + b" "
    out, at = b"%PDF-1.5\n", {}
    for n, b in {n: b for n, b in objects.items() if n not in inner}.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%b\nendobj\n" % (n, b)
    at[20] = len(out)
    out += b"20 0 obj\n%b\nendobj\n" % stream(head + body, b"/Type /ObjStm /N %d /First %d" % (len(inner), len(head)))
    rows = [(2, 20, list(inner).index(n)) if n in inner else (1, at.get(n, 0), 0) for n in range(1, 21)]
    flat, before = b"", bytes(6)
    for kind, a, b in rows:
        row = bytes([kind]) + a.to_bytes(4, "big") + bytes([b])
        flat += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, before, strict=True))
        before = row
    where = len(out)
    out += b"21 0 obj\n%b\nendobj\n" % stream(flat, b"/Type /XRef /W [1 4 1] /Index [1 20] /Size 22 /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 6 >>")
    return out + b"startxref\n%d\n%%%%EOF" % where


def test_object_streams_and_broken_references():
    assert text_of(packed()) == TEXT
    assert text_of(packed().replace(b"startxref", b"startxxxx")) == TEXT
    data = classic(cut(SHOWN.index(b"BT /A 10 Tf 12")))
    assert text_of(data.replace(b"startxref\n", b"startxref\n9")) == TEXT
    with pytest.raises(pdf.Unreadable):
        opened(classic(OBJECTS, b"/Encrypt 5 0 R"))
    with pytest.raises(pdf.Unreadable):
        opened(b"%PDF-1.4 nothing else")


def test_source(spark, tmp_path):
    pdf.register(spark)
    texts = [(1, "one  two\n\n three\fpage 2 " + "x" * 3000), (2, ""), (3, None), (4, "中文 😀 ﬁn­") , (5, "\f".join(f"p{i} of the file" for i in range(120)))]
    folder = f"file://{tmp_path}/pdf"
    df = spark.createDataFrame(texts, "doc_id long, text string")
    df.write.format("pdf_pages").mode("append").save(folder)
    df.write.format("pdf_pages").mode("append").save(folder)  # a second try leaves the same files
    (tmp_path / "pdf" / "bad.pdf").write_bytes(b"%PDF-1.4\nno objects")
    (tmp_path / "pdf" / "packed.PDF").write_bytes(packed())
    (tmp_path / "pdf" / "notes.txt").write_text("not a page file")
    whole = {(r.path.rsplit("/", 1)[1].split("-")[0], r.page_no): r for r in spark.read.format("pdf_pages").load(folder).collect()}
    ranges = spark.read.format("pdf_pages").option("largeBytes", 1).option("pagesPerPartition", 7).load(folder)
    assert {(r.path.rsplit("/", 1)[1].split("-")[0], r.page_no): r for r in ranges.collect()} == whole and ranges.rdd.getNumPartitions() >= 18
    assert len(whole) == 2 + 1 + 1 + 1 + 120 + 1 + 2
    assert whole["1", 1].page_text == "one two three" and [(w.start, w.x0, w.y0) for w in whole["1", 1].words] == [(0, 0, 0), (4, 5, 0), (8, 1, 2)]
    assert len(whole["1", 2].words[2].text) == 3000 and whole["2", 1].page_text == "" and whole["4", 1].page_text == "中文 😀 ﬁn­"
    assert [whole["5", i + 1].page_text for i in range(120)] == [f"p{i} of the file" for i in range(120)]
    bad = whole["bad.pdf", None]
    assert bad.problem.startswith("Unreadable") and bad.words is None and whole["packed.PDF", 1].page_text == TEXT


def test_pages_are_read_without_steps_for_each_glyph(tmp_path):
    """Glyphs are placed and put together into words string by string, and words go to Spark as columns."""
    import sys

    import pyarrow as pa

    lines = ["the quick  brown fox 中 " * 20] * 40
    (tmp_path / "1.pdf").write_bytes(pdf.write_pdf("\n".join(lines)))
    (tmp_path / "2.pdf").write_bytes(b"%PDF-1.4\nno objects")
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    reader = pdf.PdfReader(f"file://{tmp_path}", pdf.LARGE, pdf.RANGE)
    read = lambda: [b for p in reader.partitions() for b in reader.read(p)]
    read()  # what is imported on first use is not counted
    sys.setprofile(count)
    try:
        got = read()
    finally:
        sys.setprofile(None)
    assert all(isinstance(b, pa.RecordBatch) for b in got)
    assert calls < sum(map(len, lines)) / 4
    first, second = pa.Table.from_batches(got).to_pylist()
    expected = [(w, x, y) for y, line in enumerate(lines) for x, w in ((i, line[i:].split(" ")[0]) for i in range(len(line)) if line[i] != " " and line[i - 1 : i] in ("", " "))]
    assert [(w["text"], w["x0"], w["y0"]) for w in first["words"]] == expected and first["page_text"] == " ".join(w for w, _, _ in expected)
    assert all(first["page_text"][w["start"] : w["end"]] == w["text"] and w["x1"] == w["x0"] + len(w["text"]) for w in first["words"])
    assert second["words"] is None and second["page_no"] is None and second["problem"].startswith("Unreadable")
