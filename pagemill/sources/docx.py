"""Word documents: a heading, a table of facts and paragraphs, as the parts of a zip file; and their texts read back."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
#: Characters that XML cannot hold.
UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")

PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}


def _run(text: str, bold: bool = False, half_points: int | None = None, italic: bool = False) -> str:
    """One line of text; a newline in it is a break and a tab a tab."""
    look = "<w:b/>" * bold + "<w:i/>" * italic + (f'<w:sz w:val="{half_points}"/>' if half_points else "")
    parts = {"\n": "<w:br/>", "\t": "<w:tab/>"}
    body = "".join(parts.get(x) or f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in re.split("([\n\t])", UNFIT.sub(" ", text).replace("\r", " ")) if x)
    return f"<w:r>{f'<w:rPr>{look}</w:rPr>' if look else ''}{body}</w:r>"


def _paragraph(run: str, centred: bool = False) -> str:
    return f"<w:p>{'<w:pPr><w:jc w:val=\"center\"/></w:pPr>' if centred else ''}{run}</w:p>"


def write_docx(title: str, facts: list[tuple[str, str]], heading: str, paragraphs: list[str], table_heading: str = "", footer: str = "") -> bytes:
    cell = lambda text, bold: f'<w:tc><w:tcPr><w:tcW w:w="0" w:type="auto"/></w:tcPr>{_paragraph(_run(text, bold))}</w:tc>'
    edges = "".join(f'<w:{e} w:val="single" w:sz="4" w:color="auto"/>' for e in ("top", "left", "bottom", "right", "insideH", "insideV"))
    rows = "".join(f"<w:tr>{cell(k, True)}{cell(v, False)}</w:tr>" for k, v in facts)
    body = [_paragraph(_run(title, True, 36), True)]
    if table_heading:
        body.append(_paragraph(_run(table_heading, True, 28)))
    if facts:
        body.append(f"<w:tbl><w:tblPr><w:tblBorders>{edges}</w:tblBorders></w:tblPr><w:tblGrid><w:gridCol/><w:gridCol/></w:tblGrid>{rows}</w:tbl>")
    body += [_paragraph(""), _paragraph(_run(heading, True, 28)), *(_paragraph(_run(p)) for p in paragraphs)]
    if footer:
        body += [_paragraph(""), _paragraph(_run(footer, half_points=18, italic=True), True)]
    document = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{W}"><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (PARTS | {"word/document.xml": document}).items():
            z.writestr(zipfile.ZipInfo(name), text)  # without a time: the same record gives the same bytes
    return out.getvalue()


def read_docx(content: bytes) -> tuple[list[str], list[list[str]]]:
    """The paragraphs outside of tables, and the rows of tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{{{W}}}body")
    texts = {f"{{{W}}}t": lambda e: e.text or "", f"{{{W}}}br": lambda e: "\n", f"{{{W}}}tab": lambda e: "\t"}
    text = lambda e: "".join(texts[x.tag](x) for x in e.iter() if x.tag in texts)
    rows = [[text(c) for c in r.iter(f"{{{W}}}tc")] for r in body.iter(f"{{{W}}}tr")]
    return [text(p) for p in body.findall(f"{{{W}}}p")], rows
