"""Text layers of files made here: plain, deflated, with object streams, updated and broken."""

import zlib

import pytest

from recordloom.sources import pdf


def made(contents, deflate=False, objstm=False, first_length=True):
    """A file of one page for each content stream."""
    kids = " ".join(f"{10 + 2 * k} 0 R" for k in range(len(contents)))
    plain = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{kids}] /Count {len(contents)} >>"}
    out = b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"
    for k in range(len(contents)):
        plain[10 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R /Resources << >> >>"
    if objstm:
        at, bodies, head = 0, "", ""
        for n, body in plain.items():
            head += f"{n} {at} "
            bodies += body + " "
            at = len(bodies)
        data = zlib.compress((head + bodies).encode())
        out += f"5 0 obj\n<< /Type /ObjStm /N {len(plain)} /First {len(head)} /Filter /FlateDecode /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n"
    else:
        for n, body in plain.items():
            out += f"{n} 0 obj\n{body}\nendobj\n".encode()
    for k, c in enumerate(contents):
        data = zlib.compress(c) if deflate else c
        size = f"/Length {len(data)}" if first_length else "/Length 99 0 R"
        out += f"{11 + 2 * k} 0 obj\n<< {size} {'/Filter /FlateDecode' if deflate else ''} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF\n"


ONE = b"BT /F1 12 Tf 72 720 Td (Hello \\(World\\)) Tj 0 -14 Td [(Sur) -20 (vey) -300 (No: 5)] TJ T* <4F776E6572> Tj ET"
TWO = b"BT 1 0 0 1 72 700 Tm (caf\\351 \\\\ x) Tj (next) ' ET q (not shown) pop Q BT 5 0 Td (same line) Tj ET"


@pytest.mark.parametrize("deflate", [False, True])
@pytest.mark.parametrize("objstm", [False, True])
@pytest.mark.parametrize("first_length", [False, True])
def test_pages(deflate, objstm, first_length):
    assert pdf.pages(made([ONE, TWO, b""], deflate, objstm, first_length)) == ["Hello (World)\nSurvey No: 5\nOwner", "café \\ x\nnextsame line", ""]


def test_updates_and_utf16():
    first = made([b"BT (old) Tj ET"])
    new = b"BT <FEFF09170 93E0935> Tj ET".replace(b" 93E", b"93E")
    assert pdf.pages(first + f"11 0 obj\n<< /Length {len(new)} >>\nstream\n".encode() + new + b"\nendstream\nendobj\n") == ["गाव"]


@pytest.mark.parametrize("raw", [b"", b"not a pdf", b"%PDF-1.4\n", made([ONE]).replace(b"/Root", b"/Encrypt 9 0 R /Root"), b"%PDF-1.4 1 0 obj << /Type /Catalog /Pages 1 0 R /Kids [1 0 R] >> endobj"])
def test_broken(raw):
    assert pdf.pages(raw) == []


def test_cut_files():
    whole = made([ONE, TWO], deflate=True)
    for n in range(0, len(whole), 7):
        pdf.pages(whole[:n])  # whatever is there


def test_rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made([ONE, b""], deflate=True))
    (tmp_path / "b.pdf").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(made([ONE]))
    got = pdf.read_pdf_pages(spark, str(tmp_path)).orderBy("page").collect()
    assert [(r["path"].rpartition("/")[2], r["page"], r["page_count"], [(b["text"], b["bbox"], b["confidence"]) for b in r["blocks"]]) for r in got] == [
        ("a.pdf", 1, 2, [("Hello (World)\nSurvey No: 5\nOwner", [0.0] * 4, 1.0)]), ("a.pdf", 2, 2, []),
    ]
