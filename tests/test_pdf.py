"""The PDF reader on files made here, and what the parser does with PDFs."""

import base64
import zlib

import pytest

from docgauge.plans.run import parse_folder
from docgauge.sources import files as fs
from docgauge.sources import pdf

HELVETICA = "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"


def stream(data, extra="", flate=True):
    data = data.encode("cp1252") if isinstance(data, str) else data
    body = zlib.compress(data) if flate else data
    return f"<< /Length {len(body)} {'/Filter /FlateDecode' if flate else ''} {extra} >>\nstream\n".encode() + body + b"\nendstream"


def build(pages, fonts=None, extra=None, packed=False):
    """A file with a content stream per page. ``fonts``: name -> object; ``extra``: object number -> bytes."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    fonts = fonts or {"F1": HELVETICA}
    extra = extra or {}
    x = " ".join(f"/X{n} {n} 0 R" for n in extra)
    res = f"<< /Font << {' '.join(f'/{k} {v}' for k, v in fonts.items())} >> /XObject << {x} >> >>"
    kids = []
    for i, p in enumerate(pages):
        objects[10 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R >>".encode()
        objects[11 + 2 * i] = p if isinstance(p, bytes) else stream(p)
        kids.append(f"{10 + 2 * i} 0 R")
    objects[2] = f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(kids)}] /MediaBox [0 0 600 800] /Resources {res} >>".encode()
    objects |= extra
    if packed:  # dictionaries in a compressed object stream
        plain = {n: o for n, o in objects.items() if b"stream" not in o}
        heads, body = "", b""
        for n, o in plain.items():
            heads += f"{n} {len(body)} "
            body += o + b" "
        objects = {n: o for n, o in objects.items() if n not in plain}
        objects[900] = stream(heads.encode() + body, f"/Type /ObjStm /N {len(plain)} /First {len(heads)}")
        objects[901] = stream(b"", "/Type /XRef /Root 1 0 R /Size 902")
    out = b"%PDF-1.5\n" + b"".join(f"{n} 0 obj\n".encode() + o + b"\nendobj\n" for n, o in objects.items())
    return out + (b"%%EOF" if packed else b"trailer << /Root 1 0 R >>\n%%EOF")


TEXT = "BT /F1 12 Tf 50 700 Td (Été à l’assurance) Tj 0 -14 Td (deuxième \\(ligne\\)) Tj 0 -60 Td [(Apr) -20 (ès) -400 (coup)] TJ ET"


@pytest.mark.parametrize("packed", [False, True])
def test_text_of_pages(packed):
    pages, typed, images = pdf.read(build([TEXT, "BT /F1 10 Tf 1 0 0 1 50 500 Tm (Page deux) Tj ET"], packed=packed))
    assert pages == ["Été à l’assurance\ndeuxième (ligne)\n\nAprès coup", "Page deux"] and not typed and not images
    assert pdf.read(build([TEXT, "BT /F1 10 Tf (Page deux) Tj ET"], packed=packed), 2, 2)[0] == ["Page deux"]


def test_filters_and_strings():
    for raw in (base64.a85encode(b"BT /F1 9 Tf <4162> Tj ET") + b"~>", b"BT /F1 9 Tf <4162> Tj ET".hex().encode() + b">"):
        name = "ASCII85Decode" if raw.endswith(b"~>") else "ASCIIHexDecode"
        assert pdf.read(build([stream(raw, f"/Filter /{name}", flate=False)]))[0] == ["Ab"]
    assert pdf._lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B" and pdf._run_length(bytes([2, 65, 66, 67, 254, 68, 128])) == b"ABCDDD"
    rows = bytes([2, 1, 2, 3, 2, 1, 1, 1, 1, 5, 1, 1])
    assert pdf._predict(rows, {"Predictor": 12, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4, 5, 6, 7])
    lex = pdf.Lexer(b"<< /A#20b [1 -2.5 (a\\051\\n) <6> true 3 0 R] % note\n>> Do")
    assert lex.next() == {"A b": [1, -2.5, b"a)\n", b"`", True, pdf.Ref(3)]} and lex.next() == "Do" and lex.next() == ""


def test_fonts_by_map_differences_and_lost_codes():
    cmap = stream(b"1 beginbfchar <0041> <00C90074> endbfchar 1 beginbfrange <0050> <0052> <0061> endbfrange 1 beginbfrange <0060> <0061> [<0031> <0032>] endbfrange")
    fonts = {
        "F1": "<< /Subtype /Type0 /Encoding /Identity-H /ToUnicode 50 0 R /DescendantFonts [<< /DW 500 /W [65 [600] 80 82 400] >>] >>",
        "F2": "<< /Subtype /Type1 /Encoding << /BaseEncoding /MacRomanEncoding /Differences [1 /eacute /Eacute /quoteright 10 /uni20AC /g77 /ccedilla] >> >>",
    }
    got = pdf.read(build(["BT /F1 10 Tf 50 700 Td <004100500051006000610099> Tj /F2 10 Tf 0 -12 Td <0102030A0B0C8E> Tj ET"], fonts, {50: cmap}))[0]
    assert got == ["Étab12(cid:153)\néÉ’€(cid:11)çé"]
    assert pdf.glyph("Otilde") == "Õ" and pdf.glyph("three") == "3" and pdf.glyph("g12") is None and pdf.glyph("a.alt") == "a"


def test_tables_images_and_forms():
    grid = " ".join(f"50 {y} m 250 {y} l S" for y in (400, 420, 440)) + " " + " ".join(f"{x} 400 m {x} 440 l S" for x in (50, 150, 250)) + " 300 300 10 10 re S"
    image = stream(b"\xff\xd8", "/Subtype /Image /Filter /DCTDecode", flate=False)
    form = stream("BT /F1 10 Tf (dans la forme) Tj ET q 30 0 0 30 0 0 cm /X60 Do Q", "/Subtype /Form /Matrix [1 0 0 1 100 200]")
    content = f"{grid} q 200 0 0 100 50 50 cm /X60 Do Q q 10 0 0 10 20 700 cm BI /W 1 /H 1 ID \x00\x01 EI Q /X61 Do BT /F1 9 Tf 50 600 Td (fin) Tj ET"
    texts, typed, images = pdf.read(build([content], extra={60: image, 61: form}))
    assert [b["kind"] for b in typed] == ["table", "image", "image", "image"] and "dans la forme" in texts[0] and "fin" in texts[0]
    assert images[0] == [{"x0": 20, "top": 90, "x1": 30, "bottom": 100}, {"x0": 100, "top": 570, "x1": 130, "bottom": 600}, {"x0": 50, "top": 650, "x1": 250, "bottom": 750}]
    assert pdf.count(build([content], extra={60: image, 61: form})) == (1, 4, 3)


def test_pictures():
    grey = stream(bytes(range(6)), "/Subtype /Image /Width 3 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceGray")
    rgb = stream(bytes(12), "/Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace [/ICCBased 70 0 R]")
    odd = stream(b"\x00", "/Subtype /Image /Width 8 /Height 1 /BitsPerComponent 1 /ColorSpace /DeviceGray")
    jpeg = stream(b"\xff\xd8rest", "/Subtype /Image /Filter /DCTDecode", flate=False)
    content = " ".join(f"q 50 0 0 50 50 {y} cm /X{n} Do Q" for n, y in ((60, 100), (61, 600), (62, 300), (63, 200)))
    files = pdf.pictures(build([content], extra={60: grey, 61: rgb, 62: odd, 63: jpeg, 70: stream(b"", "/N 3")}), 1)
    assert [e for _, e in files] == ["png", "", "jpg", "png"] and files[2][0] == b"\xff\xd8rest"
    png = files[3][0]
    at = png.index(b"IDAT")
    assert png.startswith(b"\x89PNG") and png[16:24] == (3).to_bytes(4, "big") + (2).to_bytes(4, "big") and zlib.decompress(png[at + 4 : at + 4 + int.from_bytes(png[at - 4 : at], "big")]) == bytes([0, 0, 1, 2, 0, 3, 4, 5])


def test_damage():
    whole = build([TEXT, TEXT])
    assert pdf.read(whole.replace(b"trailer", b"trelier"))[0][0].startswith("Été")  # the catalog is looked for
    assert pdf.read(build([TEXT, b"<< /Length 4 /Filter /FlateDecode >>\nstream\nabcd\nendstream"]))[0][1] == ""
    loop = build([TEXT]).replace(b"/Kids [10 0 R]", b"/Kids [2 0 R 10 0 R]")
    assert len(pdf.read(loop)[0]) == 1
    for bad in (b"", b"%PDF-1.4", whole.replace(b"/Root", b"/Encrypt 5 0 R /Root"), b"\x00" * 100):
        with pytest.raises(ValueError):
            pdf.read(bad)
    for cut in range(0, len(whole), 97):  # never anything but a value or a ValueError
        try:
            pdf.read(whole[:cut])
        except ValueError:
            pass


def page(n):
    return f"BT /F1 12 Tf 50 700 Td (Page {n} du contrat de la caisse avec assez de mots pour compter.) Tj ET"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("pdf")
    image = stream(b"\xff\xd8", "/Subtype /Image /Filter /DCTDecode", flate=False)
    (d / "a.pdf").write_bytes(build([page(i) + (" q 100 0 0 50 50 50 cm /X60 Do Q q 90 0 0 40 50 300 cm /X60 Do Q" if i == 2 else "") for i in range(1, 6)], extra={60: image}))
    lost = stream(b"1 beginbfchar <41> <FFFD> endbfchar")
    (d / "b.pdf").write_bytes(build(["BT /F1 12 Tf 50 700 Td (AAAAAAAAAA) Tj ET"], {"F1": HELVETICA.replace(">>", "/ToUnicode 50 0 R >>")}, {50: lost}))
    (d / "c.pdf").write_bytes(b"%PDF-1.4 rien")
    (d / "d.pdf").write_bytes(build(["0 0 m"]))
    return str(d)


def test_pdfs_are_parsed(spark, folder):
    got = {r["doc_id"]: r for r in parse_folder(spark, folder).collect()}
    a, b = got["a"], got["b"]
    assert a["markdown"].count("Page ") == 5 and a["category"] == "mixed" and a["provenance"]["source_pages"] == 5 and a["provenance"]["parser"] == "builtin"
    assert [(i["placeholder"], i["top"]) for i in a["images"]] == [("[[IMAGE:p=2;idx=1]]", 460.0), ("[[IMAGE:p=2;idx=2]]", 700.0)] and a["markdown"].index("Page 2") < a["markdown"].index("[[IMAGE:p=2;idx=1]]") < a["markdown"].index("Page 3")
    assert [x["kind"] for x in a["blocks"]] == ["image", "image"] + ["text"] * 5 and a["parse_confidence"] == 0.4  # thin pages
    assert b["markdown"] == "AAAAAAAAAA" and b["parse_confidence"] <= 0.6  # the second reader lost fewer glyphs
    assert got["c"]["category"] == "unreadable" and got["c"]["blocks"][0]["kind"] == "unreadable" and got["d"]["markdown"] == "" and got["d"]["category"] == "scanned"


def test_choice_of_readers():
    one = lambda text: lambda content: ([text], [], {})

    def failing(content):
        raise OSError

    assert fs.read_pdf(b"", [one("ab�" * 9), one("cd")])[0::3] == ("cd", True)
    assert fs.read_pdf(b"", [one("ab�"), one("c��")])[0::3] == ("ab�", False)
    assert fs.read_pdf(b"", [one("abcdefghijklmnopqrst�"), one("cd")])[0].startswith("abc")  # few lost: no second try
    assert fs.read_pdf(b"", [failing, one("cd")])[0::3] == ("cd", True)
    with pytest.raises(ValueError):
        fs.read_pdf(b"", [failing, one(" ")])


def test_heavy_extraction_in_batches(spark, folder, monkeypatch):
    def extractor(content, first, last):
        if first == 2:
            raise MemoryError
        if first == 4:
            while True:  # runs into the limit of time
                pass
        return "" if first == 5 else f"## Titre {first}-{last}\n\nCorps"

    monkeypatch.setattr(fs, "LIMIT", 0.5)
    files = fs.scan(spark, folder)
    triaged = fs.triage(files).cache()
    parts = {r["path"].rsplit("/", 1)[-1]: r["parts"] for r in fs.extract_pages(files, triaged, extractor, 1, 2, 0.5).collect()}
    assert [p.split("\n")[0] for p in parts["a.pdf"]] == ["## Titre 1-1", "## Titre 3-3", "Page 5 du contrat de la caisse avec assez de mots pour compter."]
    assert "Page 2 du" in parts["a.pdf"][0] and "Page 4 du" in parts["a.pdf"][1]
    docs = {r["doc_id"]: r for r in fs.parse(files, triaged, extracted=fs.extract_pages(files, triaged, extractor, 1, 2, 0.5)).collect()}
    a = docs["a"]
    assert a["markdown"].endswith("[[IMAGE:p=2;idx=1]]\n\n[[IMAGE:p=2;idx=2]]") and {b["page"] for b in a["blocks"] if b["kind"] == "text"} == {0} and len(a["images"]) == 2
    assert docs["b"]["markdown"].startswith("## Titre 1") and docs["c"]["blocks"][0]["kind"] == "unreadable"
