import io
import zipfile

from vellumspark.sources import readers


def zipped(**parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_x", ".xml"), text)
    return b.getvalue()


W = 'xmlns:w="urn:w"'
FILES = {
    "a.docx": zipped(word__document_x=f"<w:d {W}><w:p><w:r><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p><w:t>Three</w:t></w:p></w:d>"),
    "b.xlsx": zipped(xl__workbook_x='<b><sheets><sheet name="Costs"/></sheets></b>', xl__sharedStrings_x="<s><si><t>name</t></si></s>", xl__worksheets__sheet1_x='<w><row><c t="s"><v>0</v></c><c><v>7</v></c></row></w>'),
    "c.eml": b"From: a@b.example\nSubject: Bill\nMIME-Version: 1.0\nContent-Type: text/plain\n\nPay 5 EUR\n",
    "d.ics": b"BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:Din\r\n ner\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n",
    "e.xml": b"<rss><channel><item><title>T & U</title><link>http://x</link></item></channel></rss>",
    "f.html": b"<html><body><p>Hi <b>you</b></p><script>x</script></body></html>",
    "g.txt": "caf\u00e9".encode("cp1252"),
    "h.rtf": rb"{\rtf1{\fonttbl{\f0 Arial;}}\f0 One\par T\'e9}",
    "i.docx": b"PK\x03\x04broken",
    "k.bin": b"\0\1\2",
}
WANT = {
    "a.docx": [("docx", "One two\nThree")], "b.xlsx": [("xlsx", "name | 7")], "c.eml": [("eml", "From: a@b.example\nSubject: Bill\n\nPay 5 EUR")], "d.ics": [("ics", "SUMMARY:Dinner")], "e.xml": [("feed", "T & U\nhttp://x")],
    "f.html": [("html", "Hi you")], "g.txt": [("text", "café")], "h.rtf": [("rtf", "One\nTé")], "i.docx": [("binary", None)], "k.bin": [("binary", None)],
}


def test_files(spark, tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in readers.read_files(spark, f"file://{tmp_path}").orderBy("path", "unit").collect():
        got.setdefault(r.path.rpartition("/")[2], []).append((r.kind, r.text))
    assert got == WANT


def test_pages_keep_all_text():
    text = "\n\n".join(f"paragraph {i} " + "x" * (i % 300) for i in range(400))
    pages = readers.split_pages(text, 1000)
    assert max(map(len, pages)) <= 1000 and "".join("".join(pages).split()) == "".join(text.split())


def test_archive_bomb():
    kind, found, note = readers.units("z.docx", zipped(word__document_x="<w>" + "0" * (40 << 20) + "</w>"))
    assert kind == "docx" and not found and "too large" in note
