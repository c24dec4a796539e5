"""Files as rows: binary files are sniffed, decoded and cut into units (pages, sections, sheets, parts), a batch at a time on the executors.

A file that can't be read gives one row with a note instead of failing its task. Archives are bounded before they are opened.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

UNITS = "path string, kind string, unit int, label string, text string, note string"
#: What an archive may hold before it is refused: entries, bytes unpacked, times its packed size.
ENTRIES, UNPACKED, RATIO = 4000, 200 << 20, 200
PAGE = 6000


def decode(data: bytes) -> str:
    """Text by its byte order mark, as UTF-8 where valid, else as Windows-1252, else as Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    for name in ("utf-8", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def sniff(name: str, data: bytes) -> str:
    """The kind of a file by its content first and its name second."""
    if data.startswith(b"%PDF-"):
        return "pdf"
    if data.startswith(b"PK\x03\x04"):
        try:
            names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
        except zipfile.BadZipFile:
            return "binary"
        for part, kind in (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"), ("META-INF/container.xml", "epub"), ("content.xml", "odt")):
            if part in names:
                return kind
        return "zip"
    if data.startswith((b"\x89PNG", b"\xff\xd8\xff", b"GIF8")):
        return "image"
    if b"\0" in data[:4096] and not data.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "binary"
    head, end = decode(data[:4096]), name.lower().rpartition(".")[2]
    if head.lstrip().startswith("{\\rtf"):
        return "rtf"
    if "BEGIN:VCALENDAR" in head:
        return "ics"
    if re.search(r"<(?:rss|feed|rdf:RDF)\b", head):
        return "feed"
    if re.search(r"(?i)<!doctype html|<html\b|<body\b", head):
        return "html"
    if end == "eml" or re.match(r"(?:[A-Za-z-]+:[^\n]*\n(?:[ \t][^\n]*\n)*){2,}\r?\n", head) and re.search(r"(?im)^(from|subject):", head):
        return "eml"
    return {"csv": "csv", "md": "markdown", "json": "json", "srt": "srt"}.get(end, "text")


def split_pages(text: str, size: int = PAGE) -> list[str]:
    """Pages of about `size` signs, cut at paragraph ends where there are any, else at line ends, else anywhere."""
    out = []
    while len(text) > size:
        at = max(text.rfind("\n\n", size // 2, size), -1)
        if at < 0:
            at = text.rfind("\n", size // 2, size)
        at = at if at > 0 else size
        out.append(text[:at].strip("\n"))
        text = text[at:].lstrip("\n")
    return [*out, text] if text or not out else out


def _archive(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    infos = z.infolist()
    total = sum(i.file_size for i in infos)
    if len(infos) > ENTRIES or total > UNPACKED or total > RATIO * max(len(data), 1 << 16):
        raise ValueError("archive too large")
    return z


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    raw = z.read(name)
    if b"<!DOCTYPE" in raw[:2000]:
        raise ValueError("document type in part")
    return ElementTree.fromstring(raw)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _runs(e: ElementTree.Element, text: str = "t", paragraph: str = "p") -> list[str]:
    out = []
    for p in e.iter():
        if _local(p) == paragraph:
            out.append("".join((x.text or "") if _local(x) == text else "\t" if _local(x) == "tab" else "\n" if _local(x) == "br" else "" for x in p.iter()))
    return out


def docx(data: bytes) -> list[tuple[str, str]]:
    return [("document", "\n".join(_runs(_xml(_archive(data), "word/document.xml"))))]


def pptx(data: bytes) -> list[tuple[str, str]]:
    z = _archive(data)
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    return [(f"slide {k}", "\n".join(x for x in _runs(_xml(z, n)) if x)) for k, n in enumerate(slides, 1)]


def odt(data: bytes) -> list[tuple[str, str]]:
    body = _xml(_archive(data), "content.xml")
    return [("document", "\n".join("".join(e.itertext()) for e in body.iter() if _local(e) in ("p", "h")))]


def xlsx(data: bytes) -> list[tuple[str, str]]:
    """A unit for each sheet, its rows as cells with bars between."""
    z = _archive(data)
    names = set(z.namelist())
    shared = ["".join(t.text or "" for t in s.iter() if _local(t) == "t") for s in _xml(z, "xl/sharedStrings.xml") if _local(s) == "si"] if "xl/sharedStrings.xml" in names else []
    titles = [s.get("name", "") for s in _xml(z, "xl/workbook.xml").iter() if _local(s) == "sheet"]
    out = []
    for k, title in enumerate(titles, 1):
        part = f"xl/worksheets/sheet{k}.xml"
        if part not in names:
            continue
        rows = []
        for row in (r for r in _xml(z, part).iter() if _local(r) == "row"):
            cells = []
            for c in (x for x in row if _local(x) == "c"):
                v = next((x.text or "" for x in c if _local(x) == "v"), "".join(t.text or "" for t in c.iter() if _local(t) == "t"))
                cells.append(shared[int(v)] if c.get("t") == "s" and v.isdigit() and int(v) < len(shared) else v)
            rows.append(" | ".join(cells))
        out.append((title, "\n".join(rows)))
    return out


def eml(data: bytes) -> list[tuple[str, str]]:
    """The headers and body of a mail, then a unit for each text attachment; others are named only."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    body = m.get_body(("plain", "html"))
    text = body.get_content() if body is not None else ""
    if body is not None and body.get_content_type() == "text/html":
        text = plain_html(text)
    head = "\n".join(f"{k}: {m[k]}" for k in ("From", "To", "Date", "Subject") if m[k])
    out = [("message", f"{head}\n\n{text}".strip())]
    for part in m.iter_attachments():
        content = part.get_payload(decode=True) or b""
        out.append((part.get_filename() or "attachment", decode(content) if part.get_content_maintype() == "text" else ""))
    return out


def ics(text: str) -> list[tuple[str, str]]:
    """A unit for each event of a calendar: its properties as lines, long lines unfolded."""
    flat = re.sub(r"\r?\n[ \t]", "", text)
    return [(f"event {k}", m[1].strip().replace("\r", "")) for k, m in enumerate(re.finditer(r"(?s)BEGIN:VEVENT\r?\n(.*?)END:VEVENT", flat), 1)]


def feed(data: bytes) -> list[tuple[str, str]]:
    """A unit for each item of a feed: title, link, date and summary as lines; stray ampersands are repaired."""
    text = re.sub(r"&(?!#?\w+;)", "&amp;", decode(data))
    if "<!DOCTYPE" in text[:2000]:
        raise ValueError("document type in feed")
    out = []
    for item in (e for e in ElementTree.fromstring(text.encode()).iter() if _local(e) in ("item", "entry")):
        got = {}
        for e in item:
            got.setdefault(_local(e), (e.text or e.get("href") or "").strip())
        out.append((got.get("title", ""), "\n".join(v for k in ("title", "link", "pubDate", "updated", "description", "summary") if (v := got.get(k)))))
    return out


def plain_html(source: str) -> str:
    source = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ", source)
    source = re.sub(r"(?i)<(?:br|/?(?:p|div|li|tr|h[1-6]|ul|ol|table|section|article))\b[^>]*>", "\n", source)
    import html

    lines = (" ".join(x.split()) for x in html.unescape(re.sub(r"<[^>]+>", "", source)).split("\n"))
    return "\n".join(x for x in lines if x)


def rtf(text: str) -> str:
    """Text of a rich-text file: destinations without text dropped, hex and Unicode signs decoded, paragraphs as lines."""
    text = re.sub(r"\{\\(?:\*|fonttbl|colortbl|stylesheet|info|pict)(?:[^{}]|\{[^{}]*\})*\}", "", text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\u(-?\d+) ?\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\(?:par|line)\b ?", "\n", text)
    return re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]|\\[^a-zA-Z]", "", text).strip()


def units(name: str, data: bytes) -> tuple[str, list[tuple[str, str]], str]:
    """(kind, units as (label, text), note) of one file."""
    kind = sniff(name, data)
    try:
        if kind in ("docx", "pptx", "odt", "xlsx", "eml", "feed"):
            return kind, globals()[kind](data), ""
        if kind == "ics":
            return kind, ics(decode(data)), ""
        if kind in ("pdf", "image", "binary", "zip", "epub"):
            return kind, [], "no text reader for this kind"
        text = decode(data)
        text = plain_html(text) if kind == "html" else rtf(text) if kind == "rtf" else text
        return kind, [(f"page {k}", p) for k, p in enumerate(split_pages(text), 1)], ""
    except Exception as e:  # a broken file must not fail the task of all others
        return kind, [], f"{type(e).__name__}: {e}"[:200]


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The units of all files below `path`. A file that can't be read gives one row without text; Spark lists no files of zero bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")
    return files.mapInArrow(_units, UNITS)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, data in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
            kind, found, note = units(path.rpartition("/")[2], data or b"")
            rows += [(path, kind, k, label, text, note) for k, (label, text) in enumerate(found, 1)] or [(path, kind, 0, None, None, note)]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["path", "kind", "unit", "label", "text", "note"])
