"""Files of documents: a folder's files to rows of text, with a row for each that can't be read.

Every file is one row of Spark's binaryFile source, so reading is spread over the cluster by file. Readers are plain
functions of bytes, by suffix, and more can be given.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking as c

#: What a scan takes.
SCANNED = "pdf png jpg jpeg txt md json csv xlsx xls docx".split()
BREAK = "\n" + c.RULE + "\n\n"


def scan(spark: SparkSession, path: str, suffixes: list[str] = SCANNED) -> DataFrame:
    """(path, modificationTime, length, content, suffix) of files at any depth."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))).filter(F.col("suffix").isin(suffixes))


# -- readers: bytes to (text, entries)


def read_text(data: bytes) -> tuple[str, int]:
    """S5."""
    return data.decode("utf-8"), 1


def person_text(x: dict) -> str:
    """T21 in Python, for records of any shape."""
    out = [f"Name: {x['name']}"] if "name" in x else []
    for key in ("qualification", "experience", "research_interests"):
        value = str(x.get(key) or "").strip()
        if value and value.lower() != "not specified":
            out.append(f"{' '.join(key.split('_')).title()}: {value}")
    pubs, awards = x.get("publications"), x.get("awards")
    groups = [("\n" + k.title(), xs) for k, xs in pubs.items()] if isinstance(pubs, dict) else [("Publications", pubs)]
    for head, xs in [*groups, ("\nAwards", awards)]:
        if isinstance(xs, list) and xs:
            out += [f"{head}:", *(f"  - {e}" for e in xs)]
    return "\n".join(out)


def read_json(data: bytes) -> tuple[str, int]:
    """An array or object, or else lines of objects, of which bad ones are passed over; error if nothing is there."""
    text = data.decode("utf-8-sig").strip()
    try:
        found = json.loads(text)
        rows = list(enumerate(found if isinstance(found, list) else [found], 1))
    except ValueError:
        rows = []
        for n, line in enumerate(text.splitlines(), 1):
            try:
                rows.append((n, json.loads(line)))
            except ValueError:
                continue
    parts: list[str] = []
    for n, x in rows:
        if isinstance(x, dict):
            parts += c.profile_chunks(x.get("name", f"Entry {n}"), x.get("profile_url", ""), x.get("text") or person_text(x))
    if not parts:
        raise ValueError("no valid JSON entries")
    return BREAK.join(parts), len(parts)


def entries(rows: list[dict]) -> str:
    out = []
    for n, row in enumerate(rows, 1):
        out += [f"Entry {n}:", *(f"  {k}: {x}" for k, x in row.items() if k and x not in (None, "")), ""]
    return "\n".join(out).strip()


def read_csv(data: bytes) -> tuple[str, int]:
    """The first of some encodings that fits."""
    for encoding in ("utf-8-sig", "utf-8", "cp1252", "latin-1"):
        try:
            rows = list(csv.DictReader(io.StringIO(data.decode(encoding))))
            return entries(rows), len(rows)
        except UnicodeDecodeError:
            continue
    raise ValueError("no encoding fits")


def read_xlsx(data: bytes) -> tuple[str, int]:
    """The active sheet, names of columns in its first row, rows without a value passed over."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        words = ["".join(e.text or "" for e in si.iter(ns + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        view = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{ns}bookViews/{ns}workbookView")
        sheets = sorted((x for x in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)), key=lambda x: int(re.sub(r"\D", "", x)))
        sheet = ElementTree.fromstring(z.read(sheets[int(view.get("activeTab", 0)) if view is not None else 0]))
    table: list[dict[int, str]] = []
    for row in sheet.iter(ns + "row"):
        cells = {}
        for k, cell in enumerate(row.iter(ns + "c")):
            letters = re.match(r"[A-Z]*", cell.get("r", "")).group()
            at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else k
            value = cell.find(ns + "v")
            text = "".join(e.text or "" for e in cell.iter(ns + "t")) if cell.get("t") == "inlineStr" else value.text if value is not None else None
            if text is not None:
                cells[at] = words[int(text)] if cell.get("t") == "s" else text
        table.append(cells)
    heads, rows = (table[0] if table else {}), [r for r in table[1:] if r]
    return entries([{heads.get(k, f"Column {k + 1}"): x for k, x in sorted(r.items())} for r in rows]), len(rows)


def pdf_text(pages: list[str]) -> str:
    """S3: pages of a document joined; error if there is too little text or too many pages have none."""
    total = sum(len(p.strip()) for p in pages)
    empty = sum(not p.strip() for p in pages)
    if total < max(200, 50 * len(pages)):
        raise ValueError(f"too little text: {total} characters on {len(pages)} pages")
    if empty > max(1, int(len(pages) * 0.2)):
        raise ValueError(f"{empty} of {len(pages)} pages have no text")
    return "\n\n".join(c.join_lines(p) for p in pages if p.strip())


def read_pdf(data: bytes, ocr: Callable[[bytes, int], str] | None = None) -> tuple[str, int]:
    """Pages of fewer than 50 characters go to `ocr`, a function of the file and the page's number, where one is given."""
    try:
        import pypdf
    except ImportError as e:
        raise ValueError("no PDF library is installed") from e
    pages = [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages]
    pages = [ocr(data, k) if ocr and len(p.strip()) < 50 else p for k, p in enumerate(pages)]
    return pdf_text(pages), len(pages)


def read_image(data: bytes, ocr: Callable[[bytes], str] | None = None) -> tuple[str, int]:
    """Text by `ocr` where one is given, else a description of the size, from the header of PNG and JPEG files."""
    if ocr:
        return ocr(data), 1
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return f"[Image: {int.from_bytes(data[16:20], 'big')}x{int.from_bytes(data[20:24], 'big')} pixels]", 1
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data):
        if data[at + 1] in (0xC0, 0xC1, 0xC2):
            return f"[Image: {int.from_bytes(data[at + 7 : at + 9], 'big')}x{int.from_bytes(data[at + 5 : at + 7], 'big')} pixels]", 1
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    raise ValueError("neither PNG nor JPEG")


READERS: dict[str, Callable[[bytes], tuple[str, int]]] = {"txt": read_text, "md": read_text, "json": read_json, "csv": read_csv, "xlsx": read_xlsx, "pdf": read_pdf, "png": read_image, "jpg": read_image, "jpeg": read_image, "tiff": read_image}


def read_documents(files: DataFrame, readers: dict | None = None) -> DataFrame:
    """Files of scan() to (path, suffix, length, content_hash, text, entries, error); a file without a reader, or
    that its reader refuses, is a row with an error."""
    readers = READERS if readers is None else readers

    def run(contents: pa.Array, suffixes: pa.Array) -> pa.Array:
        out = []
        for data, suffix in zip(contents, suffixes.to_pylist()):
            try:
                if suffix not in readers:
                    raise ValueError(f"no reader for .{suffix}")
                text, n = readers[suffix](data.as_py())
                out.append({"text": text, "entries": n, "error": None})
            except Exception as e:  # noqa: BLE001 - a broken file is a row, not a failed job
                out.append({"text": None, "entries": 0, "error": f"{type(e).__name__}: {e}"})
        return pa.array(out, pa.struct([("text", pa.string()), ("entries", pa.int32()), ("error", pa.string())]))

    read = F.arrow_udf(run, "text string, entries int, error string")("content", "suffix")
    return files.withColumn("__r", read).select("path", "suffix", "length", F.sha2("content", 256).alias("content_hash"), "__r.text", "__r.entries", "__r.error")
