"""Raw folder scan, triage, and readers of text, Word, PowerPoint and PDF files.

Files are read with the binaryFile source, so listing, splitting over executors and retry are Spark's. One file never
fails a job: a reader returns an ``unreadable`` block instead.
"""

from __future__ import annotations

import io
import re
import signal
import threading
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.functions import text as tx
from docgauge.sources import pdf as own

TEXT, OFFICE, PDF = ("txt", "md"), ("docx", "pptx"), ("pdf",)
SUPPORTED = TEXT + OFFICE + PDF
RAW_ONLY = tuple(x for x in SUPPORTED if x != "md")

BLOCK = "struct<kind:string,text:string,page:int,section:string>"
IMAGE = "struct<page:int,idx:int,x0:double,top:double,x1:double,bottom:double,placeholder:string>"
TRIAGE = "doc_id string, type string, hash string, path string, pages int, category string"
PARSED = f"doc_id string, markdown string, blocks array<{BLOCK}>, images array<{IMAGE}>, pages int, fallback boolean"


def scan(spark: SparkSession, folder: str, formats: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """Files directly in ``folder`` with a supported extension: path, doc_id, type, hash, content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "content")
    if empty := _empty_files(spark, folder):
        raw = raw.unionByName(spark.createDataFrame([(p,) for p in empty], "path string").withColumn("content", F.lit(b"")))
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    files = raw.withColumns({"_n": F.url_decode(F.regexp_replace(name, r"\+", "%2B")), "type": ext}).where(F.col("type").isin(*formats))
    return files.select("path", F.regexp_replace("_n", r"\.[^.]+$", "").alias("doc_id"), "type", F.sha2("content", 256).alias("hash"), "content")


def _empty_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of files without content, which the binaryFile source leaves out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for status in files.globStatus(path) or []:
        entries = files.listStatusIterator(status.getPath())
        while entries.hasNext():
            e = entries.next()
            if e.isFile() and e.getLen() == 0:
                out.append(e.getPath().toUri().toString())
    return out


def density_category(words: Column, images: Column, pages: Column) -> Column:
    """Category of a PDF by words and images a page."""
    wpp = F.coalesce(F.try_divide(words, pages), F.lit(0.0))
    ipp = F.coalesce(F.try_divide(images, pages), F.lit(0.0))
    return F.when(wpp < 10, "scanned").when((wpp > 100) & (ipp < 25), "born_digital").otherwise("mixed")


def slide_count(content: bytes) -> int | None:
    """Slides of a deck, None if it can't be opened."""
    try:
        return len(_slides(zipfile.ZipFile(io.BytesIO(content))))
    except Exception:
        return None


PdfCounter = Callable[[bytes], tuple[int, int, int]]  # pages, words, images


def triage(files: DataFrame, pdf_counter: PdfCounter | None = own.count) -> DataFrame:
    """Triage rows. A PDF that can't be read (or any, without a counter) is ``unreadable``; Word files have no page count."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                pages = words = images = None
                if r.type == "pptx":
                    pages = slide_count(r.content)
                elif r.type == "pdf" and pdf_counter is not None:
                    try:
                        pages, words, images = pdf_counter(r.content)
                    except Exception:
                        pages = None
                rows.append((r.path, r.doc_id, r.type, r.hash, pages, words, images))
            out = pd.DataFrame(rows, columns=["path", "doc_id", "type", "hash", "pages", "words", "images"])
            yield out.astype({"pages": "Int32", "words": "Int32", "images": "Int32"})

    counted = files.mapInPandas(count, "path string, doc_id string, type string, hash string, pages int, words int, images int")
    category = (
        F.when(F.col("type").isin(*TEXT), "text")
        .when(F.col("type").isin(*OFFICE), "office")
        .when(~F.col("type").isin(*PDF), "unsupported_format")
        .when(F.col("pages").isNull(), "unreadable")
        .otherwise(density_category(F.col("words"), F.col("images"), F.col("pages")))
    )
    return counted.select("doc_id", "type", "hash", "path", "pages", category.alias("category"))


def nfkc(s: str | None) -> str:
    return unicodedata.normalize("NFKC", s or "")


def _block(kind: str, text: str = "", page: int = 0) -> dict:
    return {"kind": kind, "text": text, "page": page, "section": None}


def pipe_table(rows: list[list[str]]) -> str:
    """Pipe table: first row as header, a rule, the others."""
    if not rows:
        return ""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


def read_text(content: bytes) -> tuple[str, list[dict]]:
    """UTF-8 text without BOM, damage as U+FFFD, one kind of line end, compatibility forms flattened."""
    t = content.decode("utf-8-sig", errors="replace").replace("\r\n", "\n").replace("\r", "\n")
    t = nfkc(t).strip()
    return t, [_block("text", p.strip(), 1) for p in t.split("\n\n") if p.strip()]


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _w_text(p: ET.Element) -> str:
    out = []
    for e in p.iter():
        if e.tag == W + "t":
            out.append(e.text or "")
        elif e.tag == W + "tab":
            out.append("\t")
        elif e.tag in (W + "br", W + "cr"):
            out.append("\n")
    return "".join(out)


def read_docx(content: bytes) -> tuple[str, list[dict]]:
    """Body in document order: headings, paragraphs, pipe tables; one image block for each image of the package."""
    z = zipfile.ZipFile(io.BytesIO(content))
    body = ET.fromstring(z.read("word/document.xml")).find(W + "body")
    names = {}
    if "word/styles.xml" in z.namelist():
        for s in ET.fromstring(z.read("word/styles.xml")).iter(W + "style"):
            name = s.find(W + "name")
            names[s.get(W + "styleId")] = name.get(W + "val") if name is not None else ""
    parts, blocks = [], []
    for child in body:
        if child.tag == W + "p":
            text = nfkc(_w_text(child)).strip()
            if not text:
                continue
            style = child.find(f"{W}pPr/{W}pStyle")
            name = names.get(style.get(W + "val"), style.get(W + "val") or "") if style is not None else ""
            if name.lower().startswith("heading"):
                depth = re.sub(r"(?i)^heading", "", name).strip().split(" ")[-1]
                text_md = ("#" * min(int(depth), 6) if depth.isdigit() else "#") + " " + text
            else:
                text_md = text
            parts.append(text_md)
            blocks.append(_block("text", text))
        elif child.tag == W + "tbl":
            rows = [[nfkc("\n".join(_w_text(p) for p in c.iter(W + "p"))).strip() for c in r.findall(W + "tc")] for r in child.findall(W + "tr")]
            parts.append(pipe_table(rows))
            blocks.append(_block("table"))
    images = [n for n in z.namelist() if n.startswith("word/media/")]
    return "\n\n".join(p for p in parts if p), blocks + [_block("image") for _ in images]


def _rels(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    folder, name = part.rsplit("/", 1)
    path = f"{folder}/_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    out = {}
    for r in ET.fromstring(z.read(path)).iter(REL + "Relationship"):
        target = r.get("Target")
        full = target.lstrip("/") if target.startswith("/") else _join(folder, target)
        out[r.get("Id")] = (r.get("Type").rsplit("/", 1)[-1], full)
    return out


def _join(folder: str, target: str) -> str:
    at = folder.split("/")
    for step in target.split("/"):
        at = at[:-1] if step == ".." else [*at, step]
    return "/".join(at)


def _slides(z: zipfile.ZipFile) -> list[str]:
    rels = _rels(z, "ppt/presentation.xml")
    ids = ET.fromstring(z.read("ppt/presentation.xml")).iter(P + "sldId")
    return [rels[s.get(R + "id")][1] for s in ids]


def _a_text(body: ET.Element) -> str:
    lines = []
    for p in body.findall(A + "p"):
        lines.append("".join("\v" if e.tag == A + "br" else e.text or "" for e in p.iter() if e.tag in (A + "t", A + "br")))
    return "\n".join(lines)


def read_pptx(content: bytes) -> tuple[str, list[dict]]:
    """Slides in order: tables, pictures, text frames, then speaker notes; page is the slide number."""
    z = zipfile.ZipFile(io.BytesIO(content))
    parts, blocks = [], []
    for page, name in enumerate(_slides(z), 1):
        for shape in ET.fromstring(z.read(name)).find(f"{P}cSld/{P}spTree"):
            table = next(shape.iter(A + "tbl"), None) if shape.tag == P + "graphicFrame" else None
            if table is not None:
                parts.append(pipe_table([[nfkc(_a_text(c.find(A + "txBody"))).strip() for c in r.findall(A + "tc")] for r in table.findall(A + "tr")]))
                blocks.append(_block("table", page=page))
            elif shape.tag == P + "pic":
                blocks.append(_block("image", page=page))
            elif shape.tag == P + "sp" and (body := shape.find(P + "txBody")) is not None and (text := nfkc(_a_text(body)).strip()):
                parts.append(text)
                blocks.append(_block("text", text, page))
        for kind, target in _rels(z, name).values():
            if kind == "notesSlide":
                for sp in ET.fromstring(z.read(target)).iter(P + "sp"):
                    ph = sp.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                    if ph is not None and ph.get("type") == "body" and (body := sp.find(P + "txBody")) is not None and (text := nfkc(_a_text(body)).strip()):
                        parts.append(text)
                        blocks.append(_block("text", text, page))
    return "\n\n".join(p for p in parts if p), blocks


def assemble(pages: list[str], images: dict[int, list[dict]]) -> tuple[str, list[dict]]:
    """Page texts with an image placeholder for each image after its page; images are numbered within a page from 1."""
    parts, refs = [], []
    for i, text in enumerate(pages):
        if text:
            parts.append(text)
        for k, im in enumerate(images.get(i, []), 1):
            mark = f"[[IMAGE:p={i + 1};idx={k}]]"
            parts.append(mark)
            refs.append({"page": i + 1, "idx": k, **{x: float(im[x]) for x in ("x0", "top", "x1", "bottom")}, "placeholder": mark})
    return "\n\n".join(parts), refs


#: A PDF reader: content -> (page texts, typed blocks, images by page index).
PdfReader = Callable[[bytes], tuple[list[str], list[dict], dict[int, list[dict]]]]
GLYPHS = re.compile(r"\(cid:\d+\)|�")
GLYPH_RETRY = 0.1


def glyph_share(text: str) -> float:
    return min(1.0, sum(len(m.group()) for m in GLYPHS.finditer(text)) / len(text)) if text else 0.0


def read_pdf(content: bytes, readers: list[PdfReader]) -> tuple[str, list[dict], list[dict], bool]:
    """(markdown, blocks, images, fallback used): the first reader, a later one only if it strictly has fewer lost glyphs
    or the first gives nothing."""
    best = None
    for n, reader in enumerate(readers):
        try:
            pages, typed, images = reader(content)
            md, refs = assemble(pages, images)
            got = (md, [*typed, *(_block("text", t, i + 1) for i, t in enumerate(pages) if t)], refs, n > 0)
        except Exception:
            continue
        if not md.strip():
            continue
        if best is None or glyph_share(md) < glyph_share(best[0]):
            best = got
        if glyph_share(best[0]) <= GLYPH_RETRY:
            break
    if best is None:
        raise ValueError("no text")
    return best


#: A heavy extractor: (content, first page, last page) -> markdown of these pages.
Extractor = Callable[[bytes, int, int], str]
#: Pages of one call of a heavy extractor and of one row of work, and seconds of a call.
BATCH_PAGES, ROW_PAGES, LIMIT = 1, 64, 1800.0


@contextmanager
def time_limit(seconds: float):
    """Raise ``TimeoutError`` in the block after so many seconds (in the main thread of a worker, where signals arrive)."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_):
        raise TimeoutError(f"over {seconds} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def extract_pages(files: DataFrame, triaged: DataFrame, extractor: Extractor, batch_pages: int = BATCH_PAGES, row_pages: int = ROW_PAGES, limit: float = LIMIT) -> DataFrame:
    """Markdown of PDF pages by a heavy extractor: (path, parts), the parts in order of their pages.

    Files are dealt to tasks by ranges of ``row_pages`` pages, so a long file is extracted in many tasks; within one the
    extractor is called for ``batch_pages`` pages at a time. A call that fails, takes too long or gives nothing is
    replaced by the plain text of its pages.
    """
    n = triaged.where("type = 'pdf' and pages > 0").select("path", F.col("pages").cast("int").alias("n"))
    first = F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(row_pages))).alias("first")
    rows = files.select("path", "content").join(n, "path").select("path", "n", first, "content").repartition("path", "first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                plain: list[str] | None = None
                parts = []
                last = min(r.first + row_pages - 1, r.n)
                for a in range(r.first, last + 1, batch_pages):
                    b = min(a + batch_pages - 1, last)
                    try:
                        with time_limit(limit):
                            md = nfkc(extractor(r.content, a, b)).strip()
                    except Exception:
                        md = ""
                    if not md:
                        try:
                            plain = own.read(r.content, r.first, last)[0] if plain is None else plain
                        except Exception:
                            plain = []
                        md = "\n\n".join(p for p in plain[a - r.first : b - r.first + 1] if p)
                    if md:
                        parts.append(md)
                out.append((r.path, r.first, "\n\n".join(parts)))
            yield pd.DataFrame(out, columns=["path", "first", "md"])

    got = rows.mapInPandas(run, "path string, first int, md string")
    one = got.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("first", "md"))).alias("p"))  # the ranges of one file
    return one.select("path", F.filter(F.transform("p", lambda x: x["md"]), lambda x: x != "").alias("parts"))


def read_extracted(content: bytes, parts: list[str]) -> tuple[str, list[dict], list[dict], bool]:
    """(markdown, blocks, images, fallback used) of a file whose markdown a heavy extractor gave: its paragraphs have no
    page, and the image marks come at the end."""
    md = "\n\n".join(parts)
    if not md:
        raise ValueError("no text")
    _, typed, images = own.read(content)
    marks, refs = assemble([""] * (max(images, default=-1) + 1), images)
    blocks = [*typed, *(_block("text", p.strip()) for p in md.split("\n\n") if p.strip())]
    return md + ("\n\n" + marks if marks else ""), blocks, refs, False


def parse(files: DataFrame, triaged: DataFrame, pdf_readers: list[PdfReader] | None = None, extracted: DataFrame | None = None) -> DataFrame:
    """Parsed documents of scanned files: markdown, blocks, images; never fails on a file.

    ``extracted``: (path, parts) of ``extract_pages``; PDFs without parts, and all of them where it is not given, go
    through ``pdf_readers`` (this package's by default).
    """
    pages = triaged.select("path", "pages")
    readers = own.READERS if pdf_readers is None else pdf_readers
    if extracted is not None:
        pages = pages.join(extracted, "path", "left")
    else:
        pages = pages.withColumn("parts", F.lit(None).cast("array<string>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                images, fallback = [], False
                try:
                    if r.type in TEXT:
                        md, blocks = read_text(r.content)
                    elif r.type == "docx":
                        md, blocks = read_docx(r.content)
                    elif r.type == "pptx":
                        md, blocks = read_pptx(r.content)
                    else:
                        try:
                            md, blocks, images, fallback = read_extracted(r.content, [] if r.parts is None else list(r.parts))
                        except Exception:
                            md, blocks, images, fallback = read_pdf(r.content, readers)
                except Exception:
                    md, blocks, images = "", [_block("unreadable")], []
                rows.append((r.doc_id, md, blocks, images, None if pd.isna(r.pages) else int(r.pages), fallback))
            yield pd.DataFrame(rows, columns=["doc_id", "markdown", "blocks", "images", "pages", "fallback"]).astype({"pages": "Int32"})

    # The files stay in place; the narrow triage rows come to them.
    return files.select("path", "doc_id", "type", "content").join(pages, "path", "left").mapInPandas(run, PARSED)


def with_confidence(parsed: DataFrame) -> DataFrame:
    """Add parse_confidence to parsed documents; drops the helper column ``fallback``."""
    from docgauge.operators.signals import GLYPH, parse_confidence

    n = F.length("markdown")
    cid = tx.ratio(n - F.length(F.regexp_replace("markdown", GLYPH, "")), n, 4, 0.0)
    conf = parse_confidence(F.col("markdown"), F.col("blocks"), F.coalesce("pages", F.lit(0)), cid, F.col("fallback"))
    return parsed.withColumn("parse_confidence", conf).drop("fallback")
