"""Reports for people: CSV with byte order mark, workbooks, JSON files. Parquet stays the system of record.

The three report tables are small next to the corpus but not bounded; they are streamed to the driver in their order
with ``toLocalIterator`` and written row by row, never collected. Paths may be local, mounted or of an object store.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterable
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.operators import scoring
from docgauge.operators.golden import COLUMNS
from docgauge.sinks import paths


def clean(v):
    """A report cell: None as empty; text that a spreadsheet would run gets an apostrophe; numbers as they are."""
    if v is None:
        return ""
    return "'" + v if isinstance(v, str) and v[:1] in ("=", "+", "-", "@") else v


def write_csv(path: str | Path, header: list[str], rows: Iterable[Iterable]) -> str:
    fs, p = paths.at(str(path))
    with fs.open_output_stream(p) as raw, io.TextIOWrapper(raw, encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f, delimiter=";")
        w.writerow(header)
        for r in rows:
            w.writerow([clean(v) for v in r])
    return str(path)


def _column(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(ref: str, v) -> str:
    if isinstance(v, bool) or not isinstance(v, int | float):
        text = "".join(c for c in str(v) if c in "\t\n\r" or ord(c) >= 32)
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
    return f'<c r="{ref}"><v>{v}</v></c>'


def write_workbook(path: str | Path, sheets: list[tuple[str, list[str], Iterable[Iterable]]]) -> str:
    """A workbook written as a stream: (title, header, rows) per sheet."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    mime = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    n = range(1, len(sheets) + 1)
    fs, p = paths.at(str(path))
    with fs.open_output_stream(p) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{mime}.worksheet+xml"/>' for i in n)
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{mime}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(t)}" sheetId="{i}" r:id="rId{i}"/>' for i, (t, _, _) in zip(n, sheets)) + "</sheets></workbook>")
        for i, (_, header, rows) in zip(n, sheets):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<?xml version="1.0"?><worksheet {ns}><sheetData>'.encode())
                for at, r in enumerate(_chain(header, rows), 1):
                    cells = "".join(_cell(f"{_column(c)}{at}", clean(v)) for c, v in enumerate(r, 1))
                    f.write(f'<row r="{at}">{cells}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
    return str(path)


def _chain(header, rows):
    yield header
    yield from rows


def _rows(df: DataFrame, columns: list[str]):
    for r in df.toLocalIterator():
        yield [r[c] for c in columns]


SYNTHESIS = ["doc_id", "score_global_%", "niveau", "couverture_%", "flags"]
DETAIL = ["doc_id", "critere_id", "critere", "tag", "poids", "status", "score", "justification", "preuve"]
REMEDIATION = ["doc_id", "critere_id", "critere", "poids", "score_actuel"]


def _file_order():
    """Order of entries by file name: a point follows each stem, so that "a" comes after "a-b"."""
    return F.concat("doc_id", F.lit("."))


def write_corpus_report(doc_scores: DataFrame, criterion_rows: DataFrame, out: str | Path) -> dict[str, str]:
    """Workbook with three sheets and the same three tables as CSV."""
    out = str(out)
    paths.make_folder(out)
    tables = {
        "synthese": (SYNTHESIS, scoring.synthesis(doc_scores).orderBy(_file_order())),
        "detail": (DETAIL, scoring.detail(criterion_rows).orderBy(_file_order(), "ord")),
        "remediation": (REMEDIATION, scoring.remediation(criterion_rows).orderBy("doc_id", F.desc("poids"), "ord")),
    }
    written = {f"csv_{k}": write_csv(paths.join(out, f"{k}.csv"), cols, _rows(df, cols)) for k, (cols, df) in tables.items()}
    written["xlsx"] = write_workbook(paths.join(out, "corpus_report.xlsx"), [(k.capitalize(), cols, _rows(df, cols)) for k, (cols, df) in tables.items()])
    return written


def write_golden(rows: DataFrame, out: str | Path) -> dict[str, str]:
    out = str(out)
    paths.make_folder(out)
    ordered = rows.orderBy("id")
    return {"csv": write_csv(paths.join(out, "golden_qa.csv"), COLUMNS, _rows(ordered, COLUMNS)), "xlsx": write_workbook(paths.join(out, "golden_qa.xlsx"), [("golden_qa", COLUMNS, _rows(ordered, COLUMNS))])}


def write_doc_json(doc_scores: DataFrame, criterion_rows: DataFrame, out: str, config_hash: str) -> None:
    """One JSON file per document, written by the tasks into a shared folder."""
    paths.make_folder(out)
    crit = criterion_rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "tag", "weight", "status", "score", "justification", "evidence"))).alias("criteria"))  # the grid's rows

    def write(rows) -> None:
        for r in rows:
            d = r.asDict(recursive=True)
            d["criteria"] = [{k: v for k, v in c.items() if k != "ord"} for c in d.get("criteria") or []]
            d["config_hash"] = config_hash
            paths.put(paths.join(out, f"{r['doc_id']}.score.json"), json.dumps(d, ensure_ascii=False, indent=2).encode())

    doc_scores.join(crit, "doc_id", "left").foreachPartition(write)


def write_parsed_store(docs: DataFrame, out: str) -> None:
    """Markdown and sidecar of each document, byte for byte, written by the tasks into a shared folder.

    ``docs``: doc_id, markdown, blocks, images, parse_confidence, provenance (struct).
    """
    import hashlib

    paths.make_folder(out)

    def write(rows) -> None:
        for r in rows:
            d = r.asDict(recursive=True)
            data = (d["markdown"] or "").encode("utf-8")
            side = {
                "schema_version": 1, "doc_id": d["doc_id"], "markdown_hash": hashlib.sha256(data).hexdigest(), "parse_confidence": d["parse_confidence"],
                "blocks": d["blocks"] or [], "images": d["images"] or [], "provenance": d["provenance"],
            }
            paths.put(paths.join(out, f"{d['doc_id']}.md"), data)
            paths.put(paths.join(out, f"{d['doc_id']}.parse.json"), json.dumps(side, ensure_ascii=False, indent=2).encode())

    docs.select("doc_id", "markdown", "blocks", "images", "parse_confidence", "provenance").foreachPartition(write)


def write_redundancy(groups: DataFrame, near: DataFrame | None, status: str, path: str | Path) -> str:
    """The redundancy file, streamed in group order."""
    fs, p = paths.at(str(path))
    with fs.open_output_stream(p) as raw, io.TextIOWrapper(raw, encoding="utf-8", newline="") as f:
        f.write('{\n  "exact_duplicates": [')
        last = None
        for r in groups.orderBy("group_id", "doc_id").toLocalIterator():
            if r["group_id"] != last:
                f.write(("],\n    [" if last is not None else "\n    [") + json.dumps(r["doc_id"], ensure_ascii=False))
                last = r["group_id"]
            else:
                f.write(", " + json.dumps(r["doc_id"], ensure_ascii=False))
        f.write("]\n  " if last is not None else "")
        f.write('],\n  "near_duplicates": [')
        for i, r in enumerate(near.orderBy("a", "b").toLocalIterator() if near is not None else ()):
            f.write((",\n    " if i else "\n    ") + json.dumps({"a": r["a"], "b": r["b"], "score": r["score"]}, ensure_ascii=False))
        f.write('],\n  "near_duplicates_status": ' + json.dumps(status) + "\n}\n")
    return str(path)


def write_cost(cost: DataFrame, path: str | Path) -> str:
    """Calls and prompt characters of each document, streamed in order of the documents."""
    fs, p = paths.at(str(path))
    with fs.open_output_stream(p) as raw, io.TextIOWrapper(raw, encoding="utf-8", newline="") as f:
        f.write("{")
        for i, r in enumerate(cost.orderBy(_file_order()).toLocalIterator()):
            f.write((",\n  " if i else "\n  ") + json.dumps(r["doc_id"], ensure_ascii=False) + ": " + json.dumps({"n_calls": r["n_calls"], "prompt_chars": r["prompt_chars"]}))
        f.write("\n}\n")
    return str(path)


def write_manifest(images: DataFrame, path: str | Path) -> str:
    """Images for a person to describe: image_path, context, placeholder, description; read again by the manual provider."""
    fs, p = paths.at(str(path))
    with fs.open_output_stream(p) as raw, io.TextIOWrapper(raw, encoding="utf-8", newline="") as f:
        f.write("[")
        for i, r in enumerate(images.orderBy("doc_id", "page", "placeholder").toLocalIterator()):
            item = {"image_path": r["image_path"], "context": r["context"], "placeholder": r["placeholder"], "description": r["description"] or ""}
            f.write((",\n  " if i else "\n  ") + json.dumps(item, ensure_ascii=False))
        f.write("\n]\n")
    return str(path)


def write_enriched(docs: DataFrame, out: str) -> None:
    """The markdown of documents with described images, as it is scored: one file per document, written by the tasks."""
    paths.make_folder(out)

    def write(rows) -> None:
        for r in rows:
            paths.put(paths.join(out, f"{r['doc_id']}.enriched.md"), (r["markdown"] or "").encode())

    docs.where(F.size("images") > 0).select("doc_id", "markdown").foreachPartition(write)
