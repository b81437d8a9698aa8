"""Whole workflows on folders, by the command line and by call."""

import csv
import json
import warnings
import zipfile

import pytest

from docgauge.__main__ import main
from docgauge.plans import workflows
from docgauge.sinks import paths, reports
from docgauge.sources.parsed_store import read_store
from test_pdf import build, page, stream

NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
FULL = "1234567 " + " ".join(f"mot{chr(97 + i % 26)}{chr(97 + i // 26)} autre 12" for i in range(80))


def deck(path):
    text = lambda t: f"<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    cell = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    table = f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr>{cell('a')}{cell('b')}</a:tr><a:tr>{cell('1')}{cell('')}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    slide = lambda inner: f"<p:sld {NS}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    rels = lambda *rows: '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{REL}/{k}" Target="{t}"/>' for i, k, t in rows) + "</Relationships>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {NS}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", rels(("r1", "slide", "slides/slide1.xml"), ("r2", "slide", "slides/slide2.xml")))
        z.writestr("ppt/slides/slide1.xml", slide(text("Dernière ﬁche") + "<p:pic/>"))
        z.writestr("ppt/slides/slide2.xml", slide(text("Première") + table))
        z.writestr("ppt/slides/_rels/slide2.xml.rels", rels(("r9", "notesSlide", "../notesSlides/n2.xml")))
        z.writestr("ppt/notesSlides/n2.xml", f'<p:notes {NS}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>Une note</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:notes>')


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    image = stream(b"\xff\xd8", "/Subtype /Image /Filter /DCTDecode", flate=False)
    (d / "contrat.pdf").write_bytes(build([page(1) + " q 100 0 0 50 50 50 cm /X60 Do Q q 9 0 0 9 50 300 cm /X60 Do Q"], extra={60: image}))
    deck(d / "diapos.pptx")
    (d / "limite.txt").write_text(FULL, encoding="utf-8")
    (d / "copie.md").write_text(FULL.upper(), encoding="utf-8")
    (d / "vide.md").write_text(" ", encoding="utf-8")
    (d / "ignore.xlsx").write_bytes(b"x")
    return d


@pytest.fixture
def config(tmp_path):
    def write(**parts):
        (tmp_path / "c.yaml").write_text(json.dumps({"llm": {"provider": "mock"}} | parts), encoding="utf-8")
        return str(tmp_path / "c.yaml")

    return write


def test_slides_tables_notes(spark, raw):
    from docgauge.plans.run import parse_folder

    got = {r["doc_id"]: r for r in parse_folder(spark, str(raw)).collect()}
    r = got["diapos"]
    assert set(got) == {"contrat", "diapos", "limite", "copie", "vide"} and r["provenance"]["source_pages"] == 2
    assert r["markdown"] == "Première\n\n| a | b |\n| --- | --- |\n| 1 |  |\n\nUne note\n\nDernière fiche"
    assert [(b["kind"], b["page"]) for b in r["blocks"]] == [("text", 1), ("table", 1), ("text", 1), ("text", 2), ("image", 2)]


def test_parse_skips_reports_and_forces(spark, raw, tmp_path, config, capsys):
    src, out = tmp_path / "src", tmp_path / "store"
    src.mkdir()
    for n in ("limite.txt", "vide.md"):
        (src / n).write_bytes((raw / n).read_bytes())
    args = ["parse", str(src), "--config", config(), "--out", str(out)]
    assert main(args, spark) == 0 and "2 documents written, 0 skipped" in capsys.readouterr().out
    (out / "limite.md").write_text("corrigé à la main", encoding="utf-8")
    (src / "limite.txt").write_text("autre", encoding="utf-8")
    (src / "neuf.txt").write_text("neuf", encoding="utf-8")
    assert main(args, spark) == 0
    said = capsys.readouterr().out
    assert "1 documents written, 2 skipped" in said and "  limite" in said and (out / "limite.md").read_text(encoding="utf-8") == "corrigé à la main"
    assert main([*args, "--force"], spark) == 0 and "3 documents written" in capsys.readouterr().out and (out / "limite.md").read_text(encoding="utf-8") == "autre"


def test_parse_refuses(spark, raw, tmp_path, config, capsys):
    assert main(["parse", str(raw), "--config", config(), "--out", str(raw)], spark) == 2
    two = tmp_path / "two"
    two.mkdir()
    (two / "a.md").write_text("x")
    (two / "a.txt").write_text("y")
    assert main(["parse", str(two), "--config", config(), "--out", str(tmp_path / "o")], spark) == 2 and not list((tmp_path / "o").iterdir())
    store = tmp_path / "store"
    store.mkdir()
    (store / "a.parse.json").write_text("{}")
    assert main(["parse", str(store), "--config", config(), "--out", str(tmp_path / "p")], spark) == 2
    (store / "b.docx").write_bytes(b"")
    assert main(["run", str(store), "--config", config(), "--out", str(tmp_path / "p")], spark) == 2
    assert "Error" in capsys.readouterr().err


def test_images_are_described_in_parse(spark, raw, tmp_path, config):
    out = tmp_path / "store"
    assert main(["parse", str(raw), "--config", config(), "--out", str(out), "--enrich"], spark) == 0
    md = (out / "contrat.md").read_text(encoding="utf-8")
    assert "[Image (description automatique, non verifiee): mock: description image]" in md and "[Image decorative ignoree]" in md and "[[IMAGE" not in md
    assert [p.name for p in (out / "images" / "contrat").iterdir()] == ["p1_idx2.jpg"] and (out / "images" / "contrat" / "p1_idx2.jpg").read_bytes() == b"\xff\xd8"
    side = json.loads((out / "contrat.parse.json").read_text(encoding="utf-8"))
    assert side["provenance"]["enriched"] and not json.loads((out / "limite.parse.json").read_text(encoding="utf-8"))["provenance"]["enriched"]
    assert {r["doc_id"]: r["entry_flags"] for r in read_store(spark, str(out)).collect()}["contrat"] == []
    with warnings.catch_warnings(record=True) as got:
        warnings.simplefilter("always")
        ran = workflows.score_into(spark, str(out), {"llm": {"provider": "mock"}}, str(tmp_path / "run"), enrich=True)
    assert any("parsed folder" in str(w.message) for w in got)
    flags = {r[0]: r[4] for r in csv.reader((tmp_path / "run" / "synthese.csv").open(encoding="utf-8-sig", newline=""), delimiter=";")}
    assert "auto_descriptions:1" in flags["contrat"] and ran.n_docs == 5


def test_failing_images_are_reported(spark, raw, tmp_path, monkeypatch):
    from docgauge.judging.clients import Scripted

    class Broken(Scripted):
        def describe(self, image, context):
            raise TimeoutError

    monkeypatch.setattr(workflows, "_image_client", lambda c: (Broken, None))
    done = workflows.parse_into(spark, str(raw), {}, str(tmp_path / "o"), enrich=True)
    assert [(r["doc_id"], r["error"]) for r in done.errors.collect()] == [("contrat", "enrichissement: TimeoutError")] and done.n_written == 5
    assert "[Image non decrite: TimeoutError]" in (tmp_path / "o" / "contrat.md").read_text(encoding="utf-8")


def test_manual_manifest_goes_round(spark, raw, tmp_path):
    file = tmp_path / "m.json"
    config = {"enrichment": {"enabled": True, "vlm": {"provider": "manual", "manifest": str(file)}}}
    done = workflows.parse_into(spark, str(raw), config, str(tmp_path / "one"))
    items = json.loads(file.read_text(encoding="utf-8"))
    assert done.manifest == str(file) and [(i["placeholder"], i["description"]) for i in items] == [("[[IMAGE:p=1;idx=2]]", "")]
    assert "[[IMAGE:p=1;idx=2]]" in (tmp_path / "one" / "contrat.md").read_text(encoding="utf-8")
    file.write_text(json.dumps([items[0] | {"description": "Un plan"}]), encoding="utf-8")
    workflows.parse_into(spark, str(raw), config, str(tmp_path / "two"))
    assert "non verifiee): Un plan]" in (tmp_path / "two" / "contrat.md").read_text(encoding="utf-8")


def test_run_writes_everything(spark, raw, tmp_path, config, capsys):
    answers = {"1234567": {"1.1": {"status": "scored", "score": 2, "justification": "faible"}, "2.6": {"status": "scored", "score": 1, "justification": "nul"}, "1.2": {"status": "scored", "score": 2, "justification": "maigre"}}}
    out = tmp_path / "out"
    assert main(["run", str(raw), "--config", config(llm={"provider": "mock", "answers": answers}), "--out", str(out), "--force"], spark) == 0
    said = capsys.readouterr().out
    assert "5 documents, 0 with errors" in said and "--force has no effect" in said
    same = json.loads((out / "corpus_redundancy.json").read_text(encoding="utf-8"))
    assert same["exact_duplicates"] == [["copie", "limite"]] and same["near_duplicates"] == [] and same["near_duplicates_status"] == "skipped: aucun encodeur"
    cost = json.loads((out / "cost.json").read_text(encoding="utf-8"))
    assert set(cost) == {"contrat", "diapos", "limite", "copie"} and cost["limite"]["n_calls"] == 1 and cost["limite"]["prompt_chars"] > len(FULL)
    rows = list(csv.reader((out / "remediation.csv").open(encoding="utf-8-sig", newline=""), delimiter=";"))
    mine = [(r[1], int(r[3])) for r in rows[1:] if r[0] == "limite"]
    assert rows[0] == reports.REMEDIATION and [r[0] for r in rows[1:]] == sorted(r[0] for r in rows[1:]) and [w for _, w in mine] == sorted((w for _, w in mine), reverse=True) and {"1.1", "2.6"} <= {k for k, _ in mine}
    one = json.loads((out / "vide.score.json").read_text(encoding="utf-8"))
    assert one["flags"] == ["unreadable"] and one["criteria"] == [] and len(one["config_hash"]) == 16


def test_a_hand_edit_keeps_its_score(spark, raw, tmp_path):
    """The flag of an edited entry comes on top; the score is that of its text."""
    workflows.parse_into(spark, str(raw), {}, str(tmp_path / "s"))
    before = {r["doc_id"]: r for r in workflows.score_corpus(read_store(spark, str(tmp_path / "s")), workflows.load_grid()).doc_scores.collect()}
    side = json.loads((tmp_path / "s" / "limite.parse.json").read_text(encoding="utf-8"))
    (tmp_path / "s" / "limite.parse.json").write_text(json.dumps(side | {"markdown_hash": "0" * 64}), encoding="utf-8")
    after = {r["doc_id"]: r for r in workflows.score_corpus(read_store(spark, str(tmp_path / "s")), workflows.load_grid()).doc_scores.collect()}
    assert after["limite"]["flags"] == [*before["limite"]["flags"], "manually_edited"] and after["limite"]["global_pct"] == before["limite"]["global_pct"]


def test_golden_files(spark, raw, tmp_path, config):
    answers = {"Extraits": {"reponse": "=1+1", "couvert": "oui"}, "Trouve des questions": {"questions": [{"question": "Quel lien ?"}]}, "1234567": {"questions": [{"question": "Qui ?", "reponse": "La caisse", "couvert": "oui"}]}}
    out = tmp_path / "g"
    assert main(["golden", str(raw), "--config", config(llm={"provider": "mock", "answers": answers}), "--out", str(out)], spark) == 0
    rows = list(csv.reader((out / "golden_qa.csv").open(encoding="utf-8-sig", newline=""), delimiter=";"))
    assert rows[0] == reports.COLUMNS and [r[0] for r in rows[1:]] == ["copie-1", "corpus-1", "limite-1"] and rows[2][3] == "'=1+1" and rows[2][4]
    with zipfile.ZipFile(out / "golden_qa.xlsx") as z:
        assert "Quel lien ?" in z.read("xl/worksheets/sheet1.xml").decode()


def test_paths_by_uri(tmp_path):
    uri = (tmp_path / "a" / "b").as_uri()
    paths.make_folder(uri)
    paths.put(paths.join(uri, "x.txt"), b"1")
    assert paths.names(uri) == ["x.txt"] and paths.names(str(tmp_path / "none")) == [] and (tmp_path / "a" / "b" / "x.txt").read_bytes() == b"1"
