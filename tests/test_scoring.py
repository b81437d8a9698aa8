"""Judgement, scores and exports."""

import csv
import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from docgauge.judging.clients import Scripted, factory
from docgauge.operators import judge, scoring
from docgauge.plans.run import golden_set, parse_folder, score_corpus
from docgauge.sinks import reports
from docgauge.sources.grid import Grid, config_hash, load_grid

V = "verdict_id long, doc_id string, section_no int, crit_id string, status string, score int, justification string, evidence string, judged_at timestamp, loaded_at timestamp"


def verdict(doc, sec, crit, score, just="ok", status="scored", evid=None):
    return (1, doc, sec, crit, status, score, just, evid, None, None)


def test_medians_round_half_even_and_keep_the_nearest(spark):
    rows = [
        verdict("a", 0, "1.1", 2, "deux"), verdict("a", 1, "1.1", 3, "trois"), verdict("a", 0, "1.2", 3, "t"), verdict("a", 1, "1.2", 4, "q"), verdict("a", 0, "1.3", 7), verdict("a", 0, "1.4", 3, "  "),
        verdict("a", 0, "1.5", 5, None), verdict("a", 0, "1.6", 4, "x", "SCORED"), verdict("a", 0, "1.7", None), verdict("a", 3, "1.8", 5, "tard"), verdict("a", 1, "1.8", 5, "tot", evid="e"),
    ]
    got = {r["crit_id"]: r for r in judge.section_medians(spark.createDataFrame(rows, V)).collect()}
    assert set(got) == {"1.1", "1.2", "1.8"}
    assert (got["1.1"]["score"], got["1.1"]["justification"]) == (2, "deux")
    assert (got["1.2"]["score"], got["1.2"]["justification"]) == (4, "t")
    assert (got["1.8"]["section_no"], got["1.8"]["evidence"]) == (1, "e")


def test_latest_verdict_wins(spark):
    rows = [(1, "a", 0, "1.1", "scored", s, "j", None, None, t) for s, t in ((1, "2024-01-01"), (5, "2024-02-01"), (3, None))]
    df = spark.createDataFrame(rows, V.replace("loaded_at timestamp", "loaded_at string")).withColumn("loaded_at", F.to_timestamp("loaded_at"))
    assert [r["score"] for r in judge.latest(df).collect()] == [5]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"1.1": {"status": "scored", "score": 4, "justification": "a"}, "2.6": "bad"}', [("1.1", 4, False)]),
        ('texte ```json\n{"1.1": {"status": "scored", "score": 4.0, "justification": "a"}}\n``` fin', [("1.1", None, False)]),
        ('{"1.1": {"status": "scored", "score": "4", "justification": "a"}}', [("1.1", None, False)]),
        ('{"1.1": {"status": "scored", "score": 4, "justification": 12}}', [("1.1", 4, True)]),
        ('{"1.1": {"status": "scored", "score": 4, "justification": null}}', [("1.1", 4, False)]),
        ("rien", []),
        (None, []),
        ("{}", []),
    ],
)
def test_verdict_parsing_is_strict_and_per_value(spark, raw, want):
    df = spark.createDataFrame([("a", 0, raw)], "doc_id string, section_no int, response string")
    assert [(r["crit_id"], r["score"], r["voids"]) for r in judge.verdicts_from_json(df).collect()] == want


def crit_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, dimension string, weight int, status string, score int")


def test_scores_levels_and_flags(spark):
    rows = [("a", "1", 3, "scored", 5), ("a", "2", 2, "scored", 5), ("b", "1", 1, "scored", 3), ("b", "1", 2, "scored", 1), ("b", "2", 1, "not_evaluated", None), ("c", "1", 1, "na", None)]
    docs = spark.createDataFrame([("a", 0.9), ("b", 0.4), ("c", 1.0), ("d", None)], "doc_id string, parse_confidence double")
    got = {r["doc_id"]: r for r in scoring.doc_scores(crit_rows(spark, rows), {"1": 2, "2": 5}, docs).collect()}
    assert (got["a"]["global_pct"], got["a"]["level"], got["a"]["flags"]) == (100.0, "Excellent", [])
    assert got["b"]["dimensions"] == {"1": 33.3} and got["b"]["coverage_pct"] == 66.7 and got["b"]["flags"] == ["low_coverage", "low_parse_confidence"]
    assert (got["c"]["global_pct"], got["c"]["level"], got["c"]["coverage_pct"]) == (0.0, "Inadapté", 100.0)
    assert got["d"]["flags"] == ["low_parse_confidence"]


def test_global_weighs_rounded_dimensions(spark):
    rows = [("a", "1", 3, "scored", 1), ("a", "1", 3, "scored", 2), ("a", "1", 1, "scored", 3), ("a", "2", 7, "scored", 2)]
    r = scoring.doc_scores(crit_rows(spark, rows), {"1": 2, "2": 5}, spark.createDataFrame([("a", 1.0)], "doc_id string, parse_confidence double")).first()
    assert r["dimensions"] == {"1": 34.3, "2": 40.0} and r["global_pct"] == 38.4


def test_default_grid():
    g = load_grid()
    assert len(g.criteria) == 57 and sum(g.weights.values()) == 31 and [c["id"] for c in g.criteria if c["external_dep"]] == ["2.7", "2.9", "5.4", "8.3"]
    assert g.na_possible == ["3.1", "3.2", "3.3", "3.4", "3.5", "3.6", "3.8", "3.9"] and [sum(c["tag"] == t for c in g.criteria) for t in "DHL"] == [13, 24, 20]
    with pytest.raises(ValueError):
        Grid([g.criteria[0], g.criteria[0]])
    with pytest.raises(ValueError):
        Grid([g.criteria[0] | {"dimension": "9"}])


def test_config_hash_ignores_paths_only():
    base = {"llm": {"provider": "mock"}, "paths": {"out": "a"}}
    assert config_hash(base, "g") == config_hash(base | {"paths": {"out": "b"}}, "g")
    assert len({config_hash(base, "g"), config_hash(base, "h"), config_hash(base | {"judge": {"section_chars": 1}}, "g")}) == 3


def test_unknown_provider_is_refused():
    with pytest.raises(ValueError):
        factory({"provider": "autre"})


EDGE = "1234567 " + " ".join(f"mot{chr(97 + i % 26)}{chr(97 + i // 26)} autre 12" for i in range(80))  # a document on the full route


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    (d / "clair.md").write_text("Auteur : pôle. " + " ".join(f"mot{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)), encoding="utf-8")
    (d / "limite.txt").write_text("﻿" + EDGE, encoding="utf-8")
    (d / "vide.md").write_bytes(b" \r\n")
    (d / "casse.docx").write_bytes(b"rien")
    (d / "sans.pdf").write_bytes(b"%PDF-1.4")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(d / "bureau.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="T2"/></w:pPr><w:r><w:t>Titre</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl><w:p><w:r><w:t>ﬁn</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="T2"><w:name w:val="heading 2"/></w:style></w:styles>')
        z.writestr("word/media/i.png", b"x")
    return parse_folder(spark, str(d)).cache(), d


def test_readers_never_fail(corpus):
    got = {r["doc_id"]: r for r in corpus[0].collect()}
    assert set(got) == {"clair", "limite", "vide", "casse", "sans", "bureau"}
    assert got["bureau"]["markdown"] == "## Titre\n\n| a | b |\n| --- | --- |\n| 1 |  |\n\nfin"
    assert [b["kind"] for b in got["bureau"]["blocks"]] == ["text", "table", "text", "image"]
    assert got["casse"]["blocks"][0]["kind"] == "unreadable" and got["casse"]["parse_confidence"] == 0.0
    assert got["limite"]["markdown"].startswith("1234567") and got["sans"]["category"] == "unreadable"
    assert got["clair"]["provenance"]["parser"] == "direct" and len(got["clair"]["provenance"]["source_sha256"]) == 64


def test_run_scores_every_document(spark, corpus, tmp_path):
    script = {"1234567": {"1.1": {"status": "scored", "score": 1, "justification": "=titre absent"}, "1.2": {"status": "scored", "score": 9, "justification": "x"}}}
    s = score_corpus(corpus[0], load_grid(), lambda: Scripted(script))
    got = {r["doc_id"]: r for r in s.doc_scores.collect()}
    assert set(got) == {"clair", "limite", "vide", "casse", "sans", "bureau"}
    assert got["vide"]["flags"] == ["unreadable"] and got["clair"]["flags"][-1] == "screen:light (signaux_propres)"
    crit = {r["id"]: r for r in s.criterion_rows.where("doc_id = 'limite'").collect()}
    assert len(crit) == 57 and crit["1.1"]["score"] == 1 and crit["1.2"]["status"] == "not_evaluated" and crit["2.7"]["justification"] == judge.J_EXTERNAL
    assert crit["1.3"]["status"] == "scored" and crit["3.4"]["status"] == "na"
    cost = {r["doc_id"]: r for r in s.cost.collect()}
    assert cost["limite"]["n_calls"] == 1 and cost["clair"]["n_calls"] == 0
    paths = reports.write_corpus_report(s.doc_scores, s.criterion_rows, tmp_path)
    raw = (tmp_path / "detail.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf")
    rows = list(csv.reader((tmp_path / "detail.csv").open(encoding="utf-8-sig", newline=""), delimiter=";"))
    assert rows[0] == reports.DETAIL and any(r[7] == "'=titre absent" for r in rows)
    assert zipfile.ZipFile(paths["xlsx"]).testzip() is None
    reports.write_doc_json(s.doc_scores, s.criterion_rows, str(tmp_path / "json"), "abc")
    one = json.loads((tmp_path / "json" / "limite.score.json").read_text(encoding="utf-8"))
    assert one["config_hash"] == "abc" and len(one["criteria"]) == 57


def test_one_failing_section_voids_its_document(spark, corpus):
    class Broken(Scripted):
        def ask(self, prompt):
            raise TimeoutError

    s = score_corpus(corpus[0], load_grid(), Broken)
    got = {r["doc_id"]: r["flags"] for r in s.doc_scores.collect()}
    assert got["limite"] == ["processing_error: TimeoutError"] and len(got) == 6


def test_calls_run_in_parallel_and_are_tried_again(spark):
    from docgauge.judging.run import answer, tried

    class Slow(Scripted):
        def __init__(self):
            super().__init__(default={"ok": 1})
            self.seen = {}

        def ask(self, prompt):
            self.seen[prompt] = self.seen.get(prompt, 0) + 1
            time.sleep(0.2)
            if prompt == "p3" and self.seen[prompt] < 3:
                raise ConnectionError
            if prompt == "p4":
                raise TimeoutError
            if prompt == "p5":
                raise KeyError
            return f"{prompt} {self.seen[prompt]}"

    rows = spark.createDataFrame([(f"p{i}",) for i in range(12)], "prompt string").coalesce(1)
    began = time.time()
    got = {r["prompt"]: (r["response"], r["error"]) for r in answer(rows, Slow, parallel=6, wait=0.01).collect()}
    assert time.time() - began < 30 and got["p0"] == ("p0 1", None) and got["p3"] == ("p3 3", None) and got["p4"] == (None, "TimeoutError") and got["p5"] == (None, "KeyError")
    assert tried(lambda: "a") == ("a", None)


def test_entries_come_by_file_name(spark, tmp_path):
    rows = [("a", 1.0, "Excellent", 1.0, {}, [], []), ("a-b", 2.0, "Excellent", 1.0, {}, [], []), ("b", 3.0, "Excellent", 1.0, {}, [], [])]
    scores = spark.createDataFrame(rows, "doc_id string, global_pct double, level string, coverage_pct double, dimensions map<string,double>, worst_sections array<string>, flags array<string>")
    crit = spark.createDataFrame([], "doc_id string, ord int, id string, dimension string, label string, tag string, weight int, state string, status string, score int, justification string, evidence string")
    reports.write_corpus_report(scores, crit, str(tmp_path))
    assert [r[0] for r in csv.reader((tmp_path / "synthese.csv").open(encoding="utf-8-sig", newline=""), delimiter=";")] == ["doc_id", "a-b", "a", "b"]


def test_store_round_trip_and_edits(spark, corpus, tmp_path):
    from docgauge.sources.parsed_store import is_parsed_folder, read_store

    reports.write_parsed_store(corpus[0], str(tmp_path))
    back = {r["doc_id"]: r for r in read_store(spark, str(tmp_path)).collect()}
    first = {r["doc_id"]: r for r in corpus[0].collect()}
    assert {k: (r["markdown"], r["parse_confidence"], r["entry_flags"]) for k, r in back.items()} == {k: (r["markdown"], r["parse_confidence"], []) for k, r in first.items()}
    a = {r["doc_id"]: r.asDict(True) for r in score_corpus(read_store(spark, str(tmp_path)), load_grid()).doc_scores.collect()}
    b = {r["doc_id"]: r.asDict(True) for r in score_corpus(corpus[0], load_grid()).doc_scores.collect()}
    assert a == b
    (tmp_path / "bureau.md").write_text("Un\r\n\r\nDeux", encoding="utf-8", newline="")
    (tmp_path / "clair.md").unlink()
    (tmp_path / "seul.md").write_text("texte", encoding="utf-8")
    (tmp_path / "limite.parse.json").write_text("{", encoding="utf-8")
    (tmp_path / "vide.parse.json").rename(tmp_path / "autre.parse.json")
    got = {r["doc_id"]: r for r in read_store(spark, str(tmp_path)).collect()}
    assert got["bureau"]["entry_flags"] == ["manually_edited"] and [b["kind"] for b in got["bureau"]["blocks"]] == ["table", "image", "text", "text"]
    assert got["clair"]["entry_flags"] == ["missing_markdown"] and got["seul"]["entry_flags"] == ["missing_sidecar"] and got["limite"]["entry_flags"] == ["invalid_sidecar"]
    assert got["autre"]["entry_flags"] == ["missing_markdown"] and got["vide"]["entry_flags"] == ["missing_sidecar"]
    with pytest.raises(ValueError):
        is_parsed_folder(["a.parse.json", "b.docx"])


def test_golden_rows(spark, corpus):
    answers = {
        "Extraits": {"reponse": "Les deux", "couvert": "oui"},
        "Auteur": {"questions": [{"question": "Qui ?", "reponse": "Le pôle", "couvert": "Oui"}, {"question": "Quoi ?", "reponse": "Inconnu", "couvert": "non"}]},
    }
    questions = spark.createDataFrame([(1, "Que disent les textes ?"), (2, "  ")], "q_no int, question string")
    rows = {r["id"]: r for r in golden_set(corpus[0], lambda: Scripted(answers), corpus_questions=questions, k=2).collect()}
    assert set(rows) == {"clair-1", "clair-2", "corpus-1"}
    assert rows["clair-1"]["couvert"] == "oui" and rows["clair-2"]["reponse"] == "Non couvert par le document"
    assert rows["corpus-1"]["reponse"] == "Les deux" and len(rows["corpus-1"]["sources"].split("; ")) >= 1


def test_corpus_questions_are_proposed(spark, corpus):
    answers = {"Trouve des questions": {"questions": [{"question": "Quel lien ?"}, {"question": " "}]}, "Extraits": {"reponse": "Aucun", "couvert": "oui"}}
    rows = {r["id"]: r for r in golden_set(corpus[0], lambda: Scripted(answers), corpus_level=True, k=1).collect()}
    assert set(rows) == {"corpus-1"} and rows["corpus-1"]["question"] == "Quel lien ?"


def test_every_document_proposes_corpus_questions(spark):
    from docgauge.operators import golden

    names = [f"d{i:04d}" for i in range(2 * golden.PROMPT_DOCS + 1)]
    docs = spark.createDataFrame([(x, f"Texte {x}") for x in names], "doc_id string, markdown string").repartition(5)
    answers = {f"[{x}]\nTexte": {"questions": [{"question": f"Quel lien avec {x} ?"}]} for x in (names[0], names[-1])}
    rows = [r for r in golden_set(docs, lambda: Scripted(answers), corpus_level=True, k=1).collect() if r["origine"] == "corpus"]
    assert [r["question"] for r in sorted(rows, key=lambda r: r["id"])] == [f"Quel lien avec {x} ?" for x in (names[0], names[-1])]
    prompts = [r["prompt"] for r in golden.corpus_questions_prompts(docs, "p", "q").orderBy("batch").collect()]
    told = [[x for x in p.split("Debut de chaque document")[1].split() if x.startswith("[")] for p in prompts]
    assert [len(x) for x in told] == [267, 267, 267] and sum(told, []) == [f"[{x}]" for x in names]


def test_colliding_names_are_refused(spark, tmp_path):
    for n in ("a.md", "a.txt"):
        (tmp_path / n).write_text("x", encoding="utf-8")
    with pytest.raises(ValueError):
        parse_folder(spark, str(tmp_path))
