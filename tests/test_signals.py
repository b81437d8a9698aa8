"""Signals against a plain definition of each, on documents of every odd kind."""

import re

import pytest
from pyspark.sql import functions as F

from docgauge.operators import inventory, rules, screen, sections, signals

SPACE = "[\\s\\x1c-\\x1f]"
TEXTS = {
    "empty": "", "blank": " \n\t ", "half": "½ est ²", "crlf": "ligne a\r\nligne a\r\nligne b", "fs": "a\x1cb\x1dc", "ideographic": "mot　mot",
    "boiler": "\n".join(["En-tete repete du document"] * 5 + ["Une ligne unique de texte"]), "dup": "Une ligne longue de texte\nUne ligne longue de texte\nautre",
    "tokens": " ".join(f"mot{i % 700}" for i in range(2345)), "vocabulary": " ".join(["a" * (i % 300 + 1) for i in range(3000)]), "cid": "(cid:12)(cid:3) texte (cid:x) �",
    "astral": "𝒜𝓑 𐐀𐐁 mot", "sentences": "Un deux. Trois quatre cinq! Six? ... ", "questions": "\n".join(["Pourquoi ?"] * 5), "combining": "été",
}


def expect(t):
    strip = lambda s: re.sub(f"^{SPACE}+|{SPACE}+$", "", s)
    tokens = re.findall(r"\w+", t.lower())
    lines = [s for s in (x.strip() for x in t.splitlines()) if s]
    big = [x for x in lines if len(x) >= 15]
    kept = [x for x in big if big.count(x) <= 3]
    parts = [p for p in re.split(r"[.!?]+", t) if p.strip()]
    assert strip(t) == t.strip()
    return {
        "len": len(t), "alpha": sum(c.isalpha() for c in t), "cid": sum(len(m) for m in re.findall(r"\(cid:\d+\)", t)) + t.count("�"), "n_tok": len(tokens), "u_tok": len(set(tokens)),
        "seg_u": sum(len(set(tokens[i : i + 1000])) for i in range(0, len(tokens) // 1000 * 1000, 1000)), "n_line": len(lines), "u_line": len(set(lines)),
        "kept": len(kept), "dup": len(kept) - len(set(kept)), "n_sent": len(parts), "n_word": sum(len(p.split()) for p in parts), "q_line": sum(x.endswith("?") for x in lines),
    }


def test_counts_equal_plain_definitions(spark):
    df = spark.createDataFrame([(k, v) for k, v in TEXTS.items()], "doc_id string, markdown string")
    got = {r["doc_id"]: r["c"].asDict() for r in signals.with_counts(df).select("doc_id", "c").collect()}
    for k, t in TEXTS.items():
        want = expect(t)
        assert {x: got[k][x] for x in want} == want, k


def test_signals_of_null_and_empty(spark):
    df = spark.createDataFrame([("a", None, None), ("b", "", [])], "doc_id string, markdown string, blocks array<struct<kind:string,text:string,page:int,section:string>>")
    for r in signals.signals(df).collect():
        assert (r["non_alpha_fraction"], r["duplicate_line_fraction"], r["type_token_ratio"], r["mattr"], r["n_tokens"], r["block_integrity"]) == (1.0, 0.0, 0.0, 0.0, 0, 0.0)


def test_repeated_vocabulary_keeps_window_ratio(spark):
    words = " ".join(f"mot{i}" for _ in range(20) for i in range(300))
    r = signals.signals(spark.createDataFrame([("a", words)], "doc_id string, markdown string"), blocks=None).first()
    assert r["type_token_ratio"] == 0.05 and r["mattr"] == 0.3 and r["n_tokens"] == 6000


@pytest.mark.parametrize(
    ("text", "scores"),
    [
        ("Auteur : pole. Version 2.1, 1er janvier 2026", {"1.3": 5, "1.4": 5, "1.9": 5}),
        ("Juin 2025", {"1.4": 3, "1.3": 1}),
        ("mise à jour", {"1.6": 1}),
        ("Mise a jour", {"1.6": 5}),
        ("document archivé", {"1.7": 5}),
        ("\n".join(["En quoi ?"] * 5), {"8.1": 5}),
        ("la FAQ du site", {"8.1": 5}),
        ("FAQs", {"8.1": 1}),
        ("rien", {"1.3": 1, "1.4": 1, "1.8": 1, "4.5": 5, "8.1": 1}),
    ],
)
def test_rules(spark, text, scores):
    d = rules.with_rule_scores(signals.signals(spark.createDataFrame([("a", text)], "doc_id string, markdown string"), blocks=None)).first()["d_scores"]
    assert {k: d[k] for k in scores} == scores


def test_routes(spark):
    rows = [
        ("clean", 0.9, 0.2, 0.1, 0.5, 100, "signaux_propres", "light"), ("edge", 0.9, 0.35, 0.1, 0.5, 100, "cas_limite", "full"), ("bad", 0.4, 0.2, 0.0, 0.5, 100, "extraction_degradee", "light"),
        ("large", 0.9, 0.2, 0.0, 0.17, 20000, "gros_document_extraction_saine", "full"), ("large bad", 0.9, 0.5, 0.0, 0.17, 20000, "extraction_degradee", "light"), ("null", None, 0.2, 0.0, 0.5, 100, "extraction_degradee", "light"),
    ]
    df = spark.createDataFrame(rows, "doc_id string, parse_confidence double, non_alpha_fraction double, duplicate_line_fraction double, mattr double, n_tokens int, want string, want_route string")
    for r in screen.with_route(df).collect():
        assert (r["reason"], r["route"]) == (r["want"], r["want_route"])


def test_inventory_and_na(spark):
    block = "array<struct<kind:string,text:string,page:int,section:string>>"
    rows = [("t", "voir [a](http://x) et http://y", [("table", "", 1, None), ("text", "a", 1, None)]), ("n", None, None), ("p", "x", [("picture", None, 1, None), (None, "a", 1, None)])]
    d = inventory.with_inventory(spark.createDataFrame(rows, f"doc_id string, markdown string, blocks {block}"))
    got = {r["doc_id"]: r for r in d.withColumn("na", inventory.na_ids(["3.1", "3.2", "3.3", "3.4", "3.5", "3.6", "3.8"])).collect()}
    assert got["t"]["links"] == 2 and got["t"]["tables"] == 1 and got["t"]["na"] == ["3.1", "3.2", "3.3", "3.6"]
    assert got["n"]["na"] == ["3.1", "3.2", "3.3", "3.4", "3.5", "3.6", "3.8"]
    assert got["p"]["images_n"] == 1 and "3.1" not in got["p"]["na"]


@pytest.mark.parametrize(("n", "size", "overlap"), [(0, 10, 0), (1, 10, None), (10, 10, 3), (11, 10, 3), (25, 10, 9), (25, 10, 99), (24, 10, 0), (7, 1, 0)])
def test_windows_cover_the_text(spark, n, size, overlap):
    text = "".join(chr(0x61 + i % 26) for i in range(n))
    parts = spark.createDataFrame([(text,)], "t string").select(sections.windows(F.col("t"), size, overlap).alias("w")).first()["w"]
    _, stride = sections.window_stride(size, overlap)
    want, i = [], 0
    while i < n:
        want.append(text[i : i + size])
        if i + size >= n:
            break
        i += stride
    assert parts == want


def test_excerpt_ends_with_the_text(spark):
    text = "".join(str(i % 10) for i in range(5000))
    got = spark.createDataFrame([(text,)], "t string").select(sections.representative_excerpt(F.col("t"), 1000).alias("e")).first()["e"]
    assert got.startswith(text[:500]) and got.endswith(text[-125:]) and got.count("[...]") == 4


def test_parse_confidence_covers_glyph_codes(spark, tmp_path):
    from docgauge.plans import queries

    texts = {"clean": "a" * 500, "codes": "a" * 480 + "(cid:12)" + "(cid:345)" + "\ufffd" * 3, "blank": " \n", "thin": "a" * 700, "other": "a" * 600}
    df = spark.createDataFrame([(k, t, []) for k, t in texts.items()], "doc_id string, markdown string, blocks array<struct<kind:string,text:string>>")
    df.write.parquet(str(tmp_path / "docs.parquet"))
    side = "schema_version int, doc_id string, markdown_hash string, parse_confidence double, n_blocks int, provenance struct<parser:string,source_pages:int>"
    spark.createDataFrame([(1, "thin", None, None, 0, ("direct", 9)), (1, "other", None, None, 0, ("fallback", 1)), (1, None, None, None, 0, None)], side).write.parquet(str(tmp_path / "sidecars.parquet"))
    got = {r["doc_id"]: r["confidence"] for r in queries.queries()["parse_confidence"](spark, str(tmp_path)).collect()}
    assert got == {"clean": 1.0, "codes": round(1 - 20 / 500, 3), "blank": 0.0, "thin": 0.4, "other": 0.6}
