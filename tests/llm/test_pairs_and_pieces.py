"""Problems 5 to 7: pairs, look-alikes, pieces."""

import functools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docgauge.llm import p02_language as p2
from docgauge.llm import p05_pairs as p5
from docgauge.llm import p06_lookalike as p6
from docgauge.llm import p07_split as p7

Q = "Dans quel cas est-ce que la caisse transmet le dossier de remboursement ?"


@pytest.mark.parametrize(
    ("answer", "covered", "want"),
    [
        (None, "oui", "empty"), ("", "oui", "empty"), ("  \n", "oui", "empty"), ("N/A", None, "empty"), ("[]", "oui", "empty"), ("…", "oui", "empty"),
        ("Non couvert par le document", "non", None), ("Non couvert par le document", "Oui", "refusal"),
        ("Je suis désolé, mais je ne peux pas répondre à cette question.", "oui", "refusal"), ("JE NE SAURAIS VOUS DIRE.", "oui", "refusal"), ("I must decline this request.", "oui", "refusal"), ("Dazu kann ich mich nicht äußern.", "", "refusal"),
        ("Il n'est pas possible de déroger à cette règle ; le comité vérifie la demande.", "oui", None),
        (Q, "oui", "copy"), (Q.upper(), "oui", "copy"), ("Question : " + Q, "oui", "copy"), (Q + " " + Q, "oui", "copy"), ("« " + Q + " »", "oui", "copy"), (Q[:-2], "oui", "copy"),
        ("The case handler of the fund sends the file before the end of the month.", "oui", "language"),
        ("Le comité vérifie la demande avant la fin", "oui", None), ("Le comité vérifie la demande. La caisse archive le dos", "oui", "truncated"), ("La caisse archive (avec l'appui du", "oui", "truncated"),
        ("1. Le comité vérifie.\n2. La caisse archive.\n3.", "oui", "truncated"), ("1. Le comité vérifie.\n2. La caisse archive.", "oui", None), ("La caisse [...]", "oui", "truncated"), ("Selon l'art.", "oui", "truncated"),
        ("```json\n{}", "oui", "truncated"), ("12 %", "oui", None), ("Oui", "oui", None), ("Non", "oui", None), ("Au plus tard le 2 mars", "oui", None), ("Pack “accueil” : la caisse archive.", "oui", None),
    ],
)
def test_first_pass(answer, covered, want):
    assert p5.judged([Q], [answer], [covered], model())[0][0] == want


@functools.cache
def model():
    from test_text_types import DE, EN, FR

    texts = {"fr": [*FR, Q], "de": DE, "en": EN}
    return p2.fit([p5.plain(p5.normal(t)) for ts in texts.values() for t in ts], [c for c, ts in texts.items() for _ in ts])


def test_languages_of_pairs_by_centroids(spark):
    import test_text_types as tt

    rows = [(f"{c}{i}", ts[i % 3], ts[(i + 1) % 3], "oui") for c, ts in (("fr", tt.FR), ("de", tt.DE), ("en", tt.EN)) for i in range(6)]
    rows += [("x", tt.FR[0], tt.DE[1], "oui"), ("y", tt.EN[0], tt.FR[2], None), ("z", tt.FR[0], "Комитет проверяет заявление до конца месяца.", "oui"), ("short", tt.FR[0], "The board decides.", "oui"), ("null", None, tt.EN[0], "oui")]
    df = spark.createDataFrame(rows + rows[:2], "id string, question string, reponse string, couvert string")
    assert {tuple(r) for r in p5.found(df).collect()} == {("x", "language"), ("y", "language"), ("z", "language")}


@pytest.mark.parametrize("text", ["No answer will be given here: please turn to the board.", "Aucune réponse ne sera donnée ici.", "Hier wird keine Antwort gegeben.", "Aquí no se dará ninguna respuesta.", "Qui non verrà data alcuna risposta.", "Não será dada qualquer resposta.", "Je ne peux pas répondre.", "I cannot say.", "Das kann ich nicht beantworten.", "No puedo responder.", "Mi dispiace, non posso.", "Lamento, mas recuso."])
def test_every_refusal_passes_the_cheap_test(text):
    assert p5.first_pass(Q, text, "oui")[0] == "refusal"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=12), st.lists(st.sampled_from("abcdef"), min_size=1, max_size=14))
def test_bound_before_tiling_loses_no_copy(q, a):
    in_a, in_q = p5.tiled(a, q)
    if in_a >= p5.COPY_ANSWER and in_q >= p5.COPY_QUESTION:
        assert len(a) - len(set(a) - set(q)) >= p5.COPY_ANSWER * len(a) - 1e-9


def test_a_copy_with_one_word_in_ten_changed():
    words = Q.replace(" ?", "").split()[:10]
    assert len(words) == 10 and p5.first_pass(" ".join(words), " ".join([*words[:9], "autre"]), "oui")[0] == "copy"


def test_open_phrases_use_the_table(spark):
    rows = [(f"q{i}", f"Qui {v} le dossier de la caisse ?", f"Le comité du siège {v} le dossier de la caisse avant la fin du mois.", "oui") for i, v in enumerate(["vérifie", "archive", "transmet"] * 12)]
    rows += [("short", "Qui archive le dossier ?", "Le comité du siège", "oui"), ("verb", "Qui archive le dossier ?", "Le comité du siège archive le dossier", "oui"), ("torn", "Qui archive le dossier ?", "Le com", "oui"), ("gram", "Qui archive le dossier ?", "Le comité de la", "oui"), ("null", None, "Le comité.", None), (None, None, None, None)]
    df = spark.createDataFrame(rows + rows[-1:], "id string, question string, reponse string, couvert string")
    got = {r["id"]: r["defect"] for r in p5.defects(df).collect()}
    assert {k: got[k] for k in ("short", "verb", "torn", "gram", "null", None)} == {"short": None, "verb": "truncated", "torn": "truncated", "gram": "truncated", "null": None, None: "empty"}
    assert got["q0"] is None and p5.defects(df).count() == len(rows)
    assert p5.found(spark.createDataFrame([], df.schema)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=10))
def test_tiling_covers_only_common_runs(a, q):
    in_a, in_q = p5.tiled(a, q)
    assert 0 <= in_a <= 1 and 0 <= in_q <= 1
    if a and a == q:
        assert in_a == in_q == 1
    runs = {tuple(q[i : i + min(3, len(q))]) for i in range(len(q) - min(3, len(q)) + 1)}
    if q and not any(tuple(a[i : i + min(3, len(q))]) in runs for i in range(len(a))):
        assert in_a == 0


LOOK = [
    ("a", "Été à 12 h : café"), ("b", "Été à 12 h : café"), ("c", "Été à 12 h : ca​fé"), ("d", "Été à １２ ｈ : café"), ("e", "Été à 12 h : саfé"), ("f", "Été à 12 h : cafe"), ("g", "été à 12 h : café"), ("h", "Été à 13 h : café"),
    ("i", "ﬁn\r\nfin"), ("j", "fin\nfin"), ("k", "Été à 12 h : café"), ("l", None), ("m", "  "), ("n", ""), ("o", "  "),
]


def test_look_alike_classes(spark):
    df = spark.createDataFrame(LOOK, "doc_id string, markdown string")
    same, two = ["a", "b", "c", "d", "e", "k"], ["i", "j"]
    text = dict(LOOK)
    want = {(x, y) for g in (same, two) for x in g for y in g if x < y and text[x] != text[y]}
    assert {tuple(r) for r in p6.found(df).collect()} == want
    forms = {r["doc_id"]: (r["class_id"], r["form"]) for r in p6.consistent_form(df).collect()}
    assert len({forms[k] for k in same}) == 1 and len({forms[k] for k in two}) == 1 and forms["a"][1] == text["a"]
    assert len({forms[k][1] for k in "afgh"}) == 4 and forms["l"][1] is None and forms["f"][0] is None
    size = {r["doc_id"]: r["n_docs"] for r in p6.class_members(df).collect()}
    assert size == dict.fromkeys(same, 6) | dict.fromkeys(two, 2)
    assert p6.found(df.where("false")).count() == 0


def test_coarse_key_of_other_scripts(spark):
    import unicodedata

    texts = ["Комитет проверяет йод", "Комитет проверяет иод", "Ἡ ἐπιτροπή", "위원회가 확인", "委員会は確認", "が ガ", "اللجنة تفحص", "Ångström Å", "Å K Ω", "naïve coöp", "Ǖ ộ ǹ", "क़ ख़", "﷽"]
    rows = [(f"{i}{form}", unicodedata.normalize(form, t)) for i, t in enumerate(texts) for form in ("NFC", "NFD")]
    df = spark.createDataFrame(rows, "doc_id string, markdown string").withColumn("k", p6.coarse_key(p6.drawn(F.col("markdown"))))
    keys = {r["doc_id"]: r["k"] for r in df.collect()}
    assert all(keys[f"{i}NFC"] == keys[f"{i}NFD"] for i in range(len(texts)))
    assert len({keys[f"{i}NFC"] for i in (0, 2, 3, 4, 5, 6, 8, 9, 11)}) == 9
    want = {(f"{i}NFC", f"{i}NFD") for i, t in enumerate(texts) if unicodedata.normalize("NFC", t) != unicodedata.normalize("NFD", t)}
    assert {tuple(r) for r in p6.found(df).collect()} == want


def test_hot_class_gives_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(p6, "BLOCK", 4)
    rows = [(f"d{i:02d}", ["café", "cafe\u0301", "caf\u200bé"][i % 3]) for i in range(25)]
    got = [tuple(r) for r in p6.found(spark.createDataFrame(rows, "doc_id string, markdown string")).collect()]
    want = {(a, b) for a, s in rows for b, t in rows if a < b and s != t}
    assert set(got) == want and len(got) == len(want)


def test_look_alike_blocks(spark):
    rows = [("a", [("p", "Cafe\u0301 du soir"), ("h", None), ("p", " ")]), ("b", [("p", "Caf\u00e9 du soir"), ("p", "Autre")]), ("c", None)]
    got = {(r["doc_id"], r["block_no"]): (r["kind"], r["form"]) for r in p6.blocks_form(spark.createDataFrame(rows, "doc_id string, blocks array<struct<kind:string,text:string>>")).collect()}
    assert got == {("a", 0): ("p", "Caf\u00e9 du soir"), ("a", 1): ("h", None), ("a", 2): ("p", " "), ("b", 0): ("p", "Caf\u00e9 du soir"), ("b", 1): ("p", "Autre"), ("c", None): (None, None)}


def whole(rows, text, limit, overlap):
    out, end = "", 0
    for i, r in enumerate(rows):
        assert r["piece_no"] == i and 0 < len(r["piece"]) <= limit and r["piece"] == text[r["start"] : r["end"]]
        assert r["start"] <= end and (i == 0 or end - r["start"] <= overlap) and r["end"] > end
        out += r["piece"][end - r["start"] :]
        end = r["end"]
    return out


def texts():
    rng = np.random.default_rng(2)
    sentence = lambda n: " ".join("é" * int(k) for k in rng.integers(1, 9, n)) + ". "
    return {
        "prose": "".join(sentence(12) + ("\n\n" if i % 5 == 0 else "") for i in range(60)), "solid": "x" * 5000, "lines": "\r\n".join("abc def" for _ in range(700)), "short": "court", "limit": "y" * 400, "over": "y " * 200 + "z",
        "empty": "", "null": None, "spaces": " " * 3000, "emoji": "😀a " * 900,
    }


@pytest.mark.parametrize(("limit", "overlap", "size"), [(400, 40, 1000), (400, 0, 97), (1000, 100, 1 << 16)])
def test_pieces_give_back_the_text(spark, limit, overlap, size):
    df = spark.createDataFrame(list(texts().items()), "doc_id string, markdown string")
    at = p7.piece_offsets(df, limit=limit, overlap=overlap, size=size, over_only=False).collect()
    for k, t in texts().items():
        rows = sorted(({"piece": t[r["start"] : r["end"]], **r.asDict()} for r in at if r["doc_id"] == k), key=lambda r: r["piece_no"])
        assert whole(rows, t or "", limit, overlap) == (t or "")
    got = p7.pieces(df, limit=limit, overlap=overlap).collect()
    for k, t in texts().items():
        assert whole(sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["piece_no"]), t or "", limit, overlap) == (t or "")


def test_pieces_prefer_strong_boundaries(spark):
    t = ("mot " * 90 + "fin.\n\n") * 4
    rows = p7.pieces(spark.createDataFrame([("a", t)], "doc_id string, markdown string"), limit=400, overlap=40).orderBy("piece_no").collect()
    assert rows[0]["cut"] == 4 and rows[0]["piece"].endswith("fin.\n\n")


@pytest.mark.parametrize("size", [97, 1000, 1 << 16])
def test_white_space_over_range_edges_keeps_its_rank(spark, tmp_path, size):
    t = "".join(f"mot{i} fin." + ("\n" + " " * 300 + "\n" + "\t" * 150 if i % 3 else " " * 400) for i in range(30)) + "fin"
    strong = [m.end() for m in p7.BOUNDARY.finditer(t) if m.lastindex <= 3]
    pos = {a + x: r for a in range(0, len(t), size) for x, r in zip(*p7._table(t, a, min(a + size, len(t)))) if r >= 2}
    assert sorted(pos) == strong
    (tmp_path / "w.txt").write_text(t, encoding="utf-8", newline="")
    rows = p7.file_pieces(spark, [(tmp_path / "w.txt").as_uri()], limit=1000, overlap=100, size=size).orderBy("piece_no").collect()
    assert whole(rows, t, 1000, 100) == t


def test_oversized_documents_as_files(spark):
    rng = np.random.default_rng(5)
    t = "".join(" ".join("é" * int(k) for k in rng.integers(1, 9, 30)) + ".\n\n" for _ in range(150))
    df = spark.createDataFrame([("a b", t), ("c", "court"), ("n", None)], "doc_id string, markdown string")
    rows = p7.file_query(df).orderBy("piece_no").collect()
    assert {r["doc_id"] for r in rows} == {"a b"} and whole(rows, t, p7.LIMIT, p7.OVERLAP) == t and len(rows) > 1


def test_files_by_byte_ranges(spark, tmp_path):
    body = "".join(t or "" for t in texts().values()) * 3
    (tmp_path / "big.txt").write_text(body, encoding="utf-8", newline="")
    (tmp_path / "none.txt").write_text("")
    rows = p7.file_pieces(spark, [str(tmp_path / "big.txt"), str(tmp_path / "none.txt")], limit=1000, overlap=100, size=1003).orderBy("piece_no").collect()
    assert whole(rows, body, 1000, 100) == body


def test_found_is_the_length_rule(spark):
    df = spark.createDataFrame([("a", "x" * 8000), ("b", "x" * 8001), ("c", None), ("d", "mot " * 3000)], "doc_id string, markdown string")
    assert {r["doc_id"] for r in p7.found(df).collect()} == {"b", "d"}
