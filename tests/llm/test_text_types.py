"""Problems 1 to 4: text types, languages, repetition, encoding repair."""

import numpy as np
from pyspark.sql import functions as F

from docgauge.llm import p01_text_type as p1
from docgauge.llm import p02_language as p2
from docgauge.llm import p03_repetition as p3
from docgauge.llm import p04_mojibake as p4
from docgauge.llm.em import dawid_skene

FR = ["Le gestionnaire de la caisse transmet le dossier de remboursement à l'adhérent avant la fin du mois, même si le délai est dépassé.", "La déléguée vérifie la demande d'affiliation après accord préalable, sauf stipulation contraire.", "Après examen du dossier, le comité de la région enregistre l'échéancier des garanties pour l'année à venir."]
DE = ["Der Sachbearbeiter der Kasse prüft den Antrag zur Erstattung nach Eingang der Unterlagen, wenn alle Belege vollständig sind.", "Die Vertreterin überwacht die Übersicht für den Zeitraum gemäß der gültigen Tabelle, solange die Probezeit läuft.", "Für jeden Begünstigten archiviert das Sekretariat das Protokoll über Garantien spätestens am Ende des Monats."]
EN = ["The case handler of the fund sends the file for reimbursement before the end of the month, unless the ceiling has been passed.", "The delegate checks the request on enrolment after prior approval, as long as the trial period is running.", "After a look at the file, the committee of the region records the payment plan of guarantees for the coming year."]


def prose(texts, n, seed=0):
    rng = np.random.default_rng(seed)
    return "\n\n".join(" ".join(texts[int(i)] for i in rng.integers(0, len(texts), 3)) for _ in range(n))


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id string, markdown string, lang string, folder string" + extra)


def mixed(spark):
    rows = [(f"fr{i}", prose(FR, 2, i), "fr", "a") for i in range(12)] + [(f"de{i}", prose(DE, 2, i), "Deutsch", "a") for i in range(12)] + [(f"en{i}", prose(EN, 2, i), "en-GB", "b") for i in range(12)]
    rows += [(f"list{i}", "\n".join(f"- Poste {chr(97 + j)} du contrat" for j in range(8 + i)), "fr", "a") for i in range(4)]
    rows += [(f"table{i}", "\n".join(f"| Soins {chr(97 + j)} | {j * 7} % | {j},50 € |" for j in range(8 + i)), "fr", "a") for i in range(4)]
    rows += [(f"junk{i}", " ".join("".join("bcdfghjklmnpqrstvwxz"[(i * 7 + j * k) % 20] for k in range(2, 11)) for j in range(60)), None, "b") for i in range(4)]
    return rows + [("null", None, None, None), ("empty", "", "fr", "a"), ("blank", " \n\t", "fr", "a")]


def test_types_and_their_edges(spark):
    rows = mixed(spark)
    df = docs(spark, rows + [rows[0]]).withColumn("text_type", F.lit("x")).withColumn("n_words", F.lit(1))
    t = p1.text_types(df)
    got = {r["doc_id"]: r["text_type"] for r in t.collect()}
    assert t.count() == len(rows) + 1
    for k, v in got.items():
        want = "blank" if k in ("null", "empty", "blank") else "".join(c for c in k if c.isalpha())
        assert v == (want if want in ("list", "table", "junk", "blank") else "prose"), k
    assert {(r["doc_id"], r["kind"]) for r in p1.found(df).collect()} == {(k, v) for k, v in got.items() if v in ("list", "table", "junk")}


def test_types_of_an_empty_table(spark):
    df = docs(spark, [])
    assert p1.text_types(df).count() == 0 and p1.found(df).count() == 0 and p2.found(df).count() == 0 and p3.method(df).count() == 0 and p3.found(df).count() == 0 and p4.found(df).count() == 0


def test_statistics_by_hand(spark):
    r = p1.with_statistics(docs(spark, [("a", "Le chat dort.\n- un\n\n# Titre", "fr", "a")])).first()
    assert (r["n_words"], r["n_lines"]) == (5, 3) and abs(r["punct_line_share"] - 1 / 3) < 1e-9 and abs(r["mean_line_words"] - 5 / 3) < 1e-9


def test_em_learns_from_agreement():
    rng = np.random.default_rng(3)
    true = rng.integers(0, 2, 4000)
    acc = [0.9, 0.8, 0.85, 0.55]
    votes = np.array([[t if rng.random() < a else 1 - t for a in acc] for t in true])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    lean = np.tile(np.array([[0.6, 0.4], [0.4, 0.6]]), (4, 1, 1))
    post, tables, _ = dawid_skene(patterns, counts.astype(float), lean)
    learned = tables[:, [0, 1], [0, 1]].mean(axis=1)
    assert np.abs(learned - acc).max() < 0.05
    best = {tuple(p): int(q.argmax()) for p, q in zip(patterns, post)}
    assert np.mean([best[tuple(v)] == t for v, t in zip(votes, true)]) > 0.9
    assert dawid_skene(np.zeros((0, 4), int), np.zeros(0), lean)[0].shape == (0, 2)


def test_labels_name_languages(spark):
    labels = ["fr-FR", "FRA", "anglais", " Deutsch ", "en, fr", "pt;es", "xx", None, "", "n/a", "en_US"]
    df = spark.createDataFrame([(x,) for x in labels], "lang string").withColumn("n", p2.named_languages(F.col("lang")))
    assert [r["n"] for r in df.collect()] == [["fr"], ["fr"], ["en"], ["de"], ["en", "fr"], ["pt", "es"], [], [], [], [], ["en"]]


def test_languages_of_paragraphs(spark):
    rows = mixed(spark)
    rows += [("mixed", prose(FR, 1) + "\r\n\r\n" + prose(DE, 1), "fr", "a"), ("wrong", prose(EN, 2), "de", "a"), ("none", prose(DE, 1), None, "a"), ("heading", prose(FR, 1) + "\n\nThe board\n\n" + prose(FR, 1), "fr", "a")]
    df = docs(spark, rows)
    got = {(r["doc_id"], r["lang"]) for r in p2.found(df).collect()}
    assert got == {("mixed", "de"), ("wrong", "en"), ("none", "de")}
    main = {r["doc_id"]: (r["main_lang"], r["langs"]) for r in p2.document_languages(df, p2.train(df)).collect()}
    assert main["wrong"] == ("en", ["en"]) and main["mixed"][1] == ["de", "fr"] and "null" not in main


def test_unknown_languages_are_rejected(spark):
    rows = [(f"{c}{i}", prose(t, 3, i), c, "a") for c, t in (("fr", FR), ("de", DE), ("en", EN)) for i in range(20)]
    strange = {
        "ru": "Комитет проверяет заявление о возмещении расходов до конца месяца, если все документы были представлены вовремя, и хранит копию в архиве отделения.",
        "fi": "Toimikunta tarkastaa korvaushakemuksen ennen kuukauden loppua, jos kaikki asiakirjat on toimitettu ajoissa, ja säilyttää jäljennöksen osaston arkistossa koko vuoden ajan.",
        "hu": "A bizottság a hónap vége előtt ellenőrzi a térítési kérelmet, ha minden iratot időben benyújtottak, és egy másolatot megőriz az osztály levéltárában a következő évig.",
        "el": "Η επιτροπή ελέγχει την αίτηση επιστροφής εξόδων πριν από το τέλος του μήνα, εφόσον όλα τα έγγραφα υποβλήθηκαν εγκαίρως, και φυλάσσει αντίγραφο στο αρχείο.",
        "vi": "Ủy ban kiểm tra đơn yêu cầu hoàn trả trước cuối tháng nếu mọi giấy tờ đã được nộp đúng hạn và lưu giữ một bản sao trong kho lưu trữ của phòng.",
    }
    df = docs(spark, rows + [(k, t, None, "a") for k, t in strange.items()])
    seg = {r["doc_id"]: (r["seg_lang"], r["confidence"]) for r in p2.language_segments(df, p2.train(df)).collect()}
    assert {k: seg[k] for k in strange} == dict.fromkeys(strange, ("und", 0.0)) and seg["fr0"][0] == "fr"
    assert not {r["doc_id"] for r in p2.found(df).collect()} & set(strange)


def test_training_paragraphs_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(p2, "PER_DOC", 3)
    seen = []
    monkeypatch.setattr(p2, "fit", lambda texts, labels: seen.append((texts, labels)))
    p2.train(docs(spark, [("a", prose(FR, 40), "fr", "a"), ("b", "mot " * 5000, "fr", "a"), ("c", prose(DE, 2), "de", "a")]))
    assert sorted(seen[0][1]) == ["de", "de", "fr", "fr", "fr"] and max(map(len, seen[0][0])) <= p2.LONGEST + 2


def test_segments_round_trip():
    for t in ("", "a", "a\n\nb", "\n\na\r\n \t\r\nb\n", "a\rb\r\rc"):
        parts = [t[a:b] for a, b in p2.segments(t)]
        assert "".join("".join(parts).split()) == "".join(t.split())


def brute_repeated(text, run=8):
    import re

    w = re.findall(r"[^\W\d_]+", (text or "").lower())
    hit = [False] * len(w)
    for i in range(len(w) - run + 1):
        if any(w[j : j + run] == w[i : i + run] for j in range(i)):
            hit[i : i + run] = [True] * run
    return sum(hit), len(w)


def test_repetition_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = FR[0] + " " + EN[0]
    cases = [None, "", "mot " * 7, "mot " * 9, "mot " * 50, base, base + " Puis 12 autres. " + base.upper().replace(",", " ;"), " ".join(rng.choice(list("abc"), 200)), base[:150] + base]
    for t in cases:
        assert p3.repeated_words(t) == brute_repeated(t)
    got = p3.repeated_share(docs(spark, [(str(i), t, "fr", "a") for i, t in enumerate(cases)])).orderBy("doc_id").collect()
    assert [(r["n_repeated"], r["n_words"]) for r in got] == [brute_repeated(t) for t in cases]


def test_found_repetition_leaves_junk_out(spark):
    rows = mixed(spark)
    plain = " ".join(f"{w} " for w in ("Le comité vérifie chaque dossier déposé avant la clôture annuelle et la caisse archive ensuite toutes les pièces reçues au siège central").split())
    rows = [r for r in rows if not r[0][:2] in ("fr", "de", "en") or r[0] == "empty"]
    rows += [("rep", plain + ". " + plain + ".", "fr", "a"), ("once", plain + ".", "fr", "a"), ("junkrep", rows[-7][1] + " " + rows[-7][1], None, "b")]
    assert {r["doc_id"] for r in p3.found(docs(spark, rows)).collect()} & {"rep", "once", "junkrep"} == {"rep"}


def test_fertility_equals_whole_text_encoding(spark):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=f"{p3.FOLDER}/{p3.PIECES}")
    texts = [FR[0], DE[1] + "\n\n" + DE[2], "日本語日本 abc", "x" * 500, "", None]
    got = p3.fertility(docs(spark, [(str(i), t, "fr", "a") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [sum(len(m.encode(w)) for w in (t or "").split()) for t in texts]
    assert abs(got[0]["n_tokens"] - len(m.encode(texts[0]))) <= 1
    assert [r["band"] for r in got] == ["fr", "de", "han", "latin", "none", "none"] and got[2]["byte_share"] >= 0
    byte = p3._Tokens(f"{p3.FOLDER}/{p3.BYTES}")
    byte.learn({w for t in texts for w in (t or "").split()})
    assert [r["b_tokens"] for r in got] == [sum(len(byte.known[w][0]) for w in (t or "").split()) for t in texts] and 0 < byte.measure(["日本語日本"])[1] + 1e-9
    out = {r["doc_id"]: r["rejected"] for r in p3.method(docs(spark, mixed(spark))).collect()}
    assert not any(out[f"{x}{i}"] for x in ("fr", "en") for i in range(12)) and out["empty"]


def test_scripts():
    for t, want in (("Комитет проверяет", "cyrillic"), ("Η επιτροπή ελέγχει", "greek"), ("اللجنة تفحص", "arabic"), ("위원회가", "hangul"), ("委員会", "han"), ("ひらがな", "kana"), ("Été à la caisse", "latin"), ("12 | 34 --", "none"), ("ועדה", "hebrew")):
        assert p3.script_of(t) == want


def test_fertility_is_blind_to_order(spark):
    text = prose(FR, 3) + " " + prose(FR, 3)
    words = text.split()
    mixed_up = " ".join(np.random.default_rng(1).permutation(words))
    got = p3.fertility(docs(spark, [("a", text, "fr", "a"), ("b", mixed_up, "fr", "a")])).drop("doc_id").collect()
    assert all(x == y or abs(x - y) < 1e-9 for x, y in zip(got[0][1:], got[1][1:])) and p3.repeated_words(text)[0] > p3.repeated_words(mixed_up)[0]


def wrong(text, written, read, times=1):
    for _ in range(times):
        text = p4._read(text.encode(written), read)
    return text


def test_repair_restores_unknown_swaps(spark, monkeypatch):
    rows = [(f"c{i}", prose([FR, DE, EN][i % 3], 2, i), "fr", "a") for i in range(90)]
    swaps = [("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp437", 1), ("utf-8", "mac_roman", 1), ("utf-8", "cp1252", 2), ("cp1252", "cp850", 1), ("cp1252", "cp1251", 1), ("mac_roman", "latin-1", 1)]
    bad = [(f"g{i}", wrong(prose(FR, 1, i), *s), "fr", "a", prose(FR, 1, i)) for i, s in enumerate(swaps)]
    part = ("part", prose(FR, 2, 5) + "\n\n" + wrong(prose(FR, 1, 6), "utf-8", "cp1252"), "fr", "a")
    lost = ("lost", prose(FR, 1).replace("é", "�"), "fr", "a")
    fine = [("glyph", FR[0] + "(cid:40)", "fr", "a"), ("look", FR[0].replace("a", "а").replace("o", "о"), "fr", "a"), ("shout", "ATENÇÃO – NÃO ESTÁ", "pt", "a"), ("null", None, None, None), ("blank", "  ", None, "a")]
    df = docs(spark, rows + [b[:4] for b in bad] + [part, lost, *fine])
    cipher = p4.train(df)
    got = {r["doc_id"]: r for r in p4.repair(df, cipher).collect()}
    assert {k for k, r in got.items() if r["garbled"]} == {b[0] for b in bad} | {"part", "lost"}
    assert not got["lost"]["recoverable"] and got["null"]["restored"] is None
    same = [np.mean([x == y for x, y in zip(got[b[0]]["restored"], b[4])]) if len(got[b[0]]["restored"]) == len(b[4]) else 0.0 for b in bad]
    assert np.mean([s > 0.99 for s in same]) >= 0.75, same
    for k in ("c0", "c1", "c2", "glyph", "look", "shout"):
        assert got[k]["restored"] == {r[0]: r[1] for r in rows + fine}[k]
    assert {r["doc_id"] for r in p4.found(df).collect()} == {b[0] for b in bad} | {"part", "lost"}
    monkeypatch.setattr(p4, "SENT", 0)
    monkeypatch.setattr(p4, "PART", 7)
    streamed = p4.repair(df, p4.train(df))
    assert {r["doc_id"]: r for r in streamed.collect()} == got and streamed.count() == df.count()


def test_vowels_are_counted_as_letters(spark):
    import re

    texts = [FR[0], DE[2], "ŒUVRE où Ÿ ý ñ Ç ø × ÷", "12 %", "", None]
    got = p1.with_statistics(docs(spark, [(str(i), t, "fr", "a") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        letters = re.findall(r"[^\W\d_]", t or "")
        vowels = re.findall("[aeiouyAEIOUYà-æè-ïò-öù-ýœÀ-ÆÈ-ÏÒ-ÖÙ-Ý]", t or "")
        assert r["vowel_ratio"] == (len(vowels) / len(letters) if letters else None)
