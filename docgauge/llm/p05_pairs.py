"""Problem 5: defective question and answer pairs, each with its type.

Every answer goes through a pushdown parser (fences, brackets, quotations, emphasis, list items) whose end state tells
truncation, greedy string tiling against its question (copies), a refusal grammar of six languages, and a check of script
and language. The languages of question and answer are those of their nearest clustered centroids, as in problem 2; the
centroids are fitted on a bounded sample of the table's own texts (``SAMPLE`` pairs), labelled by grammatical words. An answer of one unfinished phrase is ambiguous ("Le comité du siège" is
whole, "Le comité du siège annule la" is not): it is held against two lexicons counted over the whole table by joins,
the words that occur inside answers and questions and the verbs that follow an interrogative pronoun.

Order of types: empty, refusal, copy, language, truncated. A null question is compared with nothing. Pairs delivered
twice count once. A null id keeps its row with id null.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm import p02_language as p2
from docgauge.llm.lexicon import FUNCTION_WORDS, LANGS
from docgauge.session import cut

#: Pairs of smallest hash whose texts may train the language centroids, and texts of a language among them.
SAMPLE, PER_LANGUAGE = 12_000, 400
#: Centroids of a language.
CLUSTERS = 2
#: Words and confidence from which a language counts.
LEAST_WORDS, SURE = 5, 0.8
#: Shares of an answer and of its question that tiles must cover for a copy.
COPY_ANSWER, COPY_QUESTION = 0.9, 0.6

# Stand-ins for a missing value.
STAND_INS = {"", "n/a", "na", "n.a.", "-", "--", "---", "–", "—", "null", "none", "nan", "nil", "[]", "{}", "()", "?", "??", "???", "…", "...", "..", ".", "_", "/", "x", "xx", "xxx", "tbd", "todo", "à compléter", "a completer", "vide", "néant", "undefined", "#n/a", "<na>", "''", '""'}
# Fixed value: the marker of an answer that the document doesn't cover.
NOT_COVERED = "non couvert par le document"
# Abbreviations that end in a full stop inside a sentence.
ABBREVIATIONS = {"art", "réf", "ref", "abs", "no", "nr", "núm", "num", "n", "cf", "p", "chap", "ex", "mme", "dr", "bzw", "vgl", "ca", "z", "pag", "pág"}

# Refusal grammar by language: words of which each refusal holds one, for a cheap test before the patterns of the speaker's
# inability, lack, regret or unwillingness to answer.
REFUSALS = [
    (
        frozenset("je m mes tant permettant désolé désolée navré navrée malheureusement hélas aucune".split()),
        r"""
        \bje\s+(?:suis\s+(?:vraiment\s+)?(?:désolée?|navrée?)|regrette|m'excuse|refuse|décline|préfère\s+ne\s+pas|ne\s+(?:peux|puis|saurais|suis\s+pas\s+(?:en\s+mesure|capable|autorisé\w*|habilité\w*)|dispose|sais|souhaite|possède|connais|trouve|vois)|n'ai\s+(?:pas|aucun\w*)|n'arrive)
        |\b(?:il\s+)?m'est\s+(?:impossible|interdit)|\bmes\s+(?:capacités|compétences|attributions)|\ben\s+tant\s+qu'(?:assistant\w*|ia\b|intelligence|modèle)|\bme\s+permettant\s+de\s+vous\s+aider
        |^(?:désolée?|navrée?|malheureusement|hélas)\b.*\b(?:je|j'|n'ai|moi)\b
        |^aucune\s+réponse\s+ne\s+(?:sera|peut\s+être|saurait\s+être)\s+(?:donnée|apportée|fournie)
        """,
    ),
    (
        frozenset("i as my me sorry no".split()),
        r"""
        \bi\s*(?:'m|\s+am|\s+was)\s+(?:so\s+|very\s+|really\s+|afraid\b|sorry|unable|not\s+(?:able|allowed|in\s+a\s+position|permitted))
        |\bi\s+(?:can(?:no|')t|can\s+not|could\s+not|won't|will\s+not|must\s+decline|decline|refuse|have\s+(?:no|to\s+decline)|do\s+not\s+(?:have|know)|don't\s+(?:have|know)|would\s+(?:rather|prefer)\s+not|regret)
        |\bas\s+an?\s+(?:ai|assistant|language\s+model)\b|\b(?:beyond|outside)\s+(?:the\s+scope\s+of\s+)?my\b|\b(?:nothing|anything)\b.{0,30}\blets?\s+me\b|^sorry\b.*\b(?:i|my)\b
        |^no\s+answer\s+(?:will|can|may|is\s+to)\s+be\s+(?:given|provided|supplied)
        """,
    ),
    (
        frozenset("ich mir als meine meiner meinen hier dazu darauf stelle eine es".split()),
        r"""
        \b(?:ich|mir)\b.{0,40}\b(?:nicht|kein\w*)\b|\b(?:kann|darf|habe|möchte|weiß)\s+ich\b.{0,60}\b(?:nicht|kein\w*)\b|\bes\s+tut\s+mir\s+leid|\bals\s+(?:assistent\w*|ki)\b|\bich\s+(?:lehne|verweigere|bedau\w+)|\bmeine[rn]?\s+(?:möglichkeiten|fähigkeiten|befugnisse)
        |^(?:hier|dazu|darauf|an\s+dieser\s+stelle)\s+(?:wird|kann)\s+keine\s+(?:antwort|auskunft)\b|^eine\s+antwort\s+(?:wird|kann)\b.{0,30}\bnicht\b|^es\s+wird\b.{0,20}\bkeine\s+antwort\b
        """,
    ),
    (
        frozenset("lo no me niego prefiero rechazo como mis ninguna aquí".split()),
        r"""
        \blo\s+(?:siento|lamento)\b|\bno\s+(?:puedo|tengo|dispongo|sé|sabría|estoy|quisiera|me\s+es)\b|\bme\s+(?:niego|es\s+imposible|resulta\s+imposible)|\bprefiero\s+no\b|\brechazo\s+(?:esta|tratar)|\bcomo\s+asistente\b|\bmis\s+(?:capacidades|competencias)
        |^(?:aquí\s+)?no\s+se\s+(?:dará|facilitará|ofrecerá|puede\s+dar)\b.{0,20}\brespuesta
        |^ninguna\s+respuesta\b
        """,
    ),
    (
        frozenset("mi non preferisco quanto come mie mio qui nessuna".split()),
        r"""
        \bmi\s+(?:dispiace|spiace|rifiuto|è\s+impossibile|risulta\s+impossibile)|\bnon\s+(?:posso|ho|dispongo|so|saprei|sono\s+(?:in\s+grado|autorizzat\w))\b|\bpreferisco\s+non\b|\bin\s+quanto\s+assistente|\bcome\s+assistente\b|\b(?:mie|mio)\s+(?:capacità|competenze)
        |^(?:qui\s+)?non\s+(?:verrà|sarà|viene|può\s+essere)\s+(?:data|fornita)\b.{0,20}\brisposta
        |^nessuna\s+risposta\s+(?:verrà|sarà|può)
        """,
    ),
    (
        frozenset("lamento não prefiro recuso desculpe é enquanto minhas aqui nenhuma".split()),
        r"""
        ^(?:aqui\s+)?não\s+(?:será|pode\s+ser)\s+dada\b.{0,20}\bresposta|^nenhuma\s+resposta\s+(?:será|pode)
        |\blamento\b|\bnão\s+(?:posso|tenho|disponho|sei|saberia|consigo|estou)\b|\bprefiro\s+não\b|\b(?:recuso|desculpe)\b|\bé-me\s+impossível|\benquanto\s+assistente|\bas\s+minhas\s+(?:capacidades|competências)
        """,
    ),
]
_REFUSALS = [(words, re.compile(pattern, re.X | re.S)) for words, pattern in REFUSALS]


def refuses(low: str, tokens: list[str]) -> bool:
    """True if a lower-case answer with single spaces refuses to answer."""
    held = set(tokens)
    return any(not words.isdisjoint(held) and pattern.search(low) for words, pattern in _REFUSALS)


_TOKEN = re.compile(r"\w+")
_LETTERS = re.compile(r"[^\W\d_]+")
# What closes each bracket or quotation mark.
CLOSERS = {")": "(", "]": "[", "}": "{", "»": "«", "›": "‹", "”": "“„", "“": "„"}
OPENERS = set("([{«“„‹")
ITEM = re.compile(r"^\s*(?:\(?\d{1,3}[.)]|[-*•–]|\(?[a-z][.)])(?=\s|$)")


_PAIRED = re.compile("[" + re.escape("".join([*CLOSERS, *OPENERS])) + "]")


def open_close(text: str, stack: list[str]) -> None:
    """Push and pop the brackets and quotation marks of a text; a closer drops what was left open inside."""
    for c in _PAIRED.findall(text):
        if c in CLOSERS and any(o in stack for o in CLOSERS[c]):
            while stack.pop() not in CLOSERS[c]:
                pass
        elif c in OPENERS:
            stack.append(c)


class Parsed:
    """End state of the pushdown parser: open constructs, sentences and items finished, and the open phrase."""

    def __init__(self, text: str):
        self.stack: list[str] = []
        t = text.rstrip()
        fence = False
        for line in t.split("\n"):
            if line.lstrip().startswith("```"):
                fence = not fence
                continue
            if fence:
                continue
            body = line[m.end() :] if (m := ITEM.match(line)) else line  # the marker's bracket opens nothing
            open_close(body, self.stack)
            if line.count("**") % 2:
                self.stack.append("**")
        if fence:
            self.stack.append("```")
        lines = [x for x in t.split("\n") if x.strip()]
        last = lines[-1] if lines else ""
        marker = ITEM.match(last)
        self.items = sum(bool(ITEM.match(x)) for x in lines)
        self.bare_item = bool(marker) and not last[marker.end() :].strip() and len(lines) > 1
        self.cut_mark = bool(re.search(r"(?:…|\.\.\.|\[…\]|\[\.\.\.\]|\(\.\.\.\))$", t))
        core = re.sub(r"[\s»”\"')\]*_]+$", "", t)
        tail = re.search(r"(\w+)\.$", core)
        self.ended = core[-1:] in tuple(".!?。") and not (tail and tail.group(1).lower() in ABBREVIATIONS)
        self.abbreviation = bool(tail) and tail.group(1).lower() in ABBREVIATIONS
        self.comma = core[-1:] in tuple(",;:-–—/'’")
        body = last[marker.end() :] if marker else last
        self.phrase = re.split(r"(?<=[.!?])\s+", body.strip())[-1] if body.strip() else ""
        self.alone = len(lines) == 1 and self.phrase == body.strip()

    def truncated(self) -> bool:
        """True where the end state alone shows a cut."""
        return bool(self.stack) or self.cut_mark or self.bare_item or self.abbreviation or self.comma or (not self.ended and not self.alone)


def normal(text: str | None) -> list[str]:
    return _TOKEN.findall(unicodedata.normalize("NFKC", text or "").lower())


def tiled(answer: list[str], question: list[str], least: int = 3) -> tuple[float, float]:
    """(share of the answer, share of the question) covered by greedy string tiling with tiles of ``least`` words or more.

    Texts without a common run of ``least`` words have none.

    The longest common run is tiled first. The question's words become free again when a round finds no more tile, so
    that a question given back twice is covered as well.
    """
    if not answer or not question:
        return 0.0, 0.0
    run = min(least, len(question))
    runs = lambda ws: set(zip(*(ws[i:] for i in range(run))))
    if runs(answer).isdisjoint(runs(question)):
        return 0.0, 0.0
    done_a = [False] * len(answer)
    ever_q = [False] * len(question)
    while True:
        done_q = [False] * len(question)
        progress = False
        while True:
            best, at = 0, None
            row = [0] * (len(question) + 1)
            for i in range(len(answer) - 1, -1, -1):
                new = [0] * (len(question) + 1)
                if not done_a[i]:
                    for j in range(len(question) - 1, -1, -1):
                        if not done_q[j] and answer[i] == question[j]:
                            new[j] = row[j + 1] + 1
                            if new[j] > best:
                                best, at = new[j], (i, j)
                row = new
            if best < min(least, len(question)):
                break
            for k in range(best):
                done_a[at[0] + k] = done_q[at[1] + k] = ever_q[at[1] + k] = True
            progress = True
        if not progress or all(done_a):
            break
    return sum(done_a) / len(answer), sum(ever_q) / len(question)


_BY_WORD: dict[str, list[str]] = {}
for _lang in LANGS:
    for _w in FUNCTION_WORDS[_lang]:
        _BY_WORD.setdefault(_w, []).append(_lang)
# Letters that one of the languages alone uses.
_OWN_LETTERS = {"ñ": "es", "¿": "es", "¡": "es", "ß": "de", "ä": "de", "ö": "de", "ü": "de", "ã": "pt", "õ": "pt", "œ": "fr", "ê": "fr", "ù": "fr", "ì": "it"}


def seed_language(text: str) -> tuple[str | None, float]:
    """(language or None, margin) by grammatical words and the letters that one language alone uses: a noisy label."""
    low = text.lower()
    score = dict.fromkeys(LANGS, 0.0)
    for w in _LETTERS.findall(low):
        own = _BY_WORD.get(w, ())
        for lang in own:
            score[lang] += 1.0 / len(own)
    for c, lang in _OWN_LETTERS.items():
        if c in low:
            score[lang] += 0.7
    rank = sorted(score.items(), key=lambda x: -x[1])
    return (rank[0][0] if rank[0][1] > 0 else None), rank[0][1] - rank[1][1]


_OTHER = re.compile("[^\x00-\u024f\u1e00-\u1eff]")


def script(text: str) -> str:
    """Script of most letters: latin, other, or none."""
    if text and max(text) < "\u0250" and any(map(str.isalpha, text)):
        return "latin"
    letters = "".join(_LETTERS.findall(text))
    return "none" if not letters else "latin" if letters.isascii() or len(_OTHER.findall(letters)) * 2 <= len(letters) else "other"


def train(golden: DataFrame) -> p2.Centroids:
    """Language centroids of a bounded sample of the questions and answers; a language with no clear text has none."""
    pairs = golden.select("question", "reponse", F.xxhash64("id", "question", "reponse").alias("h"))
    # Answers as long as a book train no better: texts over 4,000 characters are left out of the sample.
    rows = pairs.where("coalesce(length(question), 0) < 4000 and coalesce(length(reponse), 0) < 4000").orderBy("h").limit(SAMPLE).select("question", "reponse").toPandas()
    held: dict[str, list[str]] = {c: [] for c in LANGS}
    for t in sorted({t for c in rows for t in rows[c] if t}):
        lang, margin = seed_language(t)
        if lang and margin >= 2 and len(held[lang]) < PER_LANGUAGE:
            held[lang].append(plain(normal(t)))
    return p2.fit([t for ts in held.values() for t in ts], [c for c, ts in held.items() for _ in ts], CLUSTERS)


def plain(words: list[str]) -> str:
    """Words without digits, with single spaces, as the centroids read them."""
    return " " + " ".join(w for w in words if w.isalpha()) + " "


def first_pass(question: str | None, answer: str | None, covered: str | None) -> tuple[str | None, bool | None, str]:
    """(defect or None, whether languages must be compared; None if the pair is sound, words of the answer and question as
    two lines) before language and truncation."""
    text = unicodedata.normalize("NFKC", answer or "").replace("\u200b", "").replace("\ufeff", "").strip()
    if text.lower() in STAND_INS or not any(c.isalnum() for c in text):
        return "empty", False, ""
    low = " ".join(text.lower().replace("’", "'").split())
    if low.rstrip(".") == NOT_COVERED:
        return (None if (covered or "").strip().lower() != "oui" else "refusal"), None, ""
    a = normal(text)
    if refuses(low, a):
        return "refusal", False, ""
    q = normal(question)
    body = a[1:] if a and a[0] in ("q", "question", "pregunta", "domanda", "pergunta", "frage") else a
    known = set(q)
    # Tiles hold words of the question only: an answer with fewer of them is no copy.
    if body and len(body) - len(set(body) - known) >= COPY_ANSWER * len(body) - 1e-9:
        in_a, in_q = tiled(body, q)
        if in_a >= COPY_ANSWER and in_q >= COPY_QUESTION:
            return "copy", False, ""
    return None, bool(question) and len(a) >= LEAST_WORDS, f"{plain(q)}\n{plain(a)}"


def last_pass(answer: str) -> tuple[str | None, str | None]:
    """("truncated" or None, ambiguous phrase or None) of an answer by the pushdown parser."""
    p = Parsed(unicodedata.normalize("NFKC", answer).replace("\u200b", "").replace("\ufeff", "").strip())
    if p.truncated():
        return "truncated", None
    return None, (p.phrase if not p.ended else None)


def judged(questions: list[str | None], answers: list[str | None], covered: list[str | None], model: p2.Centroids) -> list[tuple[str | None, str | None]]:
    """(defect or None, ambiguous phrase or None) of each pair of a batch."""
    got = [first_pass(q, a, c) for q, a, c in zip(questions, answers, covered)]
    out: list[tuple[str | None, str | None]] = [(d, None) for d, *_ in got]
    asked = [i for i, (d, compare, _) in enumerate(got) if compare]
    folded = [t for i in asked for t in got[i][2].split("\n")]
    langs, sure = model.classify(folded)
    for k, i in enumerate(asked):
        (ql, al), (qs, sa) = langs[2 * k : 2 * k + 2], sure[2 * k : 2 * k + 2]
        scripts = {script(questions[i]), script(answers[i])}
        if scripts == {"latin", "other"} or (ql != al and "und" not in (ql, al) and min(qs, sa) >= SURE):
            out[i] = ("language", None)
    for i, (d, compare, _) in enumerate(got):
        if d is None and compare is not None and out[i][0] is None:
            out[i] = last_pass(answers[i])
    return out


INTERROGATIVES = ("qui", "who", "wer", "chi", "quién", "quem")
#: Times by which a longer word must be more frequent than the torn word that starts it.
RARER = 10
#: Words of a phrase that end none: grammatical words of the languages.
UNFINISHED = sorted({w for ws in FUNCTION_WORDS.values() for w in ws if len(w) > 1 or w in "aoyeè"} - {"no", "si"})


def defects(golden: DataFrame) -> DataFrame:
    """One row per distinct pair: id, question, reponse, couvert, defect (null if sound)."""
    pairs = golden.select("id", "question", "reponse", "couvert").distinct()

    held = golden.sparkSession.sparkContext.broadcast(train(golden))  # languages x clusters x hashed trigrams

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = judged(pdf["question"].tolist(), pdf["reponse"].tolist(), pdf["couvert"].tolist(), held.value)
            yield pdf.assign(defect=pd.Series([g[0] for g in got], dtype=object, index=pdf.index), phrase=pd.Series([g[1] for g in got], dtype=object, index=pdf.index))

    first = pairs.mapInPandas(run, "id string, question string, reponse string, couvert string, defect string, phrase string")
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    first = first.withColumn("w", words(F.col("phrase")))
    # Lexicons over the whole table: words that stand before another word, with the prefixes of those, and the verbs
    # after an interrogative pronoun.
    texts = pairs.select(F.explode(F.array("question", "reponse")).alias("t")).where("t is not null").select(words(F.col("t")).alias("ws"))
    inner = texts.select(F.explode(F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    inner = cut(inner)
    starts = inner.where(F.length("word") > 1).select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), F.lit(1), i))).alias("word")).groupBy("word").agg(F.max("n").alias("longer"))
    verbs = pairs.select(words(F.col("question")).alias("ws")).where(F.size("ws") > 2).where(F.col("ws")[0].isin(*INTERROGATIVES)).select(F.col("ws")[1].alias("word")).groupBy("word").count().where("count > 1").select("word")
    key = F.struct("id", "question", "reponse", "couvert")
    first = cut(first.withColumn("k", F.xxhash64(F.to_json(key))))
    open_phrases = first.where(F.size("w") > 1).select("k", "w")
    last = open_phrases.select("k", F.element_at("w", -1).alias("word")).where(~F.col("word").rlike(r"^\d+$"))
    own = last.groupBy("word").agg(F.count(F.lit(1)).alias("own"))
    # A torn word: never inside a text, and the start of a word far more frequent than itself.
    torn = own.join(inner, "word", "left_anti").join(starts, "word").where(F.col("longer") >= RARER * F.col("own")).select("word")
    unknown = last.join(torn, "word", "left_semi").select("k")
    grammatical = last.where(F.col("word").isin(*UNFINISHED)).select("k")
    # A verb that no grammatical word precedes, unlike the nouns in "the records clerk" and "in charge of archives".
    after = F.filter(F.transform(F.sequence(F.lit(2), F.size("w")), lambda i: F.when(~F.element_at("w", i - 1).isin(*UNFINISHED), F.element_at("w", i))), lambda x: x.isNotNull())
    with_verb = open_phrases.select("k", F.explode(after).alias("word")).join(verbs, "word", "left_semi").select("k")
    open_ended = unknown.union(grammatical).union(with_verb).distinct().withColumn("cut", F.lit(True))
    out = first.join(open_ended, "k", "left")
    late = F.when(F.col("defect").isNull() & F.col("cut"), "truncated")
    return out.select("id", "question", "reponse", "couvert", F.coalesce("defect", late).alias("defect"))


def found(golden: DataFrame) -> DataFrame:
    """p5_found: (id, defect) of the defective pairs."""
    return defects(golden).where("defect is not null").select("id", "defect").distinct()
