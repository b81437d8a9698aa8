"""Problem 4: text decoded with the wrong character set, found and restored as a substitution cipher.

A unit is what one original letter became: a lead character with its continuations (UTF-8 read byte by byte, once or
twice) or a single character above ASCII that some code page can give. The hidden letter of a unit is learned per
source by expectation-maximization: an occurrence between the characters l and r has P(h | l) * P(r | h) from the
bigrams of its language over the whole corpus, times the source's mapping unit -> h. Which code pages were swapped is
unknown: the mapping starts with all letters that any swap of public code pages gives, and for a unit that none
explains, with the whole alphabet. "Keep" is one of the hypotheses, so clean accents stay. The language of a paragraph
is that of its grammatical words without letters above ASCII. One pass over the text
counts bigrams and unit contexts (sums over a fixed alphabet, independent of the number of documents); EM runs per
source on those counts; a second pass decides each unit once per document from all its occurrences and applies the
decisions with ``str.translate``. Characters already lost (U+FFFD) are reported, not guessed.

The maps of a bounded number of sources are sent to all tasks; those of more sources lie sorted among their documents, a
copy for each part of a source, so neither the number of sources nor the size of one is bounded by a task's memory.

Null and blank texts hold no units and are never garbled. Glyph codes, look-alike letters, ligatures, full-width forms
and zero-width characters are no units. A null source is the source "". Repeated rows are handled each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.lexicon import FUNCTION_WORDS, LANGS
from docgauge.llm.lookalike import CYRILLIC, GREEK, LIGATURES, TO_LATIN
from docgauge.llm.p02_language import segments
from docgauge.session import cut

# Letters and signs of the corpus languages above ASCII.
ALPHABET = "àâäáãåæçèéêëìíîïñòóôöõœùúûüýÿßÀÂÄÁÃÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÖÕŒÙÚÛÜÝ«»“”‘’‚„–—…•€£§°ºª·¿¡©®™±²³½¼µ×\xa0\u202f\u2011"
# Code pages by which bytes are read wrongly, and those by which text is written with the ones it is mistaken for.
READ = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251")
WRITTEN = {
    "utf-8": READ,
    "cp1252": ("cp437", "cp850", "mac_roman", "cp1250", "cp1251"),
    "mac_roman": ("cp1252", "latin-1"),
    "cp850": ("cp1252", "latin-1"),
    "cp437": ("cp1252", "latin-1"),
}
STAND_INS = CYRILLIC + GREEK
LOST = "�"
#: Odds (natural logarithm) by which a mapping must beat "keep" in a document, more for a letter of the alphabet; EM rounds.
ODDS, ODDS_LETTER, MEAN_LETTER, ROUNDS = 3.0, 6.0, 1.5, 8
#: Bigram smoothing.
KAPPA = 5.0


def _char(page: str, byte: int) -> str:
    try:
        return bytes([byte]).decode(page)
    except UnicodeDecodeError:
        return chr(byte)  # undefined bytes pass as control characters


def _read(data: bytes, page: str) -> str:
    return "".join(_char(page, b) for b in data)


HIGH = {p: [_char(p, b) for b in range(0x80, 0x100)] for p in READ}
_MARKS = "".join(sorted({c for cs in HIGH.values() for c in cs if not c.isascii()}))
_cls = lambda chars: "[" + "".join(map(re.escape, sorted(set(c for c in chars if not c.isascii())))) + "]"


def _unit_pattern() -> str:
    parts = []
    for p in ("cp1252", "latin-1"):  # read wrongly twice: every character of a unit became a unit
        twice = lambda bs: "(?:" + "|".join(sorted({re.escape(_read(_char(p, b).encode(), p)) for b in bs}, key=len, reverse=True)) + ")"  # noqa: B023, E731
        cont = twice(range(0x80, 0xC0))
        parts += [twice(range(0xE0, 0xF0)) + cont + cont, twice(range(0xC2, 0xE0)) + cont]
    for p in READ:
        high = lambda a, b: _cls(_char(p, x) for x in range(a, b))  # noqa: B023, E731
        cont = high(0x80, 0xC0)
        parts.append(high(0xE0, 0xF0) + cont + cont)
    for p in READ:
        high = lambda a, b: _cls(_char(p, x) for x in range(a, b))  # noqa: B023, E731
        parts.append(high(0xC2, 0xE0) + high(0x80, 0xC0))
    return "|".join(parts) + "|" + _cls(_MARKS)


UNIT = re.compile(_unit_pattern())
_RUN = re.compile(r"[^\x00-\x7f]+")
_MARK_SET = frozenset(_MARKS)


def _by_code_page() -> dict[str, set[str]]:
    """Letters that a known swap of code pages turns into each unit."""
    out: dict[str, set[str]] = {}
    for letter in ALPHABET:
        for written, reads in WRITTEN.items():
            try:
                data = letter.encode(written)
            except UnicodeEncodeError:
                continue
            for read in reads:
                once = _read(data, read)
                out.setdefault(once, set()).add(letter)
                if written == "utf-8" and read in ("cp1252", "latin-1"):
                    out.setdefault(_read(once.encode(), read), set()).add(letter)
    return {u: {x for x in ls if x != u} for u, ls in out.items() if not u.isascii()}


SWAPS = _by_code_page()
# Class of a character for the bigrams: itself if ASCII, of the alphabet or of a code page; else one class for the rest.
_CLASSES = [chr(c) for c in range(0x20, 0x7F)] + sorted(set(ALPHABET) | set(_MARKS))
N_CLASS = len(_CLASSES) + 2
#: The class of an unknown neighbour; before it stands the class of all other characters.
ANY = N_CLASS - 1
_TABLE = np.full(0x10000, N_CLASS - 2, dtype=np.int32)
for _i, _c in enumerate(_CLASSES):
    _TABLE[ord(_c)] = _i
for _c in "123456789":
    _TABLE[ord(_c)] = _TABLE[ord("0")]
for _c in "\n\r\t":
    _TABLE[ord(_c)] = _TABLE[ord(" ")]
for _a, _b in TO_LATIN.items():
    _TABLE[_a] = _TABLE[ord(_b)]  # a stand-in is read as the letter it looks like
SPACE = int(_TABLE[ord(" ")])


def _classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return _TABLE[np.minimum(points, 0xFFFF)]


def _one(c: str) -> int:
    return int(_TABLE[min(ord(c), 0xFFFF)])


def spans(text: str) -> Iterator[tuple[int, int]]:
    """Places of the units of a text, in order; clean letters that only happen to stand like a UTF-8 unit are apart."""
    for run in _RUN.finditer(text):
        a, b = run.span()
        if b - a == 1:
            if text[a] in _MARK_SET:
                yield a, b
            continue
        yield from _in_run(text, a, b)


def _in_run(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    for m in UNIT.finditer(text, start, end):
        a, b = m.span()
        if b - a > 1 and (u := m.group()) not in SWAPS and (all(c in ALPHABET for c in u) or all(c in STAND_INS for c in u)):
            yield from ((i, i + 1) for i in range(a, b))
        else:
            yield a, b


def units(text: str) -> list[tuple[str, int, int]]:
    """(unit, class before, class after) of the units of a text, in order.

    Beside another unit that is no clean letter the neighbour is unknown (class ANY).
    """
    n = len(text)
    where = list(spans(text))
    odd = [text[a:b] not in ALPHABET for a, b in where]
    out = []
    for i, (a, b) in enumerate(where):
        left = SPACE if not a else ANY if i and odd[i - 1] and where[i - 1][1] == a else _one(text[a - 1])
        right = SPACE if b == n else ANY if i + 1 < len(where) and odd[i + 1] and where[i + 1][0] == b else _one(text[b])
        out.append((text[a:b], left, right))
    return out


_WORD = re.compile(r"[a-z]+")
_VOTES: dict[str, list[int]] = {}
for _i, _lang in enumerate(LANGS):
    for _w in FUNCTION_WORDS[_lang]:
        if _w.isascii() and len(_w) > 1:
            _VOTES.setdefault(_w, []).append(_i)
#: Language tables: one of each language, and one for text without grammatical words.
N_LANG = len(LANGS) + 1


def language(text: str) -> int:
    """Number of the language with most grammatical words; a word of several languages counts in part."""
    score = [0.0] * len(LANGS)
    low = text.lower() if text.isascii() else text.lower().translate(TO_LATIN)
    for w in _WORD.findall(low):
        if (v := _VOTES.get(w)) is not None:
            for i in v:
                score[i] += 1.0 / len(v)
    best = max(score)
    return score.index(best) if best > 0 else N_LANG - 1


def _counts(docs: DataFrame, text: str, source: str) -> DataFrame:
    """Sums over all documents: bigrams (source and unit null, classes l and r) and unit contexts, by language."""
    square = N_CLASS * N_CLASS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = np.zeros(N_LANG * square, dtype=np.int64)
        occ: Counter = Counter()
        for pdf in batches:
            keys = []
            for s, t in zip(pdf["s"], pdf["t"]):
                for a, b in segments(t):
                    part = t[a:b]
                    lang = language(part)
                    c = _classes(" " + part + " ")
                    keys.append(c[:-1] * N_CLASS + c[1:] + lang * square)
                    if not part.isascii():
                        for unit, left, right in units(part):
                            occ[s, lang, unit, left, right] += 1
                if len(keys) > 2000:
                    pairs += np.bincount(np.concatenate(keys), minlength=len(pairs))
                    keys = []
            if keys:
                pairs += np.bincount(np.concatenate(keys), minlength=len(pairs))
            if len(occ) > 200_000:
                yield _occ_frame(occ)
                occ.clear()
        at = np.flatnonzero(pairs)
        none = np.full(len(at), None, dtype=object)
        yield pd.DataFrame({"source": none, "lang": at // square, "unit": none, "l": at % square // N_CLASS, "r": at % N_CLASS, "n": pairs[at]})
        yield _occ_frame(occ)

    flat = docs.where(F.length(text) > 0).select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s"), F.col(text).alias("t"))
    return flat.mapInPandas(run, "source string, lang int, unit string, l int, r int, n long").groupBy("source", "lang", "unit", "l", "r").agg(F.sum("n").alias("n"))


def _occ_frame(occ: Counter) -> pd.DataFrame:
    return pd.DataFrame([(*k, n) for k, n in occ.items()], columns=["source", "lang", "unit", "l", "r", "n"])


def bigram_log(lang: np.ndarray, l: np.ndarray, r: np.ndarray, n: np.ndarray) -> np.ndarray:  # noqa: E741
    """Smoothed log P(r | l) over the classes, for each language; a language leans on the sum of all."""
    table = np.zeros((N_LANG, N_CLASS, N_CLASS))
    np.add.at(table, (lang, l, r), n)
    every = table.sum(axis=0)
    after = every.sum(axis=0) + 0.5
    base = (every + KAPPA * (after / after.sum())[None, :]) / (every.sum(axis=1, keepdims=True) + KAPPA)
    p = np.log((table + KAPPA * base[None]) / (table.sum(axis=2, keepdims=True) + KAPPA)).astype(np.float32)
    p[:, ANY, :] = np.log(after / after.sum())[None]
    p[:, :, ANY] = 0.0
    return p


def hypotheses(unit: str, lm: np.ndarray, lang: np.ndarray, left: np.ndarray, right: np.ndarray, letters: str) -> np.ndarray:
    """Log-likelihood (occurrences x hypotheses); column 0 is "keep", the others are ``letters``."""
    own = [_one(c) for c in unit]
    keep = lm[lang, left, own[0]] + lm[lang, own[-1], right]
    for a, b in zip(own, own[1:]):
        keep = keep + lm[lang, a, b]
    to = np.array([_one(c) for c in letters], dtype=int)
    swapped = lm[lang[:, None], left[:, None], to[None, :]] + lm[lang[:, None], to[None, :], right[:, None]]
    return np.column_stack([keep, swapped])


def prior(unit: str) -> tuple[str, np.ndarray]:
    """(letters a unit may stand for, starting mapping with "keep" first).

    A clean letter, and a unit that swaps of code pages explain, have only the letters of those swaps; any other unit
    may stand for the whole alphabet. Ligatures and characters of the unseen kind are kept.
    """
    known = "".join(sorted(SWAPS.get(unit, ())))
    if known:
        keep = 0.5 if len(unit) == 1 else 0.3
        return known, np.array([keep, *[(1 - keep) / len(known)] * len(known)])
    if unit in ALPHABET or unit in LIGATURES or unit == "\xad" or unit == LOST:
        return "", np.ones(1)
    return ALPHABET, np.array([0.97, *[0.03 / len(ALPHABET)] * len(ALPHABET)])


def learn(rows: pd.DataFrame, lm: np.ndarray, rounds: int = ROUNDS) -> pd.DataFrame:
    """EM over the contexts of one source: (source, unit, h, p), h the letter or null for "keep"."""
    out = []
    for unit, part in rows.groupby("unit", sort=True):
        letters, start = prior(unit)
        if not letters:
            continue
        n = part["n"].to_numpy(dtype=float)
        ll = hypotheses(unit, lm, part["lang"].to_numpy(), part["l"].to_numpy(), part["r"].to_numpy(), letters)
        theta = start.copy()
        for _ in range(rounds):
            q = ll + np.log(theta)
            q = np.exp(q - q.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            new = (q * n[:, None]).sum(axis=0) + 4 * start
            new /= new.sum()
            moved = np.abs(new - theta).max()
            theta = new
            if moved < 1e-4:
                break
        for i in np.flatnonzero(theta > 1e-6):
            out.append((part["source"].iloc[0], unit, letters[i - 1] if i else None, float(theta[i])))
    return pd.DataFrame(out, columns=["source", "unit", "h", "p"])


#: Rows of learned maps (source, unit, letter) that are sent to all tasks, about 100 bytes each; and documents of a source
#: that meet one copy of its map beyond that.
SENT, PART = 200_000, 4096


class Cipher:
    """Learned mappings and the bigrams. ``rows`` holds those of all sources, or of one; ``table`` is a DataFrame of them
    where they are too many to be sent."""

    def __init__(self, lm: np.ndarray, rows: list[tuple], table: DataFrame | None = None):
        self.lm, self.table = lm, table
        self.maps: dict[tuple[str, str], dict[str | None, float]] = {}
        self.add(rows)

    def add(self, rows) -> None:
        for s, u, h, p in rows:
            self.maps.setdefault((s, u), {})[h] = p

    def __getstate__(self) -> dict:
        return {"lm": self.lm, "maps": self.maps, "table": None}

    def decide(self, source: str, text: str) -> tuple[dict[str, str], float, int]:
        """(unit -> letter of the garbled units, least odds among them, occurrences) for one document."""
        by: dict[str, list[tuple[int, int, int]]] = {}
        for a, b in segments(text):
            part = text[a:b]
            if part.isascii():
                continue
            lang = None
            for unit, left, right in units(part):
                if (source, unit) in self.maps:
                    lang = language(part) if lang is None else lang
                    by.setdefault(unit, []).append((lang, left, right))
        table, least, hits = {}, np.inf, 0
        for unit, where in by.items():
            known = self.maps[source, unit]
            letters = "".join(h for h in known if h)
            if not letters:
                continue
            at = np.array(where)
            ll = hypotheses(unit, self.lm, at[:, 0], at[:, 1], at[:, 2], letters)
            score = ll.sum(axis=0) + np.log([max(known.get(h, 0.0), 1e-9) for h in (None, *letters)])
            best = int(score[1:].argmax()) + 1
            odds = float(score[best] - score[0])
            if unit in ALPHABET:  # a clean letter: occurrences in a known language must speak against it, on average
                ll = ll[at[:, 0] < N_LANG - 1]
                if not len(ll):
                    continue
                sure = odds > ODDS_LETTER and float(ll[:, best].mean() - ll[:, 0].mean()) > MEAN_LETTER
            else:
                sure = odds > ODDS
            if sure:
                table[unit] = letters[best - 1]
                least = min(least, odds)
                hits += len(where)
        return table, least, hits


def train(docs: DataFrame, text: str = "markdown", source: str = "folder") -> Cipher:
    """Learn the ciphers of all sources; what comes to the driver is bounded by the alphabet and ``SENT``."""
    counts = cut(_counts(docs, text, source))
    pairs = counts.where("unit is null").select("lang", "l", "r", "n").toPandas()  # at most N_LANG * N_CLASS^2 rows
    lm = bigram_log(pairs["lang"].to_numpy(), pairs["l"].to_numpy(), pairs["r"].to_numpy(), pairs["n"].to_numpy(dtype=float))
    table = docs.sparkSession.sparkContext.broadcast(lm)  # N_LANG * N_CLASS^2 floats
    fitted = counts.where("unit is not null").groupBy("source").applyInPandas(lambda rows: learn(rows, table.value), "source string, unit string, h string, p double")
    fitted = cut(fitted)
    if fitted.count() > SENT:
        return Cipher(lm, [], fitted)
    return Cipher(lm, [tuple(r) for r in fitted.collect()])  # at most SENT rows


def apply(text: str, table: dict[str, str]) -> str:
    """Replace units: each becomes one private character, then one translate() call."""
    if not table:
        return text
    private = {u: chr(0xF0000 + i) for i, u in enumerate(sorted(table))}
    out, at = [], 0
    for a, b in spans(text):
        out += text[at:a], private.get(text[a:b], text[a:b])
        at = b
    return ("".join(out) + text[at:]).translate({ord(private[u]): letter for u, letter in table.items()})


REPAIR_SCHEMA = "doc_id string, garbled boolean, n_garbled int, n_lost int, recoverable boolean, log_odds double, restored string"


def repair(docs: DataFrame, cipher: Cipher, key: str = "doc_id", text: str = "markdown", source: str = "folder") -> DataFrame:
    """One row per row of ``docs``: whether and how much is garbled, and the text with what could be restored."""
    held = docs.sparkSession.sparkContext.broadcast(cipher)
    columns = [c.split()[0] for c in REPAIR_SCHEMA.split(", ")]

    def mended(c: Cipher, k: str, s: str, t: str | None) -> tuple:
        if t is None or t.isascii():
            return k, False, 0, 0, True, 0.0, t
        table, odds, hits = c.decide(s, t)
        lost = t.count(LOST)
        return k, bool(table) or lost > 0, hits, lost, lost == 0, odds if table else 0.0, apply(t, table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([mended(held.value, *r) for r in zip(pdf["k"], pdf["s"], pdf["t"])], columns=columns)

    flat = docs.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s"), F.col(text).alias("t"))
    if cipher.table is None:
        return flat.mapInPandas(run, REPAIR_SCHEMA)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, now = None, None  # the maps of one source at a time: its map rows come before its documents
        for pdf in batches:
            rows = []
            for s, unit, h, p, k, t in zip(*(pdf[x] for x in ("s", "unit", "h", "p", "k", "t"))):
                if s != now:
                    c, now = Cipher(held.value.lm, []), s
                if unit is not None:
                    c.add([(s, unit, h, p)])
                else:
                    rows.append(mended(c, k, s, t))
            yield pd.DataFrame(rows, columns=columns)

    # A large source has several parts, each with a copy of its map; without units of its own it has one without any.
    parts = flat.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART)).alias("parts"))
    none = F.lit(None)
    mine = flat.join(parts, "s").select("s", F.pmod(F.xxhash64("k"), F.col("parts")).alias("part"), F.lit(1).alias("what"), none.cast("string").alias("unit"), none.cast("string").alias("h"), none.cast("double").alias("p"), "k", "t")
    maps = cipher.table.withColumnRenamed("source", "s").join(parts, "s").select("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("what"), "unit", "h", "p", none.cast("string").alias("k"), none.cast("string").alias("t"))
    return maps.unionByName(mine).repartition("s", "part").sortWithinPartitions("s", "part", "what").mapInPandas(stream, REPAIR_SCHEMA)


def found(docs: DataFrame) -> DataFrame:
    """p4_found: (doc_id) of documents with wrongly decoded characters, recoverable or not."""
    cipher = train(docs)
    return repair(docs, cipher).where("garbled").select("doc_id").distinct()
