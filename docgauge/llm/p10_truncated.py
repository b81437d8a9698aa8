"""Problem 10: records whose text was cut off, and how often each source cuts.

Near-copies are found by min-hash banding over 5-word shingles (exact copies count once, by digest). A cut copy is the
head of its whole text, so signatures are those of heads: a record is looked up by its largest head among the heads of
all texts. A candidate must go on where the record ends; the pair is verified by the containment of the record in the
other text (0.8 or more) and aligned, and the record whose alignment ends early is a cut one if it stops inside a sentence.
Records without such a partner are scored by the terminality of their closing words, counted over the whole corpus:

* running text, by its closing token ("associe", "mil", "siège..."): how often the token ends a running paragraph that
  another one follows, of its occurrences, backed off to its closing mark and from there to running text at large;
* a closing line (heading, signature, item, cell): how often it is, as a sequence of words, a whole line of the corpus and
  how often a longer line starts with it, whether its last word is a torn one, and for a line nobody else has, how often
  its last two words end a line.

An end whose structure is open (a bracket, an item without text, a table row short of cells) is scored by its closing token
too; where that is one that may end a text, the structure decides as an exact check.

All counts cover all documents and shrink map-side. Null and blank texts are never cut; a null source is the source "".
Repeated rows are each reported; doc_id is the key.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.functions.rows import copied, dealt
from docgauge.functions.sieve import Held, lets, sieve, sieved, text_key
from docgauge.llm import minhash as mh
from docgauge.llm.p05_pairs import ABBREVIATIONS, UNFINISHED, open_close
from docgauge.session import cut

#: Words of a line up to which its terminality is counted; longer unfinished lines are running text.
SHORT = 12
#: Share of the lines starting like the closing line that must end like it.
TERMINAL = 0.15
#: Share of a closing token's occurrences that must end a running paragraph, and the weight of the share it backs off to.
RUNNING, BACK_OFF = 0.1, 5.0
#: Share of the last two words' occurrences at line ends, for a line that occurs once; less for an item of a list.
PAIR_TERMINAL, PAIR_ITEM = 0.2, 0.03
#: Times by which a longer word must be more frequent than the torn word that starts it.
RARER = 10
#: Words before the last one that must stand in the text that goes on, and texts holding them that meet in one task.
ANCHOR, PART = 4, 4096

#: Documents whose signatures are computed at once, and words whose hashes a task remembers.
BLOCK, MEMO = 1000, 500_000

ITEM = re.compile(r"^\s*(?:[-*+•‣◦▪–—]|\[[ xX]?\]|\(?\d{1,4}[.)]|\(?[a-zA-Z][.)])\s+")
BARE_ITEM = re.compile(r"^\s*(?:\[[ xX]?\]?|\(?\d{1,4}[.)]?|\([a-zA-Z]\)?|[a-zA-Z][.)])\s*$")
MARK = re.compile(r"(?:…|\.\.\.|\[…\]|\[\.\.\.\]|\(\.\.\.\)|\(…\)|\[[. ]+)$")
URL = re.compile(r"(?:https?://|www\.)\S+$")
OPENING = re.compile(r"[(\[{«“„‹]")
BLANK_LINE = re.compile(r"\n[ \t]+\n")
CELL = re.compile(r"\s\|\s|\t|\",\"| {3,}|(?<=[^\s;]);(?=[^\s;])")
YEAR = re.compile(r"\b(?:19|20)\d\d$")
MONEY = re.compile(r"\d,\d?$|,$")


def cells(line: str) -> tuple[str, list[str]]:
    """(notation, cells) of a table row; notation "" if the line is none."""
    if line.lstrip().startswith("|"):
        return "|", line.strip().strip("|").split("|")
    if " | " in line:
        return " | ", line.split(" | ")
    if "\t" in line:
        return "\t", line.split("\t")
    if line.lstrip().startswith('"') and '","' in line:
        return '","', line.split('","')
    if ";" in line and re.search(r"[^\s;];[^\s;]", line) and not re.search(r"; ", line):
        return ";", line.split(";")
    if "   " in line and re.search(r"\S {3,}\S", line):
        return "   ", re.split(r" {3,}", line.strip())
    return "", [line]


def word_before(text: str) -> str:
    """The word before the last character of a text."""
    at = end = len(text) - 1
    while at and (text[at - 1].isalnum() or text[at - 1] == "_"):
        at -= 1
    return text[at:end].lower()


def end_state(text: str) -> tuple[str, str | None]:
    """(state, what to ask about) of the end of one text.

    "cut" and "whole" show in the structure, "still" is whole unless a copy goes on; "cut" and "run" (running text) ask about
    the closing token, "ask" and "item" (in a list or table) about the closing line.
    """
    t = text.rstrip()
    if t.endswith("\ufffd") or MARK.search(t, max(0, len(t) - 20)):
        return "run", closing_token(t)
    # The closing paragraph, and the line before it for its context.
    body = text.rstrip("\r\n ")
    t = (body if body.endswith("\t") else t).replace("\r\n", "\n").replace("\r", "\n")
    at = t.rfind("\n\n") + 2 if "\n\n" in t else 0
    paragraph = BLANK_LINE.split(t[at:])[-1]
    inside = [x for x in paragraph.split("\n") if x.strip()]
    above = t[: len(t) - len(paragraph)].rstrip().rpartition("\n")[2]
    lines = [above, *inside] if above else inside
    last = lines[-1]
    kind, row = cells(last)
    before = [cells(x) for x in inside[-6:-1]] if kind or len(inside) > 2 and cells(inside[-2])[0] else []
    same = [c for k, c in before if k == kind]
    if kind and (len(same) >= 1 or kind == "|"):
        if kind == "|":
            if not last.rstrip().endswith("|"):
                return "cut", closing_token(t)
            widths = Counter(len(c) for c in same)
            return ("whole", None) if not widths or len(row) == widths.most_common(1)[0][0] else ("cut", closing_token(t))
        if kind == '","' and not last.rstrip().endswith('"'):
            return "cut", closing_token(t)
        if len(row) < Counter(len(c) for c in same).most_common(1)[0][0]:
            return "cut", closing_token(t)
        cell = row[-1].strip().strip('"')
        if MONEY.search(cell):
            return "cut", closing_token(t)
        return ("item", cell) if re.search(r"[^\W\d_]{2,}", cell) and cell != "n/a" else ("whole", None)
    if not kind and len(before) >= 2 and all(k for k, _ in before):
        return "cut", closing_token(t)  # the first cell of a row stands alone under rows
    stack, listed = [], False
    if OPENING.search(paragraph) or BARE_ITEM.match(last):
        for line in inside:
            m = ITEM.match(line)
            listed = listed or bool(m)
            open_close(line[m.end() :] if m else line, stack)
    if stack and not (BARE_ITEM.match(last) and len(stack) == 1):
        return "cut", closing_token(t)
    if listed and BARE_ITEM.match(last):
        return "cut", closing_token(t)
    item = ITEM.match(last)
    body = last[item.end() :] if item else last
    body = re.sub(r"^[\s>#]+", "", body)
    core = re.sub(r"[\s»”\"')\]*_]+$", "", body)
    if URL.search(body.rstrip(")>] ")):
        return "still", None
    if core[-1:] in tuple(".!?。"):
        return ("cut", closing_token(t)) if core.endswith(".") and word_before(core) in ABBREVIATIONS else ("whole", None)
    if core[-1:] == ",":
        return "run", closing_token(t)
    if core[-1:] in tuple(":'’(/") or (core[-1:] in tuple("-–—") and not item):
        return "cut", closing_token(t)
    heading = last.lstrip().startswith("#")
    short = len(body.split()) <= SHORT
    wrapped = not item and not heading and len(inside) > 1 and len(lines[-2]) >= 45 and not re.search(r"[.!?;:]\s*$", lines[-2])
    body = CELL.split(body)[-1]
    if short and not wrapped and YEAR.search(body):
        return "still", None
    beside = lines[-2] if len(lines) > 1 else ""
    if item or (short and len(beside) <= 48 and beside and not re.search(r"[.!?,]\s*$|^#", beside) and len(inside) > 1):
        return "item", body
    if heading or (short and not wrapped and not re.search(r"[.!?;]\s", body)):
        return "ask", body
    return "run", closing_token(t)


NUMBER = re.compile(r"[0-9]+(?:[.,][0-9]+)*")


def folded(text: str) -> str:
    """Text as it is counted: lower case, numbers alike, one kind of apostrophe and line end."""
    return NUMBER.sub("0", text.lower()).replace("’", "'").replace("\r\n", "\n").replace("\r", "\n")


def closing_token(text: str) -> str:
    """The last token of a text, as it is counted."""
    return (folded(text[-200:]).split() or [""])[-1]


_AFTER_WORD = re.compile(r"[^\w]*$")


def closing_mark(token: str) -> str:
    """What stands after the last letter or digit of a token."""
    return _AFTER_WORD.search(token).group()


#: What is left off at the end of a line, and the marker before its words.
CLOSING = " \t\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u2028\u2029\u202f\u3000;,.:|"
CELL_END = re.compile(r"\s\|\s|\t|\",\"| {3,}|(?<=[^\s;]);(?=[^\s;])")
MARKER = re.compile(r"[\s>#]*(?:(?:[-*+•‣◦▪–—]|\[[ x]?\]|\(?0[.)]|\(?[a-z][.)])\s+)?")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
SENTENCE = re.compile(r"[.!?;]\s")


def has_cells(line: str) -> bool:
    """False for lines that ``CELL_END`` certainly leaves whole: a test without a pattern."""
    return "|" in line or "   " in line or "\t" in line or '","' in line or line.count(";") > line.count("; ") + line.endswith(";")


def line_words(line: str) -> list[str]:
    """Words of a folded line or cell, without marker and closing punctuation."""
    if not line[:1].isalpha() or line[1:2] in (".", ")"):
        line = line[MARKER.match(line).end() :]
    return line.rstrip(CLOSING).split()


def _line_key(line: str | None) -> list[str]:
    return line_words(folded(line)) if line else []


RECORD = "doc_id long, source string, digest string, n_words int, state string, closing string, words array<string>, top array<long>, heads array<long>"


def records(documents: DataFrame) -> DataFrame:
    """One row per document: digest, words, end state, closing token or line, band keys of the largest and the other heads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                texts = [None if t is None or not t.strip() else t for t in part["text"]]
                ws = [t.lower().split() if t else [] for t in texts]
                if len(known) > MEMO:
                    known.clear()
                rows = []
                for k, src, t, w, keys in zip(part["doc_id"], part["source"], texts, ws, mh.head_bands(ws, known)):
                    if t is None:
                        rows.append((k, src, None, 0, "whole", None, None, None, None))
                    else:
                        state, closing = end_state(t)
                        line = _line_key(closing) if state in ("ask", "item") else None
                        rows.append((k, src, hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest(), len(w), state, closing, line, keys[-1] if len(keys) else None, keys[:-1].ravel() if len(keys) > 1 else None))
                yield pd.DataFrame(rows, columns=["doc_id", "source", "digest", "n_words", "state", "closing", "words", "top", "heads"])

    return documents.select("doc_id", "text", source_name(F.col("source")).alias("source")).mapInPandas(run, RECORD)


def ends_early(short: list[str], long: list[str], anchor: int = ANCHOR) -> bool:
    """True if the end of ``short`` aligns inside ``long`` and ``long`` goes on, the last word of ``short`` perhaps torn."""
    n = len(short)
    if n < anchor + 1:
        return False
    mark = short[n - 1 - anchor : n - 1]
    return any(long[i] == mark[0] and long[i : i + anchor] == mark and goes_on(short[-1], long[i + anchor], len(long) - i - anchor - 1) for i in range(len(long) - anchor))


def goes_on(last: str, there: str, left: int) -> bool:
    """True if a text that has ``there`` in the place of the word ``last``, and ``left`` words after it, goes on."""
    return left > 0 if there == last else there.startswith(last)


GRAMS = "digest string, gram long, word string, left_words int"


def _grams(texts: DataFrame, wanted=None) -> DataFrame:
    """Hashes of ``ANCHOR`` words of each text, the word after them and how many words follow it.

    ``wanted``: broadcast (sorted hashes asked for, hash -> last words of the texts that ask), of which only places that go
    on come out; None for the closing one of each text; a sieve of hashes for the places that come through it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["digest"], pdf["text"]):
                ws = mh.words(t)
                n = len(ws) - ANCHOR
                if n <= 0:
                    continue
                if len(known) > MEMO:
                    known.clear()
                h = mh.shingles(ws[-ANCHOR - 1 :] if wanted is None else ws, known, ANCHOR, False).view("int64")[:-1]
                n = len(h)
                if wanted is None or not isinstance(wanted.value, tuple):
                    at = range(n) if wanted is None else np.flatnonzero(lets(wanted.value, h)).tolist()
                    rows += [(d, int(h[i]), ws[i - n], n - 1 - i) for i in at]
                    continue
                hashes, lasts = wanted.value
                for i in _places(h, hashes):
                    gram, word = int(h[i]), ws[i - n]
                    if any(goes_on(last, word, n - 1 - i) for last in lasts[gram]):
                        rows.append((d, gram, word, n - 1 - i))
            yield pd.DataFrame(rows, columns=["digest", "gram", "word", "left_words"])

    return texts.select("digest", "text").mapInPandas(run, GRAMS)


def _places(h: np.ndarray, wanted: np.ndarray) -> list[int]:
    if not len(wanted):
        return []
    return np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h).tolist()


def near_copies(rec: DataFrame, documents: DataFrame) -> DataFrame:
    """Records that end early in a near-copy: (digest, partner, similarity), one row per distinct text, by digest.

    A record that doesn't end whole is looked up by the bands of its largest head among the heads of all texts. Of the
    texts sharing a band, those are candidates that hold the words before its last one and go on after them. Each record is
    first held against the longest text of each continuation, and where that is no near-copy, against every candidate; so
    a hot group of copies costs a row per record, and none is missed.
    """
    live = rec.where("n_words > 0").select("digest", "doc_id", "n_words", (F.col("state") != "whole").alias("asked"), "top", "heads")
    keyed = live.select("digest", "asked", F.explode("top").alias("key")).unionByName(live.select("digest", F.lit(False).alias("asked"), F.explode("heads").alias("key")))
    looked = cut(keyed.where("asked").select("key").distinct())
    # Many asked keys are sent as bits, so that no key is moved but these and a few others, which nobody asks about.
    hits = cut(keyed.join(F.broadcast(looked), "key") if looked.count() <= SENT else sieved(keyed, F.col("key"), sieve(looked, "key")))
    shared = hits.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("asked").alias("asks")).where("n > 1 and asks").select("key")
    # Exact copies share all keys and count once here, by digest.
    sharing = cut(hits.join(shared, "key").groupBy("digest").agg(F.max("asked").alias("asks")))
    sharing = F.broadcast(sharing) if sharing.count() <= SENT else sharing
    one = live.join(sharing, "digest").groupBy("digest").agg(F.min_by(F.struct("doc_id", "n_words", "asks"), "doc_id").alias("r"))
    involved = cut(one.select("digest", "r.*"))
    # A few candidates go to where the texts lie; of many their bits, and only texts that come through are moved.
    ids = involved.select("doc_id", "digest", "asks")
    by_id = F.xxhash64(F.col("doc_id").cast("long"))
    many = None if ids.count() <= SENT else sieve(ids.select(by_id.alias("key")), "key")
    lying = documents.select("doc_id", "text")
    texts = cut((sieved(lying, by_id, many).join(ids, "doc_id") if many else lying.join(F.broadcast(ids), "doc_id")).select("digest", "asks", "text"))
    ends = cut(_grams(texts.where("asks")).select(F.col("digest").alias("a"), "gram", F.col("word").alias("last")))
    if ends.count() <= SENT:
        lasts: dict[int, set[str]] = {}
        for r in ends.select("gram", "last").distinct().collect():  # at most SENT rows
            lasts.setdefault(r["gram"], set()).add(r["last"])
        inner = _grams(texts, rec.sparkSession.sparkContext.broadcast((np.array(sorted(lasts), dtype=np.int64), lasts)))
    else:
        asked = ends.select("gram").distinct()
        inner = _grams(texts, sieve(asked, "gram")).join(asked, "gram", "left_semi")
    inner = cut(inner.join(involved.select("digest", "n_words"), "digest"))
    on = F.when(F.col("word") == F.col("last"), F.col("left_words") > 0).otherwise(F.startswith(F.col("word"), F.col("last")))
    b = F.struct("n_words", "digest")
    longest = inner.groupBy("gram", "word", (F.col("left_words") > 0).cast("int").alias("left_words")).agg(F.max(b).alias("m"))
    first = cut(longest.join(ends, "gram").where(on).select("a", F.col("m.digest").alias("b")).where("a <> b").distinct())
    got = cut(_verified(first, texts))
    left = cut(ends.join(got.select(F.col("digest").alias("a")), "a", "left_anti"))
    if left.isEmpty():
        return got
    parted = dealt(inner, ["gram"], "digest", PART)  # a common closing is dealt over many tasks
    rest = parted.join(copied(left, parted, ["gram"]), ["gram", "part"]).where(on).select("a", F.col("digest").alias("b")).where("a <> b").distinct().join(first, ["a", "b"], "left_anti")
    rest = cut(rest)
    if rest.isEmpty():
        return got
    mine = sieved(live, by_id, many) if many else live
    bands = mine.select("digest", "doc_id", "top", F.concat("top", F.coalesce("heads", F.array().cast("array<long>"))).alias("bands")).join(ids.select("digest", "doc_id"), ["digest", "doc_id"]).dropDuplicates(["digest"])
    rest = rest.join(bands.select(F.col("digest").alias("a"), "top"), "a").join(bands.select(F.col("digest").alias("b"), "bands"), "b").where(F.arrays_overlap("top", "bands")).select("a", "b")
    return got.unionByName(_verified(rest, texts))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b) the records a that are contained in b and end early in it: digest, partner, similarity."""
    a = texts.select(F.col("digest").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("digest").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, known = [], {}
            for x, y, tx, ty in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"]):
                wx, wy = mh.words(tx), mh.words(ty)
                # The last word of the record may be torn.
                sim = mh.containment(mh.shingles(wx[:-1], known), mh.shingles(wy, known)) if len(wx) <= len(wy) else 0.0
                if sim >= mh.SIMILAR and ends_early(wx, wy):
                    rows.append((x, y, sim))
            yield pd.DataFrame(rows, columns=["digest", "partner", "similarity"])

    found = pairs.join(a, "a").join(b, "b").mapInPandas(run, "digest string, partner string, similarity double")
    return found.groupBy("digest").agg(F.min("partner").alias("partner"), F.max("similarity").alias("similarity"))


#: Distinct asked keys up to which they are sent to all tasks; of more, bits are sent.
SENT = 300_000

COUNTS = "kind string, a string, b string, n long, ends long"

#: Kinds of asked texts in the sieve of the counts: lines, beginnings of lines by words, words before the last one, these with
#: the beginning of the last one, tokens.
KINDS = "lsvbt"


def _asked_keys(ask: DataFrame) -> DataFrame:
    """Keys of all that ``_counts`` is asked about, by kind: (key), distinct."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = set()
            for line, prev, word, token in zip(pdf["line_text"], pdf["prev"], pdf["word"], pdf["token"]):
                if token is not None:
                    keys.add(text_key("t", token))
                    continue
                ws = line.split(" ")
                keys.update(text_key("s", " ".join(ws[:k])) for k in range(1, min(len(ws), SHORT) + 1))
                keys.update((text_key("l", line), text_key("v", prev), text_key("b", f"{prev}\n{word[:2]}")))
            yield pd.DataFrame({"key": np.fromiter(keys, np.int64, len(keys))})

    return ask.select("line_text", "prev", "word", "token").mapInPandas(run, "key long").distinct()


def _counts(mine: DataFrame, ask: DataFrame, sent: bool) -> DataFrame:
    """Counts of what ``ask`` (line_text, prev, word, token) asks about, over all texts: kind, a, b, n, ends.

    "l": lines that begin with the line a, and that are it; "p": the word b after the word a, and at a line's end; "t": the
    token a before the end of a text, and at the end of a running paragraph; "m": the same of the closing mark a of tokens.
    With ``sent`` the asked keys are in every task and only theirs are counted; else their bits are, and a few others come
    through, which no row of ``ask`` has.
    """
    if sent:
        tree: dict = {}  # a tree of asked lines, word by word; the key "" holds the line
        tokens: set[str] = set()
        prevs: dict[str, set[str]] = {}  # word before -> beginnings of the words asked about after it
        for r in ask.select("line_text", "prev", "word", "token").distinct().collect():  # at most SENT, checked by the caller
            if r["token"] is not None:
                tokens.add(r["token"])
                continue
            at = tree
            for w in r["line_text"].split(" "):
                at = at.setdefault(w, {})
            at[""] = r["line_text"]
            prevs.setdefault(r["prev"], set()).add(r["word"][:2])
        held = mine.sparkSession.sparkContext.broadcast((tree, prevs, tokens))
    else:
        held = sieve(cut(_asked_keys(ask)), "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: list[Held] = []
        if sent:
            tree, prevs, tokens = held.value
            is_prev, is_token = prevs.__contains__, tokens.__contains__
        else:
            known = [Held(held.value, k) for k in KINDS]
            lines_asked, starts, _, begins, _ = known
            is_prev, is_token = known[2].__getitem__, known[4].__getitem__

        def is_begun(a: str, b: str) -> bool:
            return b in prevs[a] if sent else begins[f"{a}\n{b}"]

        begun: Counter = Counter()
        whole: Counter = Counter()
        pair: Counter = Counter()
        seen: Counter = Counter()
        stop: Counter = Counter()

        def flush() -> pd.DataFrame:
            rows = [("l", a, None, n, whole[a]) for a, n in begun.items()]
            both: dict[tuple[str, str], list[int]] = {}
            for (a, b), n in pair.items():
                word = EDGE.sub("", b)
                if word and (is_begun(a, word[:2]) or is_begun(a, word[:1])):
                    x = both.setdefault((a, word), [0, 0])
                    x[0] += n
                    x[1] += n * b.endswith("\n")
            rows += [("p", a, b, *x) for (a, b), x in both.items()]
            marks: dict[str, list[int]] = {}
            ending: dict[str, list[int]] = {}
            for c, i in ((seen, 0), (stop, 1)):
                for t, n in c.items():
                    t = t.rstrip("\n")
                    marks.setdefault(closing_mark(t), [0, 0])[i] += n
                    if is_token(t):
                        ending.setdefault(t, [0, 0])[i] += n
            rows += [("t", a, None, *x) for a, x in ending.items()] + [("m", a, None, *x) for a, x in marks.items()]
            for c in (begun, whole, pair, seen, stop, *known):
                c.clear()
            return pd.DataFrame(rows, columns=["kind", "a", "b", "n", "ends"])

        for pdf in batches:
            for t in pdf["text"]:
                low = folded(t)
                lines = low.rstrip().split("\n")
                end = len(lines) - 1
                celled = ";" in low or "|" in low or "   " in low or "\t" in low or '"' in low
                flat: list[str] = []
                for i, x in enumerate(lines):
                    parts = CELL_END.split(x) if celled and has_cells(x) else (x,)
                    for part in parts:
                        ws = line_words(part)
                        if not ws:
                            continue
                        if not sent:
                            n, key = len(ws), ""
                            for k, w in enumerate(ws[:SHORT], 1):
                                key = f"{key} {w}" if key else w
                                if not starts[key]:
                                    break
                                if lines_asked[key]:
                                    begun[key] += 1
                                    whole[key] += k == n
                        else:
                            n, at = len(ws), tree
                            for k, w in enumerate(ws[:SHORT], 1):
                                at = at.get(w)
                                if at is None:
                                    break
                                if (line := at.get("")) is not None:
                                    begun[line] += 1
                                    whole[line] += k == n
                        ws[-1] += "\n"
                        flat.append("")
                        flat += ws
                    # A running paragraph that another one follows.
                    if i < end and x and len(parts) == 1 and (not lines[i + 1] or lines[i + 1].isspace()) and (x.count(" ") >= SHORT or SENTENCE.search(x)):
                        token = x.rsplit(None, 1)[-1]
                        stop[token] += 1
                        if flat and flat[-1] != token + "\n":  # counted here with its mark, not without
                            flat[-1] = token + "\n"
                if not flat:
                    continue
                pair.update(compress(zip(flat, flat[1:]), map(is_prev, flat)))
                flat.pop()  # the end of the text says nothing about the token
                seen.update(flat)
            if len(pair) + len(begun) + len(seen) > MEMO:
                yield flush()
            elif sum(map(len, known)) > MEMO:
                for c in known:
                    c.clear()
        yield flush()

    return cut(mine.select("text").mapInPandas(run, COUNTS).groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")))


def terminality(rec: DataFrame, documents: DataFrame) -> DataFrame:
    """Digest and verdict ``torn`` of every text whose closing token or line has to be asked about."""
    n = F.coalesce(F.size("words"), F.lit(0))
    asked = rec.where("state in ('ask', 'item', 'run', 'cut')").groupBy("digest").agg(*[F.any_value(c).alias(c) for c in ("closing", "words", "state")], (F.count(F.lit(1)) - 1).alias("copies"))
    tidy = F.regexp_replace(F.element_at("words", -1), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    token = F.col("state").isin("run", "cut")
    line = ~token & (n > 0)
    asked = cut(
        asked.where(token | (n > 0)).select(
            "digest", "state", "copies", "words", F.when(line, F.array_join("words", " ")).alias("line_text"),
            F.when(line, F.when(n > 1, F.element_at("words", -2)).otherwise(F.lit(""))).alias("prev"), F.when(line, tidy).alias("word"), F.when(~line, F.col("closing")).alias("token"),
        )
    )
    sent = asked.select("line_text", "prev", "word", "token").distinct().count() <= SENT
    got = _counts(documents.where(F.length("text") > 0), asked, sent)
    return _torn_lines(asked.where("token is null"), got).unionByName(_torn_tokens(asked.where("token is not null"), got))


def _torn_tokens(asked: DataFrame, got: DataFrame) -> DataFrame:
    """Closing tokens of running text that too rarely end a running paragraph."""
    mark = F.regexp_extract("token", r"([^\p{L}\p{N}_]*)$", 1)
    total = got.where("kind = 'm' and a = ''").agg((F.coalesce(F.sum("ends"), F.lit(0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).alias("at_large"))
    token = got.where("kind = 't'").select(F.col("a").alias("token"), "n", "ends")
    marks = got.where("kind = 'm'").select(F.col("a").alias("mark"), F.col("n").alias("n_mark"), F.col("ends").alias("ends_mark"))
    j = asked.withColumn("mark", mark).join(token, "token", "left").join(marks, "mark", "left").na.fill(0, ["n", "ends", "n_mark", "ends_mark"]).crossJoin(F.broadcast(total))  # one row on the right
    of_mark = (F.col("ends_mark") + BACK_OFF * F.col("at_large")) / (F.col("n_mark") + BACK_OFF)
    score = (F.col("ends") + BACK_OFF * of_mark) / (F.col("n") + BACK_OFF)
    return j.select("digest", (score < RUNNING).alias("torn"), score.alias("score"))


def _torn_lines(asked: DataFrame, got: DataFrame) -> DataFrame:
    """Closing lines that longer lines go on from, or that end in a torn or grammatical word, or as no line does."""
    counted = got.where("kind = 'l'").select(F.col("a").alias("line_text"), F.col("n").alias("begun"), F.col("ends").alias("whole"))
    pair = got.where("kind = 'p'").select(F.col("a").alias("prev"), F.col("b").alias("word"), "n", "ends")
    first = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), F.lit(1), i))
    longer = pair.where(F.length("word") > 1).where(F.col("word").rlike(r"\p{L}")).select("prev", "n", F.explode(first).alias("word"))
    longer = longer.join(asked.select("prev", "word").distinct(), ["prev", "word"], "left_semi").groupBy("prev", "word").agg(F.max("n").alias("longer"))
    j = asked.join(counted, "line_text", "left").join(pair, ["prev", "word"], "left").join(longer, ["prev", "word"], "left")
    # Exact copies of a text don't speak for its closing line.
    j = j.withColumns({c: F.greatest(F.col(c) - F.col("copies"), F.lit(1)) for c in ("begun", "whole", "n", "ends")})
    torn_word = F.col("word").rlike(r"\p{L}") & (F.coalesce("n", F.lit(1)) == F.coalesce("ends", F.lit(1))) & (F.coalesce("longer", F.lit(0)) >= RARER * F.coalesce("n", F.lit(1)))
    begun, whole = F.coalesce("begun", F.lit(1)), F.coalesce("whole", F.lit(1))
    item = F.col("state") == "item"
    rarely_ends = (whole < TERMINAL * begun) | (~item & (whole <= 1) & (begun > 1))
    alone = (begun <= 1) & (F.coalesce(F.col("ends") / F.col("n"), F.lit(1.0)) < F.when(item, PAIR_ITEM).otherwise(PAIR_TERMINAL))
    grammatical = (F.size("words") > 1) & F.col("word").isin(*UNFINISHED)
    return j.select("digest", (torn_word | rarely_ends | grammatical | alone).alias("torn"), (whole / begun).cast("double").alias("score"))


def source_name(c: Column) -> Column:
    """One spelling of a source: trimmed, lower case, hyphens."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "_", "-")


def verdicts(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, cut, evidence (alignment, terminality, structure; null if whole)."""
    rec = cut(records(documents))
    early = near_copies(rec, documents).select("digest", F.lit(True).alias("early"))
    asked = terminality(rec, documents).select("digest", "torn")
    told = asked.join(early, "digest", "full")
    ends = rec.select("doc_id", "source", "digest", "state")
    j = ends.where("state <> 'whole'").join(told, "digest", "left")
    torn, aligned = F.coalesce("torn", F.lit(False)), F.coalesce("early", F.lit(False))
    evidence = (
        F.when((F.col("state") != "whole") & aligned, "alignment")
        .when(F.col("state").isin("ask", "item", "run", "cut") & torn, "terminality")
        .when(F.col("state") == "cut", "structure")
    )
    whole = ends.where("state = 'whole'").withColumn("evidence", F.lit(None).cast("string"))
    got = j.select("doc_id", "source", evidence.alias("evidence")).unionByName(whole.select("doc_id", "source", "evidence"))
    return got.select("doc_id", "source", F.col("evidence").isNotNull().alias("cut"), "evidence")


def by_source(documents: DataFrame) -> DataFrame:
    """How often each source cuts: source, n_docs, n_cut, cut_share."""
    v = verdicts(documents)
    return v.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("cut").cast("long")).alias("n_cut")).withColumn("cut_share", F.col("n_cut") / F.col("n_docs"))


def found(documents: DataFrame) -> DataFrame:
    """p10_found: (doc_id) of records whose text stops inside a word, a sentence or an open bracket."""
    return verdicts(documents).where("cut").select("doc_id").distinct()
