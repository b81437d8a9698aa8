"""Problem 3: repetition inside one document, and tokenizer fertility.

Fertility is the method named for the problem: two public vocabularies, pieces with byte fallback and a byte-level one for
many languages, give characters per token, the share of byte-fallback tokens and the entropy of the tokens; documents that
both vocabularies find outside the bands of their language or script are rejected. The bands come from all documents.

These numbers come from counts of tokens, and counts don't know the order of words: shuffling the words of a document
leaves all of them as they are, while its runs of eight words are gone. A third of repeated words moves the entropy by
less than documents of one length differ. So fertility inherently can't give the rows of p3_found; ``repeated_share``
counts the runs themselves, and the types of problem 1 take out the documents that are no language. ``method`` runs the
named method over the whole table.

Null and blank texts have no words, share 0 and no tokens. Repeated rows are measured each; extra columns are not read.
"""

from __future__ import annotations

import base64
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.lexicon import LANGS
from docgauge.llm.p04_mojibake import language
from docgauge.session import cut

#: Words of a run.
RUN = 8
#: Share of repeated words from which a document is named.
HEAVY = 1 / 3
#: Folder of the vocabularies, a parameter of the operator, and the two files: pieces, and byte-level tokens as ranks.
FOLDER = os.environ.get("DOCGAUGE_TOKENIZERS", "/opt/tokenizers")
PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
#: Words kept in the worker's tables of token numbers.
MEMO = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_PIECE = re.compile(r"\S+")


def repeated_words(text: str | None, run: int = RUN) -> tuple[int, int]:
    """(words standing in a run of ``run`` or more words that occurred earlier, words) of one text."""
    words = _WORD.findall(text.lower()) if text else []
    n = len(words)
    if n <= run:
        return 0, n
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64) + np.uint64(1)
    key = np.zeros(n - run + 1, dtype=np.uint64)
    for k in range(run):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - run + 1 + k]
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), dtype=bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]  # stable: the first of equal runs stays False
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + run, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum()), n


def repeated_share(docs: DataFrame, key: str = "doc_id", text: str = "markdown") -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_repeated, repeated_share (0 without words)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [repeated_words(t) for t in pdf["t"]]
            rep, n = [g[0] for g in got], [g[1] for g in got]
            yield pd.DataFrame({"doc_id": pdf["k"], "n_words": n, "n_repeated": rep, "repeated_share": [r / m if m else 0.0 for r, m in got]})

    flat = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return flat.mapInPandas(run, "doc_id string, n_words int, n_repeated int, repeated_share double")


class _Tokens:
    """Token numbers of a word in one vocabulary, remembered up to a bounded number of words."""

    def __init__(self, path: str):
        self.known: dict[str, tuple[tuple[int, ...], int]] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.fallback = {i for i in range(model.get_piece_size()) if model.is_byte(i)}
            self.encode = lambda words: model.encode(words, num_threads=1)
        else:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            # Words are given one by one, so the pattern need not split them.
            model = tiktoken.Encoding("ranks", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
            self.fallback = {i for t, i in ranks.items() if _partial(t)}
            self.encode = lambda words: [model.encode_ordinary(w) for w in words]

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > MEMO:
            self.known.clear()
            new = list(words)
        for w, ids in zip(new, self.encode(new)):
            self.known[w] = (tuple(ids), sum(i in self.fallback for i in ids))

    def measure(self, words: list[str]) -> tuple[int, float | None, float | None]:
        """(tokens, share of byte-fallback tokens, entropy in bits a token) of the words of a text."""
        n = fall = 0
        flat: list[int] = []
        for w in words:
            ids, f = self.known[w]
            flat += ids
            fall += f
        n = len(flat)
        if not n:
            return 0, None, None
        c = np.array(list(Counter(flat).values())) / n
        return n, fall / n, float(-(c * np.log2(c)).sum())


def _partial(token: bytes) -> bool:
    """True for tokens that are a part of a character only."""
    try:
        token.decode()
        return False
    except UnicodeDecodeError:
        return True


# First and last character of scripts by Unicode block; Latin ones come before.
SCRIPTS = [
    ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
_EDGES = np.array([x for _, a, b in SCRIPTS for x in (a, b + 1)])


def script_of(text: str) -> str:
    """Main script of a text by its letters; none where fewer than a quarter of its characters are letters."""
    words = _WORD.findall(text)
    letters = sum(map(len, words))
    if letters * 4 < len(text):
        return "none"
    if text.isascii():
        return "latin"
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if (points < 0x250).sum() * 2 >= letters:
        return "latin"
    at = np.searchsorted(_EDGES, points, side="right")
    per = np.bincount(at[at % 2 == 1] // 2, minlength=len(SCRIPTS))
    return SCRIPTS[int(per.argmax())][0] if per.any() else "other"


FERTILITY = "doc_id string, band string, n_tokens int, chars_per_token double, byte_share double, token_entropy double, b_tokens int, b_chars_per_token double, b_byte_share double, b_entropy double"


def fertility(docs: DataFrame, key: str = "doc_id", text: str = "markdown", folder: str = FOLDER) -> DataFrame:
    """One row per row of ``docs``: its band (language of a Latin text, else script) and, in the vocabulary of pieces and (b_)
    the byte-level one, tokens, characters per token, byte-fallback share and entropy (bits a token).

    Pieces never cross white space, so a text's tokens are those of its words; each distinct word of a batch is
    encoded once and the counts added up. A text without tokens has nulls.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = [_Tokens(f"{folder}/{v}") for v in (PIECES, BYTES)]
        for pdf in batches:
            rows = []
            split = [_PIECE.findall(t) if t else [] for t in pdf["t"]]
            distinct = {w for ws in split for w in ws}
            for t in tokens:
                t.learn(distinct)
            for k, t, ws in zip(pdf["k"], pdf["t"], split):
                if not ws:
                    rows.append((k, "none", 0, None, None, None, 0, None, None, None))
                    continue
                chars = sum(map(len, ws))
                script = script_of(t)
                if script == "latin" and (i := language(t)) < len(LANGS):
                    script = LANGS[i]
                (n, fall, h), (m, part, g) = (x.measure(ws) for x in tokens)
                rows.append((k, script, n, chars / n, fall, h, m, chars / m, part, g))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FERTILITY.split(", ")]).astype({"n_tokens": "int32", "b_tokens": "int32"})

    flat = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return flat.mapInPandas(run, FERTILITY)


def method(docs: DataFrame, width: float = 4.0, folder: str = FOLDER) -> DataFrame:
    """p3_method: fertility of every document, ``rejected`` and ``low_entropy`` by the bands of its language or script.

    A band is median +- ``width`` robust deviations over all documents of the language or script. The entropy is held
    against the documents of the same band and about the same number of tokens (a power of two), because it grows with the
    length. A document is outside where both vocabularies say so; one without letters has no band and is rejected.
    """
    kinds = {"": ("n_tokens", "chars_per_token", "byte_share", "token_entropy"), "b_": ("b_tokens", "b_chars_per_token", "b_byte_share", "b_entropy")}
    f = cut(fertility(docs.select("doc_id", "markdown"), folder=folder).withColumn("size", F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int")))
    q = lambda c: F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000).alias(f"q_{c}")
    mid = f.groupBy("band").agg(*[q(c) for _, a, b, _ in kinds.values() for c in (a, b)])
    long = f.groupBy("band", "size").agg(*[q(h) for *_, h in kinds.values()])
    j = f.join(F.broadcast(mid), "band").join(F.broadcast(long), ["band", "size"])  # bands: languages and scripts, times 31 sizes

    def away(c: str, least: float):
        band = F.col(f"q_{c}")
        return (F.col(c) - band[1]) / F.greatest((band[2] - band[0]) / F.lit(1.35), F.lit(least))

    strange = F.lit(True)
    poor = F.lit(True)
    for _, chars, share, entropy in kinds.values():
        strange = strange & ((F.abs(away(chars, 0.12)) > width) | (F.abs(away(share, 0.01)) > width))
        poor = poor & (away(entropy, 0.1) < -width / 2)
    odd = strange | (F.col("band") == "none")
    return j.select("doc_id", "band", *[c for k in kinds.values() for c in k], F.coalesce(odd, F.lit(False)).alias("rejected"), F.coalesce(poor, F.lit(False)).alias("low_entropy"))


def found(docs: DataFrame) -> DataFrame:
    """p3_found: (doc_id) of documents with at least a third of their words repeated, junk aside."""
    from docgauge.llm.p01_text_type import text_types

    share = repeated_share(docs.select("doc_id", "markdown"))
    heavy = share.where((F.col("n_repeated") * 3 >= F.col("n_words")) & (F.col("n_words") > 0)).select("doc_id").distinct()
    junk = text_types(docs).where("text_type in ('junk', 'blank')").select("doc_id")
    return heavy.join(junk, "doc_id", "left_anti")
