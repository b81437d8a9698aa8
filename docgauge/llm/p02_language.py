"""Problem 2: language of each document and of each paragraph, by nearest clustered centroid.

A paragraph is a vector of hashed character trigrams, TF-IDF weighted and normalised. Each language has several
centroids (spherical k-means over training paragraphs); the paragraph takes the language of its nearest centroid by
cosine and is rejected (``und``) when even that one is too far. Training uses a bounded sample of labelled documents,
``PER_LABEL`` per label by smallest hash of the id and of each at most ``PER_DOC`` paragraphs of at most ``LONGEST``
characters; labels may be wrong, so training paragraphs nearer to another
language are dropped and the centroids fitted anew. All documents are classified whole, in Arrow batches.

Null or blank text has no segment and the language ``und`` with confidence 0. A label that names no known language
trains nothing. Repeated rows are classified each; extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgauge.llm.lexicon import LABEL_NAMES, LANGS
from docgauge.llm.lookalike import TO_LATIN

#: Documents per label that train the centroids; the bound of the sample.
PER_LABEL = 250
#: Paragraphs of such a document, by smallest hash, and their greatest length: together under 250 KB a document.
PER_DOC, LONGEST = 64, 4000
#: Hashed trigram space, and centroids of a language.
DIM, CLUSTERS = 1 << 15, 4
#: Share of a language's training paragraphs that a cluster must hold.
SMALLEST = 0.1
#: Words that a paragraph needs before it counts as written in a language.
MIN_WORDS = 20
#: Characters of paragraphs that are turned into vectors at once, which bounds the memory of a task.
HELD = 400_000
#: Share of the training paragraphs that the rejection distance may lose, and the slack below it.
LOST, SLACK = 0.01, 0.45

BREAK = re.compile(r"(?:\r\n|\n|\r)[ \t\u00a0]*(?:(?:\r\n|\n|\r)[ \t\u00a0]*)+")
WORDS = re.compile(r"[^\W\d_]+")


def named_languages(label: Column) -> Column:
    """Codes of the languages a label names, in any of its spellings; empty for null or unknown labels."""
    names = F.create_map(*[F.lit(x) for code, all_names in LABEL_NAMES.items() for name in all_names for x in (name, code)])
    parts = F.transform(F.split(F.lower(F.coalesce(label, F.lit(""))), r"[,;/&+|]|\s+et\s+|\s+and\s+"), lambda x: F.trim(x))
    code = lambda x: F.coalesce(F.try_element_at(names, x), F.try_element_at(names, F.element_at(F.split(x, "[-_]"), 1)))
    return F.array_distinct(F.filter(F.transform(parts, code), lambda x: x.isNotNull()))


_FOLD = {**TO_LATIN, **{ord(c): " " for c in "0123456789#*|_>[]()\"«»“”,.;:!?…/=+-–—€%°\t\r\n\u00a0\u202f"}, **{ord("’"): "'"}}
_FOLD.update({c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)})


def fold(text: str) -> str:
    """Letters and single spaces in one case, look-alike characters folded."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return " " + " ".join(text.lower().translate(_FOLD).split()) + " "


def segments(text: str) -> list[tuple[int, int]]:
    """Start and end of the blank-line paragraphs of a text."""
    out, at = [], 0
    for m in BREAK.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of the trigrams of folded texts, sorted by row and feature."""
    if not texts:
        return (np.zeros(0, np.int64),) * 3
    joined = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    lengths = np.array([len(t) for t in texts])
    row = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    a, b, c = joined[:-2], joined[1:-1], joined[2:]
    h = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + c * np.uint64(0x165667B19E3779F9)) >> np.uint64(49)
    keep = row[:-2] == row[2:]
    keys = np.sort((row[:-2][keep] << 15) | h[keep].astype(np.int64))
    if not len(keys):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    counts = np.diff(np.r_[first, len(keys)])
    keys = keys[first]
    return keys >> 15, keys & (DIM - 1), counts


class Centroids:
    """Clustered centroids of each language over TF-IDF trigrams."""

    def __init__(self, langs: list[str], idf: np.ndarray, centres: np.ndarray, owner: np.ndarray, floor: np.ndarray):
        self.langs, self.idf, self.owner, self.floor = langs, idf, owner, floor
        self.table = np.ascontiguousarray(centres.T.astype(np.float32))  # feature x centroid

    def cosines(self, texts: list[str]) -> np.ndarray:
        """Cosine of each folded text to each centroid."""
        row, feature, count = _grams(texts)
        out = np.zeros((len(texts), self.table.shape[1]), np.float32)
        if len(row):
            w = ((1 + np.log(count)) * self.idf[feature]).astype(np.float32)
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            rows = row[starts]
            norm = np.sqrt(np.add.reduceat(w * w, starts))
            step = 1 << 18
            edges = np.r_[starts, len(row)]
            at = 0
            while at < len(starts):  # blocks of whole rows bound the gathered memory
                to = max(at + 1, int(np.searchsorted(edges, edges[at] + step, "right")) - 1)
                lo, hi = edges[at], edges[min(to, len(starts))]
                got = self.table[feature[lo:hi]] * w[lo:hi, None]
                out[rows[at:to]] = np.add.reduceat(got, starts[at:to] - lo, axis=0)
                at = to
            out[rows] /= np.maximum(norm, 1e-9)[:, None]
        return out

    def classify(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language (or ``und``) and confidence of each folded text."""
        if not len(self.owner):
            return ["und"] * len(texts), np.zeros(len(texts))
        cos = self.cosines(texts)
        best = np.full((len(texts), len(self.langs)), -1.0, np.float32)
        for k, o in enumerate(self.owner):
            best[:, o] = np.maximum(best[:, o], cos[:, k])
        pick = best.argmax(axis=1)
        top = best[np.arange(len(texts)), pick]
        soft = np.exp((best - top[:, None]) * 25)
        confidence = 1 / soft.sum(axis=1)
        ok = top >= self.floor[pick]
        return [self.langs[p] if y else "und" for p, y in zip(pick, ok)], np.where(ok, confidence, 0.0)


def fit(texts: list[str], labels: list[str], clusters: int = CLUSTERS, rounds: int = 3) -> Centroids:
    """Centroids from folded training texts with noisy labels."""
    langs = [c for c in LANGS if c in set(labels)]
    y = np.array([langs.index(c) for c in labels], dtype=int)
    row, feature, count = _grams(texts)
    n = len(texts)
    df = np.bincount(feature, minlength=DIM) if n else np.zeros(DIM)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    w = (1 + np.log(np.maximum(count, 1))) * idf[feature]
    norm = np.sqrt(np.bincount(row, weights=w * w, minlength=n)) if n else np.zeros(0)
    w = w / np.maximum(norm[row], 1e-9) if n else w
    edges = np.searchsorted(row, np.arange(n + 1))
    keep = np.ones(n, bool)
    model = Centroids(langs, idf, np.zeros((0, DIM)), np.zeros(0, int), np.zeros(len(langs)))

    def mean(rows: np.ndarray) -> np.ndarray:
        at = np.concatenate([np.arange(edges[r], edges[r + 1]) for r in rows])
        v = np.bincount(feature[at], weights=w[at], minlength=DIM)
        return v / max(np.sqrt((v * v).sum()), 1e-9)

    for _ in range(rounds):
        centres, owner = [], []
        for o in range(len(langs)):
            mine = np.flatnonzero(keep & (y == o))
            if not len(mine):
                continue
            group = np.arange(len(mine)) % min(clusters, len(mine))
            for _ in range(6):
                cs = [mean(mine[group == g]) for g in np.unique(group)]
                small = Centroids([langs[o]], idf, np.array(cs), np.zeros(len(cs), int), np.zeros(1))
                new = small.cosines([texts[i] for i in mine]).argmax(axis=1)
                if (new == group).all():
                    break
                group = new
            # A small cluster is what wrong labels brought in; its paragraphs then fall to their own language.
            large = [g for g in np.unique(group) if (group == g).sum() >= SMALLEST * len(mine)]
            cs = [mean(mine[group == g]) for g in large]
            centres += cs
            owner += [o] * len(cs)
        model = Centroids(langs, idf, np.array(centres).reshape(-1, DIM), np.array(owner, int), np.zeros(len(langs)))
        if not n or not owner:
            return model
        cos = model.cosines(texts)
        best = np.full((n, len(langs)), -1.0)
        for k, o in enumerate(owner):
            best[:, o] = np.maximum(best[:, o], cos[:, k])
        keep = best.argmax(axis=1) == y
        top = best[np.arange(n), y]
        model.floor = np.array([SLACK * np.quantile(top[keep & (y == o)], LOST) if (keep & (y == o)).any() else 1.0 for o in range(len(langs))])
    return model


def train(docs: DataFrame, key: str = "doc_id", text: str = "markdown", label: str = "lang", per_label: int = PER_LABEL) -> Centroids:
    """Fit on at most ``per_label`` labelled documents of each language (all of a smaller one)."""
    named = named_languages(F.col(label))
    one = docs.where(F.length(F.col(text)) > 0).select(F.element_at(named, 1).alias("_y"), F.col(text).alias("_t"), F.xxhash64(F.col(key)).alias("_h"), F.size(named).alias("_n")).where("_n = 1")
    rank = F.row_number().over(Window.partitionBy("_y").orderBy("_h"))
    chosen = one.withColumn("_r", rank).where(F.col("_r") <= per_label).select("_y", "_t")

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            rows = []
            for y, t in zip(pdf["_y"], pdf["_t"]):
                parts = [t[a:b] for a, b in segments(t) if b - a <= LONGEST]
                folded = sorted((f for f in map(fold, parts) if len(WORDS.findall(f)) >= 12), key=xxhash.xxh64_intdigest)
                rows += [(y, f) for f in folded[:PER_DOC]]
            yield pd.DataFrame(rows, columns=["y", "t"])

    rows = sorted(map(tuple, chosen.mapInPandas(sample, "y string, t string").collect()))  # labels x per_label x PER_DOC x LONGEST
    return fit([t for _, t in rows], [y for y, _ in rows])


SEGMENT_SCHEMA = "doc_id string, seg_no int, start int, end int, n_words int, seg_lang string, confidence double"


def language_segments(docs: DataFrame, model: Centroids, key: str = "doc_id", text: str = "markdown") -> DataFrame:
    """One row per paragraph: its place, words, language and confidence."""

    def frame(rows: list[tuple], folded: list[str]) -> pd.DataFrame:
        langs, conf = model.classify(folded)
        got = pd.DataFrame(rows, columns=["doc_id", "seg_no", "start", "end", "n_words"])
        return got.assign(seg_lang=pd.Series(langs, dtype=object), confidence=pd.Series(conf, dtype=float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, folded, held = [], [], 0
            for doc, t in zip(pdf["k"], pdf["t"]):
                for no, (a, b) in enumerate(segments(t)):
                    folded.append(fold(t[a:b]))
                    rows.append((doc, no, a, b, max(folded[-1].count(" ") - 1, 0)))
                    held += b - a
                if held > HELD:
                    yield frame(rows, folded)
                    rows, folded, held = [], [], 0
            yield frame(rows, folded)

    flat = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return flat.mapInPandas(run, SEGMENT_SCHEMA)


def document_languages(docs: DataFrame, model: Centroids) -> DataFrame:
    """One row per document: main language (most words), confidence, and the languages of its long paragraphs."""
    seg = language_segments(docs.select("doc_id", "markdown"), model)
    per = seg.groupBy("doc_id", "seg_lang").agg(
        F.sum("n_words").alias("w"),
        F.sum(F.col("confidence") * F.col("n_words")).alias("cw"),
        F.max(F.col("n_words") >= MIN_WORDS).alias("whole"),
    )
    known = F.col("seg_lang") != "und"
    return per.groupBy("doc_id").agg(
        F.coalesce(F.max_by(F.when(known, F.col("seg_lang")), F.when(known, F.struct("w", "seg_lang"))), F.lit("und")).alias("main_lang"),
        F.coalesce(F.max_by(F.col("cw") / F.col("w"), F.when(known, F.struct("w", "seg_lang"))), F.lit(0.0)).alias("confidence"),
        F.sort_array(F.collect_set(F.when(known & F.col("whole"), F.col("seg_lang")))).alias("langs"),
    )


def found(docs: DataFrame) -> DataFrame:
    """p2_found: (doc_id, lang) of whole paragraphs in a language that the label doesn't name."""
    model = train(docs)
    seg = language_segments(docs.select("doc_id", "markdown"), model)
    written = seg.where((F.col("n_words") >= MIN_WORDS) & (F.col("seg_lang") != "und")).select("doc_id", F.col("seg_lang").alias("lang")).distinct()
    labels = docs.select("doc_id", named_languages(F.col("lang")).alias("_named")).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("_named"))).alias("_named"))
    return written.join(labels, "doc_id").where(~F.array_contains("_named", F.col("lang"))).select("doc_id", "lang")
