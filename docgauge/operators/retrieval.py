"""Chunk index and retrieval across the corpus."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgauge.operators.sections import sections


def chunks(docs: DataFrame, size: int = 1000, overlap: int = 100, text: str = "markdown") -> DataFrame:
    """(doc_id, chunk_no, text): overlapping windows of every document."""
    return sections(docs.select("doc_id", text), text, size, overlap, "chunk_no", "text").select("doc_id", "chunk_no", "text")


def letter_counts(texts: pd.Series) -> np.ndarray:
    """The built-in encoder: counts of the 26 letters."""
    out = np.zeros((len(texts), 26))
    for i, t in enumerate(texts):
        raw = np.frombuffer((t or "").lower().encode("ascii", "ignore"), dtype=np.uint8)
        out[i] = np.bincount(raw[(raw >= 97) & (raw <= 122)] - 97, minlength=26)
    return out


def embed(texts: DataFrame, encoder=letter_counts, text: str = "text", out: str = "emb") -> DataFrame:
    """Add the embedding of ``text``; ``encoder`` maps a series of texts to a matrix and runs in Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encoder(s), dtype=float)))

    return texts.withColumn(out, run(F.col(text)))


def retrieve(index: DataFrame, questions: DataFrame, k: int = 6, q_id: str = "q_id", q_vec: str = "emb", block: int = 4096) -> DataFrame:
    """Top ``k`` chunks of each question by cosine: (q_id, rank, doc_id, chunk_no, score); ties by doc_id and chunk_no.

    ``questions`` is a stated query set: it is read and sent to all tasks in blocks of ``block`` rows, each block one pass
    over the index in which every task keeps only its own top k. ``k`` is at least 1. Scores are rounded to 12 digits, so
    that equal vectors tie wherever they lie.
    """
    k = max(1, int(k))
    spark = index.sparkSession
    out = None
    numbered = questions.select(F.col(q_id).alias("q_id"), F.col(q_vec).alias("v"))
    rows = numbered.toLocalIterator()
    while True:
        part = list(islice(rows, block))
        if not part and out is not None:
            break
        ids = [r["q_id"] for r in part]
        q = np.array([r["v"] for r in part], dtype=float).reshape(len(part), -1)
        q = q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-9)
        held = spark.sparkContext.broadcast((ids, q))  # block x dimensions

        def run(batches, held=held):
            ids, q = held.value
            best: list[list[tuple]] = [[] for _ in ids]
            for pdf in batches:
                if not len(pdf) or not len(ids):
                    continue
                m = np.vstack(pdf["emb"].to_numpy())
                sims = np.round(q @ (m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)).T, 12)
                docs, nos = pdf["doc_id"].to_numpy(), pdf["chunk_no"].to_numpy()
                for i in range(len(ids)):
                    s = sims[i]
                    if len(s) > k:
                        floor = np.partition(s, len(s) - k)[len(s) - k]
                        at = np.flatnonzero(s >= floor)
                    else:
                        at = np.arange(len(s))
                    best[i] = sorted([*best[i], *((-float(s[j]), str(docs[j]), int(nos[j])) for j in at)])[:k]
            yield pd.DataFrame([(ids[i], d, n, -s) for i, b in enumerate(best) for s, d, n in b], columns=["q_id", "doc_id", "chunk_no", "score"])

        kind = numbered.schema["q_id"].dataType.simpleString()
        got = index.select("doc_id", "chunk_no", "emb").mapInPandas(run, f"q_id {kind}, doc_id string, chunk_no int, score double")
        out = got if out is None else out.unionByName(got)
        if not part:
            break
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "doc_id", "chunk_no")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q_id", "rank", "doc_id", "chunk_no", "score")
