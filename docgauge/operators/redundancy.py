"""Redundancy of a corpus: exact duplicates by normalised text, near duplicates by embedding."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.functions import text as tx
from docgauge.functions.rows import dealt
from docgauge.session import cut


def normalised(c: Column) -> Column:
    """Lower-case text with single spaces."""
    return F.lower(tx.strip(F.regexp_replace(c, f"(?U){tx.SPACE}+", " ")))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "markdown") -> DataFrame:
    """One row per document that has an equal one: doc_id, group_id (its smallest id), n_docs.

    Groups are counted by digest with partial aggregation; members are never collected.
    """
    d = docs.where(~tx.is_blank(F.col(text))).select(F.col(key).alias("doc_id"), F.sha2(normalised(F.col(text)), 256).alias("h"))
    g = d.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("group_id")).where("n_docs > 1")
    return d.join(g, "h").select("doc_id", "group_id", "n_docs")


def hyperplanes(n: int, threshold: float, bucket: int, recall: float) -> tuple[int, int]:
    """(bits of a key, tables) for ``n`` vectors: buckets of about ``bucket`` vectors, and as many tables as longer keys need.

    Two vectors of cosine c agree in a bit with probability 1 - arccos(c) / pi; a pair at the threshold is missed by all
    tables with probability of at most 1 - ``recall``, at every size.
    """
    bits = min(60, max(10, math.ceil(math.log2(max(1, n) / bucket))))
    together = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(16, math.ceil(math.log(1 - recall) / math.log(1 - together)) if together < 1 else 1)


def near_pairs(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding", bucket: int = 1024, recall: float = 0.98, seed: int = 11) -> DataFrame:
    """Verified near duplicates: (a, b, score, copy) with cosine of at least ``threshold``, a < b.

    Candidates share a bucket of random hyperplanes in one of several tables; ``hyperplanes`` sets both numbers so that the
    share of pairs found stays at ``recall`` or above whatever the number of vectors. All pairs of a bucket are compared:
    one of more than ``bucket`` vectors is dealt into blocks of about that many, and every two blocks are compared in a
    group of their own. So whether a pair is found depends on its angle only. Equal vectors are collapsed to their first id
    beforehand: rows with ``copy`` are the membership of a copy b in the class of a, all others pair first ids.
    """
    import pandas as pd

    unit = vectors.where(F.size(vector) > 0).select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    unit = unit.withColumn("h", F.xxhash64("v"))
    first = unit.groupBy("h").agg(F.min("id").alias("rep"))
    copies = unit.select("id", "h").join(first, "h").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"), F.lit(True).alias("copy"))
    reps = cut(unit.join(first, "h").where("id = rep").select("id", "v"))
    kind = reps.schema["id"].dataType.simpleString()
    bits, tables = hyperplanes(reps.count(), threshold, bucket, recall)

    def keys(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            m = np.vstack(pdf["v"].to_numpy())
            for t in range(tables):
                planes = np.random.default_rng([seed, t]).standard_normal((m.shape[1], 60))[:, :bits]
                yield pd.DataFrame({"id": pdf["id"], "t": t, "p": (m @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))})

    def compared(run: pd.DataFrame) -> pd.DataFrame:
        """Pairs over the threshold of two blocks, or of one."""
        i, j = run["i"].iloc[0], run["j"].iloc[0]
        ids, m, block = run["id"].to_numpy(), np.vstack(run["v"].to_numpy()), run["block"].to_numpy()
        m = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        sims = m[left] @ m[right].T
        x, y = np.nonzero(np.triu(sims >= threshold, 1) if i == j else sims >= threshold)
        a, b = ids[left[x]], ids[right[y]]
        return pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "score": sims[x, y]})

    def compare(batches):
        rest = None  # the group that the next batch may go on with; at most two blocks
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            k = pdf[["t", "p", "i", "j"]].to_numpy()
            at = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist()]
            for lo, hi in zip(at, at[1:]):
                yield compared(pdf.iloc[lo:hi])
            rest = pdf.iloc[at[-1] :]
        if rest is not None:
            yield compared(rest)

    coded = cut(reps.mapInPandas(keys, f"id {kind}, t int, p long"))
    several = coded.groupBy("t", "p").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "p")
    placed = dealt(coded, ["t", "p"], "id", bucket).withColumnsRenamed({"parts": "blocks", "part": "block"}).join(several, ["t", "p"], "left_semi")
    groups = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("id", "t", "p", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    near = groups.join(reps, "id").repartition("t", "p", "i", "j").sortWithinPartitions("t", "p", "i", "j").mapInPandas(compare, f"a {kind}, b {kind}, score double")
    return near.groupBy("a", "b").agg(F.round(F.max("score"), 3).alias("score")).withColumn("copy", F.lit(False)).unionByName(copies)


def redundancy_of(docs: DataFrame, encoder=None, threshold: float = 0.9, key: str = "doc_id", text: str = "markdown") -> tuple[DataFrame, DataFrame | None, str]:
    """(exact groups, near pairs or None, status) of a corpus. ``encoder`` maps texts to vectors, see ``retrieval.embed``.

    Near duplicates are an extra: without an encoder, without documents, or when it fails, the status says so and the
    exact groups stand. Equal texts are in the groups; only pairs of different texts are near ones.
    """
    from docgauge.operators.retrieval import embed

    exact = exact_groups(docs, key, text)
    if encoder is None:
        return exact, None, "skipped: aucun encodeur"
    live = docs.where(~tx.is_blank(F.col(text))).select(F.col(key).alias("vec_id"), F.col(text).alias("text"))
    if live.isEmpty():
        return exact, None, "skipped: aucun document"
    try:
        return exact, cut(near_pairs(embed(live, encoder, "text", "embedding").drop("text"), threshold).where("not copy").drop("copy")), "ok"
    except Exception as e:
        return exact, None, f"skipped: {type(e).__name__}"


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-9) * (F.sqrt(dot(b, b)) + 1e-9))
