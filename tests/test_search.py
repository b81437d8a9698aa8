"""Redundancy, retrieval, and the registered queries."""

import importlib
import re
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from docgauge.operators import redundancy, retrieval


def test_exact_groups(spark):
    rows = [("a", "Un  texte"), ("b", "un texte\n"), ("c", "autre"), ("d", None), ("e", "  "), ("f", "")]
    got = sorted(tuple(r) for r in redundancy.exact_groups(spark.createDataFrame(rows, "doc_id string, markdown string")).collect())
    assert got == [("a", "a", 2), ("b", "a", 2)]


def test_near_pairs_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 32))
    near = base[:60] + 0.08 * rng.standard_normal((60, 32))
    m = np.vstack([base, near, base[:3]])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(999, None), (998, [])], "vec_id long, embedding array<float>")
    got = {(r["a"], r["b"]) for r in redundancy.near_pairs(df, 0.95, bucket=8).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    c = u @ u.T
    first = {i: next(j for j in range(i + 1) if np.allclose(m[i], m[j])) for i in range(len(m))}
    reps = sorted(set(first.values()))
    want = {(a, b) for x, a in enumerate(reps) for b in reps[x + 1 :] if c[a, b] >= 0.95} | {(first[i], i) for i in range(len(m)) if first[i] != i}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_recall_stays_at_every_size(spark):
    for threshold in (0.9, 0.95):
        for n in (1000, 10**6, 10**9, 10**12):
            bits, tables = redundancy.hyperplanes(n, threshold, 1024, 0.98)
            p = (1 - np.arccos(threshold) / np.pi) ** bits
            assert 1 - (1 - p) ** tables >= 0.98 and n / 2**bits <= 1024
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((600, 48)))
    side = rng.standard_normal((600, 48))
    side = unit(side - (side * base).sum(1, keepdims=True) * base)
    for threshold, bucket in ((0.9, 1024), (0.9, 1), (0.95, 1)):  # a bucket of one vector makes keys as long as for a thousand times the rows
        c = threshold + 0.005
        m = np.vstack([base, c * base + np.sqrt(1 - c * c) * side])
        df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
        want = set(zip(*(x.tolist() for x in np.nonzero(np.triu(m @ m.T >= threshold, 1)))))
        got = {(r["a"], r["b"]) for r in redundancy.near_pairs(df, threshold, bucket=bucket).collect()}
        assert len(want) >= 600 and got <= want and len(got) >= 0.96 * len(want)


def test_corpus_redundancy_says_what_it_did(spark):
    df = spark.createDataFrame([("a", "Un  texte"), ("b", "un texte"), ("c", "zzz zebre zzz"), ("d", "zzz zebres zzz"), ("e", None)], "doc_id string, markdown string")
    exact, near, status = redundancy.redundancy_of(df)
    assert exact.count() == 2 and near is None and status == "skipped: aucun encodeur"
    _, near, status = redundancy.redundancy_of(df, retrieval.letter_counts, 0.9)
    assert status == "ok" and ("c", "d") in {(r["a"], r["b"]) for r in near.collect()} and not near.where("a = 'a' and b = 'b'").count()
    assert redundancy.redundancy_of(df.where("markdown is null"), retrieval.letter_counts)[2] == "skipped: aucun document"

    def broken(texts):
        raise OSError

    assert redundancy.redundancy_of(df, broken)[2].startswith("skipped: ")


def test_numbers_follow_the_order(spark):
    from docgauge.functions.rows import numbered

    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(200)], "k string").repartition(7)
    assert [(r["number"], r["k"]) for r in sorted(numbered(df, "k").collect(), key=lambda r: r["number"])] == [(i, f"k{i:03d}") for i in range(200)]
    assert numbered(df.where("false"), "k").count() == 0


def test_hot_keys_are_dealt(spark):
    from docgauge.functions.rows import copied, dealt

    rows = [("hot", i) for i in range(90)] + [("cold", 1000 + i) for i in range(4)] + [(None, 5000)]
    df = dealt(spark.createDataFrame(rows, "k string, v int"), ["k"], "v", 10)
    per = {(r["k"], r["part"]): r["count"] for r in df.groupBy("k", "part").count().collect()}
    assert sum(n for (k, _), n in per.items() if k == "hot") == 90 and len([1 for k, _ in per if k == "hot"]) >= 7 and max(per.values()) < 30 and per["cold", 0] == 4
    other = copied(spark.createDataFrame([("hot", "a"), ("cold", "b"), ("none", "c")], "k string, w string"), df, ["k"])
    got = df.join(other, ["k", "part"]).select("k", "v", "w").collect()
    assert len(got) == 94 and len({r["v"] for r in got}) == 94


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    import pytest

    from docgauge import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda k, d=None: d)

    class Frame:
        sparkSession = Session()

    with pytest.raises(RuntimeError):
        session.cut(Frame())


def test_near_pairs_of_a_dense_group(spark):
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    group = unit(unit(rng.standard_normal(32)) + 0.45 * unit(rng.standard_normal((3000, 32))))
    twins = unit(group[:300] + 0.3 * unit(rng.standard_normal((300, 32))))
    m = np.vstack([group, twins, unit(rng.standard_normal((1500, 32)))])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    c = m @ m.T
    want = set(zip(*(x.tolist() for x in np.nonzero(np.triu(c >= 0.95, 1)))))
    got = [(r["a"], r["b"]) for r in redundancy.near_pairs(df, 0.95, bucket=200).collect()]
    assert len(want) >= 300 and len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want)


def test_retrieval_against_brute_force(spark):
    rng = np.random.default_rng(6)
    m = rng.integers(0, 3, (80, 6)).astype(float)
    index = spark.createDataFrame([(f"d{i % 20:02d}", i // 20, [float(x) for x in v]) for i, v in enumerate(m)], "doc_id string, chunk_no int, emb array<double>")
    q = spark.createDataFrame([(i, [float(x) for x in rng.integers(0, 3, 6)]) for i in range(5)], "q_id int, emb array<double>")
    got = retrieval.retrieve(index, q, 4, block=2).orderBy("q_id", "rank").collect()
    assert len(got) == 20
    keys = [(f"d{i % 20:02d}", i // 20) for i in range(80)]
    n = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
    for r in q.collect():
        v = np.array(r["emb"])
        s = n @ (v / (np.linalg.norm(v) + 1e-9))
        mine = [x for x in got if x["q_id"] == r["q_id"]]
        assert np.allclose(sorted((x["score"] for x in mine), reverse=True), np.sort(s)[::-1][:4])
        assert all(abs(s[keys.index((x["doc_id"], x["chunk_no"]))] - x["score"]) < 1e-9 for x in mine)


def test_retrieval_of_nothing(spark):
    index = spark.createDataFrame([], "doc_id string, chunk_no int, emb array<double>")
    q = spark.createDataFrame([(1, [1.0])], "q_id int, emb array<double>")
    assert retrieval.retrieve(index, q).count() == 0


def test_letter_counts_find_the_text(spark):
    docs = spark.createDataFrame([("a", "zzz zebra"), ("b", "contrat de sante")], "doc_id string, markdown string")
    index = retrieval.embed(retrieval.chunks(docs))
    q = retrieval.embed(spark.createDataFrame([(1, "zebre")], "q_id int, text string"))
    assert retrieval.retrieve(index, q, 1).first()["doc_id"] == "a"


def test_every_core_query_has_sql():
    from docgauge.plans import queries

    assert set(queries.queries()) == set(queries.oracle_sql()) and "screen_route" in queries.queries()


def test_core_stands_alone():
    root = Path(importlib.import_module("docgauge").__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"docgauge\.llm|from \.llm", p.read_text(encoding="utf-8")), p


def test_stream_screens_new_files(spark, tmp_path):
    from docgauge.streaming.incremental import screen_new_files

    block = "array<struct<kind:string,text:string,page:int,section:string>>"
    schema = f"doc_id string, markdown string, parse_confidence double, blocks {block}"
    df = spark.createDataFrame([("a", "un deux trois", 1.0, []), ("b", None, None, None)], schema)
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        screen_new_files(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {r["doc_id"]: r["route"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": "light", "b": "light"} and spark.read.parquet(str(tmp_path / "out")).select(F.count("doc_id")).first()[0] == 2
