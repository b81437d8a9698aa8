"""Problems 8 to 10: packing, mixing, cut-off records; and the registered queries."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docgauge.llm import minhash as mh
from docgauge.llm import p08_packing as p8
from docgauge.llm import p09_mixing as p9
from docgauge.llm import p10_truncated as p10

DOC = "doc_id long, text string, n_tokens long, source string"


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=25))
def test_plan_places_every_item_once(histogram):
    left = dict(histogram)
    bins = 0
    for pattern, times in p8.plan(histogram, 64, 16):
        assert sum(pattern) <= 64 and times > 0
        bins += times
        for s in pattern:
            left[s] -= times
    assert not any(left.values())
    total = sum(s * n for s, n in histogram.items())
    big = sum(n for s, n in histogram.items() if s > 32)
    assert -(-total // 64) <= bins <= big + total / 64 * 1.5 + 2


def test_nnls_finds_the_mixture():
    rng = np.random.default_rng(0)
    a = rng.random((12, 5))
    x = np.array([3.0, 0, 1.5, 0, 7])
    assert np.abs(p8.nnls(a, a @ x, 20000) - x).max() < 0.05


@pytest.mark.parametrize("n", [120, 900])
def test_patterns_come_from_the_fit_at_any_size(n, monkeypatch):
    rng = np.random.default_rng(n)
    sizes, counts = np.unique(np.minimum(rng.lognormal(5, 0.8, n).astype(int) + 1, 2048), return_counts=True)
    histogram = dict(zip(sizes.tolist(), counts.tolist()))
    placed = sum(len(k) * t for k, t in p8.plan(histogram))
    fitted = []
    monkeypatch.setattr(p8, "_greedy", lambda left, capacity, start: fitted.append(left.sum()) or [start])
    p8.plan(histogram)
    assert placed == n and (not fitted or fitted[0] <= 0.6 * n)


def test_slots_hold_each_rank_once():
    plan = [([3, 3, 2], 4), ([5], 2), ([3, 2, 2], 3)]
    table = p8.slots(plan)
    got = {}
    for size, n in ((3, 11), (2, 10), (5, 2)):
        for c in p8.container_of(table, np.full(n, size), np.arange(n)).tolist():
            got.setdefault(c, []).append(size)
    assert sorted(sorted(v, reverse=True) for v in got.values()) == sorted(sorted(k, reverse=True) for k, n in plan for _ in range(n)) and sorted(got) == list(range(9))


def test_packing(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "mot " * int(n), int(n) if i % 5 else None, "s") for i, n in enumerate(rng.integers(1, 400, 300))]
    rows += [(1000 + i, "x", 100, "hot") for i in range(200)] + [(2000, "a, b_1 ; é!", None, None), (2001, None, None, None), (2002, "", 0, "s"), (2003, "mot " * 1200, None, "s")]
    df = spark.createDataFrame(rows, DOC)
    got = p8.pack(df, 500).collect()
    per = {}
    for r in got:
        per.setdefault(r["container"], []).append(r["n_tokens"])
    none = per.pop(None)
    assert none == [0, 0] and all(sum(v) <= 500 for v in per.values()) and len({(r["doc_id"], r["part_no"]) for r in got}) == len(got)
    tokens = {}
    for r in got:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["n_tokens"]
    assert tokens[2000] == 6 and tokens[2003] == 1200 and sum(tokens.values()) == sum(n if n is not None else {2000: 6, 2001: 0, 2003: 1200}.get(i, len((t or "").split())) for i, t, n, _ in rows)
    assert sorted(r["n_tokens"] for r in got if r["doc_id"] == 2003) == [200, 500, 500]
    assert len(per) <= -(-sum(tokens.values()) // 500) * 1.03 + 1 and sorted(per) == list(range(len(per)))
    assert p8.pack(df.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(1, 500)), max_size=30))
def test_pivot_keeps_tokens(rows):
    items = [(i, f, n) for i, (f, n) in enumerate(rows)]
    done, hold = p9.pivot(items)
    n = {i: m for i, _, m in items}
    kept = sum(n[i] * u for i, u in done) + (hold[1] * hold[2] if hold else 0)
    assert abs(kept - sum(f * m for _, f, m in items)) < 1e-3 and len(done) + bool(hold) == len(items)


def test_pivot_is_unbiased():
    ups = []
    for k in range(3000):
        done, hold = p9.pivot([(k * 10 + i, 0.3, 100 + 40 * i) for i in range(4)])
        ups.append(dict(done) | ({hold[0]: hold[1]} if hold else {}))
    share = [np.mean([u[k * 10 + i] for k, u in enumerate(ups)]) for i in range(4)]
    assert max(abs(s - 0.3) for s in share) < 0.05


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(1, 500)), max_size=30))
def test_settling_keeps_tokens_and_leaves_a_short_one(rows):
    items = [(i, f, n) for i, (f, n) in enumerate(rows)]
    done, hold = p9.settle(items)
    n = {i: m for i, _, m in items}
    kept = sum(n[i] * u for i, u in done) + (hold[1] * hold[2] if hold else 0)
    assert abs(kept - sum(f * m for _, f, m in items)) < 1e-3 and len(done) + bool(hold) == len(items)


def test_settling_is_unbiased_and_short():
    ups, left = [], []
    for k in range(3000):
        items = [(k * 100 + i, f, n) for i, (f, n) in enumerate(zip([0.3, 0.7, 0.5, 0.2, 0.9, 0.4], [2000, 400, 300, 90, 80, 20]))]
        done, hold = p9.settle(items)
        ups.append(dict(done) | ({hold[0]: hold[1]} if hold else {}))
        left.append(hold[2] if hold else 0)
    share = [np.mean([u[k * 100 + i] for k, u in enumerate(ups)]) for i in range(6)]
    assert np.abs(np.array(share) - [0.3, 0.7, 0.5, 0.2, 0.9, 0.4]).max() < 0.05
    many = [(i, 0.37, n) for i, n in enumerate([3000, 2000, *range(20, 84)])]
    assert (p9.settle(many)[1] or (0, 0, 0))[2] <= 40


def test_targets_spread_what_is_missing():
    got = p9.targets({"a": 100, "b": 1000, "c": 1000}, [("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.1, 1), ("d", 0.1, 3)], 1000)
    assert got["a"][0] == 200 and got["d"] == (0.0, 0.0) and abs(sum(g for g, _ in got.values()) - 1000) < 1e-6 and abs(got["b"][0] / got["c"][0] - 3) < 1e-6
    assert sum(g for g, _ in p9.targets({"a": 10}, [("a", 1.0, 2)], 1000).values()) == 20
    assert p9.targets({}, [], 5) == {}


def test_mixture(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "x", int(n), ["Big-Source", " big_source", "small", "other", None][i % 5 if i % 7 else 0]) for i, n in enumerate(rng.integers(1, 60, 900))]
    df = spark.createDataFrame(rows + [(5000, "", None, "small")], DOC)
    want = spark.createDataFrame([("big-source", 0.5, 1), ("small", 0.4, 2), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    m = p9.mixture(df, want).collect()
    assert p9.mixture(df, want).exceptAll(spark.createDataFrame(m, p9.mixture(df, want).schema)).count() == 0
    assert max(r["copies"] for r in m if r["source"] == "small") <= 2 and max(r["copies"] for r in m if r["source"] == "big-source") <= 1
    total = sum(n for _, _, n, _ in rows)
    assert abs(sum(r["copies"] * r["n_tokens"] for r in m) - total / 2) < 200
    rep = {r["source"]: r for r in p9.report(df, want).collect()}
    assert all(abs(r["tokens"] - r["intended_tokens"]) <= 20 for r in rep.values()) and abs(sum(r["intended_share"] for r in rep.values()) - 1) < 1e-9
    assert rep["gone"]["reached_share"] == 0 and abs(sum(r["reached_share"] for r in rep.values()) - 1) < 1e-9
    assert p9.mixture(df.where("false"), want).count() == 0


@pytest.mark.parametrize(
    ("text", "state"),
    [
        ("Une phrase finie.", "whole"), ("Une phrase (finie) « dite ».", "whole"), ("Un pack “accueil” est remis.", "whole"), ("Une phrase. Puis une autre qui s'arrête au mil", "run"), ("Une phrase (ouverte", "cut"), ("Une phrase [...]", "run"), ("Une phrase…", "run"),
        ("Une phra�", "run"), ("Selon l'art.", "cut"), ("1. Un.\n2. Deux.\n3.", "cut"), ("| a | b |\n| --- | --- |\n| 1 | 2 |", "whole"), ("| a | b |\n| --- | --- |\n| 1 |", "cut"), ("| a | b |\n| --- | --- |\n| 1", "cut"),
        ("a\tb\tc\n1\t2\t3\n4\t5", "cut"), ("a\tb\n1\t2\n3\t", "whole"), ("- un\n- deux", "item"), ("Texte fini.\n\nLa direction", "ask"), ("Voir https://exemple.org/12", "still"), ("Fini.\n\nFait à Lyon, le 3 mai 2024", "still"), ("Prix,", "run"), ("annexe\n3.", "whole"),
    ],
)
def test_end_states(text, state):
    assert p10.end_state(text)[0] == state


def test_heads_of_near_copies_share_a_band():
    rng = np.random.default_rng(9)
    hits = n = 0
    for _ in range(400):
        a = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        b = list(a[: int(rng.integers(20, 150))])
        for at in rng.integers(0, len(b), int(rng.integers(0, 3))):
            b[at] = "autre"
        if mh.containment(mh.shingles(b, {}), mh.shingles(a, {})) >= 0.8:
            n += 1
            whole, copy = mh.head_bands([a, b], {})
            hits += bool(set(copy[-1].tolist()) & set(whole.ravel().tolist()))
    assert n > 150 and hits >= 0.97 * n
    assert [k.shape for k in mh.head_bands([[], ["a"] * 9, ["a"] * 40], {})] == [(0, mh.BANDS), (0, mh.BANDS), (2, mh.BANDS)] and mh.head_bands([[]], {})[0].shape == (0, mh.BANDS)
    one, other = [f"x{i}" for i in range(43)], [f"y{i}" for i in range(11)]
    alone = mh.head_bands([one], {})[0]
    assert all((x == y[0]).all() for x, y in zip(mh.head_bands([one, other], {}), (mh.head_bands([t], {}) for t in (one, other))))
    assert (alone[0] == mh.head_bands([one[:20]], {})[0][0]).all() and not set(alone[0].tolist()) & set(alone[1].tolist())


def body(seed, n=14):
    rng = np.random.default_rng(seed)
    nouns, verbs = ["dossier", "barème", "contrat", "relevé", "tableau", "comité", "plafond"], ["vérifie", "archive", "transmet", "classe"]
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    return " ".join(f"Le {pick(nouns)} {int(rng.integers(1, 9999))} {pick(verbs)} le {pick(nouns)} de la caisse {int(rng.integers(1, 9999))}." for _ in range(n))


def corpus():
    rows = [(i, body(i) + ("\n\nLa direction des soins" if i % 3 == 0 else "\n\nFin du document" if i % 3 == 1 else ""), "a") for i in range(60)]
    full = body(500, 30)
    rows += [(100, full, "B_x"), (101, full[:-40], "b-X "), (102, full[:-40], "b-x"), (103, body(7) + "\n\nLa direction des soi", "a"), (104, body(8) + "\n\nLa direction des", "a"), (105, body(9)[:-25], "a"), (106, None, None), (107, " ", "a"), (108, body(11) + " (voir", "a")]
    return rows


def test_cut_records(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in p10.verdicts(df).collect()}
    assert {k for k, r in got.items() if r["cut"]} == {101, 102, 103, 104, 105, 108} and len(got) == len(corpus())
    assert got[101]["evidence"] == got[102]["evidence"] == "alignment" and got[103]["evidence"] == "terminality"
    per = {r["source"]: (r["n_docs"], r["n_cut"]) for r in p10.by_source(df).collect()}
    assert per["b-x"] == (3, 2) and per[""] == (1, 0)
    assert {r["doc_id"] for r in p10.found(df).collect()} == {101, 102, 103, 104, 105, 108}
    assert p10.found(df.where("false")).count() == 0


def brute_early(rows):
    """Texts that a longer one contains and goes on from, by holding every text against every other."""
    ws = {t: mh.words(t) for _, t, _ in rows if t}
    sh = {t: (mh.shingles(w[:-1], {}), mh.shingles(w, {})) for t, w in ws.items()}
    return {x for x in ws for y in ws if x != y and len(ws[x]) <= len(ws[y]) and mh.containment(sh[x][0], sh[y][1]) >= 0.8 and p10.ends_early(ws[x], ws[y])}


def test_copies_cut_anywhere_are_paired(spark):
    rows, want = [], set()
    for i in range(40):
        full = body(900 + i, 20)
        rows.append((i, full, "a"))
        cut = full[: int(len(full) * (0.3 + 0.65 * i / 39))].rstrip(" .")
        rows.append((100 + i, cut, "a"))
        want.add(cut)
    rows += [(200, None, None), (201, " ", "a"), (202, rows[1][1], "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rec = p10.records(df).cache()
    text = {r["digest"]: t for r in rec.collect() for k, t, _ in rows if k == r["doc_id"]}
    whole = {text[r["digest"]] for r in rec.collect() if r["state"] == "whole"}
    got = p10.near_copies(rec, df).collect()
    assert {text[r["digest"]] for r in got} == want - whole == brute_early(rows) - whole and len(got) == len(want - whole) and all(r["similarity"] >= 0.8 for r in got)
    assert len(want - whole) >= 38 and {r["doc_id"] for r in p10.found(df).collect()} == {k for k, t, _ in rows if t in want - whole}


def test_hot_group_loses_no_record(spark, monkeypatch):
    monkeypatch.setattr(p10, "PART", 3)
    head = body(500, 12)  # a third of the texts begin alike; some are cut copies of one that is not the longest
    rows = [(i, f"{head} {body(600 + i, 3 + i % 9)}", "a") for i in range(30)]
    rows += [(100 + i, rows[i][1][:-37].rstrip(), "a") for i in range(0, 30, 2)] + [(200 + i, body(700 + i), "a") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rec = p10.records(df).cache()
    digest = {r["doc_id"]: (r["digest"], r["state"]) for r in rec.collect()}
    early = brute_early(rows)
    want = {digest[k][0] for k, t, _ in rows if t in early and digest[k][1] != "whole"}
    assert len(want) >= 12 and {r["digest"] for r in p10.near_copies(rec, df).collect()} == want


def test_counts_are_alike_sent_and_joined(spark, monkeypatch):
    rows = corpus() + [(300 + i, f"# Titre {i}\n\n- un poste ;\n- deux postes\n\n| a | b |\n| --- | --- |\n| {i} | poste |\n\nÀ suivre; demain;\n3.4. Suite", "a") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rec = p10.records(df).cache()
    one = p10.verdicts(df).collect()
    few = {tuple(r) for r in p10.terminality(rec, df).collect()}
    monkeypatch.setattr(p10, "SENT", 0)
    monkeypatch.setattr(p10, "MEMO", 50)
    assert {tuple(r) for r in p10.terminality(rec, df).collect()} == few and few
    assert sorted(p10.verdicts(df).collect()) == sorted(one)


def moved(spark, run):
    """Rows that all jobs of ``run`` write for shuffles."""
    sc = spark.sparkContext
    sc.setJobGroup("moved", "")
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {k for j in tracker.getJobIdsForGroup("moved") for k in tracker.getJobInfo(j).stageIds}
    sc.setJobGroup("", "")
    return sum(store.lastStageAttempt(k).shuffleWriteRecords() for k in stages if tracker.getStageInfo(k))  # skipped stages may be gone


def test_many_asked_keys_move_only_what_is_asked_about(spark, monkeypatch):
    lines = [" ".join(f"m{(97 * i + 31 * j + 7 * k * k) % 5003}" for k in range(9)) for i in range(400) for j in range(10)]
    rows = [(i, "\n\n".join(lines[10 * i : 10 * i + 10]) + ".", "a") for i in range(400)]  # all whole
    rows += [(500 + i, rows[i][1][: -40 - i], "a") for i in range(8)]  # cut copies
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(p10.verdicts(df).collect())
    monkeypatch.setattr(p10, "SENT", 0)
    got = []
    n = moved(spark, lambda: got.extend(p10.verdicts(df).collect()))
    assert sorted(got) == want and sum(r["cut"] for r in got) == 8
    assert 2 * len(rows) < n < 6 * len(rows), n  # counting all beginnings of lines and all pairs of words moves 23 rows a text


def test_sieve_lets_all_keys_through_and_few_others(spark):
    from docgauge.functions import sieve as sv

    rng = np.random.default_rng(5)
    keys, others = (rng.integers(-(1 << 63), (1 << 63) - 1, n) for n in (3000, 20000))
    held = sv.sieve(spark.createDataFrame([(int(k),) for k in keys], "key long"), "key")
    assert sv.lets(held.value, keys).all() and sv.lets(held.value, others).mean() < 0.05
    texts = [f"t{i}" for i in range(500)]
    held = sv.sieve(spark.createDataFrame([(sv.text_key("a", t),) for t in texts], "key long"), "key")
    asked, other = sv.Held(held.value, "a"), sv.Held(held.value, "b")
    assert all(asked[t] for t in texts) and sum(other[t] for t in texts) < 50
    df = spark.createDataFrame([(int(k),) for k in keys[:50]] + [(None,)], "key long")
    none = sv.sieve(df.where("false"), "key")
    assert sv.sieved(df, p10.F.col("key"), none).count() == 0 and not sv.Held(none.value, "a")["x"]


def test_alignment():
    long = "un deux trois quatre cinq six sept huit neuf dix".split()
    assert p10.ends_early(long[:7], long) and p10.ends_early([*long[:7], "hu"], long) and not p10.ends_early(long, long) and not p10.ends_early(["a"] * 9, long) and not p10.ends_early(long[:3], long)
    assert p10.ends_early([*long[:5], "q"], [*long[:5], "quand"]) and not p10.ends_early([*long[:5], "x"], [*long[:5], "quand"])


def test_first_query_of_each_problem():
    import re

    from docgauge.llm import queries

    names = list(queries.queries())
    assert set(queries.oracle_sql()) <= set(names)
    for n in range(1, 11):
        mine = [x for x in names if re.match(rf"p{n}_", x)]
        assert mine[0] == {3: "p3_method", 8: "p8_assignment", 9: "p9_mixture"}.get(n, f"p{n}_found")
