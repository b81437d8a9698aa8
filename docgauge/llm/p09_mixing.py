"""Problem 9: a mixture of sources with target shares of tokens, by pivotal dependent rounding.

Each source gets a real number of copies of each of its documents: its target tokens over its tokens, at most
``max_repeats``. What a capped or missing source can't give is spread over the others in proportion to their targets, so
that the mixture keeps its size as long as all sources together can fill it. The whole part of the copies is certain;
the fractional part is rounded so that the source's tokens are kept: two documents with fractional copies p and q and n
and m tokens move mass (p + d/n, q - d/m) at random, without changing n p + m q in any step or either expectation, until
one is whole. Tasks pair within (source, salt) and leave at most one fractional document each; these residuals are
combined through a reduction tree, 16 salts at a time. The ``RESERVE`` shortest documents of a source are held back to the
last level: there each document, the longest first, moves mass from or to all shorter ones until it is whole, so the one
that is rounded at random in the end is short, and a source misses its tokens by less than a short document unless it
has too few. A hot source is spread over as many salts as it has thousands of documents. Randomness is a hash of ids and
seed, so a repeated task gives the same mixture.

Source names that vary in case, outer spaces, hyphen or underscore are one; documents of a null source and of sources
without a target are in no mixture. A null ``n_tokens`` is counted; documents without tokens get no copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgauge.llm.p08_packing import token_count
from docgauge.llm.p10_truncated import source_name
from docgauge.session import cut

#: Size of the mixture as a share of all documents' tokens; documents of a source in a salt, and fan-in of the tree; seed.
SIZE, PER_SALT, FAN, SEED = 0.5, 4096, 16, 7
#: Shortest documents of a source that are held back to the last level.
RESERVE = 64


def targets(have: dict[str, int], wanted: list[tuple[str, float, int]], total: int) -> dict[str, tuple[float, float]]:
    """(tokens, copies) per source: capped sources give what they can, the rest is spread over the open ones."""
    cap = {s: have.get(s, 0) * r for s, _, r in wanted}
    share = {s: t for s, t, _ in wanted}
    give: dict[str, float] = {}
    open_, left = [s for s in share if share[s] > 0], float(total)
    while open_:
        weight = sum(share[s] for s in open_)
        full = [s for s in open_ if left * share[s] / weight >= cap[s]]
        if not full:
            give |= {s: left * share[s] / weight for s in open_}
            break
        for s in full:
            give[s] = float(cap[s])
        left -= sum(cap[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return {s: (g, g / have[s] if have.get(s) else 0.0) for s, g in give.items()}


def _unit(*key) -> float:
    """A number in [0, 1) that depends on the key alone."""
    import xxhash

    return xxhash.xxh64_intdigest("\x1f".join(map(str, key)), seed=SEED) / 2.0**64


def pivot(rows: list[tuple[int, float, int]]) -> tuple[list[tuple[int, int]], tuple[int, float, int] | None]:
    """Round (doc_id, fraction, tokens): ((doc_id, 0 or 1) of the rounded, the one that stays fractional or None)."""
    done: list[tuple[int, int]] = []
    hold: tuple[int, float, int] | None = None
    for row in rows:
        if row[1] <= 1e-12 or row[1] >= 1 - 1e-12:
            done.append((row[0], round(row[1])))
            continue
        if hold is None:
            hold = row
            continue
        (i, p, n), (j, q, m) = hold, row
        # Tokens that may move to i from j, or to j from i, before one of the fractions is whole.
        up, down = min((1 - p) * n, q * m), min(p * n, (1 - q) * m)
        d = up if _unit(i, j) * (up + down) < down else -down
        p, q = p + d / n, q - d / m
        a, b = (i, p, n), (j, q, m)
        hold = None
        for r in (a, b):
            if r[1] <= 1e-9 or r[1] >= 1 - 1e-9:
                done.append((r[0], round(r[1])))
            else:
                hold = r
    return done, hold


def settle(rows: list[tuple[int, float, int]]) -> tuple[list[tuple[int, int]], tuple[int, float, int] | None]:
    """As ``pivot``, but each document in turn, the longest first, moves mass from or to all shorter ones together.

    The shorter ones share the move by fixed weights, in both directions, so no expectation changes; a move ends when the
    long one or one of the others is whole. The document left fractional is the shortest, unless the others run out.
    """
    done = [(i, round(f)) for i, f, _ in rows if not 1e-12 < f < 1 - 1e-12]
    rest = sorted((r for r in rows if 1e-12 < r[1] < 1 - 1e-12), key=lambda r: (-r[2], r[0]))
    step = 0
    while len(rest) > 1:
        (i, p, n), others = rest[0], rest[1:]
        give = [min(f, 1 - f) * m for _, f, m in others]
        most = sum(give)
        up, down = min((1 - p) * n, most), min(p * n, most)
        d = up if _unit(i, step, len(rest)) * (up + down) < down else -down
        step += 1
        moved = [(i, p + d / n, n)] + [(j, f - d * g / most / m, m) for (j, f, m), g in zip(others, give)]
        rest = []
        for r in moved:
            if r[1] <= 1e-9 or r[1] >= 1 - 1e-9:
                done.append((r[0], round(r[1])))
            else:
                rest.append(r)
    return done, rest[0] if rest else None


def _settled(rows: DataFrame) -> DataFrame:
    """Last level, one group per source of at most ``RESERVE`` + 1 documents: doc_id, up."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        done, hold = settle([(int(r.doc_id), float(r.f), int(r.n)) for r in pdf.itertuples(index=False)])
        if hold:
            done.append((hold[0], int(_unit(hold[0]) < hold[1])))
        return pd.DataFrame(done, columns=["doc_id", "up"]).astype({"doc_id": "int64", "up": "int32"})

    return rows.groupBy("source").applyInPandas(run, "doc_id long, up int")


def _round_groups(rows: DataFrame) -> DataFrame:
    """Pivot within (source, salt); ``up`` is null for the one document that stays fractional."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                key = (r.source, r.salt)
                for kept in [k for k in state if k != key]:  # rows come sorted: a new key ends the one before
                    h = state.pop(kept)
                    if h:
                        out.append((*kept, h[0], h[2], h[1], None))
                hold = state.get(key)
                done, hold = pivot([hold, (r.doc_id, r.f, r.n)] if hold else [(r.doc_id, r.f, r.n)])
                out += [(*key, i, None, None, u) for i, u in done]
                state[key] = hold
            yield _frame(out)
        yield _frame([(*k, h[0], h[2], h[1], None) for k, h in state.items() if h])

    # Long documents first, so that the one left over is rather short.
    return rows.repartition("source", "salt").sortWithinPartitions("source", "salt", F.desc("n"), "doc_id").mapInPandas(run, "source string, salt int, doc_id long, n long, f double, up int")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=["source", "salt", "doc_id", "n", "f", "up"])
    return f.astype({"salt": "Int32", "doc_id": "Int64", "n": "Int64", "f": "float64", "up": "Int32", "source": object})


def _mixed(documents: DataFrame, mix_targets: DataFrame, size: float) -> DataFrame:
    n = F.coalesce(F.col("n_tokens"), token_count(F.col("text"))).cast("long")
    docs = cut(documents.select("doc_id", source_name(F.col("source")).alias("source"), n.alias("n")).where("n > 0"))
    wanted = [(r["source"], r["target_share"], r["max_repeats"]) for r in mix_targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").collect()]  # one row per source of the mixture
    sums = docs.groupBy("source").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("c")).where(F.col("source").isin([w[0] for w in wanted])).collect()
    have, most = {r["source"]: r["t"] for r in sums}, max([r["c"] for r in sums], default=0)
    total = docs.agg(F.sum("n")).first()[0] or 0
    copies = targets(have, wanted, round(total * size))
    table = docs.sparkSession.createDataFrame([(s, c, t) for s, (t, c) in copies.items()] or [("", 0.0, 0.0)], "source string, c double, intended double")
    each = docs.join(F.broadcast(table), "source").withColumn("whole", F.floor("c").cast("int")).withColumn("f", F.col("c") - F.col("whole"))
    width = FAN
    while width * PER_SALT < most:
        width *= FAN
    fractional = each.where("f > 0").select("source", F.pmod(F.xxhash64("doc_id"), F.lit(width)).cast("int").alias("salt"), "doc_id", "n", "f")
    # The shortest of each salt, then of each source: at most RESERVE rows a source of the mixture.
    for part in (["source", "salt"], ["source"]):
        short = F.row_number().over(Window.partitionBy(*part).orderBy("n", "doc_id"))
        reserve = (fractional if part[1:] else reserve).withColumn("at", short).where(F.col("at") <= RESERVE).drop("at")
    reserve = cut(reserve)
    level = fractional.join(F.broadcast(reserve.select("doc_id")), "doc_id", "left_anti")
    up = None
    while True:
        done = cut(_round_groups(level))
        got = done.where("up is not null").select("doc_id", "up")
        up = got if up is None else up.unionByName(got)
        level = done.where("up is null").select("source", F.call_function("div", F.col("salt"), F.lit(FAN)).cast("int").alias("salt"), "doc_id", "n", "f")
        if width == 1:
            break
        width = max(1, width // FAN)
    last = cut(_settled(level.select("source", "doc_id", "n", "f").unionByName(reserve.select("source", "doc_id", "n", "f"))))
    out = each.join(up.unionByName(last), "doc_id", "left")
    return out.select("doc_id", "source", F.col("n").alias("n_tokens"), (F.col("whole") + F.coalesce("up", F.lit(0))).alias("copies"), "intended")


def mixture(documents: DataFrame, mix_targets: DataFrame, size: float = SIZE) -> DataFrame:
    """One row per document of a mixed source: doc_id, source, n_tokens, copies (0 or more)."""
    return _mixed(documents, mix_targets, size).drop("intended")


def report(documents: DataFrame, mix_targets: DataFrame, size: float = SIZE) -> DataFrame:
    """One row per target: source, target_share, intended_share (after what capped and missing sources can't give is spread
    over the others), reached_share, tokens, intended_tokens, available, max_repeats, most_copies, repeats (tokens over available).
    """
    m = _mixed(documents, mix_targets, size)
    got = m.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("n_tokens").alias("available"), F.max("copies").alias("most_copies"), F.max("intended").alias("intended_tokens"))
    want = mix_targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    j = cut(want.join(got, "source", "left").na.fill(0, ["tokens", "available", "most_copies", "intended_tokens"]))
    total = j.agg(F.sum("tokens").alias("total"), F.sum("intended_tokens").alias("meant"))
    part = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return j.crossJoin(F.broadcast(total)).select(  # one row on the right
        "source", "target_share", part("intended_tokens", "meant").alias("intended_share"), part("tokens", "total").alias("reached_share"), "tokens", "intended_tokens", "available", "max_repeats", "most_copies", part("tokens", "available").alias("repeats"),
    )
