"""Problem 8: documents packed into containers of a fixed number of tokens by patterns.

The length histogram of all items (at most ``capacity`` rows) is fitted by non-negative least squares with patterns of
few lengths that fill a container well; the repeat counts are rounded down, and what remains of the histogram is packed
by best fit over length counts. The plan is a table of (pattern, repeats), bounded by the capacity, not by the corpus.
Items find their container by their rank within their length, counted per task and shifted by prefix sums, so a length
that a third of all documents have is ranked in all tasks at once.

A null ``n_tokens`` is counted from the text; a document over the capacity is split into full containers and a rest,
which is an item as any other. A document without tokens takes no container (container null). Repeated rows are packed
each; ``doc_id`` is the key of a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgauge.session import cut

CAPACITY = 2048
#: The public word-and-punctuation tokenizer.
TOKEN = r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
#: Length classes of the fit: the histogram is summed into so many steps a container; items of a class in a pattern.
STEPS, MAX_ITEMS = 64, 12
#: Share of the fitted repeats that is used, rounded; the rest stays for best fit, with small items among it that fill gaps.
FITTED = 0.9
#: Share of a container that a realised pattern may leave unused; worse ones stay for best fit.
UNUSED = 0.01
#: Parts in which the items of one length are ranked.
RANK_SALTS = 256


def token_count(text: Column) -> Column:
    """Tokens of the public tokenizer: runs of letters, digits and underscores, or of other visible characters."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Non-negative least squares by an active set; min |a x - b| over x >= 0.

    The result is a vertex: no more columns than rows are used, so that little is lost when it is rounded down.
    """
    x = np.zeros(a.shape[1])
    used: list[int] = []
    slack = 1e-9 * max(1.0, np.abs(b).max(initial=0.0)) * max(1.0, np.abs(a).max(initial=0.0))
    for _ in range(rounds):
        pull = a.T @ (b - a @ x)
        pull[used] = -np.inf
        if not len(pull) or pull.max() <= slack:
            break
        used.append(int(pull.argmax()))
        while True:
            y = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            if (y > 0).all():
                break
            now = x[used]
            low = y <= 0
            step = (now[low] / np.maximum(now[low] - y[low], 1e-300)).min()
            now = now + step * (y - now)
            gone = low & (now <= 1e-12 * max(1.0, now.max(initial=0.0)))
            x[:] = 0.0
            used = [c for c, g in zip(used, gone) if not g]
            x[used] = now[~gone]
            if not used:
                return x
        x[:] = 0.0
        x[used] = y
    return x


def _greedy(left: np.ndarray, capacity: int, start: int) -> list[int]:
    """Best-fit pattern of lengths with left[length] > 0, beginning with ``start``."""
    use: dict[int, int] = {}
    room, items = capacity, []
    size = start
    while size:
        items.append(size)
        use[size] = use.get(size, 0) + 1
        room -= size
        size = 0
        for s in range(room, 0, -1):
            if left[s] > use.get(s, 0):
                size = s
                break
    return items


def plan(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[list[int], int]]:
    """Patterns and how often each is used: every item of the histogram is placed exactly once.

    1. Enumerate patterns of few length classes (upper ends of ``steps`` classes) that leave little room, and fit their
       repeats to the class histogram by non-negative least squares, a share of ``FITTED`` of them rounded.
    2. Realise each repeat with true lengths of the classes, largest first, and close gaps with the largest that fits.
    3. Pack the residual histogram by best fit.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        left[int(size)] += int(n)
    width = capacity / steps
    cls = np.minimum((np.arange(capacity + 1) + width - 1) // width, steps).astype(int)  # class k holds lengths of ((k-1)w, kw]
    out: dict[tuple[int, ...], int] = {}

    def place(items: list[int], times: int) -> None:
        for s in items:
            left[s] -= times
        key = tuple(sorted(items, reverse=True))
        out[key] = out.get(key, 0) + times

    counts = np.bincount(cls, weights=left, minlength=steps + 1)[1:]
    present = np.flatnonzero(counts) + 1
    patterns = set()
    for a in present:
        patterns.add((int(a),) * max(1, steps // int(a)))
        for b in present[present <= a]:
            for na in range(1, min(3, steps // int(a)) + 1):
                room = steps - na * int(a)
                if room < b:
                    continue
                nb = min(room // int(b), MAX_ITEMS)
                rest = room - nb * int(b)
                extra = [int(x) for x in present[present <= rest]][-1:]
                patterns.add((int(a),) * na + (int(b),) * nb + tuple(extra))
                patterns.add((int(a),) * na + (int(b),) + tuple([int(x) for x in present[present <= room - b]][-1:]))
    good = sorted(p for p in patterns if sum(p) >= steps - 1 or len(p) == 1)
    m = np.zeros((steps, len(good)))
    for j, p in enumerate(good):
        for k in p:
            m[k - 1, j] += 1
    x = np.rint(FITTED * nnls(m, counts)).astype(int)
    for j in np.argsort([-sum(p) for p in good], kind="stable"):
        times = int(x[j])
        while times > 0:
            items, taken, room = [], {}, capacity
            for k in sorted(good[j], reverse=True):
                lo, hi = int(np.floor((k - 1) * width)) + 1, min(int(np.floor(k * width)), room)
                if len(items) == len(good[j]) - 1:  # the last item takes up what the classes' width left
                    lo, hi = 1, room
                size = next((s for s in range(hi, lo - 1, -1) if left[s] > taken.get(s, 0)), 0)
                if not size:
                    break
                items.append(size)
                taken[size] = taken.get(size, 0) + 1
                room -= size
            if len(items) < len(good[j]):
                break
            while room > 0:  # close the gap
                size = next((s for s in range(room, 0, -1) if left[s] > taken.get(s, 0)), 0)
                if not size:
                    break
                items.append(size)
                taken[size] = taken.get(size, 0) + 1
                room -= size
            if room > UNUSED * capacity:
                break
            n = min(times, *(int(left[s]) // c for s, c in taken.items()))
            place(items, n)
            times -= n
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        items = _greedy(left, capacity, top)
        use = {s: items.count(s) for s in set(items)}
        place(items, min(int(left[s]) // c for s, c in use.items()))
    return [(list(k), n) for k, n in out.items()]


def items(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Parts of documents: doc_id, part_no, token_start, n_tokens (0 < n_tokens <= capacity, or a document's 0)."""
    n = F.coalesce(F.col("n_tokens"), token_count(F.col("text"))).cast("long")
    d = documents.select("doc_id", n.alias("n"))
    last = F.greatest(F.call_function("div", F.col("n") + capacity - 1, F.lit(capacity)) - 1, F.lit(0))
    d = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part_no"))
    start = F.col("part_no") * capacity
    return d.select("doc_id", F.col("part_no").cast("int").alias("part_no"), start.alias("token_start"), F.greatest(F.least(F.lit(capacity), F.col("n") - start), F.lit(0)).alias("n_tokens"))


def ranked(parts: DataFrame, size: str = "n_tokens") -> DataFrame:
    """Add ``rank``, 0, 1, ... among the rows of the same ``size``, without bringing a size into one task.

    Rows are spread by a hash of their key, numbered per (size, salt), and shifted by the sums of the salts before; the
    shifts are joined on the keys by which the rows already lie. ``parts`` must be materialised, so that a lost task is
    computed alike.
    """
    salt = F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(RANK_SALTS)).cast("int")
    keyed = parts.withColumn("salt", salt)
    per = keyed.groupBy(size, "salt").agg(F.count(F.lit(1)).alias("c"))
    shift = per.withColumn("shift", F.sum("c").over(Window.partitionBy(size).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select(size, "salt", F.coalesce("shift", F.lit(0)).alias("shift"))
    within = F.row_number().over(Window.partitionBy(size, "salt").orderBy("doc_id", "part_no")) - 1
    return keyed.withColumn("within", within).join(shift, [size, "salt"]).withColumn("rank", F.col("within") + F.col("shift")).drop("salt", "within", "shift")


def slots(planned: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (size, first rank, items of the size in a container, first container), sorted; rank is among the items of a size.

    Each placement of the plan uses up a length or a pattern, so there are at most about capacity + patterns rows a pattern
    length: under 2 MB whatever the corpus.
    """
    rows, base, at = [], 0, {}
    for pattern, times in planned:
        for size in sorted(set(pattern)):
            per = pattern.count(size)
            rows.append((size, at.get(size, 0), per, base))
            at[size] = at.get(size, 0) + per * times
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def container_of(table: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Containers of items by size and rank: the last row that starts at or before the rank, by binary search."""
    key = lambda s, r: (s.astype(np.uint64) << np.uint64(48)) + r.astype(np.uint64)
    row = table[np.searchsorted(key(table[:, 0], table[:, 1]), key(size, rank), side="right") - 1]
    return row[:, 3] + (rank - row[:, 1]) // row[:, 2]


def pack(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per part of a document: doc_id, part_no, token_start, n_tokens, container (null without tokens)."""
    parts = cut(items(documents, capacity))
    sized = parts.where("n_tokens > 0")
    histogram = {r["n_tokens"]: r["count"] for r in sized.groupBy("n_tokens").count().collect()}  # at most capacity rows
    held = documents.sparkSession.sparkContext.broadcast(slots(plan(histogram, capacity)))  # bounded, see there

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(container=container_of(held.value, pdf["n_tokens"].to_numpy(), pdf.pop("rank").to_numpy()) if len(pdf) else pdf.pop("rank"))

    kept = ["doc_id", "part_no", "token_start", "n_tokens"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.select(*kept).schema)
    placed = ranked(sized).select(*kept, F.col("rank").cast("long").alias("rank")).mapInPandas(look_up, kinds + ", container long")
    none = parts.where("n_tokens = 0").withColumn("container", F.lit(None).cast("long"))
    return placed.unionByName(none)


def containers(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per container: container, n_parts, used, unused."""
    p = pack(documents, capacity).where("container is not null")
    return p.groupBy("container").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("n_tokens").alias("used")).withColumn("unused", F.lit(capacity) - F.col("used"))
