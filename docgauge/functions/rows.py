"""Rows numbered in an order, and rows of hot keys dealt into parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.session import cut


def numbered(df: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """Add 0, 1, ... in ``order`` (which should be total), without a task that sees all rows.

    Rows are sorted over ranges; only a count per range comes to the driver.
    """
    rows = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(tuple(r) for r in rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect())
    start, before = [], 0
    for p, n in sizes:
        start.append((p, before))
        before += n
    begin = df.sparkSession.createDataFrame(start, "_part long, _start long")
    return rows.withColumn("_part", part).join(F.broadcast(begin), "_part").withColumn(name, F.col("_start") + within).drop("_at", "_part", "_start")


#: Hot keys up to which they are sent to all tasks.
SENT = 100_000


def dealt(df: DataFrame, keys: list[str], by: str, per: int) -> DataFrame:
    """Add ``parts`` and ``part`` (from 0): the rows of a key with more than ``per`` rows are dealt over parts of about so many.

    Only hot keys are looked up, at most one in ``per`` rows, and sent to all tasks where they are few; so a key that a
    third of all rows have is in no task as a whole.
    """
    hot = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > per))
    j = df.join(F.broadcast(hot) if hot.count() <= SENT else hot, keys, "left")
    parts = F.coalesce(F.ceil(F.col("_n") / F.lit(per)), F.lit(1)).cast("long")
    return j.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(by), F.col("parts"))).drop("_n")


def copied(df: DataFrame, dealt_rows: DataFrame, keys: list[str]) -> DataFrame:
    """The other side of a join with dealt rows: a copy of each row for each part (``part``) of its key."""
    hot = dealt_rows.where("parts > 1").groupBy(*keys).agg(F.max("parts").alias("_p"))
    j = df.join(hot, keys, "left")
    return j.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_p", F.lit(1).cast("long")) - 1))).drop("_p")
