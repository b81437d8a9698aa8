"""Sliding character windows: the judge's sections and the index's chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_stride(size: int, overlap: int | None) -> tuple[int, int]:
    """(size, stride) after the clamps: size at least 1, overlap a tenth by default and less than the size."""
    size = max(1, int(size))
    overlap = size // 10 if overlap is None else int(overlap)
    return size, size - min(max(0, overlap), size - 1)


def windows(text: Column, size: int = 8000, overlap: int | None = None) -> Column:
    """Array of the windows of a text; empty for null and empty text. Together they cover every character."""
    size, stride = window_stride(size, overlap)
    n = F.length(text)
    last = F.when(n <= size, 0).otherwise(F.call_function("div", n - size + stride - 1, F.lit(stride)).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * stride + 1, F.lit(size)))
    return F.when(n > 0, parts).otherwise(F.array().cast("array<string>"))


def sections(df: DataFrame, text: str = "markdown", size: int = 8000, overlap: int | None = None, number: str = "section_no", part: str = "section_text") -> DataFrame:
    """One row per window, numbered from 0, with the other columns; texts without windows give no row."""
    return df.select("*", F.posexplode(windows(F.col(text), size, overlap)).alias(number, part))


def representative_excerpt(text: Column, budget: int = 24000, spread: int = 4) -> Column:
    """Half of the budget from the head and ``spread`` windows over the rest, the last one ending with the text."""
    budget = max(int(budget), 0)
    if budget == 0:
        return F.lit("")
    head = budget // 2
    width = max(1, (budget - head) // spread)
    rest = F.substring(text, F.lit(head + 1), F.length(text))
    span = F.greatest(F.lit(1), F.length(rest) - width)
    parts = [F.substring(text, 1, head)]
    for i in range(spread):
        start = F.call_function("div", span * i, F.lit(max(1, spread - 1))).cast("int")
        parts.append(F.concat(F.lit("\n[...]\n"), F.substring(rest, start + 1, F.lit(width))))
    return F.when(F.length(text) <= budget, text).otherwise(F.concat(*parts))
