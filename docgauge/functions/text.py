"""Column helpers that give Python's text semantics with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of a line, as Python's splitlines has them.
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
#: One white-space character in Python's sense.
SPACE = r"[\s\x1c-\x1f]"
#: One word token.
WORD = r"[\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    """Text without the white space at both ends."""
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return c.isNull() | ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def lines(c: Column) -> Column:
    """Non-empty stripped lines."""
    parts = F.transform(F.split(c, LINE_BREAK, -1), strip)
    return F.filter(parts, lambda x: x != "")


def tokens(c: Column) -> Column:
    """Lower-case word tokens in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def ratio(num: Column, den: Column, digits: int, empty: float) -> Column:
    """``num / den`` rounded half up at ``digits`` with integer arithmetic; ``empty`` where ``den`` is 0.

    Integer arithmetic gives the same last digit in every SQL engine.
    """
    scale = 10**digits
    n, d = num.cast("bigint"), den.cast("bigint")
    units = F.call_function("div", 2 * n * scale + d, 2 * d)
    return F.when(d == 0, F.lit(float(empty))).otherwise(units / F.lit(float(scale)))
