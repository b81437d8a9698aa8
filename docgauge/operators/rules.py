"""Criteria that a deterministic rule scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the rules, searched without regard to case.
MONTHS = r"(?:janvier|f[eé]vrier|mars|avril|mai|juin|juillet|ao[uû]t|septembre|octobre|novembre|d[eé]cembre)"
AUTHOR = r"auteur|r[eé]dig[eé]|contributeur"
VERSION = r"\bv\d+(\.\d+)?\b|version\s+\d+|r[eé]vision\s+\d+|[eé]dition\s+\d{4}"
DATE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{1,2}\s?(?:er)?\s+" + MONTHS + r"\s+\d{4}|" + MONTHS + r"\s+\d{4}"
UPDATE = r"mise\s+a\s+jour|revu\s+chaque"
STATE = r"valid[eé]|en cours|brouillon|archiv|obsol"
HISTORY = r"changelog|historique des (modif|changements)|table des r[eé]visions"
FAQ = r"\bFAQ\b|questions fr[eé]quentes|questions/r[eé]ponses"
#: Lines ending in a question mark that make a FAQ.
FAQ_LINES = 5
#: The criteria that have a rule.
RULED = ("1.3", "1.4", "1.6", "1.7", "1.8", "1.9", "4.5", "8.1")


def _has(t: Column, pattern: str) -> Column:
    return t.rlike("(?iu)" + pattern.replace(r"\b", r"(?U:\b)"))


def with_rule_scores(df: DataFrame, text: str = "markdown") -> DataFrame:
    """Add ``d_scores``: map from criterion to score. Needs question_lines and content_duplicates of ``signals``."""
    t = F.coalesce(F.col(text), F.lit(""))
    flags = df.withColumns({"_v": _has(t, VERSION), "_d": _has(t, DATE), "_f": _has(t, FAQ)})
    two = lambda c: F.when(c, 5).otherwise(1)
    dated = F.when(F.col("_v") & F.col("_d"), 5).when(F.col("_v") | F.col("_d"), 3).otherwise(1)
    dup = F.col("content_duplicates")
    score = {
        "1.3": two(_has(t, AUTHOR)),
        "1.4": dated,
        "1.6": two(_has(t, UPDATE)),
        "1.7": two(_has(t, STATE)),
        "1.8": two(_has(t, HISTORY)),
        "1.9": dated,
        "4.5": F.when(dup == 0, 5).when(dup <= 0.05, 3).otherwise(1),
        "8.1": two(F.col("_f") | (F.col("question_lines") >= FAQ_LINES)),
    }
    pairs = [x for k in RULED for x in (F.lit(k), score[k])]
    return flags.withColumn("d_scores", F.create_map(*pairs)).drop("_v", "_d", "_f")
