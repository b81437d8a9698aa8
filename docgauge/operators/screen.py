"""Two-speed triage: which documents get the full judgement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGE_TOKENS = 10_000


def with_route(df: DataFrame) -> DataFrame:
    """Add ``route`` (full or light), ``reason`` (code) and ``reason_text``; a null confidence counts as 0."""
    pc, na, m, n = F.coalesce(F.col("parse_confidence"), F.lit(0.0)), F.col("non_alpha_fraction"), F.col("mattr"), F.col("n_tokens")
    bad = (pc < 0.5) | (na > 0.40) | (m < 0.05)
    large = (n >= LARGE_TOKENS) & ~bad
    clean = (na < 0.30) & (F.col("duplicate_line_fraction") < 0.15) & (m > 0.15)
    reason = F.when(large, "gros_document_extraction_saine").when(bad, "extraction_degradee").when(clean, "signaux_propres").otherwise("cas_limite")
    return df.withColumn("reason", reason).withColumns(
        {"route": F.when(F.col("reason").isin("extraction_degradee", "signaux_propres"), "light").otherwise("full"), "reason_text": _text(pc, na, m, n)}
    )


def _text(pc: Column, na: Column, m: Column, n: Column) -> Column:
    s = lambda c: c.cast("string")
    measured = F.concat(F.lit("parse_confidence="), s(pc), F.lit(", non_alpha="), s(na), F.lit(", mattr="), s(m), F.lit(")"))
    return (
        F.when(F.col("reason") == "gros_document_extraction_saine", F.concat(F.lit("gros_document_extraction_saine (n_tokens="), s(n), F.lit(", "), measured))
        .when(F.col("reason") == "extraction_degradee", F.concat(F.lit("extraction_degradee ("), measured))
        .otherwise(F.col("reason"))
    )
