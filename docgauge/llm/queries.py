"""Registered queries of the training-data problems, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.llm import p01_text_type as p1
from docgauge.llm import p02_language as p2
from docgauge.llm import p03_repetition as p3
from docgauge.llm import p04_mojibake as p4
from docgauge.llm import p05_pairs as p5
from docgauge.llm import p06_lookalike as p6
from docgauge.llm import p07_split as p7
from docgauge.llm import p08_packing as p8
from docgauge.llm import p09_mixing as p9
from docgauge.llm import p10_truncated as p10
from docgauge.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


def _p2_segments(docs: DataFrame) -> DataFrame:
    return p2.language_segments(docs, p2.train(docs))


def _p2_documents(docs: DataFrame) -> DataFrame:
    return p2.document_languages(docs, p2.train(docs)).withColumn("langs", F.array_join("langs", ","))


def _p4_repaired(docs: DataFrame) -> DataFrame:
    return p4.repair(docs, p4.train(docs)).where("garbled")


def queries() -> dict[str, Query]:
    return {
        "p1_found": _on("docs", p1.found),
        "p1_statistics": _on("docs", lambda d: p1.with_statistics(d.select("doc_id", "markdown")).drop("markdown")),
        "p1_types": _on("docs", p1.text_types),
        "p2_found": _on("docs", p2.found),
        "p2_segments": _on("docs", _p2_segments),
        "p2_documents": _on("docs", _p2_documents),
        "p3_method": _on("docs", p3.method),
        "p3_found": _on("docs", p3.found),
        "p3_share": _on("docs", lambda d: p3.repeated_share(d.select("doc_id", "markdown"))),
        "p4_found": _on("docs", p4.found),
        "p4_repaired": _on("docs", _p4_repaired),
        "p5_found": _on("golden", p5.found),
        "p5_defects": _on("golden", p5.defects),
        "p6_found": _on("docs", p6.found),
        "p6_classes": _on("docs", p6.class_members),
        "p6_forms": _on("docs", p6.consistent_form),
        "p6_blocks": _on("docs", p6.blocks_form),
        "p7_found": _on("docs", p7.found),
        "p7_pieces": _on("docs", p7.pieces),
        "p7_file_pieces": _on("docs", p7.file_query),
        "p8_assignment": _on("documents", p8.pack),
        "p8_containers": _on("documents", p8.containers),
        "p8_token_counts": _on("documents", lambda d: d.select("doc_id", F.coalesce("n_tokens", p8.token_count(F.col("text")).cast("long")).alias("n_tokens"))),
        "p9_mixture": lambda s, d: p9.mixture(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p9_report": lambda s, d: p9.report(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p10_found": _on("documents", p10.found),
        "p10_by_source": _on("documents", p10.by_source),
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the queries whose rows have an exact definition in SQL; the others are tested against brute force."""
    return {
        "p7_found": "SELECT DISTINCT doc_id FROM docs WHERE length(markdown) > 8000",
        "p8_token_counts": r"""
            SELECT doc_id, coalesce(n_tokens, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{00a0}\x{202f}\x{2000}-\x{200a}\x{3000}\x{1c}-\x{1f}\x{85}]+'))) AS n_tokens
            FROM documents""",
    }
