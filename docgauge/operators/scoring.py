"""Weighted dimension and global scores, coverage, levels, flags, and the three report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coverage under which a document is flagged.
COVERAGE_BELOW = 0.7


def _tenths(num: Column, den: Column) -> Column:
    """num / den in tenths, half up, by whole numbers."""
    return F.call_function("div", 2 * num + den, 2 * den)


def level(pct: Column) -> Column:
    return F.when(pct >= 90, "Excellent").when(pct >= 70, "Acceptable").when(pct >= 50, "Insuffisant").otherwise("Inadapté")


def dimension_scores(scores: DataFrame, scale_max: int = 5) -> DataFrame:
    """Per cent per (doc_id, dimension) in tenths: weighted score over weighted maximum of the scored criteria."""
    ok = scores.where((F.col("status") == "scored") & F.col("score").isNotNull())
    w = F.col("weight").cast("bigint")
    g = ok.groupBy("doc_id", "dimension").agg(F.sum(w * F.col("score")).alias("num"), F.sum(w).alias("w"))
    return g.where("w > 0").select("doc_id", "dimension", _tenths(F.col("num") * 1000, F.col("w") * scale_max).alias("tenths"))


def doc_scores(scores: DataFrame, weights: dict[str, int], docs: DataFrame, scale_max: int = 5, coverage_below: float = COVERAGE_BELOW) -> DataFrame:
    """One row per document: global_pct, level, coverage_pct, dimensions and the score flags.

    The global value weighs the dimensions' rounded values, as they are shown; a document without any has 0. ``docs``
    has doc_id and parse_confidence. Criteria outside the grid must not be in ``scores``.
    """
    dims = dimension_scores(scores, scale_max)
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
    w = F.try_element_at(table, F.col("dimension"))
    g = dims.withColumn("w", w).where("w is not null").groupBy("doc_id").agg(
        _tenths(F.sum(F.col("w") * F.col("tenths")), F.sum("w")).alias("g"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", (F.col("tenths") / 10.0).alias("pct"))))).alias("dimensions"),  # one entry a dimension
    )
    cover = scores.groupBy("doc_id").agg(
        F.count_if((F.col("status") == "scored") & F.col("score").isNotNull()).alias("n_scored"),
        F.count_if(F.col("status") == "not_evaluated").alias("n_not"),
    )
    n = F.coalesce("n_scored", F.lit(0)) + F.coalesce("n_not", F.lit(0))
    coverage = F.when(n > 0, _tenths(F.col("n_scored") * 1000, n) / 10.0).otherwise(100.0)
    j = docs.select("doc_id", "parse_confidence").join(g, "doc_id", "left").join(cover, "doc_id", "left")
    j = j.withColumns({"global_pct": F.coalesce(F.col("g") / 10.0, F.lit(0.0)), "coverage_pct": coverage})
    flags = F.filter(
        F.array(
            F.when(F.col("coverage_pct") < coverage_below * 100, F.lit("low_coverage")),
            F.when(F.coalesce("parse_confidence", F.lit(0.0)) < 0.5, F.lit("low_parse_confidence")),
        ),
        lambda x: x.isNotNull(),
    )
    return j.select(
        "doc_id", "global_pct", level(F.col("global_pct")).alias("level"), "coverage_pct",
        F.coalesce("dimensions", F.create_map().cast("map<string,double>")).alias("dimensions"),
        F.array().cast("array<string>").alias("worst_sections"), flags.alias("flags"),
    )


def failed_scores(docs: DataFrame, flag: Column) -> DataFrame:
    """Rows of documents that could not be scored (unreadable, unsupported, error): zero with their flag."""
    return docs.select(
        "doc_id", F.lit(0.0).alias("global_pct"), F.lit("Inadapté").alias("level"), F.lit(0.0).alias("coverage_pct"),
        F.create_map().cast("map<string,double>").alias("dimensions"), F.array().cast("array<string>").alias("worst_sections"), F.array(flag).alias("flags"),
    )


def sanitized(c: Column) -> Column:
    """Text of a report cell: null as empty, and no text that a spreadsheet would run as a formula."""
    return F.when(c.isNull(), "").when(F.substring(c, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), c)).otherwise(c)


def synthesis(scores: DataFrame) -> DataFrame:
    return scores.select("doc_id", F.col("global_pct").alias("score_global_%"), F.col("level").alias("niveau"), F.col("coverage_pct").alias("couverture_%"), F.array_join("flags", "|").alias("flags"))


def detail(criterion_rows: DataFrame) -> DataFrame:
    return criterion_rows.select(
        "doc_id", F.col("id").alias("critere_id"), F.coalesce("label", F.lit("")).alias("critere"), "tag", F.col("weight").alias("poids"), "status", "score", "justification", F.col("evidence").alias("preuve"), "ord"
    )


def remediation(criterion_rows: DataFrame, at_most: int = 2) -> DataFrame:
    """Scored criteria of at most 2: order by doc_id, weight descending, grid order."""
    r = criterion_rows.where((F.col("status") == "scored") & (F.col("score") <= at_most))
    return r.select("doc_id", F.col("id").alias("critere_id"), F.coalesce("label", F.lit("")).alias("critere"), F.col("weight").alias("poids"), F.col("score").alias("score_actuel"), "ord")
