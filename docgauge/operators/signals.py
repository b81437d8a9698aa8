"""Per-document text signals as built-in column expressions.

Every ratio is kept as integer numerator and denominator and rounded half up with integer arithmetic, so that results
agree to the last digit with any SQL engine. Null text counts as empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.functions import text as tx

#: Tokens of a window of the segmental type-token ratio.
WINDOW = 1000
#: Lines shorter than this, and lines that occur more often, are no content duplicates.
CONTENT_LINE, BOILERPLATE = 15, 3
GLYPH = r"\(cid:\d+\)|\ufffd"
AUTO_DESCRIPTION = "[Image (description automatique, non verifiee"


def with_counts(df: DataFrame, text: str = "markdown") -> DataFrame:
    """Add ``c``, a struct of the integer counts behind all signals.

    Tokens and lines are computed once, in a projection of their own below the counts.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = df.withColumns({"_t": t, "_tk": tx.tokens(t), "_ln": tx.lines(t)})
    n, tk, ln = F.size("_tk"), F.col("_tk"), F.col("_ln")
    windows = F.transform(F.sequence(F.lit(0), F.call_function("div", n, F.lit(WINDOW)).cast("int") - 1), lambda i: F.size(F.array_distinct(F.slice(tk, i * WINDOW + 1, WINDOW))))
    seg = F.when(n >= WINDOW, F.aggregate(windows, F.lit(0), lambda a, v: a + v)).otherwise(0)
    sentences = F.filter(F.split("_t", "[.!?]+", -1), lambda q: ~tx.is_blank(q))
    words = F.aggregate(F.transform(sentences, lambda q: F.regexp_count(q, F.lit(r"(?U)[^\s\x1c-\x1f]+"))), F.lit(0), lambda a, v: a + v)
    # Content duplicates: sorted lines make equal lines neighbours, so one pass counts the runs of each.
    big = F.array_sort(F.filter(ln, lambda x: F.length(x) >= CONTENT_LINE))
    zero = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("kept"), F.lit(0).alias("dup"))

    def close(a: Column) -> tuple[Column, Column]:
        ok = a["run"] <= BOILERPLATE
        return a["kept"] + F.when(ok, a["run"]).otherwise(0), a["dup"] + F.when(ok & (a["run"] > 0), a["run"] - 1).otherwise(0)

    def step(a: Column, x: Column) -> Column:
        kept, dup = close(a)
        same = a["last"].eqNullSafe(x)
        return F.struct(
            x.alias("last"), F.when(same, a["run"] + 1).otherwise(1).alias("run"),
            F.when(same, a["kept"]).otherwise(kept).alias("kept"), F.when(same, a["dup"]).otherwise(dup).alias("dup"),
        )

    runs = F.aggregate(big, zero, step, lambda a: F.struct(close(a)[0].alias("kept"), close(a)[1].alias("dup")))
    counts = base.withColumn("_runs", runs).withColumn(
        "c",
        F.struct(
            F.length("_t").alias("len"),
            F.length(F.regexp_replace("_t", r"\P{L}+", "")).alias("alpha"),
            (F.length("_t") - F.length(F.regexp_replace("_t", GLYPH, ""))).alias("cid"),
            n.alias("n_tok"), F.size(F.array_distinct(tk)).alias("u_tok"), seg.alias("seg_u"),
            F.size("_ln").alias("n_line"), F.size(F.array_distinct(ln)).alias("u_line"),
            F.col("_runs.kept").alias("kept"), F.col("_runs.dup").alias("dup"),
            F.size(sentences).alias("n_sent"), words.alias("n_word"),
            F.size(F.filter(ln, lambda x: x.endswith("?"))).alias("q_line"),
            F.call_function("div", F.length("_t") - F.length(F.replace(F.col("_t"), F.lit(AUTO_DESCRIPTION), F.lit(""))), F.lit(len(AUTO_DESCRIPTION))).cast("int").alias("auto_desc"),
        ),
    )
    return counts.drop("_t", "_tk", "_ln", "_runs")


def signals(df: DataFrame, text: str = "markdown", blocks: str | None = "blocks") -> DataFrame:
    """Add the seven signals, the glyph-code share and the content duplicates as columns; drops ``c``."""
    d = with_counts(df, text)
    c = lambda k: F.col(f"c.{k}")
    window_total = F.call_function("div", c("n_tok"), F.lit(WINDOW)) * WINDOW
    out = {
        "non_alpha_fraction": tx.ratio(c("len") - c("alpha"), c("len"), 4, 1.0),
        "mean_words_per_sentence": tx.ratio(c("n_word"), c("n_sent"), 2, 0.0),
        "duplicate_line_fraction": tx.ratio(c("n_line") - c("u_line"), c("n_line"), 4, 0.0),
        "type_token_ratio": tx.ratio(c("u_tok"), c("n_tok"), 4, 0.0),
        "mattr": F.when(c("n_tok") < WINDOW, tx.ratio(c("u_tok"), c("n_tok"), 4, 0.0)).otherwise(tx.ratio(c("seg_u"), window_total, 4, 0.0)),
        "n_tokens": c("n_tok"),
        "cid_fraction": tx.ratio(c("cid"), c("len"), 4, 0.0),
        "content_duplicates": tx.ratio(c("dup"), c("kept"), 4, 0.0),
        "question_lines": c("q_line"),
        "auto_descriptions": c("auto_desc"),
    }
    if blocks:
        b = F.coalesce(F.col(blocks), F.array())
        out["block_integrity"] = tx.ratio(F.size(F.filter(b, lambda x: ~tx.is_blank(x["text"]))), F.size(b), 4, 0.0)
    return d.withColumns(out).drop("c")


def parse_confidence(text: Column, blocks: Column, pages: Column, cid: Column, fallback: Column) -> Column:
    """Confidence of an extraction: length and filled blocks, capped for thin pages and fallbacks, less glyph codes.

    ``cid`` is the glyph share in four digits. Thousandths come from whole numbers, rounded half up.
    """
    n, size = F.length(text).cast("bigint"), F.size(F.coalesce(blocks, F.array())).cast("bigint")
    per = F.greatest(size, F.lit(1).cast("bigint"))
    filled = F.when(size > 0, F.size(F.filter(blocks, lambda b: ~tx.is_blank(b["text"]))).cast("bigint")).otherwise(1)
    # In parts of 1000 * per.
    conf = F.least(F.lit(500).cast("bigint"), n) * per + 500 * filled
    conf = F.when((pages > 0) & (n < 200 * pages), F.least(conf, 400 * per)).otherwise(conf)
    conf = F.when(fallback, F.least(conf, 600 * per)).otherwise(conf)
    kept = F.lit(10000).cast("bigint") - F.round(cid * 10000).cast("bigint")
    thousandths = F.call_function("div", 2 * conf * kept + per * 10000, per * 20000)
    return F.when(tx.is_blank(text), 0.0).otherwise(thousandths / 1000.0)
