"""Problem 1: text statistics of a document and its text type by weak supervision.

Statistics are built-in column expressions. Each statistic is banded into a noisy labelling function with three
outcomes. The accuracies of the functions are learned by expectation-maximization from their agreements over the
whole corpus: only the histogram of vote patterns (at most 3^10 rows, whatever the corpus) reaches the driver. The
posterior of each pattern goes back to the documents by a broadcast join of that bounded table.

Null, empty and white-space-only text gets zero counts, null shares and the type ``blank``; repeated rows are kept as
they are; extra columns pass through ``text_types`` untouched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.llm.em import dawid_skene
from docgauge.llm.lexicon import COMMON
from docgauge.llm.lookalike import HIDDEN, visible
from docgauge.session import cut

KINDS = ("prose", "list", "table", "junk")

# Line patterns, Java syntax. A marked item has a bullet, number, letter or check box before its text.
MARKED = r"^\s*(?:[-*+•‣◦▪–—]|\[[ xX]?\]|\(?\d{1,4}[.)]|\(\d{1,4}\)|\(?[a-zA-Z][.)])\s+\S"
# Notations of table rows: a substring that a cheap test looks for, and the pattern of a row that has it.
TABLES = [
    ("|", r"^\s*\|.*\||\S\s*\|\s.*\S"),
    ("\t", r"\t\s*\S"),
    ("   ", r"\S {3,}\S"),
    ('"', r"^\s*\".*\"\s*[,;]\s*\".*\""),
    (";", r"[^\s;];[^\s;][^;]*;\S|[\p{L}\p{N}%€];[\p{L}\p{N}\-][^;.]{0,40}$"),
    ("---", r"^[\s|:+-]*---[\s|:+-]*$"),
    ("<t", r"</?t[dr]\b"),
]
HEADING = r"^\s{0,3}#{1,6}\s"
# Vowels with and without accents.
VOWELS = "aeiouyAEIOUYœ" + "".join(chr(x) for a, b in ("àæ", "èï", "òö", "ùý", "ÀÆ", "ÈÏ", "ÒÖ", "ÙÝ") for x in range(ord(a), ord(b) + 1))
# Glyph codes of the extractor.
CID = r"\(cid:\d+\)"


def _is_row(line: Column) -> Column:
    """True for a table row in any of the notations."""
    out = F.lit(False)
    for mark, pattern in TABLES:
        out = out | (line.contains(mark) & line.rlike(pattern))
    return out


def _line_class() -> Column:
    """Class of one line: blank, heading, table row, item, running text or debris."""

    def of(line: Column) -> Column:
        n = F.length(line)
        words = F.regexp_count(line, F.lit(r"\p{L}{2,}"))
        # Debris: no run of three letters, once the extractor's glyph codes are gone.
        shaped = F.when(line.contains("(cid:"), F.regexp_replace(line, CID, "")).otherwise(line).rlike(r"\p{L}{3}")
        return (
            F.when(~line.rlike(r"[^\s\x{a0}\x{2000}-\x{200a}\x{3000}]"), F.lit("b"))
            .when(line.rlike(HEADING), F.lit("h"))
            .when(_is_row(line), F.lit("t"))
            .when(line.rlike(MARKED) & (words <= 10), F.lit("i"))
            .when(~shaped, F.lit("x"))
            .when((n <= 48) & ~line.rlike(r"[.!?:,]\s*$") & (words <= 8), F.lit("s"))
            .otherwise(F.lit("p"))
        )

    return of


def with_statistics(df: DataFrame, text: str = "markdown", prefix: str = "") -> DataFrame:
    """Add the statistics of ``text`` as columns named ``prefix`` + name.

    n_chars, n_words, mean_word_len (letters per run of letters), symbol_ratio, odd_symbol_ratio (without the
    separators of tables and sentences), vowel_ratio, common_share, punct_line_share, n_lines,
    mean_line_words, and the characters in prose, item, short and table lines.
    """
    p = lambda name: f"{prefix}{name}"
    stored = F.coalesce(F.col(text), F.lit(""))
    # Projections of their own: the drawn text and its words are computed once.
    df = df.withColumn(p("_c"), F.when((F.length(stored) < F.octet_length(stored)) & stored.rlike(HIDDEN), visible(stored)).otherwise(stored))
    c = F.col(p("_c"))
    df = df.withColumn(p("_w"), F.split(F.lower(c), r"[^\p{L}\p{N}_]+"))
    df = df.withColumns({p("_s"): F.regexp_replace(c, r"[\p{L}\p{N}\s\x{a0}]+", ""), p("_a"): F.regexp_replace(c, r"\P{L}+", "")})
    w = F.col(p("_w"))
    of = _line_class()
    lines = F.transform(F.split(c, r"\r\n|[\n\r]", -1), lambda x: F.struct(of(x).alias("k"), F.length(x).alias("n"), F.substring(x, -4, 4).rlike(r"[.!?…:;]['»”\")]*\s*$").cast("int").alias("e")))
    zero = F.struct(*[F.lit(0).alias(k) for k in ("p", "i", "s", "t", "x", "h", "n", "e")])

    def add(acc: Column, x: Column) -> Column:
        got = [(acc[k] + F.when(x["k"] == k, x["n"]).otherwise(0)).alias(k) for k in ("p", "i", "s", "t", "x", "h")]
        full = x["k"] != "b"
        return F.struct(*got, (acc["n"] + full.cast("int")).alias("n"), (acc["e"] + F.when(full, x["e"]).otherwise(0)).alias("e"))

    step = df.withColumns(
        {
            p("_l"): F.aggregate(lines, zero, add),
            p("n_chars"): F.length(c),
            p("n_words"): F.size(w) - (w[0] == "").cast("int") - ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int"),
            p("_letters"): F.length(p("_a")),
            p("_symbols"): F.length(p("_s")),
            p("_odd"): F.length(F.regexp_replace(p("_s"), r"[|\",;:.%€'’()-]+", "")),
            p("_vowels"): F.length(c) - F.length(F.translate(c, VOWELS, "")),
            p("_common"): F.size(F.filter(w, lambda x: x.isin(COMMON))),
            p("_glyphs"): F.when(c.contains("(cid:"), F.length(c) - F.length(F.regexp_replace(c, CID, ""))).otherwise(0),
            p("_mixed"): F.regexp_count(c, F.lit("[a-z][A-Z]|[0-9][A-Za-z]|[A-Za-z][0-9]")),
            p("_long"): F.regexp_count(c, F.lit(r"\p{L}{4,}")),
            p("_runs"): F.regexp_count(c, F.lit(r"\p{L}+")),
        }
    ).drop(*[p(x) for x in ("_c", "_w", "_s", "_a")])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    body = F.col(p("_l.p")) + F.col(p("_l.i")) + F.col(p("_l.s")) + F.col(p("_l.t")) + F.col(p("_l.x"))
    return step.withColumns(
        {
            p("mean_word_len"): share(p("_letters"), p("_runs")),
            p("symbol_ratio"): share(p("_symbols"), p("n_chars")),
            p("odd_symbol_ratio"): share(p("_odd"), p("n_chars")),
            p("long_word_share"): share(p("_long"), p("_runs")),
            p("vowel_ratio"): share(p("_vowels"), p("_letters")),
            p("common_share"): share(p("_common"), p("n_words")),
            p("glyph_share"): share(p("_glyphs"), p("n_chars")),
            p("mixed_share"): share(p("_mixed"), p("n_words")),
            p("n_lines"): F.col(p("_l.n")),
            p("punct_line_share"): share(p("_l.e"), p("_l.n")),
            p("mean_line_words"): share(p("n_words"), p("_l.n")),
            p("prose_share"): F.when(body > 0, F.col(p("_l.p")) / body),
            p("list_share"): F.when(body > 0, (F.col(p("_l.i")) + F.col(p("_l.s"))) / body),
            p("table_share"): F.when(body > 0, F.col(p("_l.t")) / body),
            p("debris_share"): F.when(body > 0, F.col(p("_l.x")) / body),
        }
    ).drop(*[p(x) for x in ("_l", "_letters", "_symbols", "_vowels", "_common", "_glyphs", "_mixed", "_odd", "_runs", "_long")])


def _band(c: Column, low: float, high: float) -> Column:
    return F.when(c < low, 0).when(c > high, 2).otherwise(1)


#: Labelling functions: name, (statistic, low, high), and the starting belief of P(outcome | prose, list, table, junk).
FUNCTIONS = [
    ("prose_share", (0.35, 0.65), ([0.03, 0.95, 0.95, 0.7], [0.07, 0.04, 0.04, 0.1], [0.9, 0.01, 0.01, 0.2])),
    ("list_share", (0.35, 0.6), ([0.95, 0.02, 0.95, 0.8], [0.04, 0.08, 0.04, 0.1], [0.01, 0.9, 0.01, 0.1])),
    ("table_share", (0.35, 0.6), ([0.97, 0.97, 0.03, 0.8], [0.02, 0.02, 0.07, 0.1], [0.01, 0.01, 0.9, 0.1])),
    ("common_share", (0.06, 0.2), ([0.02, 0.2, 0.8, 0.95], [0.08, 0.6, 0.15, 0.04], [0.9, 0.2, 0.05, 0.01])),
    ("odd_symbol_ratio", (0.05, 0.15), ([0.97, 0.9, 0.9, 0.25], [0.02, 0.09, 0.09, 0.25], [0.01, 0.01, 0.01, 0.5])),
    ("vowel_ratio", (0.28, 0.6), ([0.02, 0.03, 0.05, 0.9], [0.97, 0.96, 0.94, 0.07], [0.01, 0.01, 0.01, 0.03])),
    ("mean_word_len", (2.6, 8.5), ([0.02, 0.02, 0.35, 0.5], [0.97, 0.97, 0.64, 0.25], [0.01, 0.01, 0.01, 0.25])),
    ("long_word_share", (0.15, 0.3), ([0.01, 0.01, 0.02, 0.6], [0.04, 0.04, 0.08, 0.1], [0.95, 0.95, 0.9, 0.3])),
    ("punct_line_share", (0.12, 0.35), ([0.1, 0.6, 0.9, 0.7], [0.3, 0.3, 0.08, 0.2], [0.6, 0.1, 0.02, 0.1])),
    ("mixed_share", (0.15, 0.5), ([0.97, 0.95, 0.7, 0.5], [0.02, 0.04, 0.29, 0.2], [0.01, 0.01, 0.01, 0.3])),
]


def votes(df: DataFrame) -> DataFrame:
    """Add ``votes``: one digit per labelling function; null for blank text."""
    digits = [_band(F.coalesce(F.col(name), F.lit(0.0)), low, high).cast("string") for name, (low, high), _ in FUNCTIONS]
    return df.withColumn("votes", F.when(F.col("n_words") + F.col("symbol_ratio") > 0, F.concat(*digits)))


def fit(df: DataFrame) -> tuple[list[tuple], np.ndarray]:
    """Posterior rows (votes, prose, list, table, junk) and the learned tables, from all rows of ``df``."""
    got = df.where(F.col("votes").isNotNull()).groupBy("votes").count().collect()  # at most 3^len(FUNCTIONS) rows
    got.sort(key=lambda r: r["votes"])
    patterns = np.array([[int(x) for x in r["votes"]] for r in got], dtype=int).reshape(-1, len(FUNCTIONS))
    counts = np.array([r["count"] for r in got], dtype=float)
    lean = np.array([f[2] for f in FUNCTIONS], dtype=float)
    post, tables, _ = dawid_skene(patterns, counts, lean)
    return [(r["votes"], *map(float, x)) for r, x in zip(got, post)], tables


def text_types(df: DataFrame, key: str = "doc_id", text: str = "markdown") -> DataFrame:
    """One row per row of ``df``: key, statistics, posterior of each type and ``text_type``."""
    stats = cut(votes(with_statistics(df.select(key, text), text)).drop(text))
    rows, _ = fit(stats)
    spark = df.sparkSession
    post = spark.createDataFrame(rows, "votes string, " + ", ".join(f"post_{k} double" for k in KINDS))
    best = F.greatest(*[F.col(f"post_{k}") for k in KINDS])
    kind = F.lit(None).cast("string")
    for k in reversed(KINDS):
        kind = F.when(F.col(f"post_{k}") == best, F.lit(k)).otherwise(kind)
    return stats.join(F.broadcast(post), "votes", "left").withColumn("text_type", F.when(F.col("votes").isNull(), "blank").otherwise(kind)).drop("votes")


def found(df: DataFrame) -> DataFrame:
    """p1_found: (doc_id, kind) of the documents most of whose text is not running prose.

    The type is the posterior's; the exact check after it asks that running prose holds at most half of the text.
    """
    t = text_types(df)
    most = (F.col("text_type") == "junk") | (F.col("prose_share") <= 0.5)
    return t.where(F.col("text_type").isin("list", "table", "junk") & most).select("doc_id", F.col("text_type").alias("kind")).distinct()
