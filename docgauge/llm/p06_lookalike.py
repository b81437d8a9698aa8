"""Problem 6: one form for texts that look alike but are stored in other characters.

Look-alike letters, full-width forms, ligatures, odd spaces and unseen characters are mapped with built-in string
functions; composed and decomposed accents become equal under the accent- and case-sensitive collation UNICODE, which
groups the mapped values in SQL. Each class has one canonical member (fewest odd characters, then smallest digest),
joined back to all members.

Whole texts are not shuffled for all rows: a coarse key that equal-looking texts must share (hashes of the ASCII characters
that carry no combining mark, and of the base letters of all others) finds the keys with more than one stored form, and only
their distinct forms enter the collated grouping. Exact copies count as one form by digest before that, so a hot text costs one row per
task. Null and blank texts belong to no class and come out unchanged. Nulls in other columns don't matter; extra columns
are not read.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.functions.rows import dealt
from docgauge.functions.text import is_blank
from docgauge.llm.lookalike import HIDDEN, LIGATURES, visible
from docgauge.session import cut

COLLATION = "UNICODE"
#: Members of a class that meet in one task.
BLOCK = 1024


def drawn(c: Column) -> Column:
    """Text as drawn, with one kind of line end."""
    shown = F.when(c.rlike(HIDDEN), visible(c)).otherwise(c)
    return F.regexp_replace(shown, r"\r\n?", "\n")


def _bases() -> tuple[str, str]:
    """Characters that canonical decomposition changes, and the first character of each decomposition."""
    chars = [chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    pairs = [(c, d[0]) for c in chars if (d := unicodedata.normalize("NFD", c)) != c]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


COMPOSED, BASES = _bases()


def coarse_key(form: Column) -> Column:
    """Hash that canonically equivalent texts share, of two parts: the ASCII characters that bear no combining mark, and the
    base letters of all others in order. So texts of other scripts than the Latin one have keys of their own as well."""
    marked = form.rlike(r"\p{M}")
    plain = F.when(marked, F.regexp_replace(form, r"\P{M}\p{M}+|[^\x21-\x7e]", "")).otherwise(F.regexp_replace(form, r"[^\x21-\x7e]+", ""))
    others = F.when(marked, F.regexp_replace(form, r"[\x00-\x7f](?!\p{M})", "")).otherwise(F.regexp_replace(form, r"[\x00-\x7f]+", ""))
    # Marks, and the vowels and finals of Hangul syllables, are what a composed character leaves out.
    base = F.regexp_replace(F.translate(others, COMPOSED, BASES), r"[\p{M}\x{1160}-\x{11ff}]+", "")
    return F.xxhash64(plain, base)


def odd_characters(c: Column) -> Column:
    """Characters of a stored text that its drawn form changes or that are combining marks."""
    ligatures = "".join(LIGATURES)
    return F.length(F.regexp_replace(c, rf"[\x00-\x7f]|(?!\p{{M}})[\p{{IsLatin}}&&[^{ligatures}！-～]]|[–—‘’“”«»€°•…]", ""))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "markdown") -> tuple[DataFrame, DataFrame]:
    """(members, forms): members(key, digest, canonical) of classes with several stored forms; forms(digest, canonical, form)."""
    full = docs.where(~is_blank(F.col(text))).select(F.col(key).alias("doc_id"), F.md5(text).alias("digest"), drawn(F.col(text)).alias("form"), odd_characters(F.col(text)).alias("odd"))
    full = full.withColumn("coarse", coarse_key(F.col("form")))
    narrow = cut(full.select("doc_id", "digest", "coarse"))
    several = narrow.groupBy("coarse").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("coarse")
    forms = cut(full.join(several, "coarse", "left_semi").groupBy("coarse", "digest").agg(F.any_value("form").alias("form"), F.min("odd").alias("odd")))
    collated = forms.withColumn("c", F.collate("form", COLLATION))
    best = collated.groupBy("coarse", "c").agg(F.min_by("digest", F.struct("odd", "digest")).alias("canonical"), F.count(F.lit(1)).alias("n_forms")).where("n_forms > 1")
    mapped = cut(collated.join(best, ["coarse", "c"]).select("digest", "canonical", "form"))
    members = narrow.select("doc_id", "digest").join(mapped.select("digest", "canonical"), "digest")
    return members, mapped


def consistent_form(docs: DataFrame, key: str = "doc_id", text: str = "markdown") -> DataFrame:
    """One row per row of ``docs``: key, class (null if alone) and the consistent form of its text."""
    _, forms = classes(docs, key, text)
    of = forms.select(F.col("digest").alias("_d"), "canonical")
    canon = forms.where("digest = canonical").select(F.col("canonical").alias("_c"), F.col("form").alias("_f"))
    out = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_t")).withColumn("_d", F.md5("_t"))
    out = out.join(of, "_d", "left").join(canon, F.col("canonical") == F.col("_c"), "left")
    return out.select("doc_id", F.col("canonical").alias("class_id"), F.when(is_blank(F.col("_t")), F.col("_t")).otherwise(F.coalesce("_f", drawn(F.col("_t")))).alias("form"))


def class_members(docs: DataFrame) -> DataFrame:
    """One row per document in a class of several stored forms, with the class id and the size of the class."""
    members, _ = classes(docs)
    size = members.groupBy("canonical").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return members.join(size, "canonical").select("doc_id", F.col("canonical").alias("class_id"), "n_docs", "first_doc")


def blocks_form(docs: DataFrame) -> DataFrame:
    """One row per block: document, number, kind and the consistent form of its text (null and blank text unchanged)."""
    each = docs.select("doc_id", F.posexplode_outer("blocks").alias("block_no", "b")).select(F.struct("doc_id", "block_no", F.col("b.kind").alias("kind")).alias("block"), F.col("b.text").alias("text"))
    return consistent_form(each, "block", "text").select("doc_id.doc_id", "doc_id.block_no", "doc_id.kind", "form")


def found(docs: DataFrame) -> DataFrame:
    """p6_found: (doc_id_a, doc_id_b), smaller first, of documents stored differently in one class."""
    members, _ = classes(docs)
    members = cut(members.distinct())
    # A class of more than BLOCK members is dealt into blocks; each two blocks meet in a task of their own.
    parted = dealt(members, ["canonical"], "doc_id", BLOCK)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    a = parted.select(F.col("doc_id").alias("doc_id_a"), F.col("digest").alias("da"), "canonical", F.col("part").alias("i"), every.alias("j"))
    b = parted.select(F.col("doc_id").alias("doc_id_b"), F.col("digest").alias("db"), "canonical", F.col("part").alias("j"), every.alias("i"))
    return a.join(b, ["canonical", "i", "j"]).where("doc_id_a < doc_id_b and da <> db").select("doc_id_a", "doc_id_b").distinct()
