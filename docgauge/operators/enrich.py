"""Image descriptions put into the markdown, and the manual manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.functions import text as tx

# Texts that take the place of an image placeholder.
TAG_OPEN, TAG_CLOSE = "[Image (description automatique, non verifiee): ", "]"
DECORATIVE = "[Image decorative ignoree]"
MIN_SIDE = 24.0
#: Pixels per point of a rendered crop.
SCALE = 2.0


def is_decorative(image: Column, min_side: float = MIN_SIDE) -> Column:
    return ((image["x1"] - image["x0"]) < min_side) | ((image["bottom"] - image["top"]) < min_side)


def pixel_box(image: Column, scale: float = SCALE) -> Column:
    """Crop box in whole pixels."""
    return F.struct(*[(image[c] * scale).cast("int").alias(c) for c in ("x0", "top", "x1", "bottom")])


def images_to_describe(docs: DataFrame, min_side: float = MIN_SIDE) -> DataFrame:
    """One row per image that is large enough, with its box and context."""
    im = docs.select("doc_id", F.explode("images").alias("im")).where(~is_decorative(F.col("im"), min_side))
    context = F.concat(F.lit("page "), F.col("im.page").cast("string"), F.lit("|"), F.col("im.placeholder"))
    return im.select("doc_id", F.col("im.placeholder").alias("placeholder"), F.col("im.page").alias("page"), pixel_box(F.col("im")).alias("box"), context.alias("context"))


def apply_descriptions(docs: DataFrame, described: DataFrame, min_side: float = MIN_SIDE) -> DataFrame:
    """Replace placeholders: decorative images by their mark, described ones by the tagged text.

    ``described``: doc_id, placeholder, description, error. An empty description leaves the placeholder for later; an
    error is written in its place.
    """
    text = F.when(F.col("error").isNotNull(), F.concat(F.lit("[Image non decrite: "), F.col("error"), F.lit("]"))).when(~tx.is_blank(F.col("description")), F.concat(F.lit(TAG_OPEN), tx.strip(F.col("description")), F.lit(TAG_CLOSE)))
    per = described.select("doc_id", "placeholder", text.alias("new")).where("new is not null and placeholder <> ''").groupBy("doc_id").agg(F.collect_list(F.struct("placeholder", "new")).alias("_r"))  # the images of one document
    none = F.array().cast("array<struct<placeholder:string,new:string>>")
    small = F.transform(F.filter(F.coalesce("images", F.array()), lambda i: is_decorative(i, min_side)), lambda i: F.struct(i["placeholder"].alias("placeholder"), F.lit(DECORATIVE).alias("new")))
    swaps = F.concat(F.coalesce(small, none), F.coalesce("_r", none))
    return docs.join(per, "doc_id", "left").withColumn("markdown", F.aggregate(swaps, F.col("markdown"), lambda md, x: F.replace(md, x["placeholder"], x["new"]))).drop("_r")
