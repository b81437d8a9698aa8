"""Block inventory and the criteria that don't apply to a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Criteria that need an object: images, tables, formulas, links.
NEEDS = {"images": ("3.1", "3.2", "3.3"), "tables": ("3.4", "3.8", "3.9"), "formulas": ("3.6",), "links": ("3.5",)}


def with_inventory(df: DataFrame, text: str = "markdown", blocks: str = "blocks") -> DataFrame:
    """Add tables, figures, images, formulas, links, sections (counts). Null blocks and kinds count as none."""
    kinds = F.transform(F.coalesce(F.col(blocks), F.array()), lambda b: F.lower(F.coalesce(b["kind"], F.lit(""))))
    has = lambda *names: F.size(F.filter(kinds, lambda k: _any(k, names)))
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns(
        {
            "tables": has("table"),
            "figures": has("figure", "picture"),
            "images_n": has("image", "picture", "figure"),
            "formulas": has("formula", "equation"),
            "links": F.regexp_count(t, F.lit(r"\]\(")) + F.regexp_count(t, F.lit(r"(?<!\]\()https?://")),
            "sections": F.size(F.filter(kinds, lambda k: k.isin("title", "section_header", "heading"))),
        }
    )


def _any(k: Column, names: tuple[str, ...]) -> Column:
    out = k.contains(names[0])
    for n in names[1:]:
        out = out | k.contains(n)
    return out


def na_ids(na_possible: list[str]) -> Column:
    """Sorted ids of criteria without object, among those that the grid allows to be not applicable."""
    count = {"images": "images_n", "tables": "tables", "formulas": "formulas", "links": "links"}
    parts = [F.when(F.col(count[k]) == 0, F.array(*map(F.lit, ids))).otherwise(F.array().cast("array<string>")) for k, ids in NEEDS.items()]
    allowed = F.array(*map(F.lit, na_possible)) if na_possible else F.array().cast("array<string>")
    return F.sort_array(F.array_intersect(F.concat(*parts), allowed))
