"""The parsed store: markdown and sidecar of each document, read, merged and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.functions import text as tx
from docgauge.sources.files import BLOCK, IMAGE, RAW_ONLY, scan

SCHEMA_VERSION = 1
SIDECAR = ".parse.json"
PROVENANCE = "struct<parser:string,source_name:string,source_type:string,source_sha256:string,source_pages:int,category:string,enriched:boolean>"
SIDECAR_SCHEMA = f"schema_version int, doc_id string, markdown_hash string, parse_confidence double, blocks array<{BLOCK}>, images array<{IMAGE}>, provenance {PROVENANCE}"


def is_parsed_folder(names: list[str]) -> bool:
    """True if file names are those of a parsed store; a folder that holds raw sources as well is refused."""
    sidecars = [n for n in names if n.endswith(SIDECAR)]
    raw = [n for n in names if n.rsplit(".", 1)[-1].lower() in RAW_ONLY]
    if sidecars and raw:
        raise ValueError(f"ambiguous folder: parsed documents ({', '.join(sorted(sidecars)[:3])}) beside raw sources ({', '.join(sorted(raw)[:3])})")
    return bool(sidecars)


def refuse_colliding(triaged: DataFrame) -> None:
    """Raise if two sources share a doc_id, before anything is written."""
    clash = triaged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("a"), F.max("path").alias("b")).where("n > 1").orderBy("doc_id").first()
    if clash:
        raise ValueError(f"two sources would write the same document '{clash['doc_id']}': {clash['a']} and {clash['b']}")


def blocks_from_markdown(markdown: Column, typed: Column) -> Column:
    """Blocks after a hand edit: the typed ones as parsed, then the text paragraphs of the markdown with page 0."""
    kept = F.filter(F.coalesce(typed, F.array().cast(f"array<{BLOCK}>")), lambda b: b["kind"] != "text")
    paragraphs = F.filter(F.transform(F.split(markdown, r"(?:\r?\n){2,}", -1), tx.strip), lambda p: p != "")
    new = F.transform(paragraphs, lambda p: F.struct(F.lit("text").alias("kind"), p.alias("text"), F.lit(0).alias("page"), F.lit(None).cast("string").alias("section")))
    return F.concat(kept, new)


def newest_sidecars(sidecars: DataFrame) -> DataFrame:
    """One sidecar per stem: of rows delivered twice the one with the highest schema version, then the largest hash."""
    rest = [c for c in sidecars.columns if c != "stem"]
    order = F.struct("schema_version", "markdown_hash", "parse_confidence")
    return sidecars.groupBy("stem").agg(F.max_by(F.struct(*rest), order).alias("s")).select("stem", "s.*")


def merge_entries(markdowns: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Full outer merge by file stem into documents with entry flags, in the reference order of flags.

    ``markdowns``: stem, markdown (null where unreadable). ``sidecars``: stem, invalid, and the sidecar's fields. The
    file name wins over the id that the sidecar carries.
    """
    s = sidecars.select("stem", F.lit(True).alias("_side"), "invalid", "schema_version", F.col("doc_id").alias("_sid"), "markdown_hash", "parse_confidence", "blocks", "images", "provenance")
    j = markdowns.select("stem", "markdown", F.lit(True).alias("_md")).join(s, "stem", "full")
    gone = F.col("_md").isNull()
    usable = F.col("_side").isNotNull() & ~F.coalesce("invalid", F.lit(False))
    edited = usable & ~F.coalesce(F.sha2("markdown", 256) == F.col("markdown_hash"), F.lit(False))
    none = F.array().cast(f"array<{BLOCK}>")
    flags = F.filter(
        F.array(
            F.when(gone, "missing_markdown"),
            F.when(~gone & F.col("_side").isNull(), "missing_sidecar"),
            F.when(~gone & F.coalesce("invalid", F.lit(False)), "invalid_sidecar"),
            F.when(~gone & usable & (F.col("schema_version") > SCHEMA_VERSION), F.concat(F.lit("sidecar_schema_unsupported:"), F.col("schema_version").cast("string"))),
            F.when(~gone & edited, "manually_edited"),
            F.when(~gone & usable & (F.coalesce("_sid", F.lit("")) != "") & (F.col("_sid") != F.col("stem")), F.concat(F.lit("renamed:"), F.col("_sid"))),
        ),
        lambda x: x.isNotNull(),
    )
    blocks = F.when(gone, F.coalesce("blocks", none)).when(~usable, blocks_from_markdown(F.col("markdown"), none)).when(edited, blocks_from_markdown(F.col("markdown"), F.col("blocks"))).otherwise(F.coalesce("blocks", none))
    return j.select(
        F.col("stem").alias("doc_id"), F.coalesce("markdown", F.lit("")).alias("markdown"), blocks.alias("blocks"),
        F.coalesce(F.when(usable, F.col("parse_confidence")), F.lit(0.0)).alias("parse_confidence"),
        F.coalesce(F.when(usable, F.col("images")), F.array().cast(f"array<{IMAGE}>")).alias("images"), flags.alias("entry_flags"),
        F.coalesce(F.when(usable, F.col("provenance.source_type")), F.lit("md")).alias("type"),
        F.when(usable, F.col("provenance.source_pages")).alias("pages"), F.coalesce(F.when(usable, F.col("provenance.category")), F.lit("parsed")).alias("category"),
    )


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a parsed store in a folder, orphan sidecars included."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*" + SIDECAR).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    side = raw.where(F.col("path").endswith(SIDECAR)).select(F.regexp_replace(name, r"\.parse\.json$", "").alias("stem"), F.decode(F.col("content"), "UTF-8").alias("js"))
    parsed = side.withColumn("d", F.from_json("js", SIDECAR_SCHEMA + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    sidecars = parsed.select("stem", (F.col("d").isNull() | F.col("d._corrupt_record").isNotNull() | F.col("d.markdown_hash").isNull()).alias("invalid"), "d.*").drop("_corrupt_record")
    md = scan(spark, folder, ("md",)).select(F.col("doc_id").alias("stem"), F.make_valid_utf8(F.col("content").cast("string")).alias("markdown"))
    return merge_entries(md, sidecars)


def stored_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of a store that have both files: doc_id, source_sha256."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*" + SIDECAR).load(folder)
    name = F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B"))
    sha = F.from_json(F.decode(F.col("content"), "UTF-8"), SIDECAR_SCHEMA)["provenance"]["source_sha256"]
    side = raw.select(F.regexp_replace(name, r"\.parse\.json$", "").alias("doc_id"), sha.alias("source_sha256"))
    return side.join(scan(spark, folder, ("md",)).select("doc_id"), "doc_id", "left_semi")


def plan_parse(triaged: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """What an incremental parse does with each source: write or skip, and whether a skipped source has changed.

    ``existing``: doc_id, source_sha256 of the entries that are present with both files.
    """
    e = existing.select("doc_id", F.col("source_sha256").alias("_h"), F.lit(True).alias("_there"))
    j = triaged.join(e, "doc_id", "left")
    there = F.coalesce("_there", F.lit(False)) & F.lit(not force)
    return j.select(*triaged.columns, F.when(there, "skip").otherwise("write").alias("action"), (there & F.coalesce(F.col("_h") != F.col("hash"), F.lit(False))).alias("source_changed"))
