"""The whole workflows on folders, with their files, counters and refusals: parse, run, golden."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.functions import text as tx
from docgauge.judging.clients import factory
from docgauge.operators import redundancy
from docgauge.plans.run import described, golden_set, parse_folder, parse_planned, plan_folder, score_corpus
from docgauge.session import cut
from docgauge.sinks import paths, reports
from docgauge.sources.files import BATCH_PAGES, scan
from docgauge.sources.grid import Grid, config_hash, load_grid
from docgauge.sources.parsed_store import is_parsed_folder, read_store, stored_sources

#: What a golden answer must keep to where the configuration says nothing.
POLICY = "S'en tenir au document, en citer le passage, et dire 'Non couvert par le document' quand il ne repond pas."


@dataclass
class Parsed:
    """What a parse did. ``plan`` has a row per source: doc_id, action, source_changed."""

    out: str
    n_written: int
    n_skipped: int
    n_changed: int
    errors: DataFrame
    plan: DataFrame
    manifest: str | None = None


@dataclass
class Ran:
    out: str
    report: dict[str, str]
    redundancy: str
    cost: str
    n_docs: int
    n_errors: int
    errors: DataFrame
    manifest: str | None = None


def _pdf_options(config: dict, extractor) -> dict:
    told = config.get("parsing", {})
    return {"extractor": extractor, "batch_pages": int(told.get("batch_pages") or BATCH_PAGES), "parser": told.get("parser", "builtin")}


def _image_client(config: dict) -> tuple[Callable, str | None]:
    """(client of the images, manifest file of the manual provider or None)."""
    vlm = config.get("enrichment", {}).get("vlm") or config.get("llm", {"provider": "mock"})
    return factory(vlm), vlm.get("manifest") if vlm.get("provider") == "manual" else None


def _min_side(config: dict) -> float:
    return float(config.get("enrichment", {}).get("min_side_pts", 24.0))


def parse_into(spark: SparkSession, folder: str, config: dict, out: str, enrich: bool = False, force: bool = False, extractor=None) -> Parsed:
    """Parse a raw folder into a store. Entries that are there are never overwritten unless ``force``; a source that changed
    since is reported. Refused: a parsed folder, an output that is the input, two sources of one name."""
    if is_parsed_folder(paths.names(folder)):
        raise ValueError(f"{folder} holds parsed documents already: nothing to parse")
    if folder.rstrip("/") == out.rstrip("/"):
        raise ValueError("the output folder must not be the source folder")
    paths.make_folder(out)
    existing = stored_sources(spark, out) if paths.names(out) else None
    files, plan = plan_folder(spark, folder, existing, force)
    docs = parse_planned(files, plan, **_pdf_options(config, extractor))
    manifest, errors = None, spark.createDataFrame([], "doc_id string, error string")
    if enrich or config.get("enrichment", {}).get("enabled", False):
        client, manifest = _image_client(config)
        docs, told = described(cut(docs), files, client, _min_side(config), paths.join(out, "images"))
        errors = told.where("error is not null").groupBy("doc_id").agg(F.concat(F.lit("enrichissement: "), F.min("error")).alias("error"))
        manifest = reports.write_manifest(told, manifest) if manifest else None
    reports.write_parsed_store(docs, out)
    n = {r["action"]: (r["n"], r["changed"]) for r in plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.count_if("source_changed").alias("changed")).collect()}
    return Parsed(out, n.get("write", (0, 0))[0], *n.get("skip", (0, 0)), errors, plan.select("doc_id", "action", "source_changed"), manifest)


def _documents(spark: SparkSession, folder: str, config: dict, extractor) -> tuple[DataFrame, bool]:
    """(documents, whether they come from a store) of a raw or a parsed folder."""
    if is_parsed_folder(paths.names(folder)):
        return read_store(spark, folder), True
    return parse_folder(spark, folder, **_pdf_options(config, extractor)), False


def score_into(spark: SparkSession, folder: str, config: dict, out: str, enrich: bool = False, grid: Grid | None = None, encoder=None, extractor=None) -> Ran:
    """Score a raw or parsed folder: a JSON file per document, the reports, the redundancy and the cost file.

    Every document has a row. Images are described before scoring on a raw folder; on a parsed one that is too late and
    only warned of.
    """
    grid = grid or load_grid()
    docs, parsed = _documents(spark, folder, config, extractor)
    paths.make_folder(out)
    enrich, manifest = enrich or config.get("enrichment", {}).get("enabled", False), None
    if enrich and parsed:
        warnings.warn("images are described by parse: enrichment has no effect on a parsed folder", RuntimeWarning, stacklevel=2)
    elif enrich:
        client, manifest = _image_client(config)
        docs, told = described(cut(docs), scan(spark, folder), client, _min_side(config), paths.join(out, "images"))
        manifest = reports.write_manifest(told, manifest) if manifest else None
    if not parsed:
        docs = cut(docs)  # each source file is extracted once; a store is read again instead
    if enrich and not parsed:
        reports.write_enriched(docs, out)
    scored = score_corpus(docs, grid, factory(config.get("llm", {"provider": "mock"})), config)
    rows = cut(scored.doc_scores)
    reports.write_doc_json(rows, scored.criterion_rows, out, config_hash(config, grid.fingerprint))
    report = reports.write_corpus_report(rows, scored.criterion_rows, out)
    alike = redundancy.redundancy_of(docs.join(scored.errors, "doc_id", "left_anti"), encoder)
    same = reports.write_redundancy(*alike, paths.join(out, "corpus_redundancy.json"))
    cost = reports.write_cost(scored.cost, paths.join(out, "cost.json"))
    return Ran(out, report, same, cost, rows.count(), scored.errors.count(), scored.errors, manifest)


def golden_into(spark: SparkSession, folder: str, config: dict, out: str, extractor=None) -> dict[str, str]:
    """Golden questions and answers of a raw or parsed folder as CSV and workbook; unsupported and blank documents give none."""
    told = config.get("golden", {})
    docs = _documents(spark, folder, config, extractor)[0].where("category is null or category <> 'unsupported_format'")
    docs = cut(docs.where(~tx.is_blank(F.col("markdown"))).select("doc_id", "markdown"))
    rows = golden_set(
        docs, factory(config.get("llm", {"provider": "mock"})), told.get("profile", "utilisateur metier"), told.get("policy", POLICY), told.get("n_questions", "auto"),
        k=int(told.get("k", 6)), chunk_chars=int(told.get("chunk_chars", 1000)), overlap=int(told.get("chunk_overlap", 100)), corpus_level=bool(told.get("corpus_level", True)),
    )
    return reports.write_golden(cut(rows), out)
