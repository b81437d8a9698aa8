"""The three workflows: parse a raw folder, score a corpus, build the reference questions and answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.functions import text as tx
from docgauge.judging.clients import Client, factory
from docgauge.judging.run import answer, describe_files, failed_documents
from docgauge.operators import golden as gq
from docgauge.operators import enrich, inventory, judge, retrieval, rules, scoring, screen, sections, signals
from docgauge.session import cut
from docgauge.sources import files as fs
from docgauge.sources import parsed_store as ps
from docgauge.sources import pdf
from docgauge.sources.grid import Grid


def measured(docs: DataFrame, grid: Grid) -> DataFrame:
    """Documents with signals, inventory, na ids, rule scores and route; every expression is built in."""
    d = signals.signals(docs)
    d = inventory.with_inventory(d).withColumn("na", inventory.na_ids(grid.na_possible))
    return screen.with_route(rules.with_rule_scores(d))


def section_prompts(m: DataFrame, grid: Grid, size: int = 8000, overlap: int | None = None) -> DataFrame:
    """One judge prompt per section of the documents on the full route that have something to judge: doc_id, section_no, prompt."""
    full = m.where("route = 'full'").select("doc_id", "markdown", "na", "d_scores").withColumn("scope", judge.scope(grid.criteria)).where(F.size("scope") > 0)
    s = sections.sections(full, "markdown", size, overlap)
    return s.select("doc_id", "section_no", judge.batch_prompt(F.col("scope"), F.col("section_text"), grid.scale_max).alias("prompt"))


@dataclass
class Scored:
    doc_scores: DataFrame
    criterion_rows: DataFrame
    cost: DataFrame
    errors: DataFrame


def score_corpus(docs: DataFrame, grid: Grid, client: Callable[[], Client] | None = None, config: dict | None = None) -> Scored:
    """Score documents (doc_id, markdown, blocks, parse_confidence; optional category, type, entry_flags).

    Every document gives one row: unsupported and unreadable ones a zero row with their flag, those with a failing
    section a zero row with its error, all others their scores. Flags come in the order score, screen, automatic
    descriptions, entry.
    """
    config = config or {}
    client = client or factory(config.get("llm", {"provider": "mock"}))
    for c, default in (("category", F.lit("text")), ("type", F.lit("md")), ("entry_flags", F.array().cast("array<string>"))):
        if c not in docs.columns:
            docs = docs.withColumn(c, default)
    unsupported = docs.where("category = 'unsupported_format'")
    rest = docs.where("category <> 'unsupported_format' or category is null")
    blank = rest.where(tx.is_blank(F.col("markdown")))
    # Only narrow columns are kept; the texts of the full route are read again where they lie.
    live = rest.where(~tx.is_blank(F.col("markdown")))
    m = cut(measured(live, grid).select("doc_id", "parse_confidence", "na", "d_scores", "route", "reason_text", "auto_descriptions"))
    setting = config.get("judge", {})
    overlap = setting.get("section_overlap", "auto")
    full = live.select("doc_id", "markdown").join(m.where("route = 'full'").select("doc_id", "route", "na", "d_scores"), "doc_id")
    prompts = section_prompts(full, grid, int(setting.get("section_chars", 8000)), None if str(overlap).lower() == "auto" else int(overlap))
    asked = answer(prompts, client)
    verdicts = cut(judge.verdicts_from_json(asked))
    voided = verdicts.where("voids").select("doc_id", F.lit("AttributeError").alias("error"))
    errors = cut(failed_documents(asked).unionByName(voided).groupBy("doc_id").agg(F.min("error").alias("error")))
    ok = m.join(errors, "doc_id", "left_anti")
    spark = docs.sparkSession
    crit = cut(judge.criterion_scores(ok, grid.frame(spark), judge.section_medians(verdicts, grid.scale_max)))
    below = float(config.get("thresholds", {}).get("coverage_flag_below", scoring.COVERAGE_BELOW))
    scored = scoring.doc_scores(crit, grid.weights, ok, grid.scale_max, below)
    extra = ok.select("doc_id", F.filter(F.array(F.when(F.col("route") == "light", F.concat(F.lit("screen:light ("), F.col("reason_text"), F.lit(")"))), F.when(F.col("auto_descriptions") > 0, F.concat(F.lit("auto_descriptions:"), F.col("auto_descriptions").cast("string")))), lambda x: x.isNotNull()).alias("_x"))
    scored = scored.join(extra, "doc_id").withColumn("flags", F.concat("flags", "_x")).drop("_x")
    zero = (
        scoring.failed_scores(unsupported, F.concat(F.lit("unsupported_format:"), F.col("type")))
        .unionByName(scoring.failed_scores(blank, F.lit("unreadable")))
        .unionByName(scoring.failed_scores(errors, F.concat(F.lit("processing_error: "), F.col("error"))))
    )
    flags = docs.select("doc_id", F.coalesce("entry_flags", F.array().cast("array<string>")).alias("_e"))
    rows = scored.unionByName(zero).join(flags, "doc_id").withColumn("flags", F.concat("flags", "_e")).drop("_e")
    calls = judge.judge_cost(asked, F.col("prompt"))
    cost = ok.select("doc_id").join(calls, "doc_id", "left").na.fill(0, ["n_calls", "prompt_chars"])
    return Scored(rows, crit, cost, errors)


def plan_folder(spark: SparkSession, folder: str, existing: DataFrame | None = None, force: bool = False, pdf_counter=pdf.count) -> tuple[DataFrame, DataFrame]:
    """(scanned files, plan): triage of each file with what to do (write or skip) and whether a skipped one has changed.

    Two sources with one name are refused.
    """
    files = fs.scan(spark, folder)
    triaged = cut(fs.triage(files, pdf_counter))
    ps.refuse_colliding(triaged)
    if existing is None:
        existing = spark.createDataFrame([], "doc_id string, source_sha256 string")
    return files, cut(ps.plan_parse(triaged, existing, force))


def parse_planned(files: DataFrame, plan: DataFrame, pdf_readers: list | None = None, extractor: fs.Extractor | None = None, batch_pages: int = fs.BATCH_PAGES, parser: str = "builtin") -> DataFrame:
    """Parsed documents of the planned files that are to be written, with provenance. Unsupported files become empty documents.

    ``extractor``: a heavy extractor of PDF pages, called for ``batch_pages`` pages at a time.
    """
    triaged = plan.where("action = 'write'").drop("action", "source_changed")
    chosen = files.join(triaged.select("path"), "path", "left_semi")
    extracted = fs.extract_pages(chosen, triaged, extractor, batch_pages) if extractor else None
    parsed = fs.with_confidence(fs.parse(chosen, triaged, pdf_readers, extracted))
    direct = F.col("type").isin(*fs.TEXT, *fs.OFFICE)
    prov = triaged.select(
        "doc_id", "category", "type",
        F.struct(
            F.when(direct, "direct").otherwise(parser).alias("parser"), F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B")).alias("source_name"), F.col("type").alias("source_type"),
            F.col("hash").alias("source_sha256"), F.col("pages").alias("source_pages"), "category", F.lit(False).alias("enriched"),
        ).alias("provenance"),
    )
    return parsed.drop("pages").join(prov, "doc_id")


def parse_folder(spark: SparkSession, folder: str, pdf_readers: list | None = None, pdf_counter=pdf.count, existing: DataFrame | None = None, force: bool = False, extractor: fs.Extractor | None = None, batch_pages: int = fs.BATCH_PAGES, parser: str = "builtin") -> DataFrame:
    """Parsed documents of a raw folder with provenance; entries that exist are skipped unless ``force``."""
    files, plan = plan_folder(spark, folder, existing, force, pdf_counter)
    return parse_planned(files, plan, pdf_readers, extractor, batch_pages, parser)


def described(docs: DataFrame, files: DataFrame, client: Callable[[], Client], min_side: float = enrich.MIN_SIDE, crops: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with their images described, the descriptions) of documents and their scanned files.

    Documents with images are marked as enriched; a failing image leaves its error in the text, never costs the document.
    """
    images = cut(enrich.images_to_describe(docs.where(F.size("images") > 0), min_side))
    told = describe_files(files.where("type = 'pdf'"), images, client, crops)
    out = enrich.apply_descriptions(docs, told, min_side)
    if "provenance" in docs.columns:
        out = out.withColumn("provenance", F.col("provenance").withField("enriched", F.size("images") > 0))
    return out, told


def golden_set(docs: DataFrame, client: Callable[[], Client], profile: str = "utilisateur metier", policy: str = "", n_questions="auto", corpus_questions: DataFrame | None = None, k: int = 6, chunk_chars: int = 1000, overlap: int = 100, encoder=retrieval.letter_counts, corpus_level: bool = False) -> DataFrame:
    """Golden rows of every document, and of corpus questions (q_no, question) answered from retrieved excerpts.

    With ``corpus_level`` and no questions given, the client proposes them from the synopses. Blank documents and failed
    calls give no rows. Corpus questions need at least two documents.
    """
    live = docs.where(~tx.is_blank(F.col("markdown"))).select("doc_id", "markdown")
    asked = answer(live.select("doc_id", gq.document_prompt(F.col("markdown"), profile, policy, n_questions).alias("prompt")), client)
    rows = gq.rows_from_answers(asked.where("error is null"))
    if (corpus_questions is None and not corpus_level) or len(live.head(2)) < 2:
        return rows
    if corpus_questions is None:
        prompt = gq.corpus_questions_prompts(live, profile, policy, n_questions)
        told = answer(prompt, client).where("error is null")
        found = told.select("batch", F.posexplode(F.from_json(judge.json_object(F.col("response")), gq.ANSWERS)["questions"]).alias("i", "q"))
        corpus_questions = found.select((F.shiftleft("batch", 32) + F.col("i") + 1).alias("q_no"), F.col("q.question").alias("question"))
    index = cut(retrieval.embed(retrieval.chunks(live, chunk_chars, overlap), encoder))
    q = retrieval.embed(corpus_questions.where(~tx.is_blank(F.col("question"))).select(F.col("q_no").alias("q_id"), tx.strip(F.col("question")).alias("question")), encoder, "question")
    hits = cut(retrieval.retrieve(index, q, k)).join(index.drop("emb"), ["doc_id", "chunk_no"])
    ctx = gq.contexts(hits).join(q.select("q_id", "question"), "q_id")
    told = answer(ctx.select("q_id", "question", "sources", gq.answer_prompt(F.col("question"), F.col("contexte"), policy).alias("prompt")), client)
    return rows.unionByName(gq.corpus_rows(told.where("error is null").withColumnRenamed("q_id", "q_no")))
