"""The engine's registered queries: each over its whole tables, each with its SQL in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.functions import text as tx
from docgauge.operators import enrich, golden, inventory, judge, redundancy, retrieval, rules, scoring, screen, sections, signals
from docgauge.plans import oracle
from docgauge.plans.run import measured, section_prompts
from docgauge.session import cut, table
from docgauge.sources import files as fs
from docgauge.sources import parsed_store as ps
from docgauge.sources.grid import Grid, grid_from_table

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs")


def _grid(spark: SparkSession, d: str) -> Grid:
    return grid_from_table(table(spark, d, "criteria"))


def _routed(spark: SparkSession, d: str) -> DataFrame:
    return screen.with_route(signals.signals(_docs(spark, d)))


def _medians(spark: SparkSession, d: str) -> DataFrame:
    return judge.section_medians(judge.latest(table(spark, d, "verdicts")))


def _criteria(spark: SparkSession, d: str) -> DataFrame:
    grid = _grid(spark, d)
    m = measured(_docs(spark, d).where(~tx.is_blank(F.col("markdown"))), grid).select("doc_id", "na", "d_scores", "route")
    return judge.criterion_scores(m, table(spark, d, "criteria"), _medians(spark, d))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document has a row: blank ones a zero row with their flag."""
    docs, blank = _docs(spark, d), tx.is_blank(F.col("markdown"))
    scored = scoring.doc_scores(cut(_criteria(spark, d)), _grid(spark, d).weights, docs.where(~blank).select("doc_id", "parse_confidence"))
    return scored.unionByName(scoring.failed_scores(docs.where(blank), F.lit("unreadable")))


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    """The judge's prompt of each section of the documents on the full route."""
    return section_prompts(measured(_docs(spark, d), _grid(spark, d)), _grid(spark, d))


def _sidecars(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sidecars").where("doc_id is not null")
    order = F.struct("schema_version", F.coalesce("markdown_hash", F.lit("")), F.coalesce("n_blocks", F.lit(0)))
    rest = [c for c in s.columns if c != "doc_id"]
    one = s.groupBy(F.col("doc_id").alias("stem")).agg(F.max_by(F.struct(*rest), order).alias("s")).select("stem", "s.*")
    none_b, none_i = F.lit(None).cast(f"array<{fs.BLOCK}>"), F.lit(None).cast(f"array<{fs.IMAGE}>")
    return one.withColumns({"doc_id": F.col("stem"), "invalid": F.lit(False), "blocks": none_b, "images": none_i})


def _entries(spark: SparkSession, d: str) -> DataFrame:
    md = _docs(spark, d).select(F.col("doc_id").alias("stem"), F.coalesce("markdown", F.lit("")).alias("markdown"))
    return ps.merge_entries(md, _sidecars(spark, d))


def _signals(s: SparkSession, d: str) -> DataFrame:
    return signals.signals(_docs(s, d)).select(
        "doc_id", "non_alpha_fraction", "mean_words_per_sentence", "duplicate_line_fraction", "type_token_ratio", "mattr", "n_tokens", "cid_fraction", "content_duplicates", "question_lines", "block_integrity"
    )


def _rules(s: SparkSession, d: str) -> DataFrame:
    r = rules.with_rule_scores(signals.signals(_docs(s, d)))
    return r.select("doc_id", *[F.try_element_at("d_scores", F.lit(k)).alias("r_" + k.replace(".", "_")) for k in rules.RULED])


def _inventory(s: SparkSession, d: str) -> DataFrame:
    return inventory.with_inventory(_docs(s, d)).select("doc_id", "tables", "figures", "images_n", "formulas", "links", "sections")


def _na(s: SparkSession, d: str) -> DataFrame:
    return inventory.with_inventory(_docs(s, d)).select("doc_id", F.array_join(inventory.na_ids(_grid(s, d).na_possible), ",").alias("na"))


def _scope(s: SparkSession, d: str) -> DataFrame:
    grid = _grid(s, d)
    m = measured(_docs(s, d), grid).withColumn("scope", judge.scope(grid.criteria))
    return m.select("doc_id", F.size("scope").cast("bigint").alias("n_criteria"), F.array_join(F.transform("scope", lambda x: x["id"]), ",").alias("ids"))


def _windows(size: int, overlap: int | None, number: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        w = sections.sections(_docs(s, d).select("doc_id", "markdown"), "markdown", size, overlap, number, "part")
        return w.select("doc_id", number, F.length("part").alias("n_chars"), F.md5("part").alias("digest"))

    return run


def _valid(s: SparkSession, d: str) -> DataFrame:
    return judge.latest(table(s, d, "verdicts")).select("verdict_id", F.coalesce(judge.valid(), F.lit(False)).alias("valid"))


def _detail(s: SparkSession, d: str) -> DataFrame:
    r = scoring.detail(_criteria(s, d))
    return r.select("doc_id", "critere_id", "tag", "poids", "status", "score", scoring.sanitized(F.col("justification")).alias("justification"), scoring.sanitized(F.col("preuve")).alias("preuve"))


def _remediation(s: SparkSession, d: str) -> DataFrame:
    return scoring.remediation(_criteria(s, d)).withColumn("critere", scoring.sanitized(F.col("critere")))


def _levels(s: SparkSession, d: str) -> DataFrame:
    return _scores(s, d).groupBy("level").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.round(F.col("global_pct") * 10).cast("bigint")).alias("sum_tenths"))


def _confidence(s: SparkSession, d: str) -> DataFrame:
    c = signals.with_counts(_docs(s, d))
    cid = tx.ratio(F.col("c.cid"), F.col("c.len"), 4, 0.0)
    side = _sidecars(s, d).select(F.col("stem").alias("doc_id"), "provenance.source_pages", (F.col("provenance.parser") == "fallback").alias("fallback"))
    j = c.join(side, "doc_id", "left")
    conf = signals.parse_confidence(F.coalesce("markdown", F.lit("")), F.col("blocks"), F.coalesce("source_pages", F.lit(0)), cid, F.coalesce("fallback", F.lit(False)))
    return j.select("doc_id", conf.alias("confidence"))


def _density(s: SparkSession, d: str) -> DataFrame:
    words = F.size(tx.tokens(F.coalesce("markdown", F.lit(""))))
    page = F.transform(F.coalesce("blocks", F.array()), lambda b: F.coalesce(b["page"], F.lit(0)))
    pages = F.coalesce(F.array_max(page), F.lit(0))
    return _docs(s, d).select("doc_id", fs.density_category(words, F.size(F.coalesce("images", F.array())), pages).alias("category"))


def _gate(s: SparkSession, d: str) -> DataFrame:
    im = _docs(s, d).select("doc_id", F.explode("images").alias("im"))
    box = enrich.pixel_box(F.col("im"))
    return im.select("doc_id", "im.placeholder", enrich.is_decorative(F.col("im")).alias("decorative"), box["x0"].alias("px"), box["top"].alias("py"))


def _manifest(s: SparkSession, d: str) -> DataFrame:
    """A manifest with all branches: by page and number an image is described, failed, or left for later; small ones are decorative."""
    docs = _docs(s, d).where(F.size("images") > 0).select("doc_id", "markdown", "images")
    told = docs.select("doc_id", F.explode("images").alias("im")).select("doc_id", "im.placeholder", ((F.col("im.page") + F.col("im.idx")) % 3).alias("k"))
    told = told.withColumns({"description": F.when(F.col("k") == 0, F.concat("placeholder", F.lit(" vue"))).when(F.col("k") == 2, F.lit(" ")), "error": F.when(F.col("k") == 1, F.lit("TimeoutError"))})
    return enrich.apply_descriptions(docs, told).select("doc_id", F.md5("markdown").alias("digest"))


def _guard(s: SparkSession, d: str) -> DataFrame:
    return golden.guarded(table(s, d, "golden")).select("id", "question", "couvert", "reponse").distinct()


def _golden_sources(s: SparkSession, d: str) -> DataFrame:
    """Sources of each corpus question: the documents of its retrieved excerpts, in order of rank."""
    docs = _docs(s, d).where(~tx.is_blank(F.col("markdown")))
    index = cut(retrieval.embed(retrieval.chunks(docs), retrieval.letter_counts))
    asked = table(s, d, "golden").where("id like 'corpus-%'").where(~tx.is_blank(F.col("question"))).groupBy(F.col("id").alias("q_id")).agg(F.min("question").alias("question"))
    hits = cut(retrieval.retrieve(index, retrieval.embed(asked, retrieval.letter_counts, "question"), 6))
    return golden.contexts(hits.join(index.drop("emb"), ["doc_id", "chunk_no"])).select(F.col("q_id").alias("id"), "sources")


def _changed(s: SparkSession, d: str) -> DataFrame:
    triaged = _docs(s, d).select("doc_id", F.sha2(F.coalesce("markdown", F.lit("")), 256).alias("hash"))
    there = _sidecars(s, d).select("doc_id", F.col("markdown_hash").alias("source_sha256"))
    return ps.plan_parse(triaged, there).select("doc_id", "action", "source_changed")


def _near(s: SparkSession, d: str) -> DataFrame:
    return redundancy.near_pairs(table(s, d, "embeddings"), 0.95).select("a", "b", "copy")


def _topk(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    vec: Column = F.transform("embedding", lambda x: x.cast("double"))
    index = e.select(F.col("vec_id").cast("string").alias("doc_id"), F.lit(0).alias("chunk_no"), vec.alias("emb"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), vec.alias("emb"))  # the stated query set
    return retrieval.retrieve(index, asked, 6).select("q_id", "rank", "doc_id")


def queries() -> dict[str, Query]:
    return {
        "text_signals": _signals,
        "screen_route": lambda s, d: _routed(s, d).select("doc_id", "route", "reason", "n_tokens", "non_alpha_fraction", "duplicate_line_fraction", "mattr"),
        "det_rules": _rules,
        "block_inventory": _inventory,
        "na_decisions": _na,
        "sections": _windows(8000, None, "section_no"),
        "chunks": _windows(1000, 100, "chunk_no"),
        "judge_scope": _scope,
        "latest_verdicts": lambda s, d: judge.latest(table(s, d, "verdicts")).select("verdict_id", "doc_id", "section_no", "crit_id", "status", "score"),
        "verdict_validation": _valid,
        "section_median": _medians,
        "criterion_scores": _criteria,
        "dimension_scores": lambda s, d: scoring.dimension_scores(_criteria(s, d)),
        "doc_scores": lambda s, d: _scores(s, d).select("doc_id", "global_pct", "level", "coverage_pct", F.array_join("flags", "|").alias("flags")),
        "remediation": _remediation,
        "detail": _detail,
        "synthesis": lambda s, d: scoring.synthesis(_scores(s, d)),
        "corpus_levels": _levels,
        "judge_cost": lambda s, d: judge.judge_cost(_prompts(s, d), F.col("prompt")),
        "prompt_chars": lambda s, d: _prompts(s, d).select("doc_id", "section_no", F.length("prompt").alias("prompt_chars"), F.md5("prompt").alias("digest")),
        "parse_confidence": _confidence,
        "exact_duplicates": lambda s, d: redundancy.exact_groups(_docs(s, d)),
        "near_duplicates_vec": _near,
        "retrieve_topk": _topk,
        "cell_sanitise": lambda s, d: table(s, d, "golden").select("id", scoring.sanitized(F.col("commentaire_beta")).alias("cell")),
        "golden_guard": _guard,
        "golden_sources": _golden_sources,
        "content_hash": lambda s, d: _docs(s, d).select("doc_id", F.sha2(F.coalesce("markdown", F.lit("")), 256).alias("hash")),
        "entry_flags": lambda s, d: _entries(s, d).select("doc_id", F.array_join("entry_flags", "|").alias("entry_flags")),
        "source_changed": _changed,
        "triage_density": _density,
        "image_gate": _gate,
        "apply_manifest": _manifest,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
