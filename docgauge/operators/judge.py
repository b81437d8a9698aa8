"""Section judgement: prompts, strict verdict parsing, the criterion state machine and cross-section medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.functions import text as tx
from docgauge.session import cut

# Justifications of criteria that no judge scored.
J_NA = "Objet absent du document (inventaire)."
J_EXTERNAL = "Referentiel de questions/cas d'usage absent."
J_RULE = "Signal deterministe."
J_LIGHT = "Route light (crible) : jugement LLM non execute."
J_NONE = "Non evalue: aucune section n'a produit de note conforme."

VERDICT = "status STRING, score INT, justification STRING, evidence STRING"


def scope(criteria: list[dict]) -> Column:
    """Array of structs (id, label) a document's judge is asked about, in grid order; needs ``na`` and ``d_scores``."""
    every = F.array(*[F.struct(F.lit(c["id"]).alias("id"), F.lit(c["label"]).alias("label"), F.lit(c["tag"]).alias("tag")) for c in criteria if not c["external_dep"]])
    ruled = F.map_keys("d_scores")
    return F.filter(every, lambda x: ~F.array_contains("na", x["id"]) & ~((x["tag"] == "D") & F.array_contains(ruled, x["id"])))


#: Prompt around the criteria and the text of a section; ``{top}`` is the top of the scale.
BEFORE = "Voici un extrait d'un document destine a une base documentaire interrogee par un assistant.\nAttribue a l'extrait une note entiere de 1 (mauvais) a {top} (excellent) pour chaque critere de cette liste :\n"
AFTER = (
    "\n\nSi l'extrait ne permet pas de juger un critere, donne-lui le statut not_evaluated sans note, plutot que d'en inventer une.\n"
    "Forme de la reponse : un objet JSON, une entree par identifiant de critere, avec status (scored ou not_evaluated), score (entier de 1 a {top}, ou null), "
    "justification (une phrase) et evidence (citation ou null).\n\nExtrait :\n"
)


def batch_prompt(scope_col: Column, section: Column, scale_max: int = 5, hints: Column | None = None) -> Column:
    """Prompt of one section for all criteria of the scope. ``hints``: optional map from criterion to signal."""

    def line(x: Column) -> Column:
        base = F.concat(F.lit("- "), x["id"], F.lit(" : "), x["label"])
        if hints is None:
            return base
        hint = F.try_element_at(hints, x["id"])
        return F.concat(base, F.coalesce(F.concat(F.lit(" (mesure automatique : "), hint.cast("string"), F.lit(")")), F.lit("")))

    before, after = (F.lit(x.format(top=scale_max)) for x in (BEFORE, AFTER))
    return F.concat(before, F.array_join(F.transform(scope_col, line), "\n"), after, section)


def json_object(response: Column) -> Column:
    """The JSON object inside a model's answer: of a fence if there is one, else from the first { to the last }."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    bare = F.regexp_extract(response, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(bare != "", bare)


def verdicts_from_json(answers: DataFrame, response: str = "response") -> DataFrame:
    """Explode answers (doc_id, section_no, response) to one row per criterion; malformed values give no verdict.

    Two stages, so that one bad value doesn't void the others: first a map of raw values, then each value strictly.
    ``voids`` is true where a truthy justification is no text, which voids the whole document.
    """
    raw = answers.select("doc_id", "section_no", F.explode(F.from_json(json_object(F.col(response)), "map<string,string>")).alias("crit_id", "raw"))
    v = F.from_json("raw", VERDICT)
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json("raw"), "$.justification", "variant"))
    truthy = ~F.col("v.justification").isin("0", "0.0", "false", "[]", "{}", "")
    return (
        raw.withColumn("v", v)
        .where(F.col("raw").startswith("{"))
        .select(
            "doc_id", "section_no", "crit_id", "v.status", "v.score", "v.justification", "v.evidence",
            F.coalesce((kind != "STRING") & (kind != "VOID") & truthy, F.lit(False)).alias("voids"),
        )
    )


def latest(verdicts: DataFrame) -> DataFrame:
    """One row per verdict_id: the one loaded last (null loads first, then the larger score and text)."""
    rest = F.struct("loaded_at", "judged_at", "score", "status", "justification", "evidence", "doc_id", "section_no", "crit_id")
    one = verdicts.groupBy("verdict_id").agg(F.max(rest).alias("v"))
    return one.select("verdict_id", "v.*")


def valid(scale_max: int = 5) -> Column:
    """The only way to a score: scored, a whole number on the scale, and a justification."""
    return (F.col("status") == "scored") & F.col("score").between(1, scale_max) & ~tx.is_blank(F.col("justification"))


def section_medians(verdicts: DataFrame, scale_max: int = 5) -> DataFrame:
    """Median score per (doc_id, crit_id) over the sections with a valid verdict, rounded half to even.

    Justification and evidence are those of the score closest to the median, the earliest section of equal ones. The
    counts per score give the median, so a document judged at every run costs a few numbers a group, and the closest
    verdict is kept per score while aggregating, not collected.
    """
    ok = verdicts.where(F.coalesce(valid(scale_max), F.lit(False)))
    first = F.min(F.struct("section_no", tx.strip(F.col("justification")).alias("justification"), "evidence"))
    per = ok.groupBy("doc_id", "crit_id", "score").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    g = per.groupBy("doc_id", "crit_id").agg(
        F.sum("n").cast("int").alias("n_valid"),
        F.expr("percentile(score, 0.5, n)").alias("median"),
        F.collect_list(F.struct("score", "first")).alias("by_score"),  # at most scale_max entries
    )
    near = F.array_min(F.transform("by_score", lambda x: F.struct(F.abs(x["score"] - F.col("median")).alias("d"), x["first"]["section_no"].alias("section_no"), x["first"].alias("f"))))
    return g.withColumn("near", near).select(
        "doc_id", "crit_id", "n_valid", F.col("median").alias("raw_median"), F.bround("median", 0).cast("int").alias("score"),
        F.col("near.f.section_no").alias("section_no"), F.col("near.f.justification").alias("justification"), F.col("near.f.evidence").alias("evidence"),
    )


def criterion_scores(docs: DataFrame, criteria: DataFrame, medians: DataFrame) -> DataFrame:
    """One row per document and criterion with its state: na, external, ruled, light route, judged or not evaluated.

    ``docs`` needs doc_id, na, d_scores, route. The grid is a fixed small table and is broadcast. These narrow columns are
    cut off first, else the signals behind them would be computed again for each criterion.
    """
    docs = cut(docs.select("doc_id", "na", "d_scores", "route"))
    grid = criteria.select("ord", "id", "dimension", "label", "weight", "tag", "external_dep")
    every = docs.crossJoin(F.broadcast(grid))
    m = medians.select("doc_id", F.col("crit_id").alias("id"), F.col("score").alias("_s"), F.col("justification").alias("_j"), F.col("evidence").alias("_e"))
    j = every.join(m, ["doc_id", "id"], "left")
    rule = F.try_element_at("d_scores", F.col("id"))
    state = (
        F.when(F.array_contains("na", F.col("id")), "na")
        .when(F.col("external_dep"), "external")
        .when((F.col("tag") == "D") & rule.isNotNull(), "rule")
        .when(F.col("route") == "light", "light")
        .when(F.col("_s").isNotNull(), "judged")
        .otherwise("none")
    )
    j = j.withColumn("state", state)
    by = lambda **kw: F.coalesce(*[F.when(F.col("state") == k, v) for k, v in kw.items()])
    return j.select(
        "doc_id", "ord", "id", "dimension", "label", "tag", "weight", "state",
        F.when(F.col("state").isin("rule", "judged"), "scored").when(F.col("state") == "na", "na").otherwise("not_evaluated").alias("status"),
        by(rule=rule, judged=F.col("_s")).alias("score"),
        by(na=F.lit(J_NA), external=F.lit(J_EXTERNAL), rule=F.lit(J_RULE), light=F.lit(J_LIGHT), judged=F.col("_j"), none=F.lit(J_NONE)).alias("justification"),
        by(judged=F.col("_e")).alias("evidence"),
    )


def judge_cost(section_rows: DataFrame, prompt: Column) -> DataFrame:
    """Calls and prompt characters per document over its judged sections."""
    return section_rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_calls"), F.sum(F.length(prompt)).alias("prompt_chars"))
