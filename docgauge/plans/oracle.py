"""DuckDB SQL of the engine's queries, written from the definitions and not from the Spark code."""

from __future__ import annotations

from docgauge.operators import judge, rules

# Character classes of Python's text functions for a regex engine without Unicode white space.
SP = r"[\t\n\x{0b}\x{0c}\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NSP = SP.replace("[", "[^", 1)
NL = r"\r\n|[\n\x{0b}\x{0c}\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
TOK = r"[\p{L}\p{N}_]+"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SP}+|{SP}+$', '', 'g')"


def blank(c: str) -> str:
    return f"({c} IS NULL OR NOT regexp_matches({c}, '{NSP}'))"


def ratio(n: str, d: str, digits: int, empty: str) -> str:
    return f"CASE WHEN ({d}) = 0 THEN {empty}::DOUBLE ELSE ((2 * ({n})::BIGINT * {10**digits} + ({d})::BIGINT) // (2 * ({d})::BIGINT)) / {10.0**digits} END"


COUNTS = rf"""
base AS (
  SELECT doc_id, parse_confidence, blocks, t,
         regexp_extract_all(lower(t), '{TOK}') AS tk,
         list_filter(list_transform(regexp_split_to_array(t, '{NL}'), lambda x: {strip("x")}), lambda x: x <> '') AS ln,
         list_filter(regexp_split_to_array(t, '[.!?]+'), lambda x: regexp_matches(x, '{NSP}')) AS st
  FROM (SELECT doc_id, parse_confidence, blocks, coalesce(markdown, '') AS t FROM docs)),
runs AS (
  SELECT doc_id, sum(CASE WHEN c <= 3 THEN c ELSE 0 END) AS kept, sum(CASE WHEN c <= 3 THEN c - 1 ELSE 0 END) AS dup
  FROM (SELECT doc_id, l, count(*) AS c FROM (SELECT doc_id, unnest(ln) AS l FROM base) WHERE length(l) >= 15 GROUP BY ALL) GROUP BY doc_id),
c AS (
  SELECT b.*, length(t) AS len, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS alpha,
         length(t) - length(regexp_replace(t, '\(cid:\d+\)|\x{{fffd}}', '', 'g')) AS cid,
         len(tk) AS n_tok, len(list_distinct(tk)) AS u_tok,
         CASE WHEN len(tk) >= 1000 THEN list_sum([len(list_distinct(tk[i * 1000 + 1 : i * 1000 + 1000])) FOR i IN range(0, len(tk) // 1000)]) ELSE 0 END AS seg_u,
         len(ln) AS n_line, len(list_distinct(ln)) AS u_line, coalesce(r.kept, 0) AS kept, coalesce(r.dup, 0) AS dup,
         len(st) AS n_sent, coalesce(list_sum(list_transform(st, lambda x: len(regexp_extract_all(x, '{NSP}+')))), 0) AS n_word,
         len(list_filter(ln, lambda x: x LIKE '%?')) AS q_line
  FROM base b LEFT JOIN runs r USING (doc_id)),
sig AS (
  SELECT *, {ratio("len - alpha", "len", 4, "1")} AS non_alpha_fraction, {ratio("n_word", "n_sent", 2, "0")} AS mean_words_per_sentence,
         {ratio("n_line - u_line", "n_line", 4, "0")} AS duplicate_line_fraction, {ratio("u_tok", "n_tok", 4, "0")} AS type_token_ratio,
         CASE WHEN n_tok < 1000 THEN {ratio("u_tok", "n_tok", 4, "0")} ELSE {ratio("seg_u", "(n_tok // 1000) * 1000", 4, "0")} END AS mattr,
         {ratio("cid", "len", 4, "0")} AS cid_fraction, {ratio("dup", "kept", 4, "0")} AS content_duplicates,
         {ratio(f"len(list_filter(coalesce(blocks, []), lambda b: NOT {blank('b.text')}))", "len(coalesce(blocks, []))", 4, "0")} AS block_integrity
  FROM c)
"""

ROUTE = """
route AS (
  SELECT *, CASE
      WHEN n_tok >= 10000 AND coalesce(parse_confidence, 0) >= 0.5 AND non_alpha_fraction <= 0.40 AND mattr >= 0.05 THEN 'gros_document_extraction_saine'
      WHEN coalesce(parse_confidence, 0) < 0.5 OR non_alpha_fraction > 0.40 OR mattr < 0.05 THEN 'extraction_degradee'
      WHEN non_alpha_fraction < 0.30 AND duplicate_line_fraction < 0.15 AND mattr > 0.15 THEN 'signaux_propres'
      ELSE 'cas_limite' END AS reason FROM sig),
routed AS (SELECT *, CASE WHEN reason IN ('extraction_degradee', 'signaux_propres') THEN 'light' ELSE 'full' END AS route FROM route)
"""


def has(pattern: str) -> str:
    """Case-blind search; the word boundary of the pattern language is spelled out for letters above ASCII."""
    p = pattern.replace(r"\bv\d+(\.\d+)?\b", r"(?:^|[^\p{L}\p{N}\p{M}_])v\d+(?:\.\d+)?(?:$|[^\p{L}\p{N}\p{M}_])").replace(r"\bFAQ\b", r"(?:^|[^\p{L}\p{N}\p{M}_])FAQ(?:$|[^\p{L}\p{N}\p{M}_])").replace(r"\s", r"[\s\x{0b}]")
    return f"regexp_matches(t, '(?i){p}')"


RULES = f"""
ruled AS (
  SELECT *, {has(rules.VERSION)} AS v, {has(rules.DATE)} AS d,
         CASE WHEN {has(rules.AUTHOR)} THEN 5 ELSE 1 END AS r_1_3, CASE WHEN {has(rules.UPDATE)} THEN 5 ELSE 1 END AS r_1_6,
         CASE WHEN {has(rules.STATE)} THEN 5 ELSE 1 END AS r_1_7, CASE WHEN {has(rules.HISTORY)} THEN 5 ELSE 1 END AS r_1_8,
         CASE WHEN {has(rules.FAQ)} OR q_line >= 5 THEN 5 ELSE 1 END AS r_8_1,
         CASE WHEN content_duplicates = 0 THEN 5 WHEN content_duplicates <= 0.05 THEN 3 ELSE 1 END AS r_4_5
  FROM routed),
scored AS (SELECT *, CASE WHEN v AND d THEN 5 WHEN v OR d THEN 3 ELSE 1 END AS r_1_4 FROM ruled)
"""

INVENTORY = r"""
inv AS (
  SELECT doc_id,
         len(list_filter(k, lambda x: contains(x, 'table'))) AS tables,
         len(list_filter(k, lambda x: contains(x, 'figure') OR contains(x, 'picture'))) AS figures,
         len(list_filter(k, lambda x: contains(x, 'image') OR contains(x, 'picture') OR contains(x, 'figure'))) AS images_n,
         len(list_filter(k, lambda x: contains(x, 'formula') OR contains(x, 'equation'))) AS formulas,
         len(regexp_extract_all(t, '\]\(')) + len(regexp_extract_all(t, 'https?://')) - len(regexp_extract_all(t, '\]\(https?://')) AS links,
         len(list_filter(k, lambda x: x IN ('title', 'section_header', 'heading'))) AS sections
  FROM (SELECT doc_id, coalesce(markdown, '') AS t, list_transform(coalesce(blocks, []), lambda b: lower(coalesce(b.kind, ''))) AS k FROM docs)),
na AS (
  SELECT i.doc_id, coalesce(list_sort(list(c.id) FILTER (c.id IS NOT NULL)), []) AS na
  FROM inv i LEFT JOIN criteria c ON c.na_possible AND (
       (i.images_n = 0 AND c.id IN ('3.1', '3.2', '3.3')) OR (i.tables = 0 AND c.id IN ('3.4', '3.8', '3.9'))
    OR (i.formulas = 0 AND c.id = '3.6') OR (i.links = 0 AND c.id = '3.5'))
  GROUP BY i.doc_id)
"""

LATEST = """
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY verdict_id ORDER BY loaded_at DESC NULLS LAST, judged_at DESC NULLS LAST, score DESC NULLS LAST,
         status DESC NULLS LAST, justification DESC NULLS LAST, evidence DESC NULLS LAST, doc_id DESC NULLS LAST, section_no DESC NULLS LAST, crit_id DESC NULLS LAST) AS rn FROM verdicts) WHERE rn = 1)
"""

MEDIANS = f"""
valid AS (
  SELECT doc_id, crit_id, section_no, score, {strip("justification")} AS justification, evidence FROM latest
  WHERE status = 'scored' AND score BETWEEN 1 AND 5 AND NOT {blank("justification")}),
med AS (SELECT doc_id, crit_id, count(*)::INT AS n_valid, median(score) AS raw_median FROM valid GROUP BY ALL),
near AS (
  SELECT v.*, m.n_valid, m.raw_median, row_number() OVER (PARTITION BY v.doc_id, v.crit_id ORDER BY abs(v.score - m.raw_median), v.section_no, v.justification, v.evidence NULLS FIRST) AS rn
  FROM valid v JOIN med m USING (doc_id, crit_id)),
medians AS (SELECT doc_id, crit_id, n_valid, raw_median, round_even(raw_median, 0)::INT AS score, section_no, justification, evidence FROM near WHERE rn = 1)
"""

STATES = f"""
everything AS (
  SELECT s.doc_id, s.parse_confidence, s.route, c.*, list_contains(n.na, c.id) AS is_na,
         CASE c.id WHEN '1.3' THEN r_1_3 WHEN '1.4' THEN r_1_4 WHEN '1.6' THEN r_1_6 WHEN '1.7' THEN r_1_7 WHEN '1.8' THEN r_1_8 WHEN '1.9' THEN r_1_4 WHEN '4.5' THEN r_4_5 WHEN '8.1' THEN r_8_1 END AS rule
  FROM scored s JOIN na n USING (doc_id) CROSS JOIN criteria c WHERE NOT {blank("s.t")}),
states AS (
  SELECT e.*, m.score AS m_score, m.justification AS m_just, m.evidence AS m_evid,
         CASE WHEN is_na THEN 'na' WHEN external_dep THEN 'external' WHEN tag = 'D' AND rule IS NOT NULL THEN 'rule' WHEN route = 'light' THEN 'light' WHEN m.score IS NOT NULL THEN 'judged' ELSE 'none' END AS state
  FROM everything e LEFT JOIN medians m ON m.doc_id = e.doc_id AND m.crit_id = e.id),
crit AS (
  SELECT doc_id, parse_confidence, ord, id, dimension, label, tag, weight, state,
         CASE WHEN state IN ('rule', 'judged') THEN 'scored' WHEN state = 'na' THEN 'na' ELSE 'not_evaluated' END AS status,
         CASE state WHEN 'rule' THEN rule WHEN 'judged' THEN m_score END AS score,
         CASE state WHEN 'na' THEN '{judge.J_NA}' WHEN 'external' THEN '{judge.J_EXTERNAL.replace("'", "''")}' WHEN 'rule' THEN '{judge.J_RULE}' WHEN 'light' THEN '{judge.J_LIGHT}' WHEN 'judged' THEN m_just
              ELSE '{judge.J_NONE.replace("'", "''")}' END AS justification,
         CASE state WHEN 'judged' THEN m_evid END AS evidence
  FROM states)
"""

SCORES = """
dims AS (
  SELECT doc_id, dimension, (2 * sum(weight * score)::BIGINT * 1000 + sum(weight)::BIGINT * 5) // (2 * sum(weight)::BIGINT * 5) AS tenths
  FROM crit WHERE status = 'scored' AND score IS NOT NULL GROUP BY ALL),
weights(dimension, w) AS (VALUES ('1', 2), ('2', 5), ('3', 4), ('4', 4), ('5', 5), ('6', 5), ('7', 3), ('8', 3)),
overall AS (SELECT doc_id, (2 * sum(w * tenths)::BIGINT + sum(w)::BIGINT) // (2 * sum(w)::BIGINT) AS g FROM dims JOIN weights USING (dimension) GROUP BY doc_id),
cover AS (SELECT doc_id, any_value(parse_confidence) AS pc, count(*) FILTER (status = 'scored' AND score IS NOT NULL) AS n_scored, count(*) FILTER (status = 'not_evaluated') AS n_not FROM crit GROUP BY doc_id),
pct AS (
  SELECT c.doc_id, c.pc, coalesce(g.g / 10.0, 0.0) AS global_pct,
         CASE WHEN n_scored + n_not > 0 THEN ((2 * n_scored * 1000 + n_scored + n_not) // (2 * (n_scored + n_not))) / 10.0 ELSE 100.0 END AS coverage_pct
  FROM cover c LEFT JOIN overall g USING (doc_id)),
result AS (
  SELECT doc_id, global_pct, CASE WHEN global_pct >= 90 THEN 'Excellent' WHEN global_pct >= 70 THEN 'Acceptable' WHEN global_pct >= 50 THEN 'Insuffisant' ELSE 'Inadapté' END AS level, coverage_pct,
         array_to_string(list_filter([CASE WHEN coverage_pct < 70 THEN 'low_coverage' END, CASE WHEN coalesce(pc, 0) < 0.5 THEN 'low_parse_confidence' END], lambda x: x IS NOT NULL), '|') AS flags
  FROM pct),
every_doc AS (
  SELECT doc_id, global_pct, level, coverage_pct, flags FROM result
  UNION ALL SELECT doc_id, 0.0, 'Inadapté', 0.0, 'unreadable' FROM scored WHERE {BLANK})
""".replace("{BLANK}", blank("t"))


def sql(tail: str, *parts: str) -> str:
    return "WITH " + ",".join(parts) + " " + tail if parts else tail


def windows(size: int, stride: int, text: str) -> str:
    last = f"CASE WHEN length({text}) <= {size} THEN 0 ELSE (length({text}) - {size} + {stride} - 1) // {stride} END"
    return f"unnest(range(0, {last} + 1))"


SECTIONS = f"sections AS (SELECT doc_id, i::INT AS section_no, substring(markdown, i::INT * 7200 + 1, 8000) AS part FROM (SELECT doc_id, markdown, {windows(8000, 7200, 'markdown')} AS i FROM docs WHERE length(markdown) > 0))"
CHUNKS = f"chunks AS (SELECT doc_id, i::INT AS chunk_no, substring(markdown, i::INT * 900 + 1, 1000) AS part FROM (SELECT doc_id, markdown, {windows(1000, 900, 'markdown')} AS i FROM docs WHERE length(markdown) > 0))"
FULL = (COUNTS, ROUTE, RULES, INVENTORY, LATEST, MEDIANS, STATES)

SCOPE = """
scope AS (
  SELECT s.doc_id, count(*) AS n_criteria, string_agg('- ' || c.id || ' : ' || c.label, chr(10) ORDER BY c.ord) AS lines
  FROM scored s JOIN na n USING (doc_id) CROSS JOIN criteria c
  WHERE s.route = 'full' AND NOT list_contains(n.na, c.id) AND NOT c.external_dep AND NOT (c.tag = 'D' AND c.id IN ('1.3', '1.4', '1.6', '1.7', '1.8', '1.9', '4.5', '8.1')) GROUP BY s.doc_id)
"""


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PROMPTS = f"prompts AS (SELECT s.doc_id, s.section_no, {literal(judge.BEFORE.format(top=5))} || c.lines || {literal(judge.AFTER.format(top=5))} || s.part AS prompt FROM sections s JOIN scope c USING (doc_id))"
LETTERS = "list_transform(range(97, 123), lambda c: (length(lower({t})) - length(replace(lower({t}), chr(c::INT), '')))::DOUBLE)"

SIDE = r"""
side AS (
  SELECT doc_id AS stem, max_by({'schema_version': schema_version, 'markdown_hash': markdown_hash, 'n_blocks': n_blocks, 'provenance': provenance, 'parse_confidence': parse_confidence},
         {'a': schema_version, 'b': coalesce(markdown_hash, ''), 'c': coalesce(n_blocks, 0)}) AS s
  FROM sidecars WHERE doc_id IS NOT NULL GROUP BY doc_id)
"""


def oracle_sql() -> dict[str, str]:
    cells = "CASE WHEN {c} IS NULL THEN '' WHEN left({c}, 1) IN ('=', '+', '-', '@') THEN chr(39) || {c} ELSE {c} END"
    norm = f"lower({strip(f'''regexp_replace(markdown, '{SP}+', ' ', 'g')''')})"
    dot = lambda a, b: f"list_sum([{a}[i]::DOUBLE * {b}[i]::DOUBLE FOR i IN range(1, len({a}) + 1)])"
    out = {
        "text_signals": sql("SELECT doc_id, non_alpha_fraction, mean_words_per_sentence, duplicate_line_fraction, type_token_ratio, mattr, n_tok AS n_tokens, cid_fraction, content_duplicates, q_line AS question_lines, block_integrity FROM sig", COUNTS),
        "screen_route": sql("SELECT doc_id, route, reason, n_tok AS n_tokens, non_alpha_fraction, duplicate_line_fraction, mattr FROM routed", COUNTS, ROUTE),
        "det_rules": sql("SELECT doc_id, r_1_3, r_1_4, r_1_6, r_1_7, r_1_8, r_1_4 AS r_1_9, r_4_5, r_8_1 FROM scored", COUNTS, ROUTE, RULES),
        "block_inventory": sql("SELECT doc_id, tables, figures, images_n, formulas, links, sections FROM inv", INVENTORY),
        "na_decisions": sql("SELECT doc_id, array_to_string(na, ',') AS na FROM na", INVENTORY),
        "sections": sql("SELECT doc_id, section_no, length(part) AS n_chars, md5(part) AS digest FROM sections", SECTIONS),
        "chunks": sql("SELECT doc_id, chunk_no, length(part) AS n_chars, md5(part) AS digest FROM chunks", CHUNKS),
        "judge_scope": sql("SELECT s.doc_id, count(*) AS n_criteria, string_agg(c.id, ',' ORDER BY c.ord) AS ids FROM scored s JOIN na n USING (doc_id) CROSS JOIN criteria c WHERE NOT list_contains(n.na, c.id) AND NOT c.external_dep AND NOT (c.tag = 'D' AND c.id IN ('1.3', '1.4', '1.6', '1.7', '1.8', '1.9', '4.5', '8.1')) GROUP BY s.doc_id", COUNTS, ROUTE, RULES, INVENTORY),
        "latest_verdicts": sql("SELECT verdict_id, doc_id, section_no, crit_id, status, score FROM latest", LATEST),
        "verdict_validation": sql(f"SELECT verdict_id, coalesce(status = 'scored' AND score BETWEEN 1 AND 5 AND NOT {blank('justification')}, false) AS valid FROM latest", LATEST),
        "section_median": sql("SELECT doc_id, crit_id, n_valid, raw_median, score, section_no, justification, evidence FROM medians", LATEST, MEDIANS),
        "criterion_scores": sql("SELECT doc_id, ord, id, dimension, label, tag, weight, state, status, score, justification, evidence FROM crit", *FULL),
        "dimension_scores": sql("SELECT doc_id, dimension, tenths FROM dims", *FULL, SCORES),
        "doc_scores": sql("SELECT doc_id, global_pct, level, coverage_pct, flags FROM every_doc", *FULL, SCORES),
        "remediation": sql(f"SELECT doc_id, id AS critere_id, {cells.format(c='label')} AS critere, weight AS poids, score AS score_actuel, ord FROM crit WHERE status = 'scored' AND score <= 2", *FULL),
        "detail": sql(f"SELECT doc_id, id AS critere_id, tag, weight AS poids, status, score, {cells.format(c='justification')} AS justification, {cells.format(c='evidence')} AS preuve FROM crit", *FULL),
        "synthesis": sql('SELECT doc_id, global_pct AS "score_global_%", level AS niveau, coverage_pct AS "couverture_%", flags FROM every_doc', *FULL, SCORES),
        "corpus_levels": sql("SELECT level, count(*) AS n_docs, sum((global_pct * 10)::BIGINT)::BIGINT AS sum_tenths FROM every_doc GROUP BY level", *FULL, SCORES),
        "judge_cost": sql("SELECT doc_id, count(*) AS n_calls, sum(length(prompt))::BIGINT AS prompt_chars FROM prompts GROUP BY doc_id", COUNTS, ROUTE, RULES, INVENTORY, SECTIONS, SCOPE, PROMPTS),
        "parse_confidence": sql(
            f"""SELECT doc_id, CASE WHEN {blank('t')} THEN 0.0 ELSE ((2 * conf * clean + per * 10000) // (20000 * per)) / 1000.0 END AS confidence
                FROM (SELECT *, 10000 - (cid_fraction * 10000)::BIGINT AS clean, least(base, CASE WHEN pages > 0 AND len < 200 * pages THEN 400 * per ELSE base END, CASE WHEN fallback THEN 600 * per ELSE base END) AS conf
                      FROM (SELECT *, least(500, len) * per + 500 * full_blocks AS base
                            FROM (SELECT g.*, greatest(len(coalesce(blocks, [])), 1)::BIGINT AS per, CASE WHEN len(coalesce(blocks, [])) > 0 THEN len(list_filter(blocks, lambda b: NOT {blank('b.text')})) ELSE 1 END::BIGINT AS full_blocks,
                                         coalesce(s.s.provenance.source_pages, 0) AS pages, coalesce(s.s.provenance.parser = 'fallback', false) AS fallback
                                  FROM sig g LEFT JOIN side s ON g.doc_id = s.stem)))""",
            COUNTS, SIDE,
        ),
        "exact_duplicates": f"SELECT doc_id, group_id, n_docs FROM (SELECT doc_id, min(doc_id) OVER w AS group_id, count(*) OVER w AS n_docs FROM (SELECT doc_id, {norm} AS h FROM docs WHERE NOT {blank('markdown')}) WINDOW w AS (PARTITION BY h)) WHERE n_docs > 1",
        "cell_sanitise": f"SELECT id, {cells.format(c='commentaire_beta')} AS cell FROM golden",
        "golden_guard": f"SELECT DISTINCT id, question, CASE WHEN ok THEN 'oui' ELSE 'non' END AS couvert, CASE WHEN ok THEN {strip('reponse')} ELSE 'Non couvert par le document' END AS reponse FROM (SELECT *, coalesce(lower({strip('couvert')}) = 'oui' AND NOT {blank('reponse')}, false) AS ok FROM golden)",
        "golden_sources": sql(
            f"""SELECT q_id AS id, array_to_string(list_transform(list_sort(list({{'r': first_rank, 'd': doc_id}})), lambda x: x.d), '; ') AS sources
                FROM (SELECT q_id, doc_id, min(rank) AS first_rank FROM (
                        SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id, chunk_no) AS rank
                        FROM (SELECT q_id, doc_id, chunk_no, round({dot('q.v', 'c.v')} / ((sqrt({dot('q.v', 'q.v')}) + 1e-9) * (sqrt({dot('c.v', 'c.v')}) + 1e-9)), 12) AS score
                              FROM (SELECT q_id, {LETTERS.format(t='question')} AS v FROM (SELECT id AS q_id, min(question) AS question FROM golden WHERE id LIKE 'corpus-%' AND NOT {blank('question')} GROUP BY id)) q
                              CROSS JOIN (SELECT doc_id, chunk_no, {LETTERS.format(t='part')} AS v FROM chunks JOIN docs USING (doc_id) WHERE NOT {blank('markdown')}) c))
                      WHERE rank <= 6 GROUP BY ALL) GROUP BY q_id""",
            CHUNKS,
        ),
        "content_hash": "SELECT doc_id, sha256(coalesce(markdown, '')) AS hash FROM docs",
        "entry_flags": sql(
            """SELECT coalesce(d.doc_id, s.stem) AS doc_id, array_to_string(list_filter([
                 CASE WHEN d.doc_id IS NULL THEN 'missing_markdown' END,
                 CASE WHEN d.doc_id IS NOT NULL AND s.stem IS NULL THEN 'missing_sidecar' END,
                 CASE WHEN d.doc_id IS NOT NULL AND s.s.schema_version > 1 THEN 'sidecar_schema_unsupported:' || s.s.schema_version END,
                 CASE WHEN d.doc_id IS NOT NULL AND s.stem IS NOT NULL AND NOT coalesce(sha256(coalesce(d.markdown, '')) = s.s.markdown_hash, false) THEN 'manually_edited' END], lambda x: x IS NOT NULL), '|') AS entry_flags
               FROM docs d FULL JOIN side s ON d.doc_id = s.stem""",
            SIDE,
        ),
        "source_changed": sql(
            "SELECT d.doc_id, CASE WHEN s.stem IS NULL THEN 'write' ELSE 'skip' END AS action, coalesce(s.stem IS NOT NULL AND s.s.markdown_hash <> sha256(coalesce(d.markdown, '')), false) AS source_changed FROM docs d LEFT JOIN side s ON d.doc_id = s.stem", SIDE
        ),
        "triage_density": sql(
            "SELECT doc_id, CASE WHEN wpp < 10 THEN 'scanned' WHEN wpp > 100 AND ipp < 25 THEN 'born_digital' ELSE 'mixed' END AS category FROM (SELECT doc_id, CASE WHEN pages > 0 THEN words / pages ELSE 0 END AS wpp, CASE WHEN pages > 0 THEN imgs / pages ELSE 0 END AS ipp FROM (SELECT doc_id, c.n_tok AS words, len(coalesce(d.images, [])) AS imgs, coalesce(list_max(list_transform(d.blocks, lambda b: coalesce(b.page, 0))), 0) AS pages FROM c JOIN docs d USING (doc_id)))",
            COUNTS,
        ),
        "image_gate": "SELECT doc_id, im.placeholder AS placeholder, (im.x1 - im.x0 < 24.0 OR im.bottom - im.top < 24.0) AS decorative, trunc(im.x0 * 2.0)::INT AS px, trunc(im.top * 2.0)::INT AS py FROM (SELECT doc_id, unnest(images) AS im FROM docs)",
        "near_duplicates_vec": f"""WITH k AS (SELECT *, min(vec_id) OVER (PARTITION BY embedding) AS first_id FROM embeddings), r AS (SELECT * FROM k WHERE vec_id = first_id)
            SELECT a.vec_id AS a, b.vec_id AS b, false AS copy FROM r a JOIN r b ON a.vec_id < b.vec_id WHERE {dot('a.embedding', 'b.embedding')} / (sqrt({dot('a.embedding', 'a.embedding')}) * sqrt({dot('b.embedding', 'b.embedding')})) >= 0.95
            UNION ALL SELECT first_id, vec_id, true FROM k WHERE vec_id <> first_id""",
        "retrieve_topk": f"""WITH q AS (SELECT vec_id AS q_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0),
            s AS (SELECT q_id, vec_id::VARCHAR AS doc_id, round({dot('v', 'embedding')} / ((sqrt({dot('v', 'v')}) + 1e-9) * (sqrt({dot('embedding', 'embedding')}) + 1e-9)), 12) AS score FROM q CROSS JOIN embeddings)
            SELECT q_id, rank::INT AS rank, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 6""",
        "apply_manifest": """
            SELECT doc_id, md5(list_reduce(list_prepend(markdown, list_transform(images, lambda i: i.placeholder || chr(31) || CASE
                     WHEN i.x1 - i.x0 < 24.0 OR i.bottom - i.top < 24.0 THEN '[Image decorative ignoree]'
                     WHEN (i.page + i.idx) % 3 = 0 THEN '[Image (description automatique, non verifiee): ' || i.placeholder || ' vue]'
                     WHEN (i.page + i.idx) % 3 = 1 THEN '[Image non decrite: TimeoutError]' ELSE i.placeholder END)),
                   lambda m, p: replace(m, split_part(p, chr(31), 1), split_part(p, chr(31), 2)))) AS digest
            FROM docs WHERE len(images) > 0""",
        "prompt_chars": sql("SELECT doc_id, section_no, length(prompt) AS prompt_chars, md5(prompt) AS digest FROM prompts", COUNTS, ROUTE, RULES, INVENTORY, SECTIONS, SCOPE, PROMPTS),
    }
    return out
