"""Items, groups, tallies, coverage and states over drafts, claims, notes and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.text import SENTENCE_STOP
from folioscope.operators import reports as P
from folioscope.operators.segments import sentence_rows
from folioscope.sources.tables import table


def list_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of the lists in the documents, numbered by document, with their heading."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return P.list_items(docs, "doc_id", "text").select("doc_id", "item_no", "heading", "lines", F.md5("item").alias("item_md5"))


def loose_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return P.loose_lines(docs, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("lines"))


def numbered_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims numbered by draft: Q1.. for questions, C1.. for the rest, in order of their id."""
    kind = F.when(F.col("source_sentence").rlike(r"[?？؟]\s*$"), "question").otherwise("claim")
    rows = table(spark, d, "claim_contexts").filter("source_sentence is not null").select("context_id", "draft_id", kind.alias("kind"))
    return P.numbered(rows, "draft_id", "kind", "context_id", {"claim": "C", "question": "Q"}).select("context_id", "item_id")


def grouped_findings(spark: SparkSession, d: str) -> DataFrame:
    return P.grouped_findings(table(spark, d, "claim_contexts"), "context_id", "source_sentence")


def merged_passes(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of each job's drafts as passes of one report: what the first says, and what only later ones add."""
    drafts = table(spark, d, "academic_drafts").filter("question is not null and answer_draft is not null").withColumn("pass_no", F.row_number().over(Window.partitionBy("question").orderBy("draft_id")))
    items = sentence_rows(drafts.select("question", "draft_id", "pass_no", "answer_draft"), "answer_draft").select("question", "draft_id", "pass_no", F.col("sentence_no").alias("item_no"), F.col("sentence").alias("text"))
    return P.merged_passes(items, "question").groupBy("draft_id", "later_only").agg(F.count("*").alias("kept"))


def section_previews(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each section with the five lowest ids."""
    return P.counted_with_previews(table(spark, d, "documents").select("section", "doc_id"), "section", "doc_id")


def draft_tally(spark: SparkSession, d: str) -> DataFrame:
    """Sentences a draft by model: mean, least and most."""
    rows = sentence_rows(table(spark, d, "academic_drafts").select("draft_id", "model", "answer_draft"), "answer_draft").groupBy("draft_id", "model").agg(F.count("*").alias("sentences"))
    return P.tally(rows, ["model"], "sentences")


def presence_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Which sections each source has documents of."""
    return P.presence_matrix(table(spark, d, "documents").select("source", "section"), "source", "section")


def draft_states(spark: SparkSession, d: str) -> DataFrame:
    """The first state that a draft's claims give it: incomplete, drifted, cut, else sound."""
    rows = table(spark, d, "claim_contexts").filter("draft_id is not null")
    rules = [("incomplete", F.col("source_sentence").isNull()), ("drifted", F.col("source_sentence_end") - F.col("source_sentence_start") != F.length("source_sentence")), ("cut", ~F.col("source_sentence").rlike(r"[.!?。！？।؟]\s*$"))]
    return P.first_state(rows, "draft_id", rules, "sound")


def sentence_screening(spark: SparkSession, d: str) -> DataFrame:
    """Whether each draft's sentences are each the source of exactly one claim."""
    s = sentence_rows(table(spark, d, "academic_drafts").select("draft_id", "answer_draft"), "answer_draft").select("draft_id", F.md5(F.trim("sentence")).alias("segment"))
    c = table(spark, d, "claim_contexts").filter("source_sentence is not null").select("draft_id", F.md5(F.trim("source_sentence")).alias("segment"))
    return P.screening(s, c, "draft_id", "segment")


def missing_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims whose draft and sentence no sentence of the drafts has; nulls are equal."""
    known = sentence_rows(table(spark, d, "academic_drafts").select("draft_id", "answer_draft"), "answer_draft").select("draft_id", F.col("sentence").alias("source_sentence"))
    rows = table(spark, d, "claim_contexts").groupBy("draft_id", "source_sentence").agg(F.min("context_id").alias("context_id"))
    return P.missing_claims(rows, known, ["draft_id", "source_sentence"]).select("context_id")


def relationship_states(spark: SparkSession, d: str) -> DataFrame:
    """Drafts whose references speak for identity (a DOI) or difference (none) with what is cited elsewhere."""
    rows = table(spark, d, "academic_references").select("draft_id", F.when(F.col("doi").isNotNull(), "identity").otherwise("difference").alias("kind"))
    return P.accepted_relationship(rows.filter("draft_id is not null"), "draft_id")


QUERIES = {f.__name__: f for f in (list_items, loose_lines, numbered_claims, grouped_findings, merged_passes, section_previews, draft_tally, presence_matrix, draft_states, sentence_screening, missing_claims, relationship_states)}

_LINES = "(SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS line_no FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n|\\r|\\n', chr(1), 'g'), chr(1)) AS p FROM documents))"
_MARK = r"^\s*(?:[-*•–]|\(?\d{1,3}[.)])\s+"
_SPLIT = "list_filter(string_split(regexp_replace(answer_draft, '([.;:!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '')"
_KEY = "nullif(trim(regexp_replace(lower(source_sentence), '\\s+', ' ', 'g'), ' '), '')"
_SENT = f"(SELECT draft_id, model, question, unnest({_SPLIT}) AS sentence, generate_subscripts({_SPLIT}, 1) AS sentence_no FROM academic_drafts)"
_WORDS = "list_filter(list_distinct(regexp_extract_all(lower(sentence), '[a-z][a-z\\-]+')), lambda w: length(w) > 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in SENTENCE_STOP) + "))"

ORACLES = {
    "list_items": f"""WITH k AS (SELECT *, CASE WHEN trim(line, ' ') = '' THEN 'blank' WHEN regexp_matches(line, '^#{{1,6}}\\s') THEN 'heading' WHEN regexp_matches(line, '{_MARK}') THEN 'mark' ELSE 'text' END AS kind, nullif(regexp_extract(line, '^#{{1,6}}\\s+(\\S.*)$', 1), '') AS h FROM {_LINES}),
        r AS (SELECT *, last_value(h IGNORE NULLS) OVER o AS heading, count(*) FILTER (kind = 'mark') OVER o AS item_no, max(CASE WHEN kind IN ('blank', 'heading') THEN line_no END) OVER o AS lb, max(CASE WHEN kind = 'mark' THEN line_no END) OVER o AS lm FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
        SELECT doc_id, item_no, arg_min_null(heading, line_no) AS heading, count(*) AS lines, md5(regexp_replace(string_agg(trim(line, ' '), ' ' ORDER BY line_no), '{_MARK}', '')) AS item_md5 FROM r WHERE item_no > 0 AND kind IN ('mark', 'text') AND coalesce(lb, 0) < lm GROUP BY doc_id, item_no""",
    "loose_lines": f"SELECT doc_id, count(*) AS lines FROM {_LINES} WHERE trim(line, ' ') <> '' AND NOT regexp_matches(line, '^#{{1,6}}\\s') AND NOT regexp_matches(line, '{_MARK}') GROUP BY 1",
    "numbered_claims": r"""WITH k AS (SELECT context_id, draft_id, CASE WHEN regexp_matches(source_sentence, '[?？؟]\s*$') THEN 'Q' ELSE 'C' END AS p FROM claim_contexts WHERE source_sentence IS NOT NULL)
        SELECT context_id, p || row_number() OVER (PARTITION BY draft_id, p ORDER BY context_id) AS item_id FROM k""",
    "grouped_findings": f"""WITH k AS (SELECT context_id, {_KEY} AS key FROM claim_contexts) SELECT context_id, CASE WHEN key IS NULL THEN context_id ELSE min(context_id) OVER (PARTITION BY key) END AS group_id, CASE WHEN key IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY key) END AS group_size FROM k""",
    "merged_passes": f"""WITH p AS (SELECT draft_id, row_number() OVER (PARTITION BY question ORDER BY draft_id) AS pass_no FROM academic_drafts WHERE question IS NOT NULL AND answer_draft IS NOT NULL),
        i AS (SELECT question, draft_id, pass_no, sentence_no, {_WORDS} AS w FROM {_SENT} JOIN p USING (draft_id)),
        x AS (SELECT DISTINCT a.draft_id, a.sentence_no FROM i a JOIN i b ON a.question = b.question AND b.pass_no < a.pass_no WHERE len(list_intersect(a.w, b.w)) > 0 AND len(list_intersect(a.w, b.w)) >= 0.6 * least(len(a.w), len(b.w)))
        SELECT draft_id, pass_no > 1 AS later_only, count(*) AS kept FROM i ANTI JOIN x USING (draft_id, sentence_no) GROUP BY ALL""",
    "section_previews": "SELECT section, count(*) AS n, array_to_string(list_sort(list(doc_id))[1:5], ',') AS previews FROM documents GROUP BY 1",
    "draft_tally": f"WITH s AS (SELECT draft_id, model, count(*) AS n FROM {_SENT} GROUP BY ALL) SELECT model, count(*) AS n, round(avg(n), 4) AS mean, min(n) AS least, max(n) AS most FROM s GROUP BY 1",
    "presence_matrix": """WITH f AS (SELECT source, section, count(*) AS n FROM documents WHERE source IS NOT NULL AND section IS NOT NULL GROUP BY ALL)
        SELECT source, section, CASE WHEN n IS NULL THEN 'ABSENT' ELSE 'present' END AS state, coalesce(n, 0) AS n FROM (SELECT DISTINCT source FROM f) CROSS JOIN (SELECT DISTINCT section FROM f) LEFT JOIN f USING (source, section)""",
    "draft_states": """SELECT draft_id, CASE WHEN bool_or(source_sentence IS NULL) THEN 'incomplete' WHEN coalesce(bool_or(source_sentence_end - source_sentence_start <> length(source_sentence)), false) THEN 'drifted'
        WHEN coalesce(bool_or(NOT regexp_matches(source_sentence, '[.!?。！？।؟]\\s*$')), false) THEN 'cut' ELSE 'sound' END AS state FROM claim_contexts WHERE draft_id IS NOT NULL GROUP BY 1""".replace("\\\\", "\\"),
    "sentence_screening": f"""WITH s AS (SELECT DISTINCT draft_id, trim(sentence, ' ') AS t FROM {_SENT}), c AS (SELECT draft_id, trim(source_sentence, ' ') AS t, count(*) AS n FROM claim_contexts WHERE source_sentence IS NOT NULL GROUP BY ALL)
        SELECT draft_id, count(*) AS segments, count(n) AS screened, bool_and(coalesce(n = 1, false)) AS complete FROM s LEFT JOIN c USING (draft_id, t) GROUP BY 1""",
    "missing_claims": f"""WITH r AS (SELECT draft_id, source_sentence, min(context_id) AS context_id FROM claim_contexts GROUP BY ALL)
        SELECT context_id FROM r WHERE NOT EXISTS (SELECT 1 FROM {_SENT} s WHERE s.draft_id IS NOT DISTINCT FROM r.draft_id AND s.sentence IS NOT DISTINCT FROM r.source_sentence)""",
    "relationship_states": """SELECT draft_id, CASE WHEN bool_or(doi IS NOT NULL) AND NOT bool_or(doi IS NULL) THEN 'identity' WHEN NOT bool_or(doi IS NOT NULL) THEN 'difference' ELSE 'not established' END AS state FROM academic_references WHERE draft_id IS NOT NULL GROUP BY 1""",
}
