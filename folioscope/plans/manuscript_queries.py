"""Spans, overclaims and scores over drafts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import SENTENCE_STOP
from folioscope.operators import claims as C
from folioscope.operators import manuscript as M
from folioscope.sources.tables import spread, table


def claim_sources(spark: SparkSession, d: str) -> DataFrame:
    """The draft's sentence, and the one before it, that hold each claim's span."""
    drafts = spread(table(spark, d, "academic_drafts").select("draft_id", "answer_draft"))
    claims = table(spark, d, "claim_contexts").select(F.col("context_id").alias("claim_id"), "draft_id", F.col("source_sentence_start").alias("claim_start"), F.col("source_sentence_end").alias("claim_end"))
    return M.claim_sources(claims, M.sentence_spans(drafts, "draft_id", "answer_draft"), "draft_id")


def contained_spans(spark: SparkSession, d: str) -> DataFrame:
    """The smallest context of the same draft that holds each claim's sentence, other than its own."""
    rows = table(spark, d, "claim_contexts")
    inner = rows.select(F.col("context_id").alias("inner_id"), "draft_id", F.col("source_sentence_start").alias("a"), F.col("source_sentence_end").alias("b"))
    outer = rows.select(F.col("context_id").alias("outer_id"), "draft_id", F.col("context_start").alias("a"), F.col("context_end").alias("b"))
    return M.contained_spans(inner, outer, "draft_id")


def answer_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of the documents by page."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return M.answer_blocks(docs, "doc_id", "text").groupBy("doc_id", "page").agg(F.count("*").alias("paragraphs"))


def overclaims(spark: SparkSession, d: str) -> DataFrame:
    return M.overclaims(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def search_windows(spark: SparkSession, d: str) -> DataFrame:
    return M.search_window(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def citation_scores(spark: SparkSession, d: str) -> DataFrame:
    return C.citation_scores(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def shared_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Share of each source sentence's words that its context excerpt holds."""
    rows = table(spark, d, "claim_contexts")
    return rows.select("context_id", F.round(C.shared_words(F.col("source_sentence"), F.col("context_excerpt")), 6).alias("share"))


def damaged_tables(spark: SparkSession, d: str) -> DataFrame:
    """Documents made of table rows that look damaged or fragmented."""
    rows = table(spark, d, "documents").filter(F.col("text").rlike(r"(?m)^.*\|.*\|"))
    return rows.select("doc_id", M.looks_damaged(F.col("text")).alias("damaged"), F.round(M.fragmentation(F.col("text")), 6).alias("fragmented"))


QUERIES = {f.__name__: f for f in (claim_sources, contained_spans, answer_blocks, overclaims, search_windows, citation_scores, shared_evidence, damaged_tables)}

_STOPS = ", ".join(f"'{w}'" for w in SENTENCE_STOP)
_NEAR = "list_distinct(list_transform(list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z][a-z\\-]+')), lambda w: length(w) > 2 AND w NOT IN (" + _STOPS + ")), lambda w: CASE WHEN length(w) > 3 AND suffix(w, 's') AND NOT suffix(w, 'ss') THEN substring(w, 1, length(w) - 1) ELSE w END))"
_T = "coalesce(text, '')"

ORACLES = {
    "contained_spans": """SELECT inner_id, arg_min(outer_id, (w, outer_id)) AS outer_id FROM (SELECT i.context_id AS inner_id, o.context_id AS outer_id, o.context_end - o.context_start AS w FROM claim_contexts i JOIN claim_contexts o USING (draft_id)
        WHERE o.context_start <= i.source_sentence_start AND i.source_sentence_end <= o.context_end AND i.context_id <> o.context_id) GROUP BY 1""",
    "answer_blocks": r"""WITH p AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\n\s*\n', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents)),
        f AS (SELECT doc_id, coalesce(last_value(TRY_CAST(nullif(regexp_extract(p, '\[Page (\d+)\]', 1), '') AS INTEGER) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS page FROM p)
        SELECT doc_id, page, count(*) AS paragraphs FROM f GROUP BY ALL""",
    "overclaims": "SELECT * FROM (SELECT doc_id, CAST(" + " + ".join(f"len(regexp_extract_all(lower({_T}), '{p}'))" for p in M.OVERCLAIMS) + " AS INTEGER) AS hits FROM documents) WHERE hits > 0",
    "citation_scores": f"""SELECT doc_id, len(regexp_extract_all({_T}, '(?i)confidence:\\W*high\\b')) AS high, len(regexp_extract_all({_T}, '(?i)confidence:\\W*moderate\\b')) AS moderate, len(regexp_extract_all({_T}, '(?i)confidence:\\W*low\\b')) AS low,
        len(regexp_extract_all({_T}, 'Cites this pipeline''s own summary')) AS self_cites, len(regexp_extract_all({_T}, 'Quotation (?:not found|only partly found)')) AS bad_quotes, len(regexp_extract_all({_T}, 'Evidence line restates the concern')) AS echoes FROM documents""",
    "shared_evidence": f"SELECT context_id, round(CASE WHEN len({_NEAR.format('source_sentence')}) > 0 THEN coalesce(len(list_intersect({_NEAR.format('source_sentence')}, {_NEAR.format('context_excerpt')})), 0) / len({_NEAR.format('source_sentence')}) ELSE 0 END, 6) AS share FROM claim_contexts",
    "damaged_tables": r"""WITH b AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda r: trim(r, ' ') <> '') AS r FROM documents WHERE regexp_matches(text, '(?m)^.*\|.*\|'))
        SELECT doc_id, regexp_matches(text, '[a-z]-\n[a-z]') OR regexp_matches(text, '(?m)(?:^|[|\t ])[a-zA-Z]\d(?:[|\t ]|$)') OR (len(r) > 3 AND len(list_filter(r, lambda x: NOT regexp_matches(x, '\d'))) * 3 >= len(r)) AS damaged,
        round(CASE WHEN len(r) > 0 THEN len(list_filter(r, lambda x: regexp_matches(trim(x, ' '), '^\S{1,12}$'))) / len(r) ELSE 0.0 END, 6) AS fragmented FROM b""",
}
