"""Retrieval over the reviewer notes and drafts. Searches ask every draft whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import ALIASES, RETRIEVAL_STOP
from folioscope.operators import retrieval as R
from folioscope.sources.tables import table


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "note_passages").select(F.col("passage_id").alias("id"), "text")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "academic_drafts").filter("draft_id % 100 = 0").select(F.col("draft_id").alias("query_id"), F.col("answer_draft").alias("text"))


def idf_table(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and smoothed idf of every term of the notes."""
    p = _passages(spark, d)
    return R.idf_table(R.postings(p, "id", "text"), p.count()).select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three passages nearest to each question by TF-IDF cosine."""
    p = _passages(spark, d)
    return R.tfidf_nearest(_questions(spark, d), p, p.count(), 3)


def tfidf_meta_demoted_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same with describing sections at half their score."""
    p = table(spark, d, "note_passages").select(F.col("passage_id").alias("id"), "text", R.meta_factor(F.col("heading"), F.col("note")).alias("factor"))
    return R.tfidf_nearest(_questions(spark, d), p, p.count(), 3)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    p = _passages(spark, d)
    return R.bm25_nearest(_questions(spark, d), p, p.count(), 3)


def retrieval_auc(spark: SparkSession, d: str) -> DataFrame:
    """How well the stored scores tell answering sections from describing ones."""
    rows = table(spark, d, "note_passages").filter("score is not null").select("score", (~R.is_meta(F.col("heading"), F.col("note"))).alias("positive"))
    return R.rank_separation(rows)


def retrieval_median(spark: SparkSession, d: str) -> DataFrame:
    """Median stored score by kind of section."""
    rows = table(spark, d, "note_passages").filter("score is not null")
    return rows.groupBy(R.is_meta(F.col("heading"), F.col("note")).alias("is_meta")).agg(F.round(F.median("score"), 6).alias("median_score"), F.count("*").alias("n"))


def sibling_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All chunks of the sections of every hundredth passage."""
    corpus = table(spark, d, "note_passages").select("passage_id", "note", "heading", "chunk_index", "score")
    hits = corpus.filter("passage_id % 100 = 0").select("passage_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return R.with_siblings(hits, corpus.drop("score")).select("passage_id", "note", "heading", "score")


def claim_location(spark: SparkSession, d: str) -> DataFrame:
    """Passages that hold the terms of every hundredth claim."""
    claims = table(spark, d, "claim_contexts").filter("context_id % 100 = 0").select(F.col("context_id").alias("claim_id"), F.col("source_sentence").alias("text"))
    return R.located_claims(claims, _passages(spark, d))


def budget_select(spark: SparkSession, d: str) -> DataFrame:
    """The best passages of each note within 4,000 characters."""
    rows = table(spark, d, "note_passages").filter("text is not null").select("passage_id", "note", "chunk_index", "score", F.length("text").alias("chars"))
    return R.within_budget(rows, "note", "score", "passage_id", F.col("chars"), 4000).select("passage_id", "note", "used_chars")


QUERIES = {f.__name__: f for f in (tfidf_topk, idf_table, tfidf_meta_demoted_topk, bm25_topk, retrieval_auc, retrieval_median, sibling_chunks, claim_location, budget_select)}

_STOP = ", ".join(f"'{w}'" for w in RETRIEVAL_STOP)


def _tokens(table_sql: str, id_: str, text: str) -> str:
    return f"SELECT {id_} AS id, term, count(*) AS tf FROM (SELECT {id_}, unnest(regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9_+-]*')) AS term FROM {table_sql}) WHERE length(term) > 1 AND term NOT IN ({_STOP}) GROUP BY ALL"


_ALIAS = " || ".join(["answer_draft"] + [f"CASE WHEN regexp_matches(lower(answer_draft), '{p}') THEN ' {w}' ELSE '' END" for p, w in ALIASES.items()])
_ASKED = "(SELECT draft_id, {} AS text FROM academic_drafts WHERE draft_id % 100 = 0)"
_BASE = f"""WITH post AS ({_tokens("note_passages", "passage_id", "text")}), n AS (SELECT count(*) AS n FROM note_passages),
idf AS (SELECT term, count(*) AS df, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM post, n GROUP BY term)"""
_COSINE = f"""{_BASE}, raw AS (SELECT id, term, tf * idf AS r FROM post JOIN idf USING (term)), w AS (SELECT id, term, r / sqrt(sum(r * r) OVER (PARTITION BY id)) AS w FROM raw),
ask AS ({_tokens(_ASKED.format(_ALIAS), "draft_id", "text")}), qraw AS (SELECT id AS query_id, term, tf * idf AS r FROM ask JOIN idf USING (term)),
q AS (SELECT query_id, term, r / sqrt(sum(r * r) OVER (PARTITION BY query_id)) AS wq FROM qraw),
scored AS (SELECT query_id, w.id, sum(w * wq) AS score FROM w JOIN q USING (term) GROUP BY ALL)"""
_TOP = "SELECT query_id, id, rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM {}) WHERE rank <= 3"
_META = " OR ".join(f"starts_with(lower(trim(coalesce(heading, ''))), '{h}')" for h in R.META_HEADINGS) + " OR coalesce(lower(trim(heading)) = lower(trim(note)), false)"
_CLAIM = "unnest(list_distinct(list_filter(regexp_extract_all(lower({}), '\\d+(?:\\.\\d+)?|[a-z][a-z0-9-]+'), lambda t: regexp_matches(t, '^\\d') OR (length(t) > 2 AND t NOT IN (" + _STOP + ")))))"

ORACLES = {
    "idf_table": f"{_BASE} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "tfidf_topk": f"{_COSINE} {_TOP.format('scored')}",
    "tfidf_meta_demoted_topk": f"{_COSINE}, low AS (SELECT query_id, id, scored.score * CASE WHEN {_META} THEN 0.5 ELSE 1.0 END AS score FROM scored JOIN note_passages ON id = passage_id) {_TOP.format('low')}",
    "bm25_topk": f"""{_BASE}, len AS (SELECT id, sum(tf) AS len FROM post GROUP BY id), mean AS (SELECT sum(len) / (SELECT n FROM n) AS mean FROM len),
        ask AS (SELECT DISTINCT id AS query_id, term FROM ({_tokens(_ASKED.format("answer_draft"), "draft_id", "text")})),
        scored AS (SELECT query_id, post.id, sum(greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score
          FROM post JOIN idf USING (term) JOIN ask USING (term) JOIN len ON len.id = post.id, mean, n GROUP BY ALL) {_TOP.format("scored")}""",
    "retrieval_auc": f"""WITH s AS (SELECT score, NOT ({_META}) AS positive FROM note_passages WHERE score IS NOT NULL)
        SELECT round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM (SELECT score FROM s WHERE positive) p, (SELECT score FROM s WHERE NOT positive) n""",
    "retrieval_median": f"SELECT ({_META}) AS is_meta, round(median(score), 6) AS median_score, count(*) AS n FROM note_passages WHERE score IS NOT NULL GROUP BY 1",
    "sibling_chunks": """WITH h AS (SELECT * FROM note_passages WHERE passage_id % 100 = 0)
        SELECT passage_id, note, heading, CASE WHEN passage_id % 100 = 0 THEN coalesce(score, 0) END AS score FROM note_passages p
        WHERE passage_id IN (SELECT passage_id FROM h) OR EXISTS (SELECT 1 FROM h WHERE h.note = p.note AND h.heading = p.heading)""",
    "claim_location": f"""WITH c AS (SELECT context_id AS claim_id, {_CLAIM.format("source_sentence")} AS term FROM claim_contexts WHERE context_id % 100 = 0),
        p AS (SELECT passage_id AS id, {_CLAIM.format("text")} AS term FROM note_passages), s AS (SELECT claim_id, count(*) AS size FROM c GROUP BY 1),
        m AS (SELECT claim_id, id, count(*) AS shared, count(*) FILTER (regexp_matches(term, '^\\d')) AS shared_numbers FROM c JOIN p USING (term) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY shared_numbers DESC, shared DESC, id) AS rank FROM m JOIN s USING (claim_id) WHERE shared >= 2 AND shared >= 0.25 * size)
        SELECT claim_id, id, rank, shared, shared_numbers FROM r WHERE rank <= 3""",
    "budget_select": """SELECT passage_id, note, used_chars FROM (SELECT *, CAST(sum(length(text)) OVER (PARTITION BY note ORDER BY score DESC NULLS LAST, passage_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used_chars
        FROM note_passages WHERE text IS NOT NULL) WHERE used_chars <= 4000""",
}
