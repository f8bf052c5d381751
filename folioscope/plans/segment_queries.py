"""Sentences, segments, pages and spans of documents and drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import RETRIEVAL_STOP, SENTENCE_STOP
from folioscope.operators import segments as S
from folioscope.sources.tables import table


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = S.sentence_rows(_documents(spark, d), "text")
    return rows.select("doc_id", F.col("sentence_no").cast("long").alias("sentence_no"), F.md5("sentence").alias("sentence_md5"))


def adjacent_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidates for near matches, counted by document and width."""
    rows = S.adjacent_pairs(_documents(spark, d), "doc_id", "text")
    return rows.groupBy("doc_id", "width").agg(F.count("*").alias("candidates"), F.sum(F.length("candidate")).alias("chars"))


def consecutive_repeats(spark: SparkSession, d: str) -> DataFrame:
    rows = S.consecutive_repeats(_documents(spark, d), "doc_id", "text")
    return rows.withColumn("sentence_no", F.col("sentence_no").cast("long"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of 800 characters of every document."""
    rows = S.fixed_segments(_documents(spark, d), "doc_id", "text", 800)
    return rows.select("doc_id", F.col("segment_no").cast("long").alias("segment_no"), F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"), F.md5("segment").alias("segment_md5"))


def segment_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How far the context excerpts of each draft's claims are from covering the draft exactly: gaps, overlaps, changed text, truncation."""
    excerpts = table(spark, d, "claim_contexts").filter("context_start is not null and context_end is not null and draft_id is not null")
    rows = excerpts.select("draft_id", F.col("context_start").alias("start_char"), F.col("context_end").alias("end_char"), F.col("context_excerpt").alias("segment"))
    return S.coverage_faults(rows, table(spark, d, "academic_drafts").select("draft_id", "answer_draft"), "draft_id", "answer_draft")


def paragraph_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = S.paragraphs(_documents(spark, d), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.max(F.length("paragraph")).cast("long").alias("longest"))


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """As-of lookup: each line with a sentence end, by the page marker at or before it; 0 before the first."""
    marker = lambda s: F.regexp_extract(s, r"^\[Page (\d+)\]", 1).try_cast("int")
    rows = S.filled_lines(_documents(spark, d), "doc_id", "text", marker, "page").filter(F.col("line").rlike(r"[.!?]\s*$"))
    return rows.groupBy("doc_id", F.coalesce("page", F.lit(0)).alias("page")).agg(F.count("*").alias("ended_lines"))


def section_fill(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each document by the heading that they stand under."""
    heading = lambda s: F.nullif(F.regexp_extract(s, r"^#{1,6}\s+(\S.*)$", 1), F.lit(""))
    rows = S.filled_lines(_documents(spark, d), "doc_id", "text", heading, "heading").filter("heading is not null")
    return rows.groupBy("doc_id", "heading").agg(F.count("*").alias("lines"))


def merged_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping context spans of each draft made one."""
    rows = table(spark, d, "claim_contexts").filter("draft_id is not null").select("draft_id", "context_start", "context_end")
    return S.merged_spans(rows, "draft_id", "context_start", "context_end")


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval tokens, and different ones, of each document."""
    from folioscope.functions.text import tokens

    found = tokens(F.col("text"))
    return _documents(spark, d).select("doc_id", F.size(found).cast("long").alias("tokens"), F.size(F.array_distinct(found)).cast("long").alias("different"))


def number_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number tokens of each document and the sum of the plain decimals among them."""
    from folioscope.functions.text import numbers

    plain = F.filter(numbers(F.col("text")), lambda n: n.rlike(r"^\d+\.\d+$"))
    return _documents(spark, d).select("doc_id", F.size(numbers(F.col("text"))).cast("long").alias("numbers"), F.round(F.aggregate(plain, F.lit(0.0), lambda a, n: a + n.cast("double")), 4).alias("decimal_sum"))


QUERIES = {f.__name__: f for f in (sentences, adjacent_pairs, consecutive_repeats, segments, segment_coverage, paragraph_counts, page_lines, section_fill, merged_contexts, token_counts, number_counts)}

_SENT = "(SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS kept_no, i AS sentence_no FROM (SELECT doc_id, unnest(p) AS sentence, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.;:!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '') AS p FROM documents)))"
_LINES = "(SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS line_no FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n|\\r|\\n', chr(1), 'g'), chr(1)) AS p FROM documents))"
_WORDS = "list_filter(list_distinct(regexp_extract_all(lower(sentence), '[a-z][a-z\\-]+')), lambda w: length(w) > 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in SENTENCE_STOP) + "))"
_TOK = "list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_+-]*'), lambda t: length(t) > 1 AND t NOT IN (" + ", ".join(f"'{w}'" for w in RETRIEVAL_STOP) + "))"
_NUM = "regexp_extract_all(text, '[-+−–—‒]?\\d+(?:[.,]\\d+)?(?:\\s?[eE][-+−–—‒]?\\d+)?')"
_SEG = "(SELECT doc_id, s + 1 AS segment_no, s * 800 AS start_char, least(s * 800 + 800, length(text)) AS end_char, substring(text, s * 800 + 1, 800) AS segment FROM (SELECT *, unnest(range(0, (length(text) + 799) // 800)) AS s FROM documents))"

ORACLES = {
    "sentences": f"SELECT doc_id, sentence_no, md5(sentence) AS sentence_md5 FROM {_SENT}",
    "adjacent_pairs": f"""WITH s AS (SELECT doc_id, sentence, lead(sentence) OVER (PARTITION BY doc_id ORDER BY sentence_no) AS nxt FROM {_SENT})
        SELECT doc_id, CAST(1 AS INTEGER) AS width, count(*) AS candidates, CAST(sum(length(sentence)) AS BIGINT) AS chars FROM s GROUP BY 1
        UNION ALL SELECT doc_id, CAST(2 AS INTEGER), count(*), CAST(sum(length(sentence) + 1 + length(nxt)) AS BIGINT) FROM s WHERE nxt IS NOT NULL GROUP BY 1""",
    "consecutive_repeats": f"""WITH s AS (SELECT doc_id, sentence_no, sentence, {_WORDS} AS w FROM {_SENT}),
        l AS (SELECT *, lag(w) OVER o AS b, lag(length(sentence)) OVER o AS n FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY sentence_no)),
        j AS (SELECT *, len(list_intersect(w, b)) AS x, len(w) + len(b) - len(list_intersect(w, b)) AS y FROM l WHERE len(w) >= 8 AND len(b) >= 8)
        SELECT doc_id, sentence_no, round(x / y, 6) AS jaccard FROM j WHERE x / y >= 0.9 AND greatest(length(sentence), n) / least(length(sentence), n) <= 1.15""",
    "segments": f"SELECT doc_id, segment_no, start_char, end_char, md5(segment) AS segment_md5 FROM {_SEG}",
    "segment_coverage": """WITH s AS (SELECT draft_id, context_start AS a, context_end AS b, context_excerpt AS t FROM claim_contexts WHERE context_start IS NOT NULL AND context_end IS NOT NULL AND draft_id IS NOT NULL),
        l AS (SELECT s.*, answer_draft, coalesce(lag(b) OVER (PARTITION BY draft_id ORDER BY a, b), 0) AS before FROM s JOIN academic_drafts USING (draft_id))
        SELECT DISTINCT draft_id, CASE WHEN a > before THEN 'gap' WHEN a < before THEN 'overlap' ELSE 'changed text' END AS fault FROM l WHERE a > before OR a < before OR substring(answer_draft, a + 1, b - a) <> t
        UNION SELECT draft_id, CASE WHEN coalesce(answer_draft, '') = '' AND e IS NULL THEN 'empty source' WHEN e IS NULL THEN 'no segment' ELSE 'truncated' END FROM academic_drafts LEFT JOIN (SELECT draft_id, max(b) AS e FROM s GROUP BY 1) USING (draft_id) WHERE e IS NULL OR e < length(coalesce(answer_draft, ''))""",
    "paragraph_counts": """WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n\\s*\\n', chr(1), 'g'), chr(1))) AS p FROM documents)
        SELECT doc_id, count(*) AS paragraphs, max(length(trim(p, ' '))) AS longest FROM p WHERE trim(p, ' ') <> '' GROUP BY 1""",
    "page_lines": f"""WITH l AS (SELECT *, last_value(TRY_CAST(nullif(regexp_extract(line, '^\\[Page (\\d+)\\]', 1), '') AS INTEGER) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS page FROM {_LINES})
        SELECT doc_id, coalesce(page, 0) AS page, count(*) AS ended_lines FROM l WHERE regexp_matches(line, '[.!?]\\s*$') GROUP BY ALL""",
    "section_fill": f"""WITH l AS (SELECT *, last_value(nullif(regexp_extract(line, '^#{{1,6}}\\s+(\\S.*)$', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS heading FROM {_LINES})
        SELECT doc_id, heading, count(*) AS lines FROM l WHERE heading IS NOT NULL GROUP BY ALL""",
    "merged_contexts": """WITH g AS (SELECT draft_id, context_start AS s, context_end AS e, count(*) AS n FROM claim_contexts WHERE draft_id IS NOT NULL AND context_start <= context_end GROUP BY ALL),
        r AS (SELECT *, max(e) OVER (PARTITION BY draft_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
        i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY draft_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r)
        SELECT draft_id, min(s) AS span_start, max(e) AS span_end, CAST(sum(n) AS BIGINT) AS merged FROM i GROUP BY draft_id, island""",
    "token_counts": f"SELECT doc_id, len({_TOK}) AS tokens, len(list_distinct({_TOK})) AS different FROM documents",
    "number_counts": f"SELECT doc_id, len({_NUM}) AS numbers, round(coalesce(list_sum(list_transform(list_filter({_NUM}, lambda n: regexp_matches(n, '^\\d+\\.\\d+$')), lambda n: CAST(n AS DOUBLE))), 0.0), 4) AS decimal_sum FROM documents",
}
