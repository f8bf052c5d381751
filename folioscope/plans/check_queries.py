"""Rules and checks over documents, drafts and their quotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import SENTENCE_STOP
from folioscope.operators import checks as K
from folioscope.operators import rules as R
from folioscope.operators.segments import sentence_rows
from folioscope.sources.tables import spread, table


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    """Each claim's source sentence as a quotation of its own draft."""
    drafts = table(spark, d, "academic_drafts").select("draft_id", F.col("answer_draft").alias("source"))
    return table(spark, d, "claim_contexts").select(F.col("context_id").alias("quote_id"), "draft_id", F.col("source_sentence").alias("quote")).join(drafts, "draft_id")


def design_classes(spark: SparkSession, d: str) -> DataFrame:
    return R.classified_designs(_documents(spark, d), "text")


def expected_elements(spark: SparkSession, d: str) -> DataFrame:
    return R.expected_elements(_documents(spark, d), "text")


def bayesian_gate(spark: SparkSession, d: str) -> DataFrame:
    return R.bayesian_gate(_documents(spark, d), "text")


def manifest_flags(spark: SparkSession, d: str) -> DataFrame:
    return R.manifest_flags(_documents(spark, d), "text")


def contradicted_absences(spark: SparkSession, d: str) -> DataFrame:
    """Papers of which one document says that a thing isn't reported while another reports it."""
    docs = table(spark, d, "documents").filter("paper_id is not null").select("paper_id", "text")
    marked = R.manifest_flags(docs, "text")
    flags = marked.groupBy("paper_id").agg(*[F.bool_or(f).alias(f) for f in [*R.FLAGS, "randomised"]])
    low = F.lower("text")
    said = docs.select("paper_id", F.inline(F.array(*[F.struct(F.lit(f).alias("flag"), F.regexp_extract(low, p, 0).alias("sentence")) for f, p in ABSENCES.items()]))).filter("sentence != ''").distinct()
    return R.contradicted_absences(flags, said, "paper_id")


def estimates_outside(spark: SparkSession, d: str) -> DataFrame:
    return K.estimates_outside(_documents(spark, d), "doc_id", "text")


def percentage_sums(spark: SparkSession, d: str) -> DataFrame:
    return K.percentage_sums(_documents(spark, d), "doc_id", "text").select("doc_id", F.col("sentence_no").cast("long").alias("sentence_no"), F.col("shares").cast("long").alias("shares"), "total")


def artefact_pages(spark: SparkSession, d: str) -> DataFrame:
    return K.artefact_pages(_documents(spark, d), "doc_id", "text")


def display_items(spark: SparkSession, d: str) -> DataFrame:
    return K.display_items(_documents(spark, d), "doc_id", "text").select("doc_id", F.col("tables").cast("long").alias("tables"), F.col("figures").cast("long").alias("figures"))


def truncated_texts(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).filter(K.looks_truncated(F.col("text"))).select("doc_id")


def quote_verification(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source sentence stands in its draft: exactly, elided, by its numbers, or not."""
    return K.quote_verdicts(_quotes(spark, d)).select("quote_id", "verdict")


def nearest_sentences(spark: SparkSession, d: str) -> DataFrame:
    """For each source sentence the nearest sentence of its draft."""
    drafts = table(spark, d, "academic_drafts").select("draft_id", "answer_draft")
    return K.nearest_sentences(_quotes(spark, d).select("quote_id", "draft_id", "quote"), sentence_rows(drafts, "answer_draft"), "draft_id").withColumn("sentence_no", F.col("sentence_no").cast("long"))


def nearest_candidates(spark: SparkSession, d: str) -> DataFrame:
    """For each source sentence the nearest sentence or adjacent pair of its draft that has a run of its words."""
    drafts = table(spark, d, "academic_drafts").select("draft_id", "answer_draft")
    return K.nearest_candidates(_quotes(spark, d).select("quote_id", "draft_id", "quote"), drafts, "draft_id", "answer_draft")


def stated_span_states(spark: SparkSession, d: str) -> DataFrame:
    """Each claim's offsets checked against its draft: verified, drifted, out of bounds or missing."""
    rows = table(spark, d, "claim_contexts").join(table(spark, d, "academic_drafts").select("draft_id", "answer_draft"), "draft_id", "left")
    a, b, n = F.col("source_sentence_start"), F.col("source_sentence_end"), F.length("answer_draft")
    state = F.when(F.col("source_sentence").isNull() | F.col("answer_draft").isNull() | a.isNull() | b.isNull(), "missing").when((a < 0) | (b > n) | (a > b), "out of bounds").when(F.expr("substring(answer_draft, source_sentence_start + 1, source_sentence_end - source_sentence_start)") == F.col("source_sentence"), "verified").otherwise("drifted")
    return rows.select("context_id", state.alias("state"))


ABSENCES = {"confidence_intervals": r"[^.]*\bintervals? (?:is|are|was|were) not reported", "p_values": r"[^.]*\bp values? (?:is|are|was|were) not reported", "missing_data": r"[^.]*\b(?:not stated|not reported|unclear|not said)\b[^.]*\b(?:missing|attrition|dropouts?)\b[^.]*"}

QUERIES = {f.__name__: f for f in (design_classes, expected_elements, bayesian_gate, manifest_flags, contradicted_absences, estimates_outside, percentage_sums, artefact_pages, display_items, truncated_texts, quote_verification, nearest_sentences, nearest_candidates, stated_span_states)}


def _n(text: str, patterns) -> str:
    return "(" + " + ".join("CAST(regexp_matches(" + text + ", '" + p.replace("'", "''") + "') AS INTEGER)" for p in patterns) + ")"


def _m(text: str, p: str) -> str:
    return f"regexp_matches({text}, '" + p.replace("'", "''") + "')"


_LOW = "lower(coalesce(text, ''))"
_SIM = f"regexp_replace({_LOW}, '{R.ESTIMATION}', ' ', 'g')"
_DES = {k: (_n(_SIM if k == "simulation" else _LOW, v["strong"]), _n(_SIM if k == "simulation" else _LOW, v["weak"])) for k, v in R.DESIGNS.items()}
_FIRES = {k: f"(s_{k} >= {R.LEAST_STRONG.get(k, 1)} AND s_{k} + w_{k} >= 2)" for k in R.DESIGNS}
_SPLIT = "list_filter(string_split(regexp_replace(text, '([.;:!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '')"
_FLAGSQL = ", ".join(f"{_m(_LOW, p)} AS {k}" for k, p in R.FLAGS.items()) + f", len(list_filter(string_split(regexp_replace({_LOW}, '[.;:!?]\\s+', chr(1), 'g'), chr(1)), lambda s: {_m('s', R.RANDOMISED)} AND NOT {_m('s', R.NOT_RANDOMISED)})) > 0 AS randomised"
_EST = " UNION ALL ".join(f"SELECT doc_id, CAST(regexp_extract(m, '{p}', 1) AS DOUBLE) AS estimate, CAST(regexp_extract(m, '{p}', 2) AS DOUBLE) AS lower, CAST(regexp_extract(m, '{p}', 3) AS DOUBLE) AS upper FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS m FROM documents)" for p in K.ESTIMATES)
_QK = "trim(regexp_replace(translate(lower(regexp_replace({}, '(\\p{{L}})-\\s*\\n\\s*(\\p{{L}})', '\\1\\2', 'g')), '‐‑‒–—−“”„«»‘’', '------\"\"\"\"\"'''''), '\\s+', ' ', 'g'), ' ')"
_NUMS = "list_filter(list_transform(regexp_extract_all({}, '[-+−–—‒]?\\d+(?:[.,]\\d+)?(?:\\s?[eE][-+−–—‒]?\\d+)?'), lambda n: TRY_CAST(regexp_replace(translate(n, '−–—‒', '----'), '[\\s,]', '', 'g') AS DOUBLE)), lambda n: n IS NOT NULL)"
_QUOTES = "(SELECT context_id AS quote_id, draft_id, source_sentence AS quote, answer_draft AS source FROM claim_contexts JOIN academic_drafts USING (draft_id))"
_STOPS = ", ".join(f"'{w}'" for w in SENTENCE_STOP)
_NEAR = "list_distinct(list_transform(list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z][a-z\\-]+')), lambda w: length(w) > 2 AND w NOT IN (" + _STOPS + ")), lambda w: CASE WHEN length(w) > 3 AND suffix(w, 's') AND NOT suffix(w, 'ss') THEN substring(w, 1, length(w) - 1) ELSE w END))"

ORACLES = {
    "design_classes": f"""WITH c AS (SELECT doc_id, {", ".join(f"{s} AS s_{k}, {w} AS w_{k}" for k, (s, w) in _DES.items())} FROM documents)
        SELECT doc_id, CASE {" ".join(f"WHEN {f} THEN '{k}'" for k, f in _FIRES.items())} ELSE 'unclassified' END AS design, CASE {" ".join(f"WHEN {f} THEN s_{k} + w_{k}" for k, f in _FIRES.items())} ELSE 0 END AS signals,
        greatest({" + ".join(f"CAST({f} AS INTEGER)" for f in _FIRES.values())} - 1, 0) AS runners_up FROM c""",
    "expected_elements": f"""WITH t AS (SELECT doc_id, {_LOW} AS low, string_split(regexp_replace({_LOW}, '[.;:]\\s+', chr(1), 'g'), chr(1)) AS said FROM documents), x AS (SELECT *, array_to_string(list_filter(said, lambda s: {_m("s", R.EXCLUSION)}), ' . ') AS ex FROM t),
        d AS (SELECT doc_id, {_n("low", [chr(92) + "b" + x + chr(92) + "b" for x in R.DATABASES])} AS n, {_n("low", [chr(92) + "b" + x + chr(92) + "b" for x in R.PLATFORMS])} AS p, {_m("low", R.INCLUSION)} AS i, {_m("low", R.EXCLUDED)} AS e FROM t)
        SELECT doc_id, 'databases' AS element, CASE WHEN n >= 2 THEN 'present' WHEN n = 1 THEN 'restriction' ELSE 'absent' END AS kind FROM d
        UNION ALL SELECT doc_id, 'platforms', 'present' FROM d WHERE p > 0
        UNION ALL SELECT doc_id, 'criteria', CASE WHEN i AND e THEN 'present' WHEN i OR e THEN 'restriction' ELSE 'absent' END FROM d
        UNION ALL SELECT doc_id, 'independent_screening', CASE WHEN len(list_filter(said, lambda s: {_m("s", R.SCREENERS)} AND {_m("s", R.SCREENED)})) > 0 THEN 'present' ELSE 'absent' END FROM t
        {" ".join(f"UNION ALL SELECT doc_id, '{k}', CASE WHEN {_m('low', p)} THEN 'present' ELSE 'absent' END FROM t" for k, p in R.ELEMENTS.items())}
        {" ".join(f"UNION ALL SELECT doc_id, 'restricted_{k}', 'restriction' FROM x WHERE {_m('ex', p)}" for k, p in R.RESTRICTIONS.items())}""",
    "bayesian_gate": f"""WITH c AS (SELECT doc_id, {_n(_LOW, R.BAYES_STRONG.values())} AS s, {_m(_LOW, R.BAYES_RUN)} AS run, {_n(_LOW, R.BAYES_ELEMENTS.values())} AS e FROM documents)
        SELECT doc_id, s AS strong_signals, s >= 2 AND run AS gate_open, CASE WHEN s >= 2 AND run THEN 4 - e END AS absent_elements FROM c""",
    "manifest_flags": f"SELECT doc_id, {_FLAGSQL} FROM documents",
    "contradicted_absences": f"""WITH f AS (SELECT paper_id, {", ".join(f"bool_or({k}) AS {k}" for k in [*R.FLAGS, "randomised"])} FROM (SELECT paper_id, {_FLAGSQL} FROM documents WHERE paper_id IS NOT NULL) GROUP BY 1)
        {" UNION ".join(f"SELECT paper_id, '{k}' AS flag, regexp_extract(lower(text), '{p}') AS sentence FROM documents JOIN f USING (paper_id) WHERE {k} AND regexp_extract(lower(text), '{p}') <> ''" for k, p in ABSENCES.items())}""",
    "estimates_outside": f"SELECT DISTINCT * FROM ({_EST}) WHERE lower < upper AND (estimate < lower OR estimate > upper)",
    "percentage_sums": f"""WITH s AS (SELECT doc_id, i AS sentence_no, list_transform(regexp_extract_all(s, '{K.PERCENT}', 1), lambda x: CAST(x AS DOUBLE)) AS p FROM (SELECT doc_id, unnest({_SPLIT}) AS s, generate_subscripts({_SPLIT}, 1) AS i FROM documents))
        SELECT doc_id, sentence_no, len(p) AS shares, round(list_sum(p), 4) AS total FROM s WHERE len(p) >= 3 AND list_max(p) < 90 AND abs(round(list_sum(p), 4) - 100) > 8""",
    "artefact_pages": f"""WITH l AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS line_no FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n|\\r|\\n', chr(1), 'g'), chr(1)) AS p FROM documents)),
        h AS (SELECT doc_id, coalesce(last_value(TRY_CAST(nullif(regexp_extract(line, '^\\[Page (\\d+)\\]', 1), '') AS INTEGER) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 0) AS page, len(regexp_extract_all(line, '{K.ARTEFACT}')) AS n FROM l)
        SELECT doc_id, page, CAST(sum(n) AS BIGINT) AS hits FROM h WHERE n > 0 GROUP BY ALL""",
    "display_items": r"""SELECT * FROM (SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '\btab(?:le|\.) ?(\d+)', 1))) AS tables, len(list_distinct(regexp_extract_all(lower(text), '\bfig(?:ure|\.) ?(\d+)', 1))) AS figures FROM documents) WHERE tables + figures > 12""",
    "truncated_texts": r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\s+$', '') AS t FROM documents) SELECT doc_id FROM t WHERE t = '' OR NOT regexp_matches(t, '[.!?。！？।؟:…]["''”’»)\]」*_]*$')""",
    "quote_verification": f"""WITH k AS (SELECT quote_id, quote, {_QK.format("quote")} AS q, {_QK.format("coalesce(source, '')")} AS s FROM {_QUOTES}),
        n AS (SELECT *, list_distinct({_NUMS.format("q")}) AS said, {_NUMS.format("s")} AS held, list_filter(list_transform(string_split(regexp_replace(q, '\\s*(?:\\.\\.\\.|…)\\s*', chr(1), 'g'), chr(1)), lambda h: trim(h, ' ')), lambda h: h <> '') AS halves FROM k),
        t AS (SELECT *, len(list_intersect(said, held)) AS there FROM n)
        SELECT quote_id, CASE WHEN quote IS NULL OR (len(string_split(q, ' ')) < 4 AND len(said) = 0) THEN 'not checked' WHEN contains(s, q) THEN 'exact'
          WHEN len(halves) > 1 AND len(list_filter(halves, lambda h: NOT contains(s, h))) = 0 THEN 'elided' WHEN len(said) > 0 AND there = len(said) THEN 'numbers only' WHEN there > 0 THEN 'some numbers' ELSE 'not found' END AS verdict FROM t""",
    "nearest_sentences": f"""WITH q AS (SELECT quote_id, draft_id, len(w) AS size, unnest(w) AS word FROM (SELECT quote_id, draft_id, {_NEAR.format("quote")} AS w FROM {_QUOTES}) WHERE len(w) >= 5),
        x AS (SELECT draft_id, unnest(p) AS sentence, generate_subscripts(p, 1) AS sentence_no FROM (SELECT draft_id, {_SPLIT.replace("text", "answer_draft")} AS p FROM academic_drafts)),
        s AS (SELECT draft_id, sentence_no, length(sentence) AS chars, unnest({_NEAR.format("sentence")}) AS word FROM x),
        h AS (SELECT quote_id, sentence_no, chars, count(*) / any_value(size) AS share FROM q JOIN s USING (draft_id, word) GROUP BY quote_id, size, sentence_no, chars),
        r AS (SELECT *, row_number() OVER (PARTITION BY quote_id ORDER BY share DESC, chars, sentence_no) AS r FROM h WHERE share >= 0.7)
        SELECT quote_id, sentence_no, round(share, 6) AS share FROM r WHERE r = 1""",
    "stated_span_states": """SELECT context_id, CASE WHEN source_sentence IS NULL OR answer_draft IS NULL OR source_sentence_start IS NULL OR source_sentence_end IS NULL THEN 'missing'
        WHEN source_sentence_start < 0 OR source_sentence_end > length(answer_draft) OR source_sentence_start > source_sentence_end THEN 'out of bounds'
        WHEN substring(answer_draft, source_sentence_start + 1, source_sentence_end - source_sentence_start) = source_sentence THEN 'verified' ELSE 'drifted' END AS state FROM claim_contexts LEFT JOIN academic_drafts USING (draft_id)""",
}
