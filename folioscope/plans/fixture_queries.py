"""Queries over literal rows, for operators that the tables give little to: each beside the rows that must come out, written by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import bibliography as B
from folioscope.operators import cells as C
from folioscope.operators import checks as K
from folioscope.operators import claims as L
from folioscope.operators import manuscript as M
from folioscope.operators import reports as P
from folioscope.operators import retrieval as R
from folioscope.operators import rules as G
from folioscope.operators import segments as S
from folioscope.sources import curated

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return ("true" if value else "false") if isinstance(value, bool) else str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def expects(columns: str, *rows):
    """Register a query under its name with the rows that it must give; columns are 'name TYPE' with types of SQL."""
    named = [c.strip().rsplit(" ", 1) for c in columns.split(",")]
    sql = " UNION ALL ".join("SELECT " + ", ".join(f"CAST({_literal(v)} AS {kind}) AS {name}" for v, (name, kind) in zip(row, named)) for row in rows)

    def register(query):
        QUERIES[query.__name__] = lambda spark, sf_dir: query(spark).select(*[name for name, _ in named])
        ORACLES[query.__name__] = sql
        return query

    return register


DESIGN_TEXTS = [
    (1, "The databases were searched with a search strategy by a librarian. Records were screened twice. A systematic review of eligible trials.", "evidence_synthesis"),
    (2, "This introduction cites a systematic review and a meta-analysis.", "unclassified"),
    (3, "A simulation study with 500 replications of simulated data under a known truth.", "simulation"),
    (4, "The posterior was drawn by Markov chain Monte Carlo.", "unclassified"),
    (5, "Pupils were randomly assigned to the intervention arm or to placebo.", "randomised_trial"),
    (6, "Semi-structured interviews were transcribed and coded until saturation.", "qualitative"),
    (7, "Limits of agreement and test-retest reliability of the scale.", "measurement_validation"),
    (8, "Only the test-retest figure is given, with its validity.", "unclassified"),
    (9, "A case-control design with matched controls.", "case_control"),
    (10, "A birth cohort was followed for nine years from baseline.", "cohort"),
    (11, "An online survey; the respondents used a Likert scale.", "survey"),
    (12, "A secondary analysis of registry data.", "secondary_analysis"),
    (13, "A cross-sectional estimate of prevalence.", "cross_sectional"),
    (14, None, "unclassified"),
    (15, "We ran a simulation study of simulated datasets, and pupils were randomly assigned to an intervention arm.", "simulation"),
]


@expects("doc_id BIGINT, design VARCHAR", *[(i, d) for i, _, d in DESIGN_TEXTS])
def fixture_designs(spark):
    return G.classified_designs(spark.createDataFrame([(i, t) for i, t, _ in DESIGN_TEXTS], "doc_id long, text string"), "text")


SYNTHESIS = "We searched PubMed, Embase and Ovid. Two reviewers screened all titles. Inclusion criteria were set; studies in languages other than English were excluded. Unpublished theses were excluded. I-squared and a funnel plot were given. The review was registered in PROSPERO."
THIN = "We searched Scopus. Studies were eligible if they reported sleep. One person read them."


@expects(
    "doc_id BIGINT, element VARCHAR, kind VARCHAR",
    (1, "databases", "present"), (1, "platforms", "present"), (1, "heterogeneity", "present"), (1, "publication_bias", "present"), (1, "risk_of_bias", "absent"), (1, "registration", "present"), (1, "criteria", "present"), (1, "independent_screening", "present"), (1, "restricted_language", "restriction"), (1, "restricted_grey_literature", "restriction"),
    (2, "databases", "restriction"), (2, "heterogeneity", "absent"), (2, "publication_bias", "absent"), (2, "risk_of_bias", "absent"), (2, "registration", "absent"), (2, "criteria", "restriction"), (2, "independent_screening", "absent"),
)
def fixture_elements(spark):
    return G.expected_elements(spark.createDataFrame([(1, SYNTHESIS), (2, THIN)], "doc_id long, text string"), "text")


PAGED = "TODO at the top\n[Page 1]\nclean\n[Page 2]\nsee [citation needed] and \\ref{fig:a}\nError! Reference source not found"


@expects("doc_id BIGINT, page INTEGER, hits BIGINT", (1, 0, 1), (1, 2, 3))
def fixture_artefacts(spark):
    return K.artefact_pages(spark.createDataFrame([(1, PAGED), (2, "[Page 1]\na clean text?"), (3, None)], "doc_id long, text string"), "doc_id", "text")


@expects("doc_id BIGINT, tables INTEGER, figures INTEGER", (1, 6, 8))
def fixture_display_items(spark):
    many = " ".join([*(f"Table {i}" for i in range(1, 7)), *(f"Fig. {i}" for i in range(1, 9)), "Table 1 again"])
    few = " ".join([*(f"Table {i}" for i in range(1, 4)), *(f"Figure {i}" for i in range(1, 8))])
    return K.display_items(spark.createDataFrame([(1, many), (2, few)], "doc_id long, text string"), "doc_id", "text")


@expects("doc_id BIGINT, hits INTEGER", (1, 2), (3, 1))
def fixture_overclaims(spark):
    return M.overclaims(spark.createDataFrame([(1, "This proves it conclusively."), (2, "It may be so."), (3, "It undoubtedly rose."), (4, None)], "doc_id long, text string"), "doc_id", "text")


@expects("doc_id BIGINT, high BIGINT, moderate BIGINT, low BIGINT, self_cites BIGINT, bad_quotes BIGINT, echoes BIGINT", (1, 1, 1, 0, 1, 1, 0), (2, 0, 0, 1, 0, 0, 1), (3, 0, 0, 0, 0, 0, 0))
def fixture_citation_scores(spark):
    reports = [(1, "Confidence: High\nConfidence: **Moderate**\nCites this pipeline's own summary\nQuotation not found"), (2, "Confidence: Low\nEvidence line restates the concern"), (3, None)]
    return L.citation_scores(spark.createDataFrame(reports, "doc_id long, text string"), "doc_id", "text")


@expects("doc_id BIGINT, glyph VARCHAR, hits INTEGER", (1, "hyphenation point", 3), (3, "ano teleia", 4))
def fixture_glyphs(spark):
    texts = [(1, "2\u20273 and a\u2027b and (x)\u2027y"), (2, "2·3 and a·b and c·d and 1\u20272"), (3, "1\u03872 3\u03874 5\u03876 7\u03878"), (4, None)]
    return K.unsuitable_glyphs(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text")


@expects("doc_id BIGINT, line_no INTEGER, estimate DOUBLE, lower DOUBLE, upper DOUBLE", (1, 2, 9.0, 0.1, 0.3))
def fixture_row_outliers(spark):
    blocks = [(1, "var | est | 95% CI | p\nage | 9.0 | 0.1, 0.3 | 0.01\nsex | 0.2 | 0.1, 0.3 | 0.5"), (2, "age | 9.0 | 0.1, 0.3 | 0.01"), (3, None)]
    return M.outliers_in_rows(spark.createDataFrame(blocks, "doc_id long, text string"), "doc_id", "text")


@expects("cell_id BIGINT, central DOUBLE, lower DOUBLE, upper DOUBLE", (1, 5.0, 1.0, 2.0), (4, -3.0, 0.0, 1.0))
def fixture_outside_interval(spark):
    return C.outside_interval(spark.createDataFrame([(1, "5 (1, 2)"), (2, "1.5 (1, 2)"), (3, "5 (2, 1)"), (4, "−3 (0, 1)"), (5, None)], "cell_id long, value string"))


@expects("a VARCHAR, b VARCHAR, matches BOOLEAN", ("John Wiley & Sons", "Wiley", True), ("Springer New York", "Springer", True), ("Cambridge University Press", "Cambridge Scholars Publishing", False), ("Oxford University Press", "Cambridge University Press", False), ("Elsevier", "Elsevir", True), ("Press", "Press", True), (None, "Wiley", False))
def fixture_publishers(spark):
    pairs = [("John Wiley & Sons", "Wiley"), ("Springer New York", "Springer"), ("Cambridge University Press", "Cambridge Scholars Publishing"), ("Oxford University Press", "Cambridge University Press"), ("Elsevier", "Elsevir"), ("Press", "Press"), (None, "Wiley")]
    return spark.createDataFrame(pairs, "a string, b string").withColumn("matches", B.publisher_matches(F.col("a"), F.col("b"), B.title_likeness))


ITEMS = [
    (1, '{"title": ["Sleep"], "author": [{"given": "Jane", "family": "Hale"}], "issued": {"date-parts": [[2003]]}, "published-print": {"date-parts": [[2001, 5]]}, "DOI": "10.1/A", "type": "book"}'),
    (2, '{"title": ["Noise"], "published-online": {"date-parts": [[2002]]}, "issued": {"date-parts": [[2004]]}}'), (3, '{"title": []}'), (4, "{"),
]


@expects("n BIGINT, title VARCHAR, first_author VARCHAR, year INTEGER, doi VARCHAR, fault VARCHAR", (1, "Sleep", "Jane Hale", 2001, "10.1/a", None), (2, "Noise", None, 2002, None, None), (3, None, None, None, None, "no title"), (4, None, None, None, None, "not json"), (5, "Diet", "Kim Orne", 1999, "10.2/b", None))
def fixture_records(spark):
    """Both shapes of records, and what is rejected."""
    found, rejected = B.parsed_records(spark.createDataFrame(ITEMS, "n long, json string"), "json")
    work = [(5, '{"display_name": "Diet", "authorships": [{"author": {"display_name": "Kim Orne"}}], "publication_year": 1999, "doi": "https://doi.org/10.2/B", "primary_location": {"source": {"display_name": "J Diet"}}}')]
    other, _ = B.parsed_records(spark.createDataFrame(work, "n long, json string"), "json", catalogue=True)
    good = found.unionByName(other).select("n", "title", F.get("authors", 0).alias("first_author"), "year", "doi", F.lit(None).cast("string").alias("fault"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("title", "string"), ("first_author", "string"), ("year", "int"), ("doi", "string"))]
    return good.unionByName(rejected.select("n", *empty, "fault"))


TABLE = '{"caption": "c", "columns": [{"index": 0, "header": "Variable"}, {"index": 1, "header": "B"}], "sections": [{"label": null, "rows": [{"label": "Age", "cells": [{"column_index": 0, "value": "Age"}, {"column_index": 1, "value": "1.5 (1, 2)"}]}]}]}'


@expects("observation_id VARCHAR, fault VARCHAR", ("ok", None), ("fenced", None), ("bad", "not json"), ("extra", "unknown keys"), ("column", "unknown column"), ("cell", "cell twice"), ("twice", "column twice"))
def fixture_parsed_tables(spark):
    cases = [("ok", TABLE), ("fenced", f"```json\n{TABLE}\n```"), ("bad", "{"), ("extra", TABLE.replace('"caption"', '"x": 1, "caption"')), ("column", TABLE.replace('"column_index": 1', '"column_index": 7')), ("cell", TABLE.replace('"column_index": 1', '"column_index": 0')), ("twice", TABLE.replace('{"index": 1', '{"index": 0'))]
    return C.parsed_tables(spark.createDataFrame(cases, "observation_id string, json string"))


@expects("row_label VARCHAR, row_label_header VARCHAR, column_header VARCHAR, value VARCHAR", ("Age", "Variable", "Variable", "Age"), ("Age", "Variable", "B", "1.5 (1, 2)"))
def fixture_flattened_tables(spark):
    return C.flattened(C.parsed_tables(spark.createDataFrame([("ok", TABLE)], "observation_id string, json string")))


def _records(spark) -> DataFrame:
    cells = [
        (1, "s", 1, "t1", "mean", "4 (3, 5)"), (2, "s", 1, "t1", "sd", "1.5"), (3, "s", 1, "t1", "n", "20"), (4, "s", 2, "t2", "mean", "4 (3, 5)"), (5, "s", 2, "t2", "sd", "1.5"), (6, "s", 2, "t2", "n", "21"), (7, "s", 2, "t3", "mean", "4 (3, 5)"), (8, "s", 2, "t3", "sd", "2"),
        (9, "r", 1, "t1", "mean", "4 (3, 5)"), (10, "r", 1, "t1", "sd", "1.5"), (11, "s", 3, None, "SD", "1.5"), (12, "s", 3, None, "Mean", "4 (3, 5)"),
    ]
    rows = [(i, s, p, t, 0, "Arm A" if p < 3 else "arm  a", 0, "x" if p == 1 else "y", None, h, v) for i, s, p, t, h, v in cells]
    return C.record_fields(spark.createDataFrame(rows, "cell_id long, source_name string, page int, table_evidence_id string, section_index int, section_label string, row_index int, row_label string, row_label_header string, column_header string, value string"))


@expects("left_record BIGINT, right_record BIGINT, shared INTEGER, exact INTEGER", (1, 4, 3, 2), (1, 11, 2, 2))
def fixture_correspondences(spark):
    return C.record_correspondences(_records(spark))


@expects("left_record BIGINT, right_record BIGINT, same_source BOOLEAN, same_page BOOLEAN, same_known_table BOOLEAN, same_section_label BOOLEAN, same_row_label BOOLEAN, shared_labels VARCHAR, left_only VARCHAR, right_only VARCHAR", (1, 4, True, False, False, True, False, "mean; n; sd", "", ""), (1, 11, True, False, False, True, False, "mean; sd", "n", ""))
def fixture_relationships(spark):
    recs = _records(spark)
    return C.record_relationships(C.record_correspondences(recs), recs)


@expects("label VARCHAR, fewest INTEGER, most INTEGER", ("age", 10, 12))
def fixture_observation_differences(spark):
    rows = [("s", 1, "t", "Men (10 data points)", "Age"), ("s", 1, "t", "Women (12 data points)", "age "), ("s", 1, "t", "All (12 data points of 14 data points)", "Age"), ("s", 1, "t", "Men (10 data points)", "Sex"), ("s", 1, "t", None, "Sex")]
    return C.observation_differences(spark.createDataFrame(rows, "source_name string, page int, table_evidence_id string, section_label string, row_label string"))


@expects("left_evidence_id VARCHAR, right_evidence_id VARCHAR, state VARCHAR, difference DOUBLE", ("a", "b", "opportunity", 0.5), ("a", "c", "not comparable", None), ("a", "d", "not comparable", None), ("a", "e", "unresolved", None), ("a", "f", "not comparable", None))
def fixture_compared_values(spark):
    left = ("a", "Mean", "Sleep", 1.0, 0.5)
    rights = [("b", "mean ", "sleep", 1.5, 1.0), ("c", "median", "sleep", 1.5, 1.0), ("d", "mean", "noise", 1.5, 1.0), ("e", None, "sleep", 1.5, 1.0), ("f", "mean", "sleep", 1.5, None)]
    columns = ", ".join(f"{side}_{c}" for side in ("left", "right") for c in ("evidence_id string", "parameter string", "outcome string", "estimate double", "interval_lower double"))
    return C.compared_values(spark.createDataFrame([(*left, *r) for r in rights], columns))


@expects("id BIGINT, name VARCHAR, operator VARCHAR, threshold DOUBLE, values BIGINT, failing BIGINT", (1, "cfi", ">=", 0.95, 1, 1), (1, "rmsea", "<=", 0.06, 1, 0), (1, "tli", ">=", 0.9, 0, 0))
def fixture_criteria(spark):
    text = "Criteria for fit were: CFI >= 0.95, RMSEA <= 0.06, TLI >= 0.90. In the model CFI was 0.91. The RMSEA of 0.05 was low."
    return K.criteria(spark.createDataFrame([(1, text), (2, "CFI was 0.91."), (3, None)], "id long, text string"), "id", "text")


@expects("id BIGINT, total INTEGER", (1, 1204), (2, 12), (3, 40), (4, None), (5, None))
def fixture_stated_totals(spark):
    return spark.createDataFrame([(1, "a total of 1,204 nurses"), (2, "a sample of twelve adults"), (3, "n = 40"), (4, "none"), (5, None)], "id long, text string").select("id", K.stated_total(F.col("text")).alias("total"))


@expects("doc_id BIGINT, first_year INTEGER, last_year INTEGER, kind VARCHAR", (1, 2015, 2019, "restriction"), (4, 1990, 2020, "present"))
def fixture_search_windows(spark):
    far = "Born 1990 to 1995. " + "Nothing else is said here. " * 14 + "The databases were searched for work of 1990 to 2020."
    return M.search_window(spark.createDataFrame([(1, "The search covered 2001 to 2020, records from 2015-2019."), (2, "Born 1990 to 1995."), (3, None), (4, far)], "doc_id long, text string"), "doc_id", "text")


@expects("id BIGINT, label VARCHAR, value DOUBLE", (1, "1", 12.34))
def fixture_misattributed(spark):
    text = spark.createDataFrame([(1, "Table 1 shows 12.34 and 9.99. Table 2 shows 55.55.")], "id long, text string")
    tables = spark.createDataFrame([(1, "1", "a | 9.99"), (1, "2", "b | 12.34 | 55.55")], "id long, label string, line string")
    return M.misattributed_values(text, "id", "text", tables)


@expects("claim_id BIGINT, status VARCHAR", (1, "verified"), (2, "conflict"), (3, "not_verified"))
def fixture_technical(spark):
    claims = spark.createDataFrame([(1, "RE", "RE = 1/(1 + λ/m)"), (2, "RE", "RE = 1 + lambda/m"), (3, "RE", "RE = 2")], "claim_id long, concept string, statement string")
    return M.technical_verdicts(claims, spark.createDataFrame([("re", "re=1/(1+lambda/m)", True), ("re", "re=1+lambda/m", False)], "concept string, expression string, correct boolean"))


APPRAISAL = '{"target_id": "t", "evidence_package_id": "p", "package_snapshot_id": "s", "model_verdict": "SUPPORTED", "relied_on_evidence_ids": ["e1"], "bounded_rationale": "r", "model_unresolved_premises": []}'


@expects("fault VARCHAR", (None,), ("keys",), ("verdict",), ("evidence not permitted",), ("other target",), ("unknown target",))
def fixture_appraisals(spark):
    cases = [("t", APPRAISAL), ("t", APPRAISAL.replace('"r"', '"r", "more": 1')), ("t", APPRAISAL.replace("SUPPORTED", "YES")), ("t", APPRAISAL.replace("e1", "e9")), ("t", APPRAISAL.replace('"p"', '"q"')), ("u", APPRAISAL)]
    targets = spark.createDataFrame([("t", "p", "s", ["e1", "e2"])], "target_id string, evidence_package_id string, package_snapshot_id string, permitted_evidence_ids array<string>")
    return L.appraisals(spark.createDataFrame(cases, "target_id string, raw string"), targets)


def _ids(spark, *ids) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "claim_id long")


@expects("claim_id BIGINT, state VARCHAR", (1, "located"), (2, "not_located"), (3, "not_assessed"))
def fixture_support_states(spark):
    return L.support_states(_ids(spark, 1, 2, 3), _ids(spark, 1, 2), _ids(spark, 1)).toDF("claim_id", "state")


@expects("doi VARCHAR, resolved BOOLEAN", ("10.1/a", True), ("10.1/b", False), ("10.1/c", True))
def fixture_contradictions(spark):
    first = spark.createDataFrame([("10.1/A",), ("10.1/b",), ("10.1/c",)], "doi string")
    return L.contradictions_resolved(first, spark.createDataFrame([("10.1/a", "supported"), ("10.1/b", "supported"), ("10.1/b", None)], "doi string, state string")).toDF("doi", "resolved")


@expects("finding_id VARCHAR, relationships BIGINT", ("C1", 1), ("C2", 0))
def fixture_with_relationships(spark):
    return L.with_relationships(spark.createDataFrame([("C1",), ("C2",)], "finding_id string"), spark.createDataFrame([("C1", 1), ("C9", 2)], "finding_id string, n int"))[0].toDF("finding_id", "relationships")


@expects("reference_id BIGINT", (2,))
def fixture_doi_title_conflicts(spark):
    kind = "reference_id long, doi string"
    return L.doi_title_conflicts(spark.createDataFrame([(1, "10.1/a"), (2, "10.1/a")], kind), spark.createDataFrame([(1, "doi:10.1/A"), (2, "10.1/z")], kind))


@expects("point_id BIGINT, note VARCHAR, heading VARCHAR", (1, "n", "h"), (2, None, None))
def fixture_routed_points(spark):
    """The section that each unsettled point is sent to, and the points that none takes."""
    points = spark.createDataFrame([(1, "n", "h", 0.5), (1, "n", "g", 0.9), (2, "n", "x", 0.9)], "point_id long, note string, heading string, score double")
    side = spark.createDataFrame([("n", "h"), ("n", "g")], "note string, heading string")
    best, lost = L.routed_points(points, side, side.filter("heading = 'h'"), side)
    return best.unionByName(lost.withColumn("note", F.lit(None).cast("string")).withColumn("heading", F.lit(None).cast("string")))


@expects("id VARCHAR, fault VARCHAR", ("c", "itself"), ("d", "unknown"), ("e", "id twice"))
def fixture_reference_faults(spark):
    return P.reference_faults(spark.createDataFrame([("a", "b"), ("b", None), ("c", "c"), ("d", "x"), ("e", None), ("e", None)], "id string, to_id string"), "id", "to_id")


NOTE = "# T\nbody\n```references\n- cite: Hale (2020)\n  doi: https://doi.org/10.1/a\n  supports: x\n- cite: Orne\n  suports: y\n```\n## S\ntext\n```references\n- cite: Pell\n  isbn: 1\n  supports: z\n```\nend"


@expects("heading VARCHAR, cite VARCHAR, doi VARCHAR", ("S", "Pell", None), ("T", "Hale (2020)", "10.1/a"))
def fixture_curated_references(spark):
    return curated.entries(curated.marked_lines(spark.createDataFrame([(1, NOTE)], "id long, text string"), "id", "text"), "id")[0]


@expects("text VARCHAR", ("# T\nbody\n## S\ntext\nend",))
def fixture_note_text(spark):
    return curated.without_blocks(curated.marked_lines(spark.createDataFrame([(1, NOTE)], "id long, text string"), "id", "text"), "id")


@expects("claim_id BIGINT, sentence_no INTEGER, first_no INTEGER, context_start INTEGER", (7, 2, 1, 0), (9, 1, 1, 0))
def fixture_claim_sources(spark):
    spans = M.sentence_spans(spark.createDataFrame([(1, "One here. Two there, e.g. so. Three."), (2, None)], "d long, t string"), "d", "t")
    found = M.claim_sources(spark.createDataFrame([(7, 1, 10, 13), (8, 1, 0, 20), (9, 1, 0, 3)], "claim_id long, d long, claim_start int, claim_end int"), spans, "d")
    return found.toDF("claim_id", "d", "sentence_no", "context_start", "start", "end").select("claim_id", "sentence_no", F.lit(1).alias("first_no"), "context_start")


@expects("id BIGINT, text VARCHAR", (1, " ".join(["w"] * 40) + "\n"), (2, "References\n" + " ".join(["w"] * 40)))
def fixture_back_matter(spark):
    body = " ".join(["w"] * 40)
    return spark.createDataFrame([(1, body + "\nReferences\n1. X"), (2, "References\n" + body)], "id long, t string").select("id", S.without_back_matter(F.col("t")).alias("text"))


@expects("id BIGINT, section VARCHAR, finding VARCHAR", (1, "statistical concerns", "no interval is given"), (1, "statistical concerns", "small n"), (1, "questions", "why so few?"))
def fixture_findings(spark):
    note = "## Summary\n- ignored\n## Statistical concerns\n- no interval\n  is given\n- small n\n\n**Questions:**\n1. why so few?"
    return M.candidate_findings(spark.createDataFrame([(1, note), (2, None)], "id long, t string"), "id", "t")


@expects("id BIGINT, label VARCHAR", (1, "High"), (2, "Moderate"), (3, "Low"), (4, "Low"))
def fixture_evidence_labels(spark):
    df = spark.createDataFrame([(1, ["exact", "elided"]), (2, ["exact", "not found"]), (3, ["not found"]), (4, [])], "id long, v array<string>")
    return df.select("id", L.evidence_label(F.col("v")).alias("label"))


@expects("id BIGINT, run INTEGER", (1, 2), (2, 0))
def fixture_longest_runs(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["x", "b", "c"]), (2, None, ["a"])], "id long, a array<string>, b array<string>")
    return df.select("id", L.longest_run(F.col("a"), F.col("b")).alias("run"))


@expects("id BIGINT, text VARCHAR", (1, "one two [...]"), (2, "ab"), (3, None))
def fixture_fitted_fronts(spark):
    return spark.createDataFrame([(1, "one two three four"), (2, "ab"), (3, None)], "id long, t string").select("id", R.fitted_front(F.col("t"), 14).alias("text"))


@expects("id BIGINT, text VARCHAR", (1, "one ... our"), (2, "ab"), (3, None))
def fixture_fitted_ends(spark):
    return spark.createDataFrame([(1, "one two three four"), (2, "ab"), (3, None)], "id long, t string").select("id", R.fitted_ends(F.col("t"), F.lit(6)).alias("text"))


@expects("id BIGINT, text VARCHAR", (1, "He said a b [not a verified quotation]."), (2, "x [not a verified quotation] and “y”"), (3, None))
def fixture_unmarked_quotes(spark):
    df = spark.createDataFrame([(1, 'He said "a b".', ["a b"]), (2, "“x” and “y”", ["x"]), (3, None, ["x"])], "id long, t string, q array<string>")
    return df.select("id", L.unmarked_quotes(F.col("t"), F.col("q")).alias("text"))


@expects("item_id BIGINT, place BIGINT", (2, 1), (1, 2), (4, 3), (3, 4))
def fixture_ordered_by_evidence(spark):
    return P.ordered_by_evidence(spark.createDataFrame([(1, 1, "Moderate", 1), (2, 1, "High", 2), (3, 1, None, 3), (4, 1, "Low", 4)], "item_id long, report long, label string, position int"), "report", "label", "position")


@expects("id BIGINT, check_no INTEGER, check VARCHAR, finding VARCHAR", (1, 1, "outside", '{"estimate":5.0,"lower":1.0,"upper":2.0}'), (1, 2, "sums", '{"sentence_no":2,"shares":3,"total":60.0}'))
def fixture_all_checks(spark):
    df = spark.createDataFrame([(1, "The effect was 5 (1 to 2). They were nurses (20%), cooks (20%) or other (20%).")], "id long, text string")
    return K.all_checks({"outside": K.estimates_outside(df, "id", "text"), "sums": K.percentage_sums(df, "id", "text")}, "id")
