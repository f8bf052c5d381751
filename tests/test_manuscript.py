"""Controls of scopes, tables, notes, answers and claims."""

from pyspark.sql import functions as F

from folioscope.operators import claims as C
from folioscope.operators import manuscript as M
from folioscope.operators.rules import anchor, matches


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, value, use):
    return spark.createDataFrame([(value,)], "v string").select(use(F.col("v")).alias("x")).first().x


def test_guarded_sentences():
    def cut(t):
        return [t[a:b] for a, b in M.guarded_spans(t)]

    assert cut("It fell, i.e. rose. So did Hale et al. in May. By Orne et al. Then it ended") == ["It fell, i.e. rose.", "So did Hale et al. in May.", "By Orne et al.", "Then it ended"]
    assert cut("") == [] and cut("  ") == []


def test_claim_sources(spark):
    text = "One here. Two there, e.g. so. Three."
    spans = M.sentence_spans(spark.createDataFrame([(1, text), (2, None)], "d int, t string"), "d", "t")
    claims = spark.createDataFrame([(7, 1, 10, 13), (8, 1, 0, 20), (9, 1, 0, 3)], "claim_id int, d int, claim_start int, claim_end int")
    assert rows(M.claim_sources(claims, spans, "d")) == [(7, 1, 2, 0, 10, 29), (9, 1, 1, 0, 0, 9)]


def test_containment(spark):
    inner = spark.createDataFrame([(1, "g", 5, 8), (2, "g", 0, 50)], "inner_id int, g string, a int, b int")
    outer = spark.createDataFrame([(1, "g", 0, 10), (2, "g", 0, 40), (3, "g", 4, 12)], "outer_id int, g string, a int, b int")
    assert rows(M.contained_spans(inner, outer, "g")) == [(1, 3)]


def test_table_blocks(spark):
    df = spark.createDataFrame([(1, "intro\nTable 4\na | 1\nTable 4a\nb | 2")], "id int, t string")
    assert [(r.label, r.line) for r in M.table_lines(df, "id", "t").orderBy("line_no").collect()] == [("4", "Table 4"), ("4", "a | 1"), ("4a", "Table 4a"), ("4a", "b | 2")]
    assert one(spark, "age | s0 | 4", M.looks_damaged) and one(spark, "meas-\nured | 4", M.looks_damaged) and not one(spark, "age | 4\nsex | 5", M.looks_damaged)
    assert one(spark, "a\n1\nlonger line here\n2", M.fragmentation) == 0.75


def test_findings(spark):
    note = "## Summary\n- ignored\n## Statistical concerns\n- no interval\n  is given\n- small n\n\n**Questions:**\n1. why so few?"
    got = M.candidate_findings(spark.createDataFrame([(1, note), (2, None)], "id int, t string"), "id", "t")
    assert [(r.section, r.finding) for r in got.orderBy("finding_no").collect()] == [("statistical concerns", "no interval is given"), ("statistical concerns", "small n"), ("questions", "why so few?")]


def test_item_fields(spark):
    assert one(spark, "**Concern:** no prior. **Evidence:** p. 4\n**Why it matters:** x", M.item_fields) == {"concern": "no prior.", "evidence": "p. 4", "why it matters": "x"}
    assert one(spark, "Check: the table Reason: unclear", M.item_fields) == {"check": "the table", "reason": "unclear"}


def test_trailer(spark):
    got = one(spark, "An answer.\nUsed: [1], 3\n", M.used_trailer)
    assert (got["answer"], got["used"], got["said_none"], got["found"]) == ("An answer.", [1, 3], False, True)
    got = one(spark, "An answer.\nused: none", M.used_trailer)
    assert (got["answer"], got["used"], got["said_none"], got["found"]) == ("An answer.", [], True, True)
    got = one(spark, "No such line", M.used_trailer)
    assert (got["answer"], got["used"], got["said_none"], got["found"]) == ("No such line", [], False, False)


def test_scopes(spark):
    text = "x" * 250 + "\nMethods\nwe did\nResults\nwe saw\n"
    assert one(spark, text, M.methods_scope) == "we did" and one(spark, "Methods\nx", M.methods_scope) is None
    assert one(spark, "a meta-analysis of two\nResults\nlater", M.synthesis_scope).strip() == "a meta-analysis of two"
    df = spark.createDataFrame([(1, "The literature search covered 2001 to 2020, records from 2015-2019."), (2, "Born 1990 to 1995."), (3, None)], "id int, t string")
    assert rows(M.search_window(df, "id", "t")) == [(1, 2015, 2019, "restriction")]


def test_strengths(spark):
    df = spark.createDataFrame([(1, "# Major strengths\n- Data and code availability\n- Large n\n# Other\n- open data")], "id int, t string")
    assert [(r.line_no, r.line) for r in M.self_reported_strengths(df, "id", "t").collect()] == [(2, "- Data and code availability")]


def test_rows_outside(spark):
    df = spark.createDataFrame([(1, "var | est | 95% CI | p\nage | 9.0 | 0.1, 0.3 | 0.01\nsex | 0.2 | 0.1, 0.3 | 0.5"), (2, "age | 9.0 | 0.1, 0.3 | 0.01")], "id int, t string")
    assert rows(M.outliers_in_rows(df, "id", "t")) == [(1, 2, 9.0, 0.1, 0.3)]


def test_misattribution(spark):
    text = spark.createDataFrame([(1, "Table 1 shows 12.34 and 9.99. Table 2 shows 55.55.")], "id int, t string")
    tables = spark.createDataFrame([(1, "1", "a | 9.99"), (1, "2", "b | 12.34 | 55.55")], "id int, label string, line string")
    assert rows(M.misattributed_values(text, "id", "t", tables)) == [(1, "1", 12.34)]


def test_wording(spark):
    df = spark.createDataFrame([(1, "This proves it conclusively."), (2, "It may be."), (3, None)], "id int, t string")
    assert rows(M.overclaims(df, "id", "t")) == [(1, 2)]
    df = spark.createDataFrame([("No prior is given!", "no prior is given"), ("p. 4 says so", "no prior"), (None, "x")], "e string, c string")
    assert [r.x for r in df.select(M.echoes(F.col("e"), F.col("c")).alias("x")).collect()] == [True, False, False]


def test_technical(spark):
    claims = spark.createDataFrame([(1, "RE", "RE = 1/(1 + λ/m)"), (2, "RE", "RE = 1 + lambda/m"), (3, "RE", "RE = 2")], "claim_id int, concept string, statement string")
    known = spark.createDataFrame([("re", "re=1/(1+lambda/m)", True), ("re", "re=1+lambda/m", False)], "concept string, expression string, correct boolean")
    assert rows(M.technical_verdicts(claims, known)) == [(1, "verified"), (2, "conflict"), (3, "not_verified")]


def test_appraisals(spark):
    good = '{"target_id": "t", "evidence_package_id": "p", "package_snapshot_id": "s", "model_verdict": "SUPPORTED", "relied_on_evidence_ids": ["e1"], "bounded_rationale": "r", "model_unresolved_premises": []}'
    cases = [("t", good), ("t", good.replace('"r"', '"r", "more": 1')), ("t", good.replace("SUPPORTED", "YES")), ("t", good.replace("e1", "e9")), ("t", good.replace('"p"', '"q"')), ("t", "{"), ("u", good), ("t", None)]
    targets = spark.createDataFrame([("t", "p", "s", ["e1", "e2"])], "target_id string, evidence_package_id string, package_snapshot_id string, permitted_evidence_ids array<string>")
    got = C.appraisals(spark.createDataFrame(cases, "target_id string, raw string"), targets)
    assert sorted(str(r.fault) for r in got.collect()) == sorted(["None", "keys", "verdict", "evidence not permitted", "other target", "keys", "unknown target", "keys"])


def test_claim_states(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "claim_id int")
    assert rows(C.support_states(ids(1, 2, 3), ids(1, 2), ids(1))) == [(1, "located"), (2, "not_located"), (3, "not_assessed")]
    first = spark.createDataFrame([("10.1/A",), ("10.1/b",), ("10.1/c",)], "doi string")
    later = spark.createDataFrame([("10.1/a", "supported"), ("10.1/b", "supported"), ("10.1/b", None)], "doi string, state string")
    assert rows(C.contradictions_resolved(first, later)) == [("10.1/a", True), ("10.1/b", False), ("10.1/c", True)]
    found, unknown = C.with_relationships(spark.createDataFrame([("C1",), ("C2",)], "finding_id string"), spark.createDataFrame([("C1", 1), ("C9", 2)], "finding_id string, n int"))
    assert rows(found) == [("C1", 1), ("C2", 0)] and rows(unknown) == [("C9", 2)]
    a = spark.createDataFrame([(1, "10.1/a"), (2, "10.1/a")], "reference_id int, doi string")
    b = spark.createDataFrame([(1, "doi:10.1/A"), (2, "10.1/z")], "reference_id int, doi string")
    assert rows(C.doi_title_conflicts(a, b)) == [(2,)]


def test_routing(spark):
    points = spark.createDataFrame([(1, "n", "h", 0.5), (1, "n", "g", 0.9), (2, "n", "x", 0.9)], "point_id int, note string, heading string, score double")
    side = spark.createDataFrame([("n", "h"), ("n", "g")], "note string, heading string")
    best, lost = C.routed_points(points, side, side.filter("heading = 'h'"), side)
    assert rows(best) == [(1, "n", "h")] and rows(lost) == [(2,)]


def test_claims_and_atoms(spark):
    df = spark.createDataFrame([(1, "ab", "ab x"), (2, "ab", "ab ab"), (3, "", "ab")], "claim_id int, anchor string, text string")
    assert [r.claim_id for r in C.single_anchors(df).collect()] == [1]
    claims, atoms = spark.createDataFrame([(1, "a and b"), (2, "c")], "claim_id int, statement string"), spark.createDataFrame([(1, "a"), (1, "b"), (2, "c1")], "claim_id int, statement string")
    assert rows(C.decomposed(claims, atoms)) == [(1, "a"), (1, "b"), (2, "c")]


def test_labels_and_text(spark):
    df = spark.createDataFrame([(["exact", "elided"],), (["exact", "not found"],), (["not found"],), ([],)], "v array<string>")
    assert [r.x for r in df.select(C.evidence_label(F.col("v")).alias("x")).collect()] == ["High", "Moderate", "Low", "Low"]
    runs = spark.createDataFrame([(["a", "b", "c"], ["x", "b", "c"]), (None, ["a"])], "a array<string>, b array<string>")
    assert [r.x for r in runs.select(C.longest_run(F.col("a"), F.col("b")).alias("x")).collect()] == [2, 0]
    assert one(spark, "a|b\nc", C.markdown_cell) == "a\\|b c" and one(spark, "a ``` b", C.fenced).startswith("````\n")
    assert one(spark, "x" * 70_000, C.generation_ceiling) == 20_000 and one(spark, None, C.generation_ceiling) == 4000
    quoted = F.array(F.lit("a b"))
    assert one(spark, 'He said "a b".', lambda c: C.unmarked_quotes(c, quoted)) == "He said a b [not a verified quotation]." == one(spark, 'He said "a b".', lambda c: C.unmarked_quotes(C.unmarked_quotes(c, quoted), quoted))


def test_anchored_patterns_match_as_plain_ones(spark):
    from folioscope.operators import rules as R

    patterns = [p for s in R.DESIGNS.values() for k in s for p in s[k]] + [*R.ELEMENTS.values(), *R.RESTRICTIONS.values(), *R.BAYES_STRONG.values(), *R.FLAGS.values()]
    texts = ["a systematic review of records screened after a database search", "the p value .03 and 95% ci; sd 4, eq. 5", "hamiltonian chains, r-hat and priors were placed", "two independent reviewers in duplicate", "case-control study and cross-over", "meta analysis 1,000 replications", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(*[(matches(F.col("t"), p) == F.col("t").rlike(p)).alias(f"c{i}") for i, p in enumerate(patterns)]).collect()
    assert all(all(r) for r in got)
    assert anchor(r"\bcase (studies|reports?)\b") == "case "


def test_outliers_in_rows_read_wide_rows(spark):
    line = "x" + " | a" * 60 + " | 9.0 | 1.0 to 2.0"
    got = M.outliers_in_rows(spark.createDataFrame([(1, "Estimate with 95% CI\n" + line)], "id int, block string"), "id", "block").collect()
    assert [(r.id, r.estimate, r.lower, r.upper) for r in got] == [(1, 9.0, 1.0, 2.0)]
