"""Controls on small tables: nulls, ties, repeated rows, empty tables."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.operators import bibliography as B
from folioscope.operators import cells as C
from folioscope.operators import checks as K
from folioscope.operators import reports as P
from folioscope.operators import retrieval as R
from folioscope.operators import rules as L
from folioscope.operators import segments as S
from folioscope.sources import curated, files, sinks
from folioscope.sources.tables import sent_once
from folioscope.streaming import progress as Z


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_sent_once(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "x"), (None, "x")], "id long, v string")
    assert rows(sent_once(df, "id")) == [(1, "a"), (2, None), (None, "x"), (None, "x")]
    with pytest.raises(ValueError):
        sent_once(df, "nothing")


def test_segments_cover_exactly(spark):
    df = spark.createDataFrame([(1, "a" * 1000), (2, ""), (3, None), (4, "é\U0001f600" * 900)], "id long, text string")
    seg = S.fixed_segments(df, "id", "text", 800)
    joined = seg.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_char", "segment"))), lambda x: x["segment"]), "").alias("t"))
    assert rows(joined) == [(1, "a" * 1000), (4, "é\U0001f600" * 900)]
    assert rows(S.coverage_faults(seg, df, "id", "text")) == [(2, "empty source"), (3, "empty source")]
    changed = seg.withColumn("segment", F.when((F.col("id") == 1) & (F.col("segment_no") == 1), F.lit("b" * 800)).otherwise(F.col("segment"))).filter("not (id = 4 and segment_no = 3)")
    assert rows(S.coverage_faults(changed, df, "id", "text")) == [(1, "changed text"), (2, "empty source"), (3, "empty source"), (4, "truncated")]


def test_spans_merge_with_ties(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 0, 5), (1, 4, 9), (1, 12, 15), (1, None, 3), (1, 9, 2)], "id long, a int, b int")
    assert rows(S.merged_spans(df, "id", "a", "b")) == [(1, 0, 9, 3), (1, 12, 15, 1)]


def test_line_numbers(spark):
    numbered = "\n".join(f"words of the line {i}" for i in range(1, 16))
    counts = "\n".join(f"group {c} 12" for c in "abcdefghijklmno")
    df = spark.createDataFrame([(1, numbered), (2, counts), (3, "short 1\nshort 2")], "id long, text string")
    out = {r.id: r.text for r in S.without_line_numbers(df, "id", "text").collect()}
    assert "15" not in out[1] and out[1].count("words of the line") == 15
    assert out[2] == counts and out[3] == "short 1\nshort 2"


def test_sections(spark):
    note = "# Title\n" + "x" * 300 + "\n## Short\nIncorrect.\n## Long\n" + "y" * 4000
    got = S.sections_of(note)
    assert [h for h, _ in got] == ["Title", "Long", "Long", "Long"] and "Incorrect." in got[0][1]
    assert S.sections_of("") == [] and S.sections_of("no heading") == [(None, "no heading")]
    df = spark.createDataFrame([(1, note), (2, None)], "id long, text string")
    assert S.section_pieces(df, "id", "text").count() == 4


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(5, 60))
def test_sub_blocks_cover(text, most):
    spans = S.sub_blocks_of(text, most)
    assert "".join(text[a:b] for a, b in spans) == text and all(0 < b - a <= most for a, b in spans)


def test_back_matter(spark):
    body = "word " * 100
    df = spark.createDataFrame([(body + "\nReferences\n1. X",), ("References\n" + body,), (body,)], "t string")
    out = [r.x for r in df.select(S.without_back_matter(F.col("t")).alias("x")).collect()]
    assert "1. X" not in out[0] and out[1].startswith("References") and out[2] == body


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0.9, True), (0.5, True), (0.5, False), (0.1, False), (None, True)], "score double, positive boolean")
    assert rows(R.rank_separation(df)) == [(0.875,)]
    assert rows(R.rank_separation(df.filter("positive"))) == [(None,)]


def test_budget_stops_at_the_first_that_does_not_fit(spark):
    df = spark.createDataFrame([("n", 1, 0.9, 60), ("n", 2, 0.8, 50), ("n", 3, 0.7, 10), ("n", 4, None, 1)], "g string, p int, s double, n int")
    assert [r[1] for r in rows(R.within_budget(df, "g", "s", "p", F.col("n"), 100))] == [1]


def test_fitting(spark):
    df = spark.createDataFrame([("one two three four",), ("ab",), (None,)], "t string")
    got = [r.x for r in df.select(R.fitted_front(F.col("t"), 14).alias("x")).collect()]
    assert got == ["one two [...]", "ab", None]
    assert [r.x for r in df.select(R.fitted_ends(F.col("t"), F.lit(6)).alias("x")).collect()] == ["one ... our", "ab", None]


def test_siblings(spark):
    corpus = spark.createDataFrame([(1, "n", "h", 0), (2, "n", "h", 1), (3, "n", None, 2), (4, "m", "h", 0)], "passage_id long, note string, heading string, chunk_index int")
    hits = spark.createDataFrame([(1, 0.5), (1, 0.7), (3, 0.2)], "passage_id long, score double")
    assert [(r.passage_id, r.score) for r in R.with_siblings(hits, corpus).orderBy("passage_id").collect()] == [(1, 0.7), (2, None), (3, 0.2)]


def test_structured_tables(spark):
    good = '{"caption": "c", "columns": [{"index": 0, "header": "Variable"}, {"index": 1, "header": "B"}], "sections": [{"label": null, "rows": [{"label": "Age", "cells": [{"column_index": 0, "value": "Age"}, {"column_index": 1, "value": "1.5 (1, 2)"}]}]}]}'
    cases = [("ok", good, None), ("fenced", f"```json\n{good}\n```", None), ("bad", "{", "not json"), ("extra", good.replace('"caption"', '"x": 1, "caption"'), "unknown keys"), ("column", good.replace('"column_index": 1', '"column_index": 7'), "unknown column"), ("cell", good.replace('"column_index": 1', '"column_index": 0'), "cell twice"), ("twice", good.replace('{"index": 1', '{"index": 0'), "column twice"), ("null", None, "not json")]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "observation_id string, json string")
    parsed = C.parsed_tables(df)
    assert {r.observation_id: r.fault for r in parsed.collect()} == {a: c for a, _, c in cases}
    flat = C.flattened(parsed.filter("observation_id = 'ok'"))
    assert [(r.row_label_header, r.column_header, r.value) for r in flat.orderBy("column_index").collect()] == [("Variable", "Variable", "Age"), ("Variable", "B", "1.5 (1, 2)")]


def test_quantities(spark):
    df = spark.createDataFrame([("1.5 (1.0, 2.0)",), ("−3",), ("1.5 [1; 2]",), ("about 4",), (None,)], "value string")
    assert [(r.central, r.lower, r.upper) for r in C.with_quantity(df).collect()] == [(1.5, 1.0, 2.0), (-3.0, None, None), (None,) * 3, (None,) * 3, (None,) * 3]


def test_designs(spark):
    texts = [("Records were screened after a database search; the pooled estimate was small.", "evidence_synthesis"), ("We ran Markov chain Monte Carlo on simulated data.", "unclassified"), ("A simulation study with simulated data and 1,000 replications.", "simulation"), ("", "unclassified"), (None, "unclassified"), ("The reliability of the scale was good; reliability matters.", "unclassified")]
    df = spark.createDataFrame([(i, t, "old") for i, (t, _) in enumerate(texts)], "id int, text string, design string")
    assert [r.design for r in L.classified_designs(df, "text").orderBy("id").collect()] == [d for _, d in texts]


def test_bayesian_gate(spark):
    df = spark.createDataFrame([("A weakly informative prior was placed on it, with four chains and a 95% credible interval.",), ("Prior work differs.",), (None,)], "t string")
    assert [r.gate_open for r in L.bayesian_gate(df, "t").collect()] == [True, False, False]


def test_flags(spark):
    df = spark.createDataFrame([("They were not randomised. P value 0.03.",), ("Patients were randomised.",)], "t string")
    assert [(r.randomised, r.p_values) for r in L.manifest_flags(df, "t").collect()] == [(False, True), (True, False)]


def test_criteria(spark):
    df = spark.createDataFrame([(1, "We took RMSEA < 0.06 as the cut-off. CFI >= 0.9 was regarded as good. RMSEA was 0.09."), (2, None)], "id int, text string")
    assert rows(K.criteria(df, "id", "text")) == [(1, "cfi", ">=", 0.9, 0, 0), (1, "rmsea", "<", 0.06, 1, 1)]


def test_estimates(spark):
    df = spark.createDataFrame([(1, "The odds ratio of 0.20 (0.64 to 1.30) and 1.0 (0.5 to 2.0)."), (1, None)], "id int, text string")
    assert rows(K.estimates_outside(df, "id", "text")) == [(1, 0.2, 0.64, 1.3)]


def test_percentages(spark):
    df = spark.createDataFrame([(1, "Cats (20%), dogs (30%) or others (20%)."), (2, "Cats (50%), dogs (30%) or others (20%)."), (3, "A (100%), B (100%) and C (99%).")], "id int, text string")
    assert rows(K.percentage_sums(df, "id", "text")) == [(1, 1, 3, 70.0)]


def test_artefacts(spark):
    df = spark.createDataFrame([(1, "TODO\n[Page 1]\nfine\n[Page 2]\nsee [CITATION] and TBD")], "id int, text string")
    assert rows(K.artefact_pages(df, "id", "text")) == [(1, 0, 1), (1, 2, 2)]


def test_sample_size(spark):
    df = spark.createDataFrame([("a total of 1,204 nurses",), ("a sample of twelve adults",), ("n = 40",), ("none",)], "t string")
    assert [r.x for r in df.select(K.stated_total(F.col("t")).alias("x")).collect()] == [1204, 12, 40, None]


def test_quotes(spark):
    df = spark.createDataFrame([("the slope was steep in all groups", "We say: the slope was  steep in all groups."), ("the slope was ... in all groups", "the slope was steep in all groups"), ("values of 0.31 and 0.45 were seen", "0.45; 0.31"), ("values of 0.31 and 0.99", "0.31"), ("wholly invented words stand here", "other"), ("too short", "x"), (None, None)], "quote string, source string")
    assert [r.verdict for r in K.quote_verdicts(df).collect()] == ["exact", "elided", "numbers only", "some numbers", "not found", "not checked", "not checked"]


def test_bibliography(spark):
    df = spark.createDataFrame([("Hale, J.", ["Jane Hale", None], "Journal of Sleep", "The Journal of Sleep Research"), ("Orne", ["Jane Hale"], "Sleep", None), (None, None, None, "x")], "a string, l array<string>, v string, w string")
    got = df.select(B.author_matches(F.col("a"), F.col("l")).alias("a"), B.venue_words_match(F.col("v"), F.col("w")).alias("v")).collect()
    assert [(r.a, r.v) for r in got] == [(True, True), (False, False), (False, False)]
    assert [r.x for r in spark.createDataFrame([("Sleep and health",), ("Sleep or health",), ("A note: sleep",), (None,), ("Sleep health",)], "t string").select(B.safe_title(F.col("t")).alias("x")).collect()] == [False, False, False, False, True]


def test_verification(spark):
    refs = spark.createDataFrame([(1, "Sleep in nurses", "Hale, J.", 2001, "Sleep", "10.1/a"), (2, "Sleep in nurses", "Orne, K.", 2001, "Sleep", "10.1/a"), (3, "Sleep in nurses!", "Jane Hale", 2002, None, None), (4, "Unknown work", None, None, None, None)], "reference_id long, title string, author string, year int, venue string, doi string")
    records = spark.createDataFrame([(9, "Sleep in nurses", ["Jane Hale"], 2001, "Sleep", "https://doi.org/10.1/A")], "candidate_id long, title string, authors array<string>, year int, venue string, doi string")
    assert rows(B.verified_references(refs, records)) == [(1, "verified", 9), (2, "metadata_conflict", 9), (3, "verified", 9), (4, "not_verified", None)]


def test_verification_of_titles_that_are_not_equal(spark):
    title = "Reporting stress reactivity after air quality exposure"
    refs = [
        (1, "Reporting stress rectivity aftter air quality exposure", "Hale, J.", 2001, None, None),  # 0.98
        (2, "Reporting stress reactivity after noise exposure", None, 2002, None, None),  # 0.84, no author
        (3, "Reporting stress reactivity after air quality exposures", "Hale", None, None, None),  # no year
        (4, "Stress reactivity and exposure", "Hale, J.", 2001, None, None),  # under 0.80
        (5, "Reporting stress reactivity after air qualty exposure", "Orne, K.", 2001, None, None),  # another author
        (6, "Reporting stress reactivity after air qualty exposure", None, 2003, None, None),  # two years apart
        (7, title, "Orne, K.", 2001, None, None),
        (8, "Reporting stress reactivity after air qualty exposure", "Hale Jane Ann", 2001, None, None),  # holds the record's 'Hale, J.'
    ]
    df = spark.createDataFrame(refs, "reference_id long, title string, author string, year int, venue string, doi string")
    records = spark.createDataFrame([(9, title, ["Lee Fox", "Hale, J."], 2001, "Sleep", None), (8, "Other work", ["Hale, J."], None, None, None)], "candidate_id long, title string, authors array<string>, year int, venue string, doi string")
    assert rows(B.verified_references(df, records)) == [(1, "verified", 9), (2, "probable", 9), (3, "verified", 9), (4, "not_verified", None), (5, "not_verified", None), (6, "not_verified", None), (7, "not_verified", None), (8, "verified", 9)]


def test_bound_of_the_title_ratio_loses_nothing():
    from difflib import SequenceMatcher
    from random import Random

    rng = Random(5)
    a = ["".join(rng.choices("abc de1", k=rng.randint(0, 150))) for _ in range(400)]
    b = ["".join(c for c in x if rng.random() > 0.15) + "".join(rng.choices("abc", k=rng.randint(0, 20))) for x in a]
    may = B._may_reach(a, b, B.PROBABLE)
    reached = [SequenceMatcher(None, x, y).ratio() >= B.PROBABLE for x, y in zip(a, b)]
    assert any(reached) and not all(may) and all(m for m, r in zip(may, reached) if r)


def test_items(spark):
    df = spark.createDataFrame([(1, "# A\n- one\n  more\n\nloose\n2. two\n# B\ntail"), (2, None)], "id int, text string")
    assert rows(P.list_items(df, "id", "text").select("id", "item_no", "heading", "lines", "item")) == [(1, 1, "A", 2, "one more"), (1, 2, "A", 1, "two")]
    assert [r.line for r in P.loose_lines(df, "id", "text").orderBy("line_no").collect()] == ["  more", "loose", "tail"]


def test_merge_of_equal_passes_adds_nothing(spark):
    items = [("g", p, i, t) for p in (1, 2) for i, t in enumerate(("the interval is far too wide here", "no reasons for the dropout"))] + [("g", 2, 9, "an entirely different concern")]
    merged = P.merged_passes(spark.createDataFrame(items, "g string, pass_no int, item_no int, text string"), "g")
    assert sorted((r.pass_no, r.item_no, r.later_only) for r in merged.collect()) == [(1, 0, False), (1, 1, False), (2, 9, True)]


def test_groups_lose_nothing(spark):
    df = spark.createDataFrame([(3, "A b"), (1, "a  B"), (2, None), (4, None), (5, "c")], "id long, t string")
    assert rows(P.grouped_findings(df, "id", "t")) == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 1), (5, 5, 1)]


def test_reference_faults(spark):
    df = spark.createDataFrame([("a", "b"), ("b", None), ("c", "c"), ("d", "x"), ("e", None), ("e", None)], "id string, to_id string")
    assert rows(P.reference_faults(df, "id", "to_id")) == [("c", "itself"), ("d", "unknown"), ("e", "id twice")]


def test_missing_claims_treat_nulls_as_equal(spark):
    a = spark.createDataFrame([("x", None), ("x", None), ("y", "1")], "k string, p string")
    b = spark.createDataFrame([("x", None)], "k string, p string")
    assert rows(P.missing_claims(a, b, ["k", "p"])) == [("y", "1")]


def test_status(spark):
    df = spark.createDataFrame([("no", "yes"), ("yes", "yes"), ("yes", None), (None, "yes")], "a string, b string")
    assert [r.x for r in df.select(P.methodological_status(F.col("a"), F.col("b")).alias("x")).collect()] == ["conflict", "consistent", "not_established", "not_established"]


def test_curated_references(spark):
    note = "# T\nbody\n```references\n- cite: Hale (2020)\n  doi: https://doi.org/10.1/a\n  supports: x\n- cite: Orne\n  suports: y\n```\n## S\ntext\n```references\n- cite: Pell\n  isbn: 1\n  supports: z\n```\nend"
    lines = curated.marked_lines(spark.createDataFrame([(1, note)], "id int, text string"), "id", "text")
    found, faults = curated.entries(lines, "id")
    assert sorted((r.heading, r.cite, r.doi) for r in found.collect()) == [("S", "Pell", None), ("T", "Hale (2020)", "10.1/a")]
    assert {r.fault for r in faults.collect()} == {"unknown field", "no supports"}
    assert curated.without_blocks(lines, "id").first().text == "# T\nbody\n## S\ntext\nend"
    asked = spark.createDataFrame([(1, "S"), (1, "Nowhere")], "id int, heading string")
    assert [r.cite for r in curated.references_for(asked, found, "id").collect()] == ["Pell"]


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_files(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.md").write_text("# *Head*\nbody")
    (tmp_path / "LICENSE.md").write_text("no note")
    (tmp_path / "c.docx").write_bytes(packed(word__document_xml=f'<w:document xmlns:w="{w}"><w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p></w:document>'))
    (tmp_path / "d.xlsx").write_bytes(packed(xl__sharedStrings_xml=f'<sst xmlns="{s}"><si><t>x</t></si></sst>', xl__worksheets__sheet1_xml=f'<worksheet xmlns="{s}"><row><c t="s"><v>0</v></c><c><v>4</v></c></row></worksheet>'))
    (tmp_path / "e.docx").write_bytes(b"broken")
    got = {r.path.rpartition("/")[2]: (r.text, r.fault is None) for r in files.load_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("plain", True) and got["c.docx"] == ("one\ntwo", True) and got["d.xlsx"] == ("x\t4", True) and got["e.docx"] == (None, False)
    assert [(r.title, r.text) for r in files.notes(spark, str(tmp_path)).collect()] == [("Head", "# *Head*\nbody")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r", "B", 2, "second"), ("r", "A", 1, "first"), ("r", "B", 3, None)], "report string, h string, o int, t string")
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6
    assert sinks.report_text(df.filter("t is not null"), "report", "h", "o", "t").first().markdown == "# A\n- first\n\n# B\n- second"


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([("j", 1, "progress"), ("j", 2, "complete"), ("k", 1, "progress"), (None, 1, "error")], "job_id string, seq long, type string")
    events.write.json(str(tmp_path / "in"))
    assert rows(Z.job_states(events)) == [("j", 2, 2, "complete"), ("k", 1, 1, "running")]
    stream = Z.job_states(Z.progress_events(spark, str(tmp_path / "in")))
    assert rows(Z.run_available(stream, str(tmp_path / "cp"))) == [("j", 2, 2, "complete"), ("k", 1, 1, "running")]
    seen = []
    for _ in range(2):  # the second run finds nothing new
        Z.each_batch(Z.progress_events(spark, str(tmp_path / "in")), lambda df, i: seen.extend(df.collect()), str(tmp_path / "cp2")).awaitTermination()
    assert len(seen) == 4


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert S.fixed_segments(df, "id", "text", 800).count() == 0
    assert S.sentence_rows(df, "text").count() == 0
    assert P.list_items(df, "id", "text").count() == 0
    assert L.expected_elements(df, "text").count() == 0
    assert K.percentage_sums(df, "id", "text").count() == 0
    assert P.grouped_findings(df, "id", "text").count() == 0


def test_nearest_candidates_span_sentences_and_need_a_run(spark):
    quotes = spark.createDataFrame([(1, 1, "the slope of sleep duration fell after training ended in nurses"), (2, 2, "training reduced muscle soreness among ferry crews"), (3, 3, "training reduced muscle soreness among ferry crews")], "quote_id int, d int, quote string")
    sources = spark.createDataFrame([(1, "The slope of sleep duration fell. After training ended in nurses, it rose."), (2, "Crews, soreness, ferry, reduced among, muscle, training."), (3, "Among crews ferry soreness muscle reduced training. Here training reduced muscle soreness among many ferry crews of the coast.")], "d int, text string")
    assert [tuple(r)[:3] + (r.run,) for r in K.nearest_candidates(quotes, sources, "d", "text").orderBy("quote_id").collect()] == [(1, 1, 2, 8), (3, 2, 1, 5)]


def test_fills_and_lags_within_a_row(spark):
    df = spark.createDataFrame([(1, "a\n[Page 2]\nb\n\n[Page 3] c\nd"), (2, "[Page 1]\nx"), (3, ""), (4, None), (5, "no page\r\nat all")], "id long, text string")
    page = lambda s: F.regexp_extract(s, r"^\[Page (\d+)\]", 1).try_cast("int")
    assert [(r.id, r.line_no, r.page) for r in S.filled_lines(df, "id", "text", page, "page").orderBy("id", "line_no").collect()] == [(1, 1, None), (1, 2, 2), (1, 3, 2), (1, 4, 2), (1, 5, 3), (1, 6, 3), (2, 1, 1), (2, 2, 1), (3, 1, None), (5, 1, None), (5, 2, None)]
    pairs = S.adjacent_pairs(spark.createDataFrame([(1, "One. Two. Three"), (2, None), (3, " ")], "id long, text string"), "id", "text")
    assert rows(pairs.select("sentence_no", "width", "candidate")) == [(1, 1, "One."), (1, 2, "One. Two."), (2, 1, "Two."), (2, 2, "Two. Three"), (3, 1, "Three")]
    same = "the long slope of sleep fell after training ended in nurses here. "
    long = spark.createDataFrame([(1, same * 3000), (2, "Short. Short.")], "id long, text string")
    assert S.consecutive_repeats(long, "id", "text").count() == 2999
    assert S.filled_lines(spark.createDataFrame([(1, "[Page 1]\nx\n" * 20_000)], "id long, text string"), "id", "text", page, "page").filter("page = 1").count() == 40_001
