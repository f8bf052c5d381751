"""Searches over tables whose pairs of question and passage are many: what SQL gives, and no row for each pair."""

import duckdb
import pytest

from folioscope.plans.retrieval_queries import ORACLES, QUERIES

PASSAGES, QUESTIONS = 6000, 150


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("searches")
    con = duckdb.connect()
    # every passage shares terms with every question, some passages are equal, some lack a text
    con.sql(f"""CREATE VIEW note_passages AS SELECT i AS passage_id, 'note ' || i % 7 AS note, CASE WHEN i % 5 = 0 THEN 'Purpose' WHEN i % 11 = 0 THEN 'note ' || i % 7 END AS heading,
        CASE WHEN i % 97 = 0 THEN NULL WHEN i % 89 = 0 THEN ' ' ELSE 'Sample model prior ' || repeat('model ', i % 4) || 'term' || i % 53 || ' word' || i % 31 || ' a' || i % 3000 || 'b' END AS text FROM range({PASSAGES}) t(i)""")
    con.sql(f"""CREATE VIEW academic_drafts AS SELECT i * 50 AS draft_id, CASE WHEN i % 40 = 0 THEN NULL WHEN i % 60 = 2 THEN 'nowhere' ELSE 'The model of a prior sample: term' || i % 53 || ', word' || i % 29 || ' and r-hat unseen' || i END AS answer_draft
        FROM range({2 * QUESTIONS}) t(i)""")
    for name in ("note_passages", "academic_drafts"):
        con.sql(f"COPY (SELECT * FROM {name}) TO '{d}/{name}.parquet' (FORMAT parquet)")
    return d, con


@pytest.mark.parametrize("name", ["tfidf_topk", "tfidf_meta_demoted_topk", "bm25_topk"])
def test_no_row_for_each_pair(spark, folder, name):
    d, con = folder
    written = lambda: sum(s.shuffleWriteRecords() for s in _stages(spark))
    before = written()
    ours = QUERIES[name](spark, str(d))
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in ours.collect())
    assert got == sorted(con.sql(f"SELECT query_id, rank, id, score FROM ({ORACLES[name]})").fetchall())
    assert len(got) > 2.5 * QUESTIONS
    assert written() - before < 0.5 * PASSAGES * QUESTIONS


def _stages(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    listed = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
    return [listed.apply(i) for i in range(listed.size())]
