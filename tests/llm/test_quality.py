import numpy as np

from folioscope.llm.irep import classify, induce
from folioscope.llm.labelled import labelled_documents
from folioscope.llm.quality import document_statistics, judged_documents

PROSE = [
    "The interval seems wide, and the abstract should say so. We could not find the prior in the methods section.",
    "No harms occurred. Two raters disagreed twice.",
    "[Page 1]\nThe table on page 76 gives 0.97 for knee pain, but the text gives 0.04. The means were 20.3, 39.1 and 38.4 (SD 0.53, 0.40, 0.79).",
    "the change was small and no reason\nwas given for it in the text. the\nreviewers asked for more detail, and\nthe authors sent a second table.",
    "样本包括94名老年人，其中28名退出。为什么血压没有报告？",
    "ผู้เขียนไม่ได้รายงานความดันโลหิต กลุ่มตัวอย่างมีพยาบาล 40 คน ผลของอายุยังไม่ชัดเจน",
]
JUNK = [
    "| Site | N |\n|---|---|\n| knee pain | 5.73 (4.83, 6.1) |\n| sleep | 16.5 |",
    "sha=60\nbudget=0.29\nretries=0.70\nmodel=ok",
    "- gait speed\n- sleep quality\n- knee pain\n- blood pressure",
    "1.1 Purpose ............ 3\n1.2 Choosing a prior ............ 5\n1.3 Reporting .......... 9",
    "We agree that the rule is imprecise. " * 12,
    "MmrXlVrXQcM73+Ww7Pf2gPlF+8AOFD0WDnA46k2BvK9UFgmg/Bm86TMj5MexRfuo" * 4,
    "[1] Hale, M., Orne, E. (2024). Sleep in nurses. Journal of Sleep, 25(2), 24–176. 10.5555/rf.1\n[2] Pell, K. (2005). Pain. Bulletin of Surveys, 8(6), 79–81. 10.5555/rf.9",
    "wear, acuity, quality, pickers, negative, heart, growth, injury, model, sleep, speed, curve, skin, analysis, " * 4,
]


def test_controls(spark):
    df = spark.createDataFrame(list(enumerate([*PROSE, *JUNK])), "doc_id long, text string")
    assert [r.is_prose for r in judged_documents(df).orderBy("doc_id").collect()] == [True] * len(PROSE) + [False] * len(JUNK)


def test_forms_of_any_length(spark):
    wide = "\n".join("\t".join(f"value {i}" for i in range(90)) for _ in range(4))
    long_items = "\n".join(f"- the {'very ' * 120}long item" for _ in range(4))
    prose = "The share of the readers was p = 0.03 | as printed, " + "and so it went on until dawn. The story was told for many a page, " * 2 + "as they say. It ended well, and nobody asked for more."
    df = spark.createDataFrame([(1, wide), (2, long_items), (3, prose), (4, "x, " * 400_000), (5, "A long line. " * 90_000 + "4. "), (6, "We agree with this. " * 3)], "doc_id long, text string")
    assert {r.doc_id: r.is_prose for r in judged_documents(df).collect()} == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False}


def test_means(spark):
    df = spark.createDataFrame([(1, "The cat, the dog."), (2, "我们去了花园。"), (3, "Und das ist der Weg; nicht hier")], "doc_id long, text string")
    got = {r.doc_id: r for r in document_statistics(df).collect()}
    assert (got[1].n_words, got[1].mean_word_length, got[1].common_word_share) == (4, 3, 0.5)
    assert got[2].n_words == 7 and got[2].common_word_share > 0 and got[3].common_word_share == round(5 / 7, 6)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "word. " * 200_000, "x")], "doc_id long, text string, is_prose string")
    assert {r.doc_id: r.is_prose for r in judged_documents(df).collect() if r.doc_id < 4} == {1: False, 2: False, 3: False}
    stats = document_statistics(df.withColumnRenamed("is_prose", "n_words"))
    assert stats.columns.count("n_words") == 1
    got = {r.doc_id: r for r in stats.collect()}
    assert got[1].n_words == 0 and got[4].n_words == 200_000 and got[2].distinct_share == 1
    assert judged_documents(df.limit(0)).count() == 0


def test_held_out_labels(spark):
    rows = labelled_documents(1200, seed=4711)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r.doc_id: r.is_prose for r in judged_documents(df).collect()}
    assert sum(got[i] == want for i, _, want in rows) / len(rows) >= 0.95


def test_rules_are_learned():
    r = np.random.default_rng(1)
    x = {"a": r.random(2000), "b": r.random(2000)}
    y = (x["a"] > 0.7) | (x["b"] < 0.2)
    assert (classify(induce(x, y), x) == y).mean() > 0.95
    assert induce(x, np.zeros(2000, dtype=bool)) == []
