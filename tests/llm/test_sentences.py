import pytest

from folioscope.llm.sentences import corpus_counts, corpus_evidence, sentence_spans, sentence_units

COMMON = frozenset("the it we this an item".split())
CASES = [
    ("Most came from the U.S. The rest stayed. He holds a Ph.D. in it.", ["Most came from the U.S.", "The rest stayed.", "He holds a Ph.D. in it."]),
    ("Dr. Orne and Prof. Hale met, e.g. in May, at 9 a.m. and 5 p.m. We saw.", ["Dr. Orne and Prof. Hale met, e.g. in May, at 9 a.m. and 5 p.m.", "We saw."]),
    ('He said: "It was planned." The end.', ['He said: "It was planned."', "The end."]),
    ('One asked, "Is it fixed? Was it?" and left. (The supplement differs.) Yes.', ['One asked, "Is it fixed? Was it?" and left.', "(The supplement differs.)", "Yes."]),
    ("See Fig. 5 and No. 10. It fell... but rose.", ["See Fig. 5 and No. 10.", "It fell... but rose."]),
    ("No space follows the stop.The next one is here.", ["No space follows the stop.", "The next one is here."]),
    ("- one, e.g. this\n- two. Still two\n\nA line\nthat wraps", ["- one, e.g. this", "- two. Still two", "A line\nthat wraps"]),
    ("E. B. Hale wrote it. M. Orne did not.", ["E. B. Hale wrote it.", "M. Orne did not."]),
    ("Im 2. Abschnitt fehlt das. Es war am 5. März 1997 so, z. B. hier.", ["Im 2. Abschnitt fehlt das.", "Es war am 5. März 1997 so, z. B. hier."]),
    ("Mme Orne écrit : « C'est faible. » Le reste suit. C'est tout !", ["Mme Orne écrit : « C'est faible. »", "Le reste suit.", "C'est tout !"]),
    ("作者写道：“区间小。”随后没有解释。为什么？“是吗？”审稿人问。", ["作者写道：“区间小。”随后没有解释。", "为什么？", "“是吗？”审稿人问。"]),
    ("「血圧は低い。」疲労は……不明だ。著者は「小さい。再現した」と述べた。", ["「血圧は低い。」", "疲労は……不明だ。", "著者は「小さい。再現した」と述べた。"]),
    ("यह ठीक है। डॉ. Hale ने देखा।", ["यह ठीक है।", "डॉ. Hale ने देखा।"]),
    ("Γιατί λείπει; Βλ. σχ. 5.", ["Γιατί λείπει;", "Βλ. σχ. 5."]),
    ("В 2023 г. было так, т. е. плохо. Это всё!", ["В 2023 г. было так, т. е. плохо.", "Это всё!"]),
    ("กลุ่มตัวอย่างมีพยาบาล 40 คน ผลของอายุยังไม่ชัดเจน", ["กลุ่มตัวอย่างมีพยาบาล 40 คน", "ผลของอายุยังไม่ชัดเจน"]),
    ("only a piece without", ["only a piece without"]),
    ("", []),
    (" \n\t ", []),
    (None, []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_controls(text, want):
    assert [text[a:b] for a, b in sentence_spans(text, frozenset(), COMMON)] == want


def test_document_decides_about_its_own_abbreviations():
    assert len(sentence_spans("The wks. were long, and five wks. passed. It took two wks. Hale left.", frozenset(), COMMON)) == 2


def test_document_overrules_the_lists():
    # a fruit, as the document uses the word without a stop; a figure, as it doesn't
    assert len(sentence_spans("They ate a fig after lunch. He took the last fig. (The rest was gone.)")) == 3
    assert len(sentence_spans("It was shown in the last fig. (The rest was gone.)")) == 1
    # French: a verb; the list has it as short for estimated
    assert len(sentence_spans("Il est tard. On sait où il est. Le reste suit.")) == 3
    # before a figure only the same use counts
    assert len(sentence_spans("There was no effect in item no. 5 of it.")) == 1


def test_corpus_decides_where_the_document_does_not():
    text = "It took two wks. Hale left early."
    assert len(sentence_spans(text)) == 2 and len(sentence_spans(text, frozenset({"wks"}))) == 1
    assert len(sentence_spans(text, frozenset({"wks"}), frozenset({"hale"}))) == 2
    listed = "He came resp. The rest left."
    assert len(sentence_spans(listed)) == 1 and len(sentence_spans(listed, words=frozenset({"resp"}))) == 2


def test_tokens_of_any_length():
    long = "abbreviationissima" * 3
    assert len(sentence_spans(f"The {long}. was new, and {long}. Hale left.")) == 1
    assert len(sentence_spans("x" * 500 + " https://a.example/" + "y" * 300 + "abc.Def is one.")) == 1


def test_long_text():
    text = "A short sentence stands here. " * 20_000
    assert len(sentence_spans(text)) == 20_000


def test_units_and_corpus(spark):
    df = spark.createDataFrame([(1, "It took five wks. to end, and more wks. to mend, and wks. on. The end.", 5), (1, "It took five wks. to end, and more wks. to mend, and wks. on. The end.", 5), (2, None, 5), (3, " ", 5)], "id long, text string, unit_start int")
    tokens, words = corpus_evidence(corpus_counts(df))
    assert {r.token for r in tokens.filter("abbreviation").collect()} == {"wks"} and "more" in {r.word for r in words.collect()}
    got = sentence_units(df)
    assert got.columns == ["id", "unit_start", "unit_end"]
    assert sorted((r.id, r.unit_start) for r in got.collect()) == [(1, 0), (1, 0), (1, 62), (1, 62)]
    assert sentence_units(df.limit(0)).count() == 0


def test_units_as_spans(spark):
    texts = [t for t, _ in CASES] + ["It took two wks. Hale left.", "Two wks. passed, and five wks. went by.", "It rains. Hale knows, as hale as ever."] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    tokens, words = corpus_evidence(corpus_counts(df))
    known = tokens.collect()
    want = {(i, a, b) for i, t in enumerate(texts) for a, b in sentence_spans(t, frozenset(r.token for r in known if r.abbreviation), frozenset(r.word for r in words.collect()), frozenset(r.token for r in known if not r.abbreviation))}
    assert {tuple(r) for r in sentence_units(df).collect()} == want
