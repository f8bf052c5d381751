from pyspark.sql import functions as F

from folioscope.functions import text as T


def one(spark, value, use):
    return spark.createDataFrame([(value,)], "v string").select(use(F.col("v")).alias("x")).first().x


def test_numbers(spark):
    assert one(spark, "−1,234.5", T.to_number) == -1234.5
    assert one(spark, "none", T.to_number) is None
    assert one(spark, "-1.02E-04 and 3", T.numbers) == ["-1.02E-04", "3"]
    assert one(spark, "1.5 e-3", T.pure_number) == 0.0015
    assert one(spark, "1.5 cm", T.pure_number) is None
    assert one(spark, "0$820 and 0 $235 but WHT$5R", T.repaired_numbers) == "0.820 and 0.235 but WHT$5R"


def test_words(spark):
    assert one(spark, "The r-hat of 4 chains, a", T.tokens) == ["r-hat", "chains"]
    assert one(spark, "Samples and the Sample", T.near_words) == ["sample"]
    assert one(spark, "what is r-hat?", T.widened) == "what is r-hat? potential scale reduction factor psrf"
    assert one(spark, None, T.tokens) is None


def test_keys(spark):
    assert one(spark, " https://doi.org/10.1/AB ", T.doi_key) == "10.1/ab"
    assert one(spark, "doi:10.1/x", T.doi_key) == "10.1/x"
    assert one(spark, "  ", T.doi_key) is None
    assert one(spark, " A\n b ", T.label_key) == "a b"
    assert one(spark, "", T.label_key) is None
    assert one(spark, "<i>Über</i> x", T.plain_text) is not None
    assert one(spark, "wo-\nrd – “q”", T.quote_key) == 'word - "q"'
    assert one(spark, "𝐇𝑎𝟏", T.folded_letters) == "Ha1"
    assert one(spark, "<think>a</think>b", T.without_reasoning) == "b"


def test_ids_tell_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", "")], "x string, y string").select(T.content_id(F.col("x"), F.col("y")).alias("i"))
    a, b = (r.i for r in df.collect())
    assert a != b and len(a) == 16


def test_rounding(spark):
    df = spark.createDataFrame([(0.4567, "0.46"), (0.4567, "0.5"), (0.4567, "0.45")], "v double, p string").select(T.rounds_to(F.col("v"), F.col("p")).alias("x"))
    assert [r.x for r in df.collect()] == [True, True, False]
