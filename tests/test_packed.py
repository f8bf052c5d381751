import pytest
from pyspark.sql import functions as F

from folioscope.operators.packed import CLOSE, OPEN, packed_items, split_packed

ONE = ["5.18 (4.28, 6.58)", "7.03 [6.13; 8.43]", "8.14 (95% CI: 7.24, 9.54)", "2,124 (42.8%)", "19,428", "69/295", "15:23", "7–92", "2016-12-08", "10.5555/tb.56;13", "km/h", "kg/m2", "points/week", "Orsato, T.", "pain, chronic", '"pain, chronic"', "AR(1), lag 74", "P(A|B) = 0.19", "age × sex", "phase I/II",
       "Not estimable, too few outpatients", "Recomputed from\nthe figure, page 27", "Unadjusted; converged after 7400 draws", "5.18\n(4.28, 6.58)", "sit and reach test", "p = 0.81", "n/a", "1. Tarn-9", "grip strength;"]
MANY = [
    ('"a, b"; "the ""short"" form"; c', ["a, b", 'the "short" form', "c"]),
    ("Moravel, K.\nMoravel, L.", ["Moravel, K.", "Moravel, L."]),
    ('["wait-list", "body-mass index"]', ["wait-list", "body-mass index"]),
    ("{T1 = 22; high=42}", ["T1 = 22", "high=42"]),
    ("1) asthma, mild 2) grip strength", ["asthma, mild", "grip strength"]),
    ("(a) Tarn-9\n(b) NQ-12", ["Tarn-9", "NQ-12"]),
    ("1,762 (90.1%);400 (11.4%)", ["1,762 (90.1%)", "400 (11.4%)"]),
    ("1\\,762 (90.1%),400 (11.4%)", ["1,762 (90.1%)", "400 (11.4%)"]),
    ("109  0.70  8,002", ["109", "0.70", "8,002"]),
    ("a, a,, b and c", ["a", "a", "b", "c"]),
    ("NQ-12；Velm、FLX 3 • X", ["NQ-12", "Velm", "FLX 3", "X"]),
    (f"a{OPEN}0{CLOSE}; b", [f"a{OPEN}0{CLOSE}", "b"]),
    ("x" * 50_000 + "; y", ["x" * 50_000, "y"]),
]


def items(spark, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, value string").select("id", packed_items(F.col("value")).alias("items"))
    return [r["items"] for r in df.orderBy("id").collect()]


def test_one_value(spark):
    assert [v for v, found in zip(ONE, items(spark, ONE)) if len(found) != 1] == []


def test_many_values(spark):
    assert items(spark, [v for v, _ in MANY]) == [want for _, want in MANY]


def test_nothing(spark):
    assert items(spark, [None, "", "  \n ", ";;", "-"]) == [[], [], [], [], ["-"]]


def test_rows_positions_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a; b", 9, "x"), (1, "a; b", 9, "x"), (2, "single", 9, "x"), (None, None, 9, "x")], "id long, value string, value_position int, item string")
    found = split_packed(df, "value", least=2)
    assert found.columns == ["id", "value", "value_position", "item"]
    assert sorted((r.id, r.value_position, r["item"]) for r in found.collect()) == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b")]


def test_empty_table(spark):
    assert split_packed(spark.createDataFrame([], "id long, value string"), "value").count() == 0


@pytest.mark.parametrize("least,rows", [(1, 3), (2, 2), (3, 0)])
def test_least(spark, least, rows):
    assert split_packed(spark.createDataFrame([(1, "a; b"), (2, "c")], "id long, value string"), "value", least=least).count() == rows
