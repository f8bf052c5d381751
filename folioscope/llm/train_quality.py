"""Learns the rules of quality.py: python -m folioscope.llm.train_quality."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioscope.llm.irep import classify, induce
from folioscope.llm.labelled import labelled_documents
from folioscope.llm.quality import statistics

#: Statistics that rules may ask for: those that are cheap over long texts and hold in any language.
USED = ("n_words", "mean_word_length", "words_per_line", "symbol_share", "digit_share", "words_per_stop", "comma_share", "miscoded_share", "listed_share", "distinct_share")


def table_of(spark: SparkSession, rows: list[tuple[int, str, bool]]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    df = spark.createDataFrame(rows, "id long, text string, is_prose boolean")
    found = df.select("id", "is_prose", statistics(F.col("text"), USED).alias("s")).select("id", "is_prose", "s.*").orderBy("id").toPandas()
    return {k: found[k].to_numpy(dtype=float) for k in USED}, ~found["is_prose"].to_numpy(dtype=bool)


#: Of these it is known which way they speak against prose; of a text's length only that short texts say little.
WAYS = {"n_words": ">=", "symbol_share": ">=", "digit_share": ">=", "words_per_stop": ">=", "comma_share": ">=", "miscoded_share": ">=", "listed_share": ">=", "distinct_share": "<=", "words_per_line": "<="}
#: Divisions of the labelled set that are tried; the list that is right most often on other labels is kept.
SEEDS = 12


def outward(op: str, threshold: float) -> float:
    """A threshold of four digits or a few more that still holds for the value itself."""
    short = float(f"{threshold:.4g}")
    return short if (short <= threshold if op == ">=" else short >= threshold) else float(f"{threshold + (-1 if op == '>=' else 1) * 1e-4 * max(abs(threshold), 1e-6):.5g}")


def learn(spark: SparkSession) -> tuple[list, float]:
    """(rules for what is no prose, share of held-out labels that they give)."""
    x, y = table_of(spark, labelled_documents())
    vx, vy = table_of(spark, labelled_documents(3000, seed=78))
    lists = [[[(name, op, outward(op, t)) for name, op, t in rule] for rule in induce(x, y, seed=s, ways=WAYS)] for s in range(SEEDS)]
    rules = max(lists, key=lambda r: (classify(r, vx) == vy).mean())
    hx, hy = table_of(spark, labelled_documents(1500, seed=77))
    return rules, float((classify(rules, hx) == hy).mean())


if __name__ == "__main__":
    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
    learned, right = learn(spark)
    lines = "".join(f"    {rule!r},\n" for rule in learned)
    Path(__file__).with_name("quality_rules.py").write_text(f'"""Rules learned by `python -m folioscope.llm.train_quality`; written by it, not by hand."""\n\n#: Share of held-out labels that the rules give: {right:.4f}\nRULES = [\n{lines}]\n')
    print(right, *learned, sep="\n")
