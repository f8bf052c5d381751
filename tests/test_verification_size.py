"""Verification of references whose authors share a surname: no row for each two names, and one judgement for what is said again."""

import random
from collections import Counter

import pandas as pd

from folioscope.operators import bibliography as B

N = 300


def _written(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark.sparkContext._jsc.sc().statusStore()
    listed = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
    return sum(listed.apply(i).shuffleWriteRecords() for i in range(listed.size()))


def test_common_surname(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(7))
    titles = [" ".join(word() for _ in range(6)) for _ in range(N)]
    given = [word() for _ in range(N)]
    # a slip in each title; each reference and each record is there twice, and the lower id of a record is named
    refs = [(k * N + i, None, titles[i][:-1] + "z", f"{given[i]} Smith", 2000, None) for k in range(2) for i in range(N)]
    records = [(k * N + i, None, titles[i], [f"{given[i]} Smith"], 2000 + i % 2, None) for k in range(2) for i in range(N)]
    r = spark.createDataFrame(refs, "reference_id long, doi string, title string, author string, year int, venue string")
    c = spark.createDataFrame(records, "candidate_id long, doi string, title string, authors array<string>, year int, venue string")
    before = _written(spark)
    got = sorted(tuple(x) for x in B.verified_references(r, c).collect())
    assert got == [(k * N + i, "verified", i) for k in range(2) for i in range(N)]
    assert _written(spark) - before < N * N


def test_letter_bits_bound_the_letters_in_common():
    draw = random.Random(5)
    texts = ["".join(draw.choice(" etaoinrslcdhzq079") for _ in range(draw.randint(1, 150))) for _ in range(80)] + ["e" * 90, "z"]
    bits = B.letter_bits.func(pd.Series(texts))
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            bound = sum(((int(bits[b][i]) & int(bits[b][j])) & (2**64 - 1)).bit_count() for b in bits.columns[:-1]) + min(bits["left"][i], bits["left"][j])
            assert bound >= sum((Counter(x) & Counter(y)).values())
            assert i != j or bound == len(x)
