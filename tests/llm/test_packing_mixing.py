import random

from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm.mixing import draws, plan, shares
from folioscope.llm.packing import fill, fullest, pack
from folioscope.llm.tokens import document_sizes, encoding, source_name

from pyspark.sql import functions as F


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(0, 60))
def test_fullest_against_brute_force(sizes, room):
    counts = {s: sizes.count(s) for s in sizes}
    taken = fullest(sorted(counts, reverse=True), counts, room)
    best = max(sum(x) for k in range(1 << len(sizes)) for x in [[s for i, s in enumerate(sizes) if k >> i & 1]] if sum(x) <= room)
    assert sum(taken) == best and all(taken.count(s) <= counts[s] for s in taken)


def test_fill_holds_all_once():
    r = random.Random(1)
    sizes = [r.randrange(0, 60) for _ in range(500)]
    containers = fill(sizes, 64)
    assert sorted(i for c in containers for i in c) == list(range(500))
    assert all(sum(sizes[i] for i in c) <= 64 for c in containers)
    assert len(containers) <= -(-sum(sizes) // 64) * 1.02
    assert fill([], 5) == [] and fill([0, 0], 5) == [[0, 1]]


SIZES = "doc_id long, source string, n_tokens int"


def test_pack(spark):
    sizes = spark.createDataFrame([(1, "a", 25), (2, "a", 10), (3, "b", 4), (4, None, 6), (5, "a", 0)], SIZES)
    specs = spark.createDataFrame([(1, 10, None), (2, 10, "a"), (3, 10, "absent"), (4, 0, None)], "pack_id int, capacity_tokens int, scope_source string")
    got = pack(sizes, specs)
    assert sorted((r.pack_id, r.doc_id, r.piece_no, r.n_tokens) for r in got.collect()) == [(1, 1, 1, 10), (1, 1, 2, 10), (1, 1, 3, 5), (1, 2, 1, 10), (1, 3, 1, 4), (1, 4, 1, 6), (1, 5, 1, 0), (2, 1, 1, 10), (2, 1, 2, 10), (2, 1, 3, 5), (2, 2, 1, 10), (2, 5, 1, 0)]
    over = got.groupBy("pack_id", "shard", "container").agg(F.sum("n_tokens").alias("t")).filter("t > 10")
    assert over.count() == 0 and got.filter("container < 1").count() == 0
    assert pack(sizes.limit(0), specs).count() == 0 and pack(sizes, specs.limit(0)).count() == 0


def test_pieces_of_ids_that_look_alike(spark):
    m = 2147483647
    sizes = spark.createDataFrame([(i, "a", 35) for i in (0, m, 2 * m, 5, 5 + m)], SIZES)
    got = pack(sizes, spark.createDataFrame([(1, 10, None)], "pack_id int, capacity_tokens int, scope_source string"))
    filled = got.groupBy("pack_id", "shard", "container").agg(F.sum("n_tokens").alias("t"))
    assert filled.filter("t > 10").count() == 0 and filled.agg(F.sum("t")).first()[0] == 175
    assert filled.count() == 18 and got.groupBy("doc_id").count().filter("count != 4").count() == 0


def test_mix(spark):
    sizes = spark.createDataFrame([(i, "big" if i % 10 else "small", 1 + i % 50) for i in range(5000)] + [(9999, None, 5), (10000, "big", 0)], SIZES)
    targets = spark.createDataFrame([(1, "big", 1.0, 1, 0.5), (1, "small", 1.0, 3, 0.5), (2, "absent", 1.0, 2, 0.5), (2, "big", 3.0, None, 0.2), (3, "big", 0.0, 1, 0.5)], "mix_id int, source string, target_weight double, max_repeats int, budget_share double")
    planned = plan(sizes, targets)
    drawn = draws(sizes, planned).cache()
    uses = drawn.groupBy("mix_id", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("use_no").alias("d"))
    caps = {(r.mix_id, r.n) for r in uses.select("mix_id", "n").distinct().collect()}
    assert all(n <= 3 for m, n in caps if m == 1) and all(n == 1 for m, n in caps if m == 2) and uses.filter("n != d").count() == 0
    report = {(r.mix_id, r.source): r for r in shares(planned, drawn).collect()}
    assert len(report) == 5
    small = report[1, "small"]
    assert abs(small.drawn_tokens - small.available_tokens * 3) <= 50 or abs(small.drawn_tokens - small.wanted_tokens) <= 50
    assert abs(report[2, "big"].drawn_tokens - report[2, "big"].wanted_tokens) <= 50
    assert report[2, "absent"].drawn_tokens == 0 and report[3, "big"].draws == 0
    # the schedule: repeated sources come later
    late, early = (drawn.filter(f"mix_id = 1 and source = '{s}'").agg(F.avg("position")).first()[0] for s in ("small", "big"))
    assert late > early and drawn.filter("position < 0 or position > 1").count() == 0
    assert draws(sizes.limit(0), plan(sizes.limit(0), targets)).count() == 0


def test_sizes(spark):
    df = spark.createDataFrame([(1, " Review-Reports", "one two", "x"), (2, None, None, "x"), (3, "thesis", "", "x"), (4, "A", "<|endoftext|> " * 3000, "x")], "doc_id long, source string, text string, n_tokens string")
    got = {r.doc_id: (r.source, r.n_tokens) for r in document_sizes(df).collect()}
    assert got[1] == ("review_report", len(encoding().encode_ordinary("one two"))) and got[2] == (None, 0) and got[3] == ("thesis", 0)
    assert got[4][1] == len(encoding().encode_ordinary("<|endoftext|> " * 3000))
    assert spark.range(1).select(source_name(F.lit("manuscripts")).alias("x")).first().x == "manuscript"
