"""Mixing sources to target weights.

Method: a time-varying curriculum. Each source has a weight schedule over the training
time from 0 to 1 that integrates to its share; the schedule's integral, inverted at a
document's place in its source's cumulative tokens, is the document's training position;
the draws are range-sorted by position.

A source gives its share of the wanted size, or all that it has times the cap on repeats,
if that is less: the others then keep their size, and the shares reached are reported.

Cumulative tokens come in two steps, within hash buckets and over the buckets' totals, so
that a source with a third of all documents is not one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How far the weight of repeated sources rises and that of the others falls, from -RAMP to RAMP about the mean.
RAMP = 0.5
#: Hash buckets of each source and pass.
BUCKETS = 1024


def plan(sizes: DataFrame, targets: DataFrame, ramp: float = RAMP) -> DataFrame:
    """One row per target: the tokens wanted, available and to be drawn, the passes needed, and the schedule's slope.

    Weights are relative within a mix; null or negative ones count as 0, a null cap as 1.
    An absent source has 0 tokens to draw.
    """
    have = sizes.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("available_tokens"))
    whole = sizes.agg(F.sum("n_tokens").cast("double").alias("all_tokens"))
    weight = F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))
    mix = Window.partitionBy("mix_id")
    rows = targets.withColumn("weight", weight).withColumn("target_share", F.when(F.sum("weight").over(mix) > 0, F.col("weight") / F.sum("weight").over(mix)).otherwise(0.0))
    # the left side has one row per target, the right side one row
    rows = rows.join(have, "source", "left").join(F.broadcast(whole), F.lit(True), "left")
    cap = F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))
    rows = rows.withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0.0))).withColumn("wanted_tokens", F.col("target_share") * F.coalesce("budget_share", F.lit(0.0)) * F.coalesce("all_tokens", F.lit(0.0)))
    rows = rows.withColumn("to_draw", F.least("wanted_tokens", F.col("available_tokens") * cap))
    rows = rows.withColumn("passes", F.when(F.col("available_tokens") > 0, F.least(cap, F.ceil(F.col("to_draw") / F.col("available_tokens")))).otherwise(0).cast("int"))
    late = F.sum(F.when(F.col("max_repeats") > 1, F.col("to_draw")).otherwise(0.0)).over(mix)
    early = F.sum(F.when(F.col("max_repeats") > 1, 0.0).otherwise(F.col("to_draw"))).over(mix)
    # rises and falls balance, so that the weights sum to 1 at any time
    up = F.when((late > 0) & (early > 0), F.least(F.lit(ramp), F.lit(0.9) * early / late)).otherwise(0.0)
    slope = F.when(F.col("max_repeats") > 1, up).otherwise(F.when(early > 0, -up * late / early).otherwise(0.0))
    return rows.withColumn("slope", slope).select("mix_id", "source", "target_share", "max_repeats", "wanted_tokens", "available_tokens", "to_draw", "passes", "slope")


def draws(sizes: DataFrame, planned: DataFrame, seed: int = 1) -> DataFrame:
    """(mix_id, source, doc_id, use_no, n_tokens, position): what is drawn, range-sorted by mix and position.

    A document of no tokens is never drawn. In the last pass a document is drawn if its
    middle lies within the tokens to draw, so a source misses them by half a document at
    most. planned has one row per target and is broadcast.
    """
    some = sizes.filter("n_tokens > 0")
    used = some.join(F.broadcast(planned.filter("passes > 0").select("mix_id", "source", "available_tokens", "to_draw", "passes", "slope")), "source")
    used = used.withColumn("use_no", F.explode(F.sequence(F.lit(1), F.col("passes")))).withColumn("order", F.xxhash64(F.lit(seed), "mix_id", "use_no", "doc_id"))
    used = used.withColumn("bucket", F.shiftrightunsigned("order", 64 - BUCKETS.bit_length() + 1).cast("int"))
    group = ["mix_id", "source", "use_no"]
    totals = used.groupBy(*group, "bucket").agg(F.sum("n_tokens").cast("double").alias("in_bucket"))
    before = totals.withColumn("before", F.coalesce(F.sum("in_bucket").over(Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("in_bucket")
    inside = Window.partitionBy(*group, "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    # targets x repeats x BUCKETS rows at most, whatever the number of documents
    placed = used.withColumn("own", F.sum("n_tokens").over(inside) - F.col("n_tokens") / 2).join(before, [*group, "bucket"])
    placed = placed.withColumn("middle", (F.col("use_no") - 1) * F.col("available_tokens") + F.col("before") + F.col("own")).filter("middle <= to_draw")
    f, a = F.col("middle") / F.col("to_draw"), F.col("slope")
    # the integral of 1 + a(2t - 1) up to t is t + a(t^2 - t); t where it is f
    t = F.when(F.abs(a) < 1e-9, f).otherwise((a - 1 + F.sqrt((1 - a) * (1 - a) + 4 * a * f)) / (2 * a))
    return placed.select("mix_id", "source", "doc_id", "use_no", "n_tokens", F.round(t, 9).alias("position")).orderBy("mix_id", "position", "doc_id", "use_no")


def shares(planned: DataFrame, drawn: DataFrame) -> DataFrame:
    """The shares reached: one row per target."""
    got = drawn.groupBy("mix_id", "source").agg(F.sum("n_tokens").cast("double").alias("drawn_tokens"), F.max("use_no").alias("most_uses"), F.count("*").alias("draws"))
    mix = Window.partitionBy("mix_id")
    rows = planned.join(got, ["mix_id", "source"], "left").withColumn("drawn_tokens", F.coalesce("drawn_tokens", F.lit(0.0)))
    whole = F.sum("drawn_tokens").over(mix)
    return rows.select("mix_id", "source", "target_share", "wanted_tokens", "available_tokens", "drawn_tokens", F.coalesce("draws", F.lit(0)).alias("draws"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.when(whole > 0, F.col("drawn_tokens") / whole).otherwise(0.0).alias("reached_share"))
