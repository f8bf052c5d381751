"""Filling containers of fixed capacity with items, leaving as little room as may be.

Method: minimum bin slack. A container starts with the largest item left; a bitset of the
sums that the other lengths can make is grown by dynamic programming until it holds the
room that is left, or all lengths are used; the fullest combination is read back and taken
out. Items are dealt to shards by their hash, and each shard fills its own containers, so
that the work is linear in the items and a shard is of bounded size; the room lost to
sharding is at most one container in `CONTAINERS`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Containers that a shard fills, about; and items that it holds at most, about.
CONTAINERS, ITEMS = 400, 20_000

OUT = "pack_id int, shard int, container long, doc_id long, piece_no int, n_tokens int"


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each no oftener than its count, that sum to as much of room as possible. lengths are in the order tried."""
    if room <= 0:
        return []
    mask, bits = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int]] = []
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            after = bits | (bits << length) & mask
            if after == bits:
                break
            steps.append((length, bits))
            bits = after
        if bits >> room & 1:
            break
    total, taken = bits.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> total & 1:
            taken.append(length)
            total -= length
    return taken


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Places of items in each container; every size must be from 0 to capacity. Empty items go into the first container."""
    by: dict[int, list[int]] = {}
    for i, size in enumerate(sizes):
        by.setdefault(size, []).append(i)
    empty = by.pop(0, [])
    counts = {length: len(places) for length, places in by.items()}
    lengths = sorted(by, reverse=True)
    containers = []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        taken = [first, *fullest(lengths, counts, capacity - first)]
        for length in taken[1:]:
            counts[length] -= 1
        containers.append([by[length].pop() for length in taken])
        lengths = [length for length in lengths if counts[length]]
    if empty:
        if containers:
            containers[0] += empty
        else:
            containers.append(empty)
    return containers


def _fill_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Containers of one shard, numbered from 1: first those that hold several items, then one for each full piece of an item that was cut."""
    rows = rows.sort_values("doc_id", kind="stable").reset_index(drop=True)
    capacity = int(rows["capacity_tokens"].iloc[0])
    number = np.zeros(len(rows), dtype=np.int64)
    filled = fill(rows["n_tokens"].tolist(), capacity)
    for k, places in enumerate(filled, 1):
        number[places] = k
    rest = rows.assign(container=number, piece_no=rows["full_pieces"] + 1)
    cut = rows.loc[rows.index.repeat(rows["full_pieces"])]
    whole = cut.assign(container=len(filled) + 1 + np.arange(len(cut)), piece_no=cut.groupby(level=0).cumcount() + 1, n_tokens=capacity)
    return pd.concat([rest, whole])[["pack_id", "shard", "container", "doc_id", "piece_no", "n_tokens"]]


def pack(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """(pack_id, shard, container, doc_id, piece_no, n_tokens): where each document of each spec's scope goes.

    sizes is df(doc_id, source, n_tokens), specs df(pack_id, capacity_tokens, scope_source)
    with few rows; a null scope means all documents. An item larger than the capacity is
    cut into pieces of the capacity and a rest, numbered from 1; others are piece 1. A
    container is named by (pack_id, shard, container) and never holds more than its
    capacity; a full piece of a cut item has one of its own. Documents of a null or unknown
    source are in no named scope. A doc_id that comes twice is two items.
    """
    few = specs.filter("capacity_tokens > 0").select("pack_id", F.col("capacity_tokens").cast("int").alias("capacity_tokens"), "scope_source")
    # each document asks for the specs of its source and for those of all sources, so that the join is by an equal key
    asked = sizes.withColumn("scope", F.explode(F.array(F.concat(F.lit("="), "source"), F.lit("*"))))
    scoped = asked.join(F.broadcast(few.withColumn("scope", F.coalesce(F.concat(F.lit("="), "scope_source"), F.lit("*")))), "scope").drop("scope")
    totals = scoped.groupBy("pack_id", "capacity_tokens").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items"))
    shards = totals.select("pack_id", F.greatest(F.lit(1), F.ceil(F.greatest(F.col("tokens") / F.col("capacity_tokens") / CONTAINERS, F.col("items") / ITEMS))).cast("int").alias("shards"))
    capacity = F.col("capacity_tokens")
    full = F.when(F.col("n_tokens") > capacity, F.floor((F.col("n_tokens") - 1) / capacity)).otherwise(F.lit(0)).cast("int")
    # one row per spec: no more rows than specs has
    placed = scoped.join(F.broadcast(shards), "pack_id").withColumn("full", full).withColumn("shard", F.pmod(F.xxhash64("doc_id", "pack_id"), F.col("shards")).cast("int"))
    rest = placed.select("pack_id", "shard", "doc_id", F.col("full").alias("full_pieces"), (F.col("n_tokens") - F.col("full") * capacity).cast("int").alias("n_tokens"), "capacity_tokens")
    return rest.groupBy("pack_id", "shard").applyInPandas(_fill_shard, OUT)
