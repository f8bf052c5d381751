"""Splitting oversized items at natural boundaries.

Method: a recursive hierarchy of separators (section, paragraph, sentence, word,
character) cuts a text into the largest natural parts that fit, and the parts are packed
greedily into pieces under the limit, each piece repeating the end of the one before.

Only fields over their limit reach Python, in Arrow batches; the others pass as one piece.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Places where a text may be cut, from the most natural to the least; the match's end is the cut.
SEPARATORS = (
    re.compile(r"\n[ \t]*(?=#{1,6}[ \t]|\[Page \d+\])"),
    re.compile(r"\r?\n[ \t]*\r?\n\s*|\r[ \t]*\r\s*"),
    re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])[」』”’）]*\s*|(?<=[।॥؟])\s*"),
    re.compile(r"(?<=[;:,])\s+|\r?\n|(?<=[、，；：،])"),
    re.compile(r"\s+"),
)

PIECES = ArrayType(StructType([StructField("start_offset", IntegerType()), StructField("core_start", IntegerType()), StructField("end_offset", IntegerType())]))


def _character_cuts(text: str, start: int, end: int, room: int) -> Iterator[int]:
    """Cuts at most `room` apart that leave combining marks with their letter where that is possible."""
    while end - start > room:
        cut = start + room
        while cut > start + 1 and unicodedata.combining(text[cut]):
            cut -= 1
        if cut == start + 1 and room > 1:
            cut = start + room
        yield cut
        start = cut


def _parts(text: str, start: int, end: int, room: int, level: int = 0, after: int = -1) -> Iterator[tuple[int, int, int]]:
    """Natural parts of text[start:end] in order and without gaps, none longer than room, each with the level of the separator behind it (`after` for the last)."""
    if end - start <= room:
        yield start, end, after
        return
    if level == len(SEPARATORS):
        for cut in _character_cuts(text, start, end, room):
            yield start, cut, level
            start = cut
        yield start, end, after
        return
    for m in SEPARATORS[level].finditer(text, start, end):
        if start < m.end() < end:
            yield from _parts(text, start, m.end(), room, level + 1, level)
            start = m.end()
    yield from _parts(text, start, end, room, level + 1, after)


def pieces_of(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, start without the overlap, end) of each piece of text, outer white space left out.

    No piece is longer than limit; each after the first starts with the last `overlap`
    characters before it; the parts without the overlap join to the trimmed text. Parts are
    packed as long as they fit; the piece then ends at the most natural of the places that
    leave it at least half full.
    """
    overlap = max(0, min(overlap, limit - 1))
    first, last = len(text) - len(text.lstrip(" \t\r\n")), len(text.rstrip(" \t\r\n"))
    if last <= first:
        return []
    if last - first <= limit:
        return [(first, first, last)]
    parts = list(_parts(text, first, last, limit - overlap))
    out, at = [], 0
    while at < len(parts):
        core = parts[at][0]
        back = max(first, core - overlap) if out else core
        k = at
        while k + 1 < len(parts) and parts[k + 1][1] - back <= limit:
            k += 1
        if k + 1 < len(parts):
            half = [i for i in range(at, k + 1) if parts[i][1] - back >= limit / 2] or [k]
            k = min(half, key=lambda i: (parts[i][2], -i))
        out.append((back, core, parts[k][1]))
        at = k + 1
    return out


@F.pandas_udf(PIECES)
def _pieces(text: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [{"start_offset": a, "core_start": b, "end_offset": c} for a, b, c in pieces_of(t, int(n), int(o))] for t, n, o in zip(text, limit, overlap)])


def trimmed_length(text: Column) -> Column:
    """Code points without leading and trailing spaces, tabs, CR and LF."""
    return F.length(F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+\z", ""))


def fields_with_limits(passages: DataFrame, limits: DataFrame, fields: tuple[str, ...] = ("text", "heading")) -> DataFrame:
    """(passage_id, field_name, value, max_chars, overlap_chars): one row for each field that has a limit.

    limits holds one row per field, so it is as small as `fields` and is broadcast.
    """
    rows = passages.select("passage_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("f")).select("passage_id", "f.field_name", "f.value")
    few = limits.filter(F.col("field_name").isin(*fields)).groupBy("field_name").agg(F.min("max_chars").alias("max_chars"), F.min("overlap_chars").alias("overlap_chars"))
    return rows.join(F.broadcast(few), "field_name").select("passage_id", "field_name", "value", "max_chars", "overlap_chars")


def split_oversized(rows: DataFrame) -> DataFrame:
    """Pieces of df(passage_id, field_name, value, max_chars, overlap_chars), as an array column `pieces`.

    A null or blank value has no piece, a value within its limit has one. Offsets are in
    code points of the value as stored. An overlap of the limit or more is cut to limit - 1;
    a limit under 1 counts as 1.
    """
    limit = F.greatest(F.col("max_chars"), F.lit(1))
    length = trimmed_length(F.col("value"))
    lead = F.length(F.regexp_extract(F.col("value"), r"^[ \t\r\n]*", 0))
    one = F.array(F.struct(lead.cast("int").alias("start_offset"), lead.cast("int").alias("core_start"), (lead + length).cast("int").alias("end_offset")))
    over = F.coalesce(length, F.lit(0)) > limit
    # Python gets a null in place of each field within its limit, so that one scan serves both
    cut = _pieces(F.when(over, F.col("value")), limit, F.coalesce("overlap_chars", F.lit(0)))
    within = F.when(F.coalesce(length, F.lit(0)) == 0, F.array().cast(PIECES)).otherwise(one.cast(PIECES))
    return rows.withColumn("cut", cut).select(*rows.columns, F.when(over, F.col("cut")).otherwise(within).alias("pieces"))


def piece_rows(split: DataFrame) -> DataFrame:
    """One row per piece: its number from 1, its place, how much of it repeats the piece before, and its text."""
    return split.select("passage_id", "field_name", "value", F.posexplode("pieces").alias("at", "p")).select(
        "passage_id", "field_name", (F.col("at") + 1).alias("piece_index"), "p.start_offset", "p.end_offset", (F.col("p.core_start") - F.col("p.start_offset")).alias("repeated_chars"),
        F.expr("substring(value, p.start_offset + 1, p.end_offset - p.start_offset)").alias("piece"),
    )
