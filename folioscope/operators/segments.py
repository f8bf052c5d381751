"""Cutting texts into rows: sentences, segments, sections, paragraphs, and checks of the cuts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from folioscope.functions.text import content_words

#: Characters of a section's piece, and of a section too short to stand alone.
PIECE_CHARS, SHORT_CHARS = 1800, 220
#: Word overlap, length ratio and words from which two neighbouring sentences count as one repeated.
NEAR_JACCARD, NEAR_LENGTH_RATIO, NEAR_WORDS = 0.9, 1.15, 8
BREAK = r"(?<=[.;:!?])\s+"


def let(value: Column, use) -> Column:
    """use(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), use), 0)


def sentences_of(text: Column, breaks: str = BREAK) -> Column:
    """array<string> of a text's sentences, blanks dropped; null of a null text."""
    return F.filter(F.split(text, breaks), lambda s: F.trim(s) != "")


def sentence_rows(df: DataFrame, text: str, breaks: str = BREAK) -> DataFrame:
    """One row per sentence, numbered from 1 in order, cut after . ; : ! ? and white space; blanks are dropped. Null texts give none."""
    kept = [c for c in df.columns if c not in (text, "sentence_no", "sentence")]
    return df.select(*kept, F.posexplode(sentences_of(F.col(text), breaks)).alias("at", "sentence")).select(*kept, (F.col("at") + 1).alias("sentence_no"), "sentence")


def adjacent_pairs(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, sentence_no, width, candidate): near-match candidates: each sentence, and each with the one after it. Made within a text's row, so no sentence is shuffled."""
    def candidates(sentences: Column) -> Column:
        one = lambda s, i: F.array(F.struct((i + 1).alias("sentence_no"), F.lit(1).alias("width"), s.alias("candidate")), F.struct((i + 1).alias("sentence_no"), F.lit(2).alias("width"), F.concat(s, F.lit(" "), F.get(sentences, i + 1)).alias("candidate")))
        return F.filter(F.flatten(F.transform(sentences, one)), lambda c: c["candidate"].isNotNull())

    return df.select(id_column, F.inline(let(sentences_of(F.col(text)), candidates)))


def consecutive_repeats(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, sentence_no, jaccard): sentences that say almost the same as the one before: enough words, almost all shared, about as long. Made within a text's row."""
    def repeats(said: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            before = F.get(said, i - 1)
            both, either = F.size(F.array_intersect(s["words"], before["words"])), F.size(F.array_union(s["words"], before["words"]))
            ratio = F.greatest(s["chars"], before["chars"]) / F.least(s["chars"], before["chars"])
            enough = (i > 0) & (F.size(s["words"]) >= NEAR_WORDS) & (F.size(before["words"]) >= NEAR_WORDS) & (ratio <= NEAR_LENGTH_RATIO)
            return F.struct((i + 1).alias("sentence_no"), F.when(enough, both / either).alias("jaccard"))

        return F.filter(F.transform(said, one), lambda r: r["jaccard"] >= NEAR_JACCARD)

    said = F.transform(sentences_of(F.col(text)), lambda s: F.struct(content_words(s).alias("words"), F.length(s).alias("chars")))
    return df.select(id_column, F.inline(let(said, repeats))).select(id_column, "sentence_no", F.round("jaccard", 6).alias("jaccard"))


def fixed_segments(df: DataFrame, id_column: str, text: str, size: int) -> DataFrame:
    """Lossless segments of `size` characters: (id, segment_no from 1, start_char, end_char, segment), half-open. Null and empty texts give none."""
    n = F.length(F.col(text))
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size)))
    return df.select(id_column, F.col(text).alias("__t"), F.posexplode(starts).alias("at", "start_char")).select(
        id_column, (F.col("at") + 1).alias("segment_no"), "start_char", F.least(F.col("start_char") + size, F.length("__t")).alias("end_char"), F.expr(f"substring(__t, start_char + 1, {size})").alias("segment")
    )


def coverage_faults(segments: DataFrame, sources: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, fault): sources whose segments do not cover them exactly: gap, overlap, changed text, truncated, or no segment.

    An empty source without a segment is 'empty source'. Exact coverage gives no row.
    """
    order = Window.partitionBy(id_column).orderBy("start_char", "end_char")
    rows = segments.join(sources.select(id_column, F.col(text).alias("__t")), id_column).withColumn("end_before", F.coalesce(F.lag("end_char").over(order), F.lit(0)))
    fault = (
        F.when(F.col("start_char") > F.col("end_before"), "gap")
        .when(F.col("start_char") < F.col("end_before"), "overlap")
        .when(F.expr("substring(__t, start_char + 1, end_char - start_char)") != F.col("segment"), "changed text")
    )
    inner = rows.withColumn("fault", fault).filter("fault is not null").select(id_column, "fault")
    ends = segments.groupBy(id_column).agg(F.max("end_char").alias("last"))
    outer = sources.select(id_column, F.length(F.coalesce(F.col(text), F.lit(""))).alias("n")).join(ends, id_column, "left")
    cut = outer.withColumn("fault", F.when((F.col("n") == 0) & F.col("last").isNull(), "empty source").when(F.col("last").isNull(), "no segment").when(F.col("last") < F.col("n"), "truncated")).filter("fault is not null").select(id_column, "fault")
    return inner.unionByName(cut).distinct()


def paragraphs_of(text: Column) -> Column:
    """array<string> of what blank lines part, trimmed, blanks dropped; null of a null text."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def paragraphs(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, paragraph_no from 1, paragraph): what blank lines part, trimmed, blanks dropped."""
    return df.select(id_column, F.posexplode(paragraphs_of(F.col(text))).alias("at", "paragraph")).select(id_column, (F.col("at") + 1).alias("paragraph_no"), "paragraph")


def line_rows(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, line_no from 1, line) of every line, blank ones too."""
    return df.select(id_column, F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("at", "line")).select(id_column, (F.col("at") + 1).alias("line_no"), "line")


LINES = r"\r\n|\r|\n"


def _runs(parts: Column, starts: Column) -> Column:
    """array<struct<at, run>>: the parts from each start, by its place from 0, up to the next one."""
    return let(starts, lambda at: F.transform(at, lambda a, k: F.struct(a.alias("at"), F.slice(parts, a + 1, F.coalesce(F.get(at, k + 1), F.size(parts)) - a).alias("run"))))


def filled_forward(df: DataFrame, id_column: str, parts: Column, value, name: str, part: str = "line") -> DataFrame:
    """(id, <part>_no from 1, part, name) of an array of a text's parts: each part with the last value not null at or before it, as pages, sections and table labels.

    value is a function of a part. The fill is made within the text's row, by runs from one
    value to the next, so nothing is shuffled; its work is in proportion to the text.
    """
    def runs(ps: Column) -> Column:
        places = F.filter(F.transform(ps, lambda p, i: F.when(value(p).isNotNull(), i)), lambda i: i.isNotNull())
        starts = F.when(F.get(places, 0) == 0, places).otherwise(F.concat(F.array(F.lit(0)), places))
        return F.transform(_runs(ps, starts), lambda r: F.struct(r["at"].alias("at"), value(F.get(r["run"], 0)).alias(name), r["run"].alias("run")))

    filled = df.select(id_column, F.inline(let(parts, runs)))
    return filled.select(id_column, "at", name, F.posexplode("run").alias("__i", part)).select(id_column, (F.col("at") + F.col("__i") + 1).alias(f"{part}_no"), part, name)


def filled_lines(df: DataFrame, id_column: str, text: str, value, name: str) -> DataFrame:
    """(id, line_no, line, name): filled_forward over the lines of a text, blank ones too."""
    return filled_forward(df, id_column, F.split(F.col(text), LINES), value, name)


def item_runs(text: Column, heading, mark, ends) -> Column:
    """array<struct<item_no, heading, lines>>: the lines from each mark up to the next mark, heading or end, with the last heading before it; marks are numbered from 1.

    heading, mark and ends are functions of a line: its heading or null, and two conditions.
    """
    def items(lines: Column) -> Column:
        breaks = F.filter(F.transform(lines, lambda s, i: F.when(heading(s).isNotNull() | mark(s) | ends(s), i)), lambda i: i.isNotNull())

        def of(runs: Column) -> Column:
            heads = F.filter(F.transform(runs, lambda r: F.struct(r["at"].alias("at"), heading(F.get(r["run"], 0)).alias("heading"))), lambda h: h["heading"].isNotNull())
            marked = F.filter(runs, lambda r: mark(F.get(r["run"], 0)) & heading(F.get(r["run"], 0)).isNull())
            return let(heads, lambda hs: F.transform(marked, lambda m, k: F.struct((k + 1).alias("item_no"), F.try_element_at(F.filter(hs, lambda h: h["at"] < m["at"]), F.lit(-1))["heading"].alias("heading"), m["run"].alias("lines"))))

        return let(_runs(lines, breaks), of)

    return let(F.split(text, LINES), items)


def merged_spans(spans: DataFrame, id_column: str, start: str, end: str) -> DataFrame:
    """(id, start, end, merged): overlapping or touching half-open spans of each id made one. Spans without a start or end, or that end before they start, are left out."""
    good = spans.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    once = good.groupBy(id_column, F.col(start).alias("s"), F.col(end).alias("e")).agg(F.count("*").alias("n"))  # no ties are left to order
    order = Window.partitionBy(id_column).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = once.withColumn("fresh", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(id_column, "island").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end"), F.sum("n").alias("merged")).drop("island")


_SECTION = StructType([StructField("heading", StringType()), StructField("piece", StringType())])
_HEADING = re.compile(r"(?m)^[ ]{0,3}(#{1,6})[ \t]+(\S.*)$")


def sections_of(text: str) -> list[tuple[str | None, str]]:
    """(heading, piece) of a note: a section a piece, long ones in pieces of PIECE_CHARS, short ones joined to the one before if that fits."""
    found = list(_HEADING.finditer(text))
    raw: list[tuple[str | None, str]] = []
    if not found or found[0].start() > 0:
        raw.append((None, text[: found[0].start()] if found else text))
    for m, after in zip(found, [*found[1:], None]):
        raw.append((m[2].strip(), text[m.end() : after.start() if after else len(text)]))
    joined: list[tuple[str | None, str]] = []
    held = ""
    for heading, body in ((h, b.strip()) for h, b in raw):
        if not body:
            continue
        if heading is None and found and len(body) < SHORT_CHARS:
            held = body  # a short lead goes before the first section
            continue
        if held:
            body, held = f"{held}\n\n{body}", ""
        if joined and len(body) < SHORT_CHARS and len(joined[-1][1]) + 2 + len(body) <= PIECE_CHARS:
            joined[-1] = (joined[-1][0], f"{joined[-1][1]}\n\n{body}")
        else:
            joined.append((heading, body))
    if held:
        joined.append((None, held))
    return [(h, b[i : i + PIECE_CHARS]) for h, b in joined for i in range(0, len(b), PIECE_CHARS)]


@F.pandas_udf(ArrayType(_SECTION))
def _sections(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [{"heading": h, "piece": p} for h, p in sections_of(t)] for t in texts])


def section_pieces(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, chunk_index from 0, heading, piece): see sections_of. Joining is stateful, so it runs in Arrow batches by text."""
    return df.select(id_column, F.posexplode(_sections(F.col(text))).alias("chunk_index", "s")).select(id_column, "chunk_index", "s.heading", "s.piece")


_SPANS = ArrayType(StructType([StructField("start_char", IntegerType()), StructField("end_char", IntegerType())]))


def sub_blocks_of(text: str, most: int) -> list[tuple[int, int]]:
    """Half-open spans that cover a text exactly, each of at most `most` characters, cut at blank lines where there are any, and not inside a marked table that fits."""
    spans, at = [], 0
    tables = [(m.start(), m.end()) for m in re.finditer(r"(?s)\[TABLE_START\].*?\[TABLE_END\]", text)]
    while len(text) - at > most:
        cut = -1
        for m in re.finditer(r"\n\n", text[at : at + most]):
            place = at + m.end()
            if not any(a < place < b and b - a <= most for a, b in tables):
                cut = place
        if cut <= at:
            cut = next((a for a, b in tables if at < a < at + most < b and b - a <= most), at + most)
        spans.append((at, cut))
        at = cut
    if at < len(text):
        spans.append((at, len(text)))
    return spans


def sub_blocks(df: DataFrame, id_column: str, text: str, most: int) -> DataFrame:
    """(id, block_no from 1, start_char, end_char) of sub_blocks_of each text."""

    @F.pandas_udf(_SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"start_char": a, "end_char": b} for a, b in sub_blocks_of(t, most)] for t in texts])

    return df.select(id_column, F.posexplode(spans(F.col(text))).alias("at", "s")).select(id_column, (F.col("at") + 1).alias("block_no"), "s.start_char", "s.end_char")


def without_line_numbers(df: DataFrame, id_column: str, text: str, least_run: int = 10) -> DataFrame:
    """df(id, text) with marginal line numbers taken off the line ends.

    Only climbing runs count: a trailing integer that is one more than that of the line
    before, in runs of least_run lines or more; runs may start again on each page. Numbers
    that do not climb, as in a table of counts, are kept.
    """
    order = Window.partitionBy(id_column).orderBy("line_no")
    number = F.regexp_extract("line", r"^(?:.*\s)?(\d{1,5})\s*$", 1).try_cast("int")
    rows = line_rows(df, id_column, text).withColumn("number", number)
    rows = rows.withColumn("starts", F.when(F.col("number").isNull() | F.lag("number").over(order).isNull() | (F.col("number") != F.lag("number").over(order) + 1), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count("number").over(Window.partitionBy(id_column, "run"))
    clean = F.when(F.col("number").isNotNull() & (size >= least_run), F.regexp_replace("line", r"\s*\d{1,5}\s*$", "")).otherwise(F.col("line"))
    ordered = rows.withColumn("clean", clean).groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("line_no", "clean"))).alias("lines"))
    return ordered.select(id_column, F.array_join(F.transform("lines", lambda x: x["clean"]), "\n").alias(text))


def without_back_matter(text: Column) -> Column:
    """A text up to its list of references: the first heading of one that stands alone on a line past 30% of the text; without one the text is kept."""
    headed = F.regexp_instr(F.substring(text, F.floor(F.length(text) * 0.3).cast("int") + 1, F.length(text)), F.lit(r"(?im)^\s*(?:\d+\.?\s*)?(?:references|bibliography|works cited|literature cited)\s*$"))
    return F.when(headed > 0, F.substring(text, F.lit(1), F.floor(F.length(text) * 0.3).cast("int") + headed - 1)).otherwise(text)
