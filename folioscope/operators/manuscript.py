"""Scopes of manuscripts, table blocks, sections of notes, answers and their trailers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from folioscope.functions.text import MINUS_GLYPHS, numbers, to_number
from folioscope.operators.segments import filled_forward, filled_lines, item_runs, line_rows, paragraphs_of, sentence_rows

# Abbreviations after which no sentence ends; "et al." ends one only before a capital.
NEVER_LAST = ("i.e.", "e.g.", "vs.", "cf.")
#: Sections of chunk notes whose bullets are findings.
FINDING_SECTIONS = ("missing or unclear", "statistical concerns", "methodological concerns", "statistical / methodological concerns", "table-specific notes", "questions")
OVERCLAIMS = (r"\bprov(?:es?|ed|en)\b", r"\bguarantee[sd]?\b", r"\bundoubtedly\b", r"\bwithout (?:any )?doubt\b", r"\bconclusively\b", r"\balways\b[^.]{0,40}\bworks\b")
SELF_REPORTED = r"(?i)\b(?:data|code)\b[^.]{0,40}\bavailab\w+|\bpre-?regist\w+|\btransparen\w+|\breproducib\w+|\bopen (?:data|science|code)\b"
YEARS = r"\b((?:18|19|20)\d{2})(?:\s*[-–—/]\s*|\s+(?:to|until|through|and)\s+(?:[a-z]+ )?)((?:18|19|20)\d{2})\b"
SEARCH_WORDS = r"\b(?:search\w*|retriev\w*|database\w*|bibliograph\w*|indexed|publi(?:shed|cations?)|records?|literature)\b"
_SPANS = ArrayType(StructType([StructField("start_char", IntegerType()), StructField("end_char", IntegerType())]))


def guarded_spans(text: str) -> list[tuple[int, int]]:
    """Spans of sentences cut after . ! ? and white space, but not after the abbreviations above."""
    spans, start = [], 0
    for m in re.finditer(r"[.!?]+[\"'”’)\]]*(?=\s|$)", text):
        before = text[start : m.end()].rstrip("\"'”’)]").lower()
        after = text[m.end() :].lstrip()
        if before.endswith(NEVER_LAST) or before.endswith("et al.") and not after[:1].isupper():
            continue
        spans.append((start, m.end()))
        start = m.end()
    spans.append((start, len(text)))
    return [(a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())) for a, b in spans if text[a:b].strip()]


@F.pandas_udf(_SPANS)
def _guarded(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [{"start_char": a, "end_char": b} for a, b in guarded_spans(t)] for t in texts])


def sentence_spans(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, sentence_no from 1, start_char, end_char) of guarded_spans."""
    return df.select(id_column, F.posexplode(_guarded(F.col(text))).alias("at", "s")).select(id_column, (F.col("at") + 1).alias("sentence_no"), "s.start_char", "s.end_char")


def claim_sources(claims: DataFrame, spans: DataFrame, group: str) -> DataFrame:
    """df(claim_id, group, claim_start, claim_end) with the sentence that holds each claim's span and where its context begins: one sentence earlier, if there is one. Claims in no single sentence get no row."""
    order = Window.partitionBy(group).orderBy("sentence_no")
    s = spans.withColumn("context_start", F.coalesce(F.lag("start_char").over(order), F.col("start_char")))
    return claims.join(s, group).filter("start_char <= claim_start and claim_end <= end_char").select("claim_id", group, "sentence_no", "context_start", "start_char", "end_char")


def contained_spans(inner: DataFrame, outer: DataFrame, group: str) -> DataFrame:
    """(inner_id, outer_id): the smallest span of the same group that holds each span of df(inner_id, group, a, b) but is not it; ties by the lower id. outer is df(outer_id, group, a, b)."""
    o = outer.select(group, "outer_id", F.col("a").alias("oa"), F.col("b").alias("ob"))
    held = inner.join(o, group).filter("oa <= a and b <= ob and inner_id != outer_id")
    return held.groupBy("inner_id").agg(F.min(F.struct((F.col("ob") - F.col("oa")).alias("w"), "outer_id"))["outer_id"].alias("outer_id"))


def answer_blocks(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, paragraph_no, page, paragraph): paragraphs with the page marker at or before them; 0 before the first."""
    marker = lambda p: F.try_element_at(F.regexp_extract_all(p, F.lit(r"\[Page (\d+)\]"), F.lit(1)), F.lit(1)).try_cast("int")
    filled = filled_forward(df, id_column, paragraphs_of(F.col(text)), marker, "page", "paragraph")
    return filled.select(id_column, "paragraph_no", F.coalesce("page", F.lit(0)).alias("page"), "paragraph")


def table_lines(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, label, line_no, line): lines of a block by the table label at or above them, as 4 or 4a; lines above any label are left out."""
    label = lambda s: F.nullif(F.lower(F.regexp_extract(s, r"(?i)^\s*(?:label:\s*)?table\s+(\d+[a-z]?)\b", 1)), F.lit(""))
    return filled_lines(df, id_column, text, label, "label").filter("label is not null")


def looks_damaged(block: Column) -> Column:
    """True for a table block with a word broken over lines, a cell such as s0, or a third or more of its rows without a number."""
    rows = F.filter(F.split(block, "\n"), lambda r: F.trim(r) != "")
    empty = F.filter(rows, lambda r: ~r.rlike(r"\d"))
    return block.rlike(r"[a-z]-\n[a-z]") | block.rlike(r"(?m)(?:^|[|\t ])[a-zA-Z]\d(?:[|\t ]|$)") | ((F.size(rows) > 3) & (F.size(empty) * 3 >= F.size(rows)))


def fragmentation(block: Column) -> Column:
    """Share of a block's lines that are a single short token: a table read cell by cell."""
    rows = F.filter(F.split(block, "\n"), lambda r: F.trim(r) != "")
    return F.when(F.size(rows) > 0, F.size(F.filter(rows, lambda r: F.trim(r).rlike(r"^\S{1,12}$"))) / F.size(rows)).otherwise(0.0)


def candidate_findings(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, finding_no, section, finding): bullets of the sections that hold findings, with their continuation lines."""
    heading = lambda s: F.nullif(F.lower(F.trim(F.regexp_replace(F.regexp_extract(s, r"^(?:#{1,6}\s+|\*\*)(\S.*)$", 1), r"[*:]+\s*$", ""))), F.lit(""))
    items = df.select(id_column, F.inline(item_runs(F.col(text), heading, lambda s: s.rlike(r"^\s*(?:[-*•]|\d+[.)])\s+"), lambda s: F.lit(False))))
    lines = F.filter(F.transform("lines", lambda s: F.trim(s)), lambda s: s != "")
    kept = items.filter(F.col("heading").isin(*FINDING_SECTIONS))
    return kept.select(id_column, F.col("item_no").cast("long").alias("finding_no"), F.col("heading").alias("section"), F.regexp_replace(F.array_join(lines, " "), r"^(?:[-*•]|\d+[.)])\s+", "").alias("finding"))


def item_fields(item: Column) -> Column:
    """Fields of a report item as a map: concern or check, evidence, why it matters, reason; bold or plain, on one line or several."""
    plain = F.regexp_replace(item, r"\*\*", "")
    names = ("Concern", "Check", "Evidence", "Why it matters", "Reason")
    stop = "(?:" + "|".join(names) + "):"
    pairs = [F.struct(F.lit(n.lower()).alias("key"), F.nullif(F.trim(F.regexp_extract(plain, rf"(?is)\b{n}:\s*(.*?)\s*(?=\b{stop}|\z)", 1)), F.lit("")).alias("value")) for n in names]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def self_reported_strengths(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, line_no, line, term): bullets under 'Major strengths' that rest on what a manuscript says of its own openness."""
    heading = lambda s: F.nullif(F.lower(F.trim(F.regexp_extract(s, r"^#{1,3}\s*(\S.*)$", 1))), F.lit(""))
    rows = filled_lines(df, id_column, text, heading, "section")
    return rows.filter((F.col("section") == "major strengths") & F.col("line").rlike(r"^\s*[-*•]\s") & F.col("line").rlike(SELF_REPORTED)).select(id_column, "line_no", "line", F.regexp_extract("line", SELF_REPORTED, 0).alias("term"))


def used_trailer(answer: Column) -> Column:
    """Struct of an answer without its last line 'Used: ...', the numbers named there, whether it says none, and whether the line is there at all."""
    line = F.regexp_extract(answer, r"(?i)(?:^|\n)[ \t]*used:[ \t]*([^\n]*)\s*\z", 1)
    there = answer.rlike(r"(?i)(?:^|\n)[ \t]*used:[^\n]*\s*\z")
    found = F.transform(F.regexp_extract_all(line, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("int"))
    none = there & (F.lower(line).startswith("none") | (F.size(found) == 0))
    rest = F.when(there, F.regexp_replace(answer, r"(?i)(?:^|\n)[ \t]*used:[^\n]*\s*\z", "")).otherwise(answer)
    return F.struct(F.regexp_replace(rest, r"\s+\z", "").alias("answer"), F.when(there & ~none, found).otherwise(F.array().cast("array<int>")).alias("used"), F.coalesce(none, F.lit(False)).alias("said_none"), F.coalesce(there, F.lit(False)).alias("found"))


def methods_scope(text: Column, floor: int = 200) -> Column:
    """From the heading of the methods that stands alone on a line past the floor to the next such heading of results, discussion or conclusions; null without one."""
    tail = F.substring(text, floor + 1, 100_000_000)
    found = F.regexp_extract(tail, r"(?ims)^\s*(?:\d+\.?\s*)?(?:materials and methods|methods|methodology)\s*$(.*?)(?=^\s*(?:\d+\.?\s*)?(?:results|discussion|conclusions?)\s*$|\z)", 1)
    return F.nullif(F.regexp_replace(found, r"^\s+|\s+\z", ""), F.lit(""))


def synthesis_scope(text: Column, cue: str = r"(?i)\b(?:meta-analys|pooled|synthesi[sz])", before: int = 400) -> Column:
    """From 400 characters before the first cue of a synthesis up to the results' heading, or to the end; null without a cue."""
    at = F.regexp_instr(text, F.lit(cue))
    window = F.substring(text, F.greatest(F.lit(1), at - before), F.length(text))
    return F.when(at > 0, F.regexp_replace(window, r"(?ims)^\s*(?:\d+\.?\s*)?results\s*$.*\z", ""))


def search_window(df: DataFrame, id_column: str, text: str, narrow: int = 10, near: int = 300) -> DataFrame:
    """(id, first_year, last_year, kind): the narrowest range of years within `near` characters of search words; ten years or fewer are a restriction. Texts without one get no row.

    The context is the text itself before and behind a range, other ranges in it included.
    """
    t = F.lower(F.col(text))
    ranges, rest = F.regexp_extract_all(t, F.lit(YEARS), F.lit(0)), F.split(t, YEARS, -1)
    # where each range starts: the lengths of all that stands before it
    starts = F.transform(ranges, lambda m, i: F.aggregate(F.zip_with(F.slice(rest, 1, i + 1), F.slice(F.concat(F.array(F.lit("")), ranges), 1, i + 1), lambda a, b: F.length(a) + F.length(b)), F.lit(0), lambda n, x: n + x))

    def one(m: Column, start: Column) -> Column:
        first, last = (F.regexp_extract(m, YEARS, k).try_cast("int") for k in (1, 2))
        around = F.substring(t, F.greatest(F.lit(1), start + 1 - near), F.length(m) + F.least(start, F.lit(near)) + near)
        return F.struct((last - first).alias("span"), first.alias("first_year"), last.alias("last_year"), around.rlike(SEARCH_WORDS).alias("near"))

    spans = F.filter(F.zip_with(ranges, starts, one), lambda s: s["near"] & (s["span"] >= 0))
    best = df.select(id_column, F.array_min(spans).alias("b")).filter("b is not null")
    return best.select(id_column, "b.first_year", "b.last_year", F.when(F.col("b.span") <= narrow, "restriction").otherwise("present").alias("kind"))


def outliers_in_rows(df: DataFrame, id_column: str, block: str, least_cells: int = 4, spans: float = 5.0) -> DataFrame:
    """(id, line_no, estimate, lower, upper): table rows of blocks that declare an interval, whose first number lies five spans or more from the middle of the interval in the row."""
    gated = df.filter(F.col(block).rlike(r"(?i)95\s*%\s*CI|confidence interval|lower\s*bound"))
    n = rf"[-+{MINUS_GLYPHS}]?\d+(?:\.\d+)?"
    pair = rf"({n})(?:\s*,\s*|\s*;\s*|\s+to\s+)({n})"
    rows = line_rows(gated, id_column, block).filter((F.size(F.split("line", r"\||\t")) >= least_cells) & F.col("line").rlike(pair))
    rows = rows.withColumn("lower", to_number(F.regexp_extract("line", pair, 1))).withColumn("upper", to_number(F.regexp_extract("line", pair, 2)))
    estimate = F.transform(F.filter(F.transform(F.slice(F.split("line", r"\||\t"), F.lit(2), F.size(F.split("line", r"\||\t"))), lambda c: F.trim(c)), lambda c: c.rlike(rf"^{n}$")), to_number)
    rows = rows.withColumn("estimate", F.get(estimate, 0)).filter("lower < upper and estimate is not null")
    far = F.abs(F.col("estimate") - (F.col("lower") + F.col("upper")) / 2) >= spans * (F.col("upper") - F.col("lower"))
    return rows.filter(far).select(id_column, "line_no", *[F.round(c, 12).alias(c) for c in ("estimate", "lower", "upper")]).dropDuplicates([id_column, "estimate", "lower", "upper"])


def misattributed_values(df: DataFrame, id_column: str, text: str, tables: DataFrame) -> DataFrame:
    """(id, label, value): values that a text gives near 'Table N', that are not in that table but in another of the same text.

    tables is df(id, label, line). A value needs four printed characters; the window is the
    sentence, up to the next mention of a table, 150 characters at most.
    """
    mention = r"(?i)\btable\s+(\d+[a-z]?)\b((?:(?!\btable\s+\d)[^\n]){0,150})"
    said = sentence_rows(df.select(id_column, text), text).select(id_column, F.explode(F.regexp_extract_all("sentence", F.lit(mention), F.lit(0))).alias("m"))
    said = said.select(id_column, F.lower(F.regexp_extract("m", mention, 1)).alias("label"), F.explode(F.array_distinct(numbers(F.regexp_extract("m", mention, 2)))).alias("token")).filter(F.length("token") >= 4).withColumn("value", to_number(F.col("token")))
    held = tables.select(id_column, "label", F.explode(F.transform(numbers(F.col("line")), to_number)).alias("value")).distinct()
    known = said.join(tables.select(id_column, "label").distinct(), [id_column, "label"], "left_semi")
    lost = known.join(held, [id_column, "label", "value"], "left_anti")
    return lost.join(held.select(id_column, "value").distinct(), [id_column, "value"], "left_semi").select(id_column, "label", "value").distinct()


def overclaims(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, hits): texts with wording that claims more than evidence can."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    total = F.lit(0)
    for p in OVERCLAIMS:
        total = total + F.regexp_count(low, F.lit(p))
    return df.select(id_column, total.alias("hits")).filter("hits > 0")


def echoes(evidence: Column, concern: Column) -> Column:
    """True if an evidence line only says the concern again."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    a, b = key(evidence), key(concern)
    return F.coalesce((a != "") & (b != "") & (a.contains(b) | b.contains(a)), F.lit(False))


def technical_verdicts(claims: DataFrame, known: DataFrame) -> DataFrame:
    """df(claim_id, concept, statement) with a status from a table of known expressions df(concept, expression, correct): verified, conflict or not_verified; expressions are compared without spaces, in lower case."""
    plain = F.regexp_replace(F.regexp_replace(F.lower("statement"), r"\s+|\\", ""), "λ", "lambda")
    k = known.select(F.lower("concept").alias("c"), F.regexp_replace(F.lower("expression"), r"\s+", "").alias("e"), "correct")
    rows = claims.withColumn("c", F.lower("concept")).withColumn("e", plain).join(k, ["c", "e"], "left")
    return rows.select("claim_id", F.when(F.col("correct"), "verified").when(~F.col("correct"), "conflict").otherwise("not_verified").alias("status"))
