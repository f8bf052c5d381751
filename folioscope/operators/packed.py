"""Several values packed in one field: split into one value per row, with position.

Method: spans that must stay whole (quotes, brackets, escapes, numbers with thousands
separators, fixed terms ...) are replaced by indexed placeholders, what delimiters remain
are split, and the spans are restored by looking the index up in the array of spans. The
placeholders cannot collide with the text: a private-use character that the text already
holds is itself such a span.

All steps are built-in expressions, so the operator is one projection and one generator
and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "", ""

# Terms whose comma, slash or "and" belongs to the term.
QUALIFIERS = (
    "chronic", "acute", "subacute", "mild", "moderate", "severe", "unspecified", "bilateral", "unilateral", "left", "right",
    "generalised", "generalized", "localised", "localized", "usual", "tension-type", "head", "primary", "secondary", "recurrent",
    "persistent", "other", "congenital", "acquired", "benign", "malignant", "idiopathic", "juvenile", "postoperative", "self-reported",
)
SLASH_TERMS = ("and/or", "either/or", "test/retest", "mother/infant", "parent/child", "inpatient/outpatient", "on/off", "n/a", "w/o", "his/her", "input/output", "yes/no", "true/false")
AND_TERMS = (
    "sit and reach", "stop and go", "wear and tear", "ear and throat", "black and white", "trial and error", "cause and effect", "signs and symptoms",
    "activities and participation", "bed and breakfast", "search and rescue", "pick and place", "point and click", "hand and foot", "mouth and throat", "nose and throat",
    "knowledge and attitude", "strengths and difficulties", "research and development", "health and safety",
)
UNITS_ABOVE = ("km", "cm", "mm", "m", "kg", "g", "mg", "µg", "μg", "ug", "ng", "pg", "mmol", "µmol", "nmol", "pmol", "mol", "L", "mL", "ml", "dL", "kcal", "kJ", "J", "N", "W", "mV", "points", "beats", "breaths", "cells", "copies", "cases", "steps", "events", "units", "IU", "U")
UNITS_BELOW = ("h", "hr", "s", "min", "d", "day", "week", "wk", "month", "year", "yr", "m2", "m3", "m²", "m³", "cm2", "cm3", "mm3", "L", "l", "mL", "ml", "dL", "dl", "kg", "g", "mg", "mol", "person", "capita", "cell", "m")
REMARK_WORDS = ("the", "is", "are", "was", "were", "be", "by", "from", "in", "only", "all", "too", "no", "not", "see", "after", "before", "later", "below", "above", "for", "with", "without", "of", "to", "at", "on", "due", "because", "but", "than", "as", "which", "that", "this", "given", "if", "when", "until", "since", "per", "via", "both", "none", "reported", "estimated", "excluded", "included")


def _any(words) -> str:
    return "(?:" + "|".join(sorted((w.replace(".", r"\.") for w in words), key=len, reverse=True)) + ")"


_DELIMITER = r"\n\t|;；、•·&,，/"
_BEFORE, _AFTER = rf"(?<![^\s{_DELIMITER}\[{{])", rf"(?![^\s{_DELIMITER}\]}}])"
_QUOTED = "|".join([rf'{_BEFORE}"(?:[^"]|"")*"{_AFTER}', rf"{_BEFORE}“[^”]*”{_AFTER}", rf"{_BEFORE}„[^“”]*[“”]{_AFTER}", rf"{_BEFORE}«[^»]*»{_AFTER}", rf"{_BEFORE}'[^'\n]+'{_AFTER}", rf"{_BEFORE}‘[^’\n]+’{_AFTER}"])
_MARK = r"(?:\((?:[a-z]|[ivx]{1,4}|\d{1,2})\)|(?:\d{1,2}|[a-z])[.)])\s"
#: Spans that stay whole, in order of precedence.
WHOLE = "|".join([
    f"[{OPEN}{CLOSE}]",
    _QUOTED,
    r"\\.",
    rf"(?!{_MARK})\([^()]*\)",
    r"\[[^\[\]]*\]",
    rf"(?<=[\d%])\s*\n\s*(?=[(\[][-−–+<]?\d)(?!{_MARK})",
    r"\b10\.\d{4,9}/(?:(?!;\s|;10\.\d{4})[^\s,|、；])+",
    r"https?://[^\s|]+",
    r"(?<![\d.,])\d{1,3}(?:,\d{3})+(?!\d)",
    r"(?<=\d)[·,](?=\d+[ ]?%)",
    r"\p{Lu}[\p{L}'’-]+, \p{Lu}\.(?:[ -]?\p{Lu}\.)*",
    rf", {_any(QUALIFIERS)}(?=\s*(?:$|[{_DELIMITER}\]}}]|\sand\s)|\s{{2,}}|\s+{_MARK})",
    r"(?<=\)), lag \d+",
    rf"(?<![\p{{L}}\d/]){_any(SLASH_TERMS)}(?![\p{{L}}\d])",
    rf"(?<![\p{{L}}/]){_any(UNITS_ABOVE)}/{_any(UNITS_BELOW)}(?![\p{{L}}\d])",
    r"(?<![\d/])\d+(?:\.\d+)?/\d+(?:/\d+)?(?![\d/])",
    r"\b[IVX]+/[IVX]+\b",
    rf"(?<![\p{{L}}\d]){_any(AND_TERMS)}(?![\p{{L}}\d])",
])
SPLIT = r"\s*(?:,\s*and\s+|\s+and\s+|[\n\t|;；、•·&,，/]|\s{2,})\s*"
#: A value that one cell holds as one: a remark in running words, on one line or wrapped.
REMARK = rf"^\p{{Lu}}(?=(?:.*\s){{2,}})(?=(?:.*[\s,;])?(?:{_any(REMARK_WORDS)})(?:[\s,;.]|$)|(?i:{_any(REMARK_WORDS)})\s)(?:\p{{L}}|\d|[’'.%-])+(?:(?:[,;]?\s+)(?=\p{{Ll}}|\d|\p{{Lu}})(?:\p{{L}}|\d|[’'.%-])+)*[.]?$"
#: The commonest field of one value: a number with at most one bracket after it, or one bracket after one word.
PLAIN = r"^\s*(?:[-−]?\d+(?:,\d{3})*(?:\.\d+)?|[\p{L}\d]+)\s*(?:\([^()\n]*\)|\[[^\[\]\n]*\])?\s*$"
_CAPITAL_ITEM = r"[,;]\s*\p{Lu}"


def _flat(value: Column) -> Column:
    """Without outer white space, and with one kind of line end."""
    return F.regexp_replace(F.regexp_replace(value, r"\r\n?", "\n"), r"^[\s ﻿]+|[\s ﻿]+$", "")


def is_remark(value: Column) -> Column:
    """Running words: starts with a capital, holds function words, and no part after a mark starts another item."""
    one_line = F.regexp_replace(value, r"\s*\n\s*", " ")
    return one_line.rlike(REMARK) & ~one_line.rlike(_CAPITAL_ITEM)


def _inner(value: Column) -> Column:
    """The list inside enclosing brackets; an interval in square brackets is a value and keeps them."""
    braces, square = r"(?s)^\{([^{}]*)\}$", r"(?s)^\[([^\[\]]*)\]$"
    number = r"[-−–+]?[\d.,]+%?"
    interval = rf"^\[\s*{number}\s*(?:[;,–-]|to)\s*{number}\s*\]$"
    return F.when(value.rlike(braces), F.regexp_replace(value, braces, "$1")).when(value.rlike(square) & ~value.rlike(interval), F.regexp_replace(value, square, "$1")).otherwise(value)


def _clean_span(span: Column) -> Column:
    """A span as it reads: no enclosing quotes, doubled quotes single, no escape character."""
    double = F.regexp_replace(F.regexp_replace(span, r'(?s)^"(.*)"$', "$1"), '""', '"')
    other = F.regexp_replace(span, r"(?s)^[“„«'‘]\s*(.*?)\s*[”“»'’]$", "$1")
    return F.when(span.rlike(r'(?s)^".*"$') & (F.length(span) > 1), double).when(span.rlike(r"(?s)^[“„«'‘].+[”“»'’]$"), other).when(span.rlike(r"(?s)^\\.$"), F.substring(span, 2, 1)).otherwise(span)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once a row: what is bound to a lambda's variable isn't computed again at each mention."""
    return F.get(F.transform(F.array(value), use), 0)


def _items_of(flat: Column) -> Column:
    """Items of a field that is no remark, without its enclosing brackets."""
    marks = rf"(?:^|(?<=[\s;,|]))[-–*]?\s*{_MARK}+\s*"

    def held(spans: Column) -> Column:
        return F.array_join(F.transform(F.split(flat, WHOLE, -1), lambda p, i: F.when(i < F.size(spans), F.concat(p, F.lit(OPEN), i.cast("string"), F.lit(CLOSE))).otherwise(p)), "")

    def unmarked(text: Column) -> Column:
        return F.when(text.rlike(rf"^{_MARK}"), F.regexp_replace(text, marks, "\n")).when(text.rlike(r"^[-–*]\s"), F.regexp_replace(text, r"(?m)^[-–*]\s+", "")).otherwise(text)

    def restore(item: Column, readable: Column) -> Column:
        looked_up = F.transform(F.split(item, f"[{OPEN}{CLOSE}]", -1), lambda p, i: F.when(i % 2 == 1, F.get(readable, p.try_cast("int"))).otherwise(p))
        return F.when(item.contains(OPEN), F.trim(F.array_join(looked_up, ""))).otherwise(F.trim(item))

    def from_spans(spans: Column) -> Column:
        return _let(F.transform(spans, _clean_span), lambda readable: F.filter(F.transform(F.split(_let(held(spans), unmarked), SPLIT, -1), lambda x: restore(x, readable)), lambda x: x != ""))

    return _let(F.regexp_extract_all(flat, F.lit(WHOLE), F.lit(0)), from_spans)


def packed_items(value: Column) -> Column:
    """array<string> of the values that one field holds, in the order written.

    Null, empty and blank fields give an empty array, and so does a field of delimiters
    only; equal values are all kept; a field of one value gives an array of that value.
    """

    def of(flat: Column) -> Column:
        whole = F.filter(F.array(F.trim(flat)), lambda x: x != "")
        return F.when(is_remark(flat), whole).otherwise(_let(_inner(flat), _items_of))

    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(_let(_flat(value), of))


def split_packed(df: DataFrame, column: str, position: str = "value_position", item: str = "item", least: int = 1) -> DataFrame:
    """One row for each value of each field of df[column] that holds at least `least` values.

    The other columns are kept; a column of df that has the name of one of the two new ones
    is replaced by it. An empty df gives an empty result with the same columns.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (position, item)]
    # most fields hold no delimiter outside one pair of brackets: they are told apart before any span is looked for
    maybe = df.filter(F.regexp_replace(F.col(column), PLAIN, "").rlike(r"[\n\r\t|;；、•·&,，/\[{]|\sand\s|\s{2,}|[.)]\s")) if least > 1 else df
    listed = _let(packed_items(F.col(column)), lambda items: F.when(F.size(items) >= least, items))
    return maybe.select(*kept, F.posexplode(listed).alias("__at", item)).withColumn(position, F.col("__at") + 1).select(*kept, position, item)
