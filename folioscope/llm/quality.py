"""Per-document statistics of a text, and a verdict whether it is natural prose.

Method: an ordered rule list is induced by incremental reduced-error pruning (irep.py) from
labelled documents (labelled.py); the learned thresholds (quality_rules.py) are exported
to one SQL CASE expression. Statistics and verdict are built-in expressions: one scan, no
shuffle, no Python. Each statistic is one pass over the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.quality_rules import RULES

#: Marks that a line of running text doesn't hold, and the characters that they start with. No class here that leaves characters out names any beyond Latin: such a class costs thirty times as much.
_MARKS, _STARTS = r"(?:\. ?\. ?\. ?\.|(?<=(?:19|20)\d\d);\d|\[ ?\]|____|\b[YN] ?/ ?N\b|<-|</)", r".;\[_YN<"
#: Lines that hold no running text, each kind by its form, whatever their length: columns are close together, so that one bar or sign in a long sentence makes none. Loops are possessive, so that no line is too long for the stack.
LISTED_LINES = r"(?md)^(?:[!-~]{41,}|[ \t]*(?:" + "|".join([
    r"(?:[^\n|\t]{0,80}+[|\t])++(?:[^\n|\t]{0,80}\S)",  # columns
    r"[^\n=]{1,80}+=(?:[^\n=]{0,80}+=)*+[^\n=]{0,80}+",  # keys and values
    r"(?:[^\n;]{0,40}+;){3,}+[^\n;]{0,40}+",  # columns parted by semicolons
    r"[^\n.?!]*+(?:\.[\d.][^\n.?!]*+)*+(?<=[,;{}][ \t\r]{0,4})(?<!\p{IsGreek};[ \t\r]{0,4})",  # items without a stop that end with a mark of a list, and code
    r"(?:[-–—•*·▪]\s|\[[ xX\d]{0,3}\]\s|\(?(?:\d{1,5}|[a-zA-Z]|[ivx]{2,4})[.)]\s+(?:\p{Ll}|[^\n]*[^\n.?!。！？।؟ก-๙”\")\s][ \t]*$)|\d+(?:\.\d+)+\s)[^\n]*",  # items
    r"[!-~]++(?:[ \t][!-~]++)?",  # a word or two
    r"[^\n\d.?!]*+(?:[ \t,;]*+[-–<(\[]*+\d[\d.%)\]–:]*+(?:to [\d.]+\)?)?+(?=[ \t,;]|$)){2,}+[,;]?",  # a label and numbers
    r"[^\n(]*+\((?:19|20)\d\d[a-z]?\)[.,:][^\n]*\d ?\(\d[^\n]*",  # references: the year in the first brackets, then volume and issue
    rf"(?:[^\n{_STARTS}]++|(?!{_MARKS})[{_STARTS}])*+{_MARKS}[^\n]*",  # leaders, references, forms, code
]) + r")[ \t\r]*$)"
BOXES = "[☐☑☒□]"
#: Ends of sentences; of Thai, which has no stop, the space after a letter.
STOPS = r"[.!?…ก-๙][\"'”’»)\]]*(?=\s|$)|[。！？।؟]"
#: A word is what stands between white space; of scripts that part no words by it, each Han or kana character, and about four letters of Thai.
WORDS, UNPARTED, UNPARTED_WORDS = r"\S+", "[぀-ヿ㐀-鿿฀-๿]+", "[぀-ヿ㐀-鿿]|[฀-๿]{1,4}"
# Common words of several languages; of those without spaces, common characters and words anywhere.
COMMON = "the of and to in is was that for with not be by are it der die und das ist nicht le la les des est que el los en de un no se в и не на что το και την في من أن में है ने की".split()
COMMON_ANYWHERE = "的 了 是 在 和 不 这 は が を に の と も และ ที่ ใน ของ ไม่ เป็น".split()
COUNTED = {
    "stops": STOPS,
    "digits": r"\d",
    "symbols": r"[=<>|_\\^~+{}$@]",
    "capitals": r"\p{Lu}",
    "commas": r"[,;]",
    "stopped_lines": r"[.!?。！？।؟…:;][\"'”’»)」]*[ \t\r]*(?:\n|$)",
    "short_words": r"(?<![\p{L}\p{N}_])\p{L}{1,3}(?![\p{L}\p{N}_])",
    "common_words": rf"(?<![\p{{L}}\p{{M}}])(?:{'|'.join(COMMON)})(?![\p{{L}}\p{{M}}])|{'|'.join(COMMON_ANYWHERE)}",
    "single_letters": r"(?<!\S)[\p{L}\p{N},.](?!\S)",
    "miscoded": r"[\u0080-\u009F]|[ÃÂÐÑÎÏãàèéäåç][\u0080-¿‐-›€™šœžŸ]",
}


def _let(value: Column, use) -> Column:
    """use(value), with value computed once a row, whatever the optimiser moves."""
    return F.get(F.transform(F.array(value), use), 0)


def _distinct_share(t: Column) -> Column:
    """Share of the characters of sentences and lines, numbers aside, that are in different ones; 1 of a text without any."""
    sentences = F.filter(F.transform(F.split(F.regexp_replace(t, r"\d+", ""), r"[.!?。！？।؟\n]"), lambda s: F.trim(s)), lambda s: s != "")
    size = lambda parts: F.aggregate(parts, F.lit(0), lambda n, s: n + F.length(s))
    return _let(sentences, lambda s: F.when(F.size(s) < 2, F.lit(1.0)).otherwise(size(F.array_distinct(s)) / size(s)))


#: Each statistic: the counts that it is made of, and how. What is not in COUNTED: chars, letters (and digits), lines, unlisted (characters outside listed lines) and distinct.
STATISTICS = {
    "n_chars": (("chars",), lambda c: c.chars),
    "n_words": (("words",), lambda c: c.words),
    "n_lines": (("lines",), lambda c: c.lines),
    "mean_word_length": (("letters", "words"), lambda c: _share(c.letters, c.words)),
    "words_per_line": (("words", "lines"), lambda c: _share(c.words, c.lines)),
    "symbol_share": (("symbols", "chars"), lambda c: _share(c.symbols, c.chars)),
    "digit_share": (("digits", "chars"), lambda c: _share(c.digits, c.chars)),
    "upper_share": (("capitals", "chars"), lambda c: _share(c.capitals, c.chars)),
    "line_end_stop_share": (("stopped_lines", "lines"), lambda c: _share(c.stopped_lines, c.lines)),
    "short_word_share": (("short_words", "words"), lambda c: _share(c.short_words, c.words)),
    "common_word_share": (("common_words", "words"), lambda c: _share(c.common_words, c.words)),
    "words_per_stop": (("words", "stops"), lambda c: _share(c.words, c.stops)),
    "comma_share": (("commas", "words"), lambda c: _share(c.commas, c.words)),
    "single_share": (("single_letters", "words"), lambda c: _share(c.single_letters, c.words)),
    "miscoded_share": (("miscoded", "chars"), lambda c: _share(c.miscoded, c.chars)),
    "listed_share": (("unlisted", "unbroken"), lambda c: 1 - _share(c.unlisted, c.unbroken)),
    "distinct_share": (("distinct",), lambda c: c.distinct),
}


def _count(t: Column, name: str) -> Column:
    if name == "chars":
        return F.length(t).cast("double")
    if name == "lines":
        return F.regexp_count(t, F.lit(r"[^\s][^\n]*")).cast("double")
    if name == "words":
        unparted = F.regexp_count(t, F.lit(UNPARTED_WORDS)) + F.regexp_count(F.regexp_replace(t, UNPARTED, " "), F.lit(WORDS))
        return F.when(t.rlike(UNPARTED), unparted).otherwise(F.regexp_count(t, F.lit(WORDS))).cast("double")
    if name == "letters":
        return (F.length(t) - F.length(F.regexp_replace(t, r"[\p{L}\p{M}\p{N}]+", ""))).cast("double")
    if name == "common_words":
        return F.regexp_count(F.lower(t), F.lit(COUNTED[name])).cast("double")
    if name == "unbroken":
        return F.length(F.replace(t, F.lit("\n"), F.lit(""))).cast("double")
    if name == "unlisted":
        return F.length(F.replace(F.regexp_replace(F.when(t.rlike(BOXES), F.regexp_replace(t, BOXES, "[ ]")).otherwise(t), LISTED_LINES, ""), F.lit("\n"), F.lit(""))).cast("double")
    if name == "distinct":
        return _distinct_share(t)
    return F.regexp_count(t, F.lit(COUNTED[name])).cast("double")


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1.0))


def with_statistics(text: Column, names, use) -> Column:
    """use({name: statistic}) of a text, each count taken in one pass; of a null or empty text counts and shares are 0, the share of different sentences is 1."""
    t = F.coalesce(text, F.lit(""))
    needed = sorted({c for n in names for c in STATISTICS[n][0]})

    class Counts:
        def __init__(self, row: Column):
            self.row = row

        def __getattr__(self, name: str) -> Column:
            return self.row[name]

    counts = F.struct(*[_count(t, c).alias(c) for c in needed])
    return _let(counts, lambda row: use({n: STATISTICS[n][1](Counts(row)) for n in names}))


def statistics(text: Column, names=tuple(STATISTICS)) -> Column:
    """A struct of the named statistics."""
    return with_statistics(text, names, lambda found: F.struct(*[found[n].alias(n) for n in names]))


def document_statistics(df: DataFrame, column: str = "text", names=tuple(STATISTICS)) -> DataFrame:
    """df without its text but with one column for each statistic; columns of those names are replaced."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != column and c not in names]
    return df.select(*kept, statistics(F.col(column), names).alias("__found")).select(*kept, *[F.round(F.col("__found")[n], 6).alias(n) for n in names])


def verdict(stats: dict[str, Column], rules=RULES) -> Column:
    """True if the text is natural prose: a CASE over the learned rules, in their order; no rule, no objection."""
    case = None
    for rule in rules:
        holds = F.lit(True)
        for name, op, threshold in rule:
            holds = holds & (stats[name] >= threshold if op == ">=" else stats[name] <= threshold)
        case = F.when(holds, False) if case is None else case.when(holds, False)
    return F.lit(True) if case is None else case.otherwise(True)


def judged_documents(df: DataFrame, column: str = "text") -> DataFrame:
    """df without its text, with `is_prose`. A null or blank text is no prose."""
    used = {name for rule in RULES for name, _, _ in rule}
    kept = [c for c in df.columns if c not in (column, "is_prose")]
    blank = ~F.coalesce(F.col(column).rlike(r"\S"), F.lit(False))
    judged = with_statistics(F.col(column), sorted(used), verdict)
    return df.select(*kept, F.when(blank, False).otherwise(judged).alias("is_prose"))
