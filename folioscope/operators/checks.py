"""Deterministic checks of manuscripts: intervals, criteria, percentages, artefacts, quotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import near_words, numbers, quote_key, to_number
from folioscope.operators.claims import longest_run
from folioscope.operators.segments import BREAK, adjacent_pairs, filled_lines, sentence_rows

_N = r"[-+]?\d+(?:\.\d+)?"
_TO = r"(?: to |, ?| ?; ?| ?– ?)"
_OF_INTERVAL = r"(?:95 ?% )?(?:confidence |credible )?interval (?:of|from|between) "
#: An estimate with its interval: in brackets, with or without a label, or after the words.
ESTIMATES = (rf"({_N}) ?[\[(](?:95 ?% ?(?:CI|CrI|confidence interval)[:,;]? ?)?({_N}){_TO}({_N})[\])]", rf"({_N}),? (?:with|and) (?:an? |the )?{_OF_INTERVAL}({_N}) (?:to|and) ({_N})")
#: Words that are no evidence of a shared source.
RUN_STOP = tuple("a an the of in on for to and or as at by with was were is are be been this that these those it its from which than then not no but if each any we our their there they he she his her into also".split())
PERCENT = r"\(\s*(\d+(?:\.\d+)?)\s*%\s*\)"
TOLERANCE, MOST_SHARE = 8.0, 90.0
#: What an author's tools or notes leave behind: failed fields, commands, places to be filled, notes to oneself.
ARTEFACT = r"(?i)\berror! [a-z ]+ not (?:found|defined)|\?\?+ ?\(?ref|\\(?:ref|eqref|label|cite[a-z]*)\{|\[(?:citation(?: needed)?|ref(?:erence)?|insert [^\]\n]{1,40})\]|\b(?:todo|fixme|tbd|tbc)\b|\blorem ipsum\b"
CRITERION = r"\b([A-Za-z][A-Za-z0-9-]{1,12})\s*(>=|<=|>|<|≥|≤)\s*(\d+(?:\.\d+)?)"
# Dots that are no operators.
UNSUITABLE = {"hyphenation point": "\u2027", "ano teleia": "\u0387"}
CRITERION_CONTEXT = r"(?i)criteri\w+|threshold|cut[- ]?off|considered (?:acceptable|adequate|good)|acceptable if|regarded as"
NUMBER_WORDS = dict(zip("one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred".split(), (*range(1, 13), *range(20, 100, 10), 100)))


def stated_estimates(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, estimate, lower, upper): every estimate that a text states with an interval in order."""
    def of(pattern: str) -> Column:
        matches = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        return F.transform(matches, lambda m: F.struct(*[F.regexp_extract(m, pattern, i).cast("double").alias(n) for i, n in enumerate(("estimate", "lower", "upper"), 1)]))

    return df.select(id_column, F.inline(F.flatten(F.array(*map(of, ESTIMATES))))).filter("lower < upper")


def estimates_outside(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """Stated estimates that lie outside their own interval, each once."""
    return stated_estimates(df, id_column, text).filter("estimate < lower or estimate > upper").distinct()


def criteria(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, name, operator, threshold, values, failing): thresholds that a text declares, and how the values it reports meet them.

    The first declaration of a name holds. A criterion without a reported value has none;
    a value is reported as "name was 4", "name = 4" or "name of 4" in another place.
    """
    rows = sentence_rows(df.select(id_column, text), text)
    # a colon ends a sentence here, so what announces the thresholds may be the one before
    sentences = F.split(F.col(text), BREAK)
    announced = lambda s: s.rlike(CRITERION_CONTEXT) & s.rlike(r":\s*$")
    listed = F.transform(sentences, lambda s, i: F.struct(i.alias("sentence_no"), F.when(s.rlike(CRITERION_CONTEXT) | F.coalesce(announced(F.get(sentences, i - 1)), F.lit(False)), s).alias("sentence")))
    said = df.select(id_column, F.inline(listed)).filter("sentence is not null").select(id_column, "sentence_no", F.explode(F.regexp_extract_all("sentence", F.lit(CRITERION), F.lit(0))).alias("m"))
    said = said.select(id_column, "sentence_no", F.lower(F.regexp_extract("m", CRITERION, 1)).alias("name"), F.translate(F.regexp_extract("m", CRITERION, 2), "≥≤", "GL").alias("operator"), F.regexp_extract("m", CRITERION, 3).cast("double").alias("threshold"))
    first = said.withColumn("r", F.row_number().over(Window.partitionBy(id_column, "name").orderBy("sentence_no"))).filter("r = 1").drop("r", "sentence_no").withColumn("operator", F.when(F.col("operator") == "G", ">=").when(F.col("operator") == "L", "<=").otherwise(F.col("operator")))
    reported = r"\b([A-Za-z][A-Za-z0-9-]{1,12})\s*(?:=|of|was|were|is|are|:)\s*(\d+(?:\.\d+)?)"
    values = rows.select(id_column, F.explode(F.regexp_extract_all("sentence", F.lit(reported), F.lit(0))).alias("m")).select(id_column, F.lower(F.regexp_extract("m", reported, 1)).alias("name"), F.regexp_extract("m", reported, 2).cast("double").alias("value"))
    meets = F.expr("case operator when '>=' then value >= threshold when '<=' then value <= threshold when '>' then value > threshold else value < threshold end")
    both = first.join(values, [id_column, "name"], "left").withColumn("meets", meets)
    return both.groupBy(id_column, "name", "operator", "threshold").agg(F.count("value").alias("values"), F.count_if(~F.col("meets")).alias("failing"))


def percentage_sums(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, sentence_no, shares, total): sentences with three or more (n%) that should make 100 and don't; a share of 90 or more shows that they are no partition."""
    rows = sentence_rows(df.select(id_column, text), text)
    shares = F.transform(F.regexp_extract_all("sentence", F.lit(PERCENT), F.lit(1)), lambda s: s.cast("double"))
    found = rows.withColumn("s", shares).withColumn("total", F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 4))
    return found.filter((F.size("s") >= 3) & (F.array_max("s") < MOST_SHARE) & (F.abs(F.col("total") - 100) > TOLERANCE)).select(id_column, "sentence_no", F.size("s").alias("shares"), "total")


def artefact_pages(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, page, hits): authoring artefacts by page; page 0 is before the first marker."""
    lines = filled_lines(df, id_column, text, lambda s: F.regexp_extract(s, r"^\[Page (\d+)\]", 1).try_cast("int"), "page")
    return lines.withColumn("hits", F.regexp_count("line", F.lit(ARTEFACT))).filter("hits > 0").groupBy(id_column, F.coalesce("page", F.lit(0)).alias("page")).agg(F.sum("hits").alias("hits"))


def unsuitable_glyphs(df: DataFrame, id_column: str, text: str, least: int = 3) -> DataFrame:
    """(id, glyph, hits): texts in which one of the two dots that stand in for an operator, U+2027 and U+0387, stands at least three times between operands.

    The middle dot U+00B7 is an operator and no fault. Null texts give no row.
    """
    hit = lambda g: F.struct(F.lit(name).alias("glyph"), F.regexp_count(F.col(text), F.lit(rf"(?<=[0-9A-Za-z)\s]){g}(?=[0-9A-Za-z(\s√])")).alias("hits"))
    found = []
    for name, g in UNSUITABLE.items():
        found.append(hit(g))
    return df.select(id_column, F.inline(F.array(*found))).filter(F.col("hits") >= least)


def stated_total(text: Column) -> Column:
    """The sample size that a text states, in digits or as a number word; null if it states none."""
    low = F.lower(text)
    digits = F.regexp_replace(F.regexp_extract(low, r"\b(?:total of|sample of|n\s*=)\s*(\d[\d,]*)", 1), ",", "").try_cast("int")
    word = F.regexp_extract(low, r"\b(?:total of|sample of)\s+([a-z]+)\b", 1)
    table = F.create_map(*[x for w, n in NUMBER_WORDS.items() for x in (F.lit(w), F.lit(n))])
    return F.coalesce(digits, table[word])


def display_items(df: DataFrame, id_column: str, text: str, most: int = 12) -> DataFrame:
    """(id, tables, figures): texts that name more than `most` different tables and figures."""
    count = lambda p: F.size(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(p), F.lit(1))))
    return df.select(id_column, count(r"\btab(?:le|\.) ?(\d+)").alias("tables"), count(r"\bfig(?:ure|\.) ?(\d+)").alias("figures")).filter(F.col("tables") + F.col("figures") > most)


def looks_truncated(text: Column) -> Column:
    """True for an empty text or one that ends within a sentence."""
    last = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+\z", "")
    return (last == "") | ~last.rlike(r"[.!?。！？।؟:…][\"'”’»)\]」*_]*\z")


def quote_verdicts(quotes: DataFrame) -> DataFrame:
    """df(..., quote, source) with a verdict: exact, elided, numbers only, some numbers, not found, or not checked.

    Quotes are compared in normal form; of one with "..." each half must be there. A quote
    without a number of fewer than four words is not checked. Where the wording is not
    found, the numbers that the source prints decide.
    """
    quote, source = quote_key(F.col("quote")), quote_key(F.coalesce(F.col("source"), F.lit("")))
    halves = F.filter(F.transform(F.split(quote, r"\s*(?:\.\.\.|…)\s*"), lambda h: F.trim(h)), lambda h: h != "")
    said = F.array_distinct(F.filter(F.transform(numbers(quote), to_number), lambda n: n.isNotNull()))
    held = F.filter(F.transform(numbers(source), to_number), lambda n: n.isNotNull())
    there = F.size(F.array_intersect(said, held))
    verdict = (
        F.when(F.col("quote").isNull() | (F.size(F.split(quote, " ")) < 4) & (F.size(said) == 0), "not checked")
        .when(source.contains(quote), "exact")
        .when((F.size(halves) > 1) & F.forall(halves, lambda h: source.contains(h)), "elided")
        .when((F.size(said) > 0) & (there == F.size(said)), "numbers only")
        .when(there > 0, "some numbers")
        .otherwise("not found")
    )
    return quotes.withColumn("verdict", verdict)


def nearest_sentences(quotes: DataFrame, sentences: DataFrame, group: str, least_words: int = 5, least_share: float = 0.7) -> DataFrame:
    """(quote_id, sentence_no, share): the sentence of the same group that holds most of a quote's words, if it holds enough.

    quotes is df(quote_id, group, quote), sentences df(group, sentence_no, sentence). Ties
    go to the shorter sentence, then to the earlier. Only words meet, not whole sentences.
    """
    q = quotes.withColumn("w", near_words(F.col("quote"))).filter(F.size("w") >= least_words).select("quote_id", group, F.size("w").alias("size"), F.explode("w").alias("word"))
    s = sentences.select(group, "sentence_no", F.length("sentence").alias("chars"), F.explode(near_words(F.col("sentence"))).alias("word"))
    share = q.join(s, [group, "word"]).groupBy("quote_id", "size", "sentence_no", "chars").agg(F.count("*").alias("both")).withColumn("share", F.col("both") / F.col("size")).filter(F.col("share") >= least_share)
    order = Window.partitionBy("quote_id").orderBy(F.desc("share"), "chars", "sentence_no")
    return share.withColumn("r", F.row_number().over(order)).filter("r = 1").select("quote_id", "sentence_no", F.round("share", 6).alias("share"))


def run_words(text: Column) -> Column:
    """Content words in order, repeats kept, a plural s taken off: the words of which runs are made."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")).otherwise(w))
    return F.filter(words, lambda w: ~w.isin(*RUN_STOP) & (F.length(w) > 1))


def nearest_candidates(quotes: DataFrame, sources: DataFrame, group: str, text: str, least_words: int = 5, least_share: float = 0.7, least_run: int = 3, shortlist: int = 12) -> DataFrame:
    """(quote_id, sentence_no, width, share, run): the sentence, or the sentence with the next one (width 2), of the same group that a quote is nearest to.

    As nearest_sentences, over the sentences of sources(group, text) and adjacent pairs: of the `shortlist` that hold most
    of a quote's words, the shorter first, those with `least_run` of its words in a row, and of
    these the best by (share, run).
    """
    guard = r"(?i)\[[^\]]*(?:PREVIEW CUT SHORT|DO NOT QUOTE)[^\]]*\]"
    q = quotes.select("quote_id", group, run_words(F.regexp_replace("quote", guard, " ")).alias("q_words")).filter(F.size("q_words") >= least_words)
    c = adjacent_pairs(sources, group, text).select(group, "sentence_no", "width", F.length("candidate").alias("chars"), run_words(F.col("candidate")).alias("c_words"))
    words = q.select("quote_id", group, F.size(F.array_distinct("q_words")).alias("size"), F.explode(F.array_distinct("q_words")).alias("word"))
    held = words.join(c.select(group, "sentence_no", "width", "chars", F.explode(F.array_distinct("c_words")).alias("word")), [group, "word"]).groupBy("quote_id", group, "size", "sentence_no", "width", "chars").agg(F.count("*").alias("both"))
    near = held.withColumn("share", F.col("both") / F.col("size")).filter(F.col("share") >= least_share)
    order = Window.partitionBy("quote_id").orderBy(F.desc("share"), "chars", "sentence_no", "width")
    near = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= shortlist)
    runs = near.join(q, ["quote_id", group]).join(c.select(group, "sentence_no", "width", "c_words"), [group, "sentence_no", "width"]).withColumn("run", longest_run(F.col("q_words"), F.col("c_words"))).filter(F.col("run") >= least_run)
    best = runs.groupBy("quote_id").agg(F.max_by(F.struct("sentence_no", "width", "share", "run"), F.struct("share", "run", -F.col("r"))).alias("b"))
    return best.select("quote_id", "b.sentence_no", "b.width", F.round("b.share", 6).alias("share"), "b.run")


def all_checks(checks: dict[str, DataFrame], id_column: str) -> DataFrame:
    """(id, check, finding): the findings of several checks as one table, each row's other columns as JSON; the order of the checks is that of the dict, and repeated findings are kept."""
    parts = []
    for at, (name, df) in enumerate(checks.items(), 1):
        rest = [F.col(f"`{c}`") for c in df.columns if c != id_column]
        parts.append(df.select(id_column, F.lit(at).alias("check_no"), F.lit(name).alias("check"), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("finding")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
