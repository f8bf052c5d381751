"""Scalar text functions: numbers, tokens, names and normal forms, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The glyphs that are typed for a minus sign, and the number pattern.
MINUS_GLYPHS = "−–—‒"
NUMBER = r"[-+−–—‒]?\d+(?:[.,]\d+)?(?:\s?[eE][-+−–—‒]?\d+)?"

# Stop words of passage retrieval, of sentence comparison, and the token pattern.
RETRIEVAL_STOP = tuple(
    "a about above after again against all also am an and any are as at be because been before being below between both but by can cannot could did do does doing "
    "down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of "
    "off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under "
    "until up very was we were what when where which while who whom why will with would you your".split()
)
SENTENCE_STOP = tuple("the a an of for to in and or was were is are be been with that this these those as by on at from it we our their".split())
TOKEN = r"[a-z0-9][a-z0-9_+-]*"
#: Exact technical synonyms that a query is widened by.
ALIASES = {
    r"\br[\s-]?hat\b": "potential scale reduction factor psrf",
    r"\beffective sample size\b|\bess\b": "ess n_eff autocorrelation",
    r"\bpsrf\b": "r-hat potential scale reduction",
    r"\bcredible interval\b": "posterior interval",
    r"\beti\b": "equal-tailed interval",
    r"\b(hdi|hpdi)\b": "highest-density interval",
    r"\bpareto\s*k\b": "pareto k diagnostic",
    r"\bdivergent transitions?\b": "hmc divergences",
}


def to_number(text: Column) -> Column:
    """A number as typed, with any minus glyph, spaces or thousands separators, as a double; null if it is none."""
    plain = F.regexp_replace(F.translate(text, MINUS_GLYPHS, "----"), r"[\s,]", "")
    return plain.try_cast("double")


def numbers(text: Column) -> Column:
    """array<string> of every number token, exponents included, in order."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def pure_number(text: Column) -> Column:
    """The double of a text that is one number and nothing else, a spaced exponent closed; else null."""
    closed = F.regexp_replace(F.trim(text), r"\s+(?=[eE][-+−–—‒]?\d)", "")
    return F.when(closed.rlike(rf"^{NUMBER}$"), to_number(closed))


def page_of(text: Column) -> Column:
    """The number after the first 'Page:' of a block; null if there is none."""
    return F.regexp_extract(text, r"Page:\s*(\d+)", 1).try_cast("int")


def content_words(text: Column) -> Column:
    """Distinct words of three letters or more that are no stop words, sorted."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z\-]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(F.array_except(words, F.array(*map(F.lit, SENTENCE_STOP))), lambda w: F.length(w) > 2)))


def near_words(text: Column) -> Column:
    """Content words with a plural s taken off, for nearest-sentence search."""
    return F.array_sort(F.array_distinct(F.transform(content_words(text), lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")).otherwise(w))))


def tokens(text: Column) -> Column:
    """Retrieval tokens in order: lower-case ASCII words and numbers of two characters or more, stop words left out."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*RETRIEVAL_STOP))


def widened(query: Column) -> Column:
    """A query with the synonyms of the terms that it names put behind it."""
    added = F.filter(F.array(*[F.when(F.lower(query).rlike(p), F.lit(words)) for p, words in ALIASES.items()]), lambda w: w.isNotNull())
    return F.concat_ws(" ", query, F.array_join(added, " "))


def claim_terms(text: Column) -> Column:
    """Distinct terms of a claim: words of three letters or more that are no stop words, and numbers, single digits included."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\d+(?:\.\d+)?|[a-z][a-z0-9-]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: t.rlike(r"^\d") | ((F.length(t) > 2) & ~t.isin(*RETRIEVAL_STOP))))


def doi_key(doi: Column) -> Column:
    """A DOI without resolver or 'doi:' before it, in lower case; null if nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(doi)), r"^(?:https?://)?(?:dx\.)?(?:doi\.[a-z]+/)?(?:doi:\s*)?", "")
    return F.nullif(bare, F.lit(""))


def plain_text(text: Column) -> Column:
    """Lower case, without tags and punctuation, spaces collapsed; null stays null."""
    untagged = F.regexp_replace(F.lower(text), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(untagged, r"[^a-z0-9\s]", " "), r"\s+", " "))


def label_key(label: Column) -> Column:
    """A label for comparison: lower case, spaces collapsed; a blank label is null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(label), r"\s+", " ")), F.lit(""))


def quote_key(text: Column) -> Column:
    """Text for locating quotations: lower case, dash and quote glyphs made one, spaces collapsed, words split over lines closed."""
    joined = F.regexp_replace(text, r"(\p{L})-\s*\n\s*(\p{L})", "$1$2")
    same = F.translate(F.lower(joined), "‐‑‒–—−“”„«»‘’", "------\"\"\"\"\"''")
    return F.trim(F.regexp_replace(same, r"\s+", " "))


def content_id(*fields: Column) -> Column:
    """First 16 hex digits of the sha256 of |-joined fields; a null field reads 'None', so that it is told from an empty one."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("None")) for f in fields]), 256), 1, 16)


def closed_hyphens(text: Column) -> Column:
    """Lower case with words that a line break or a space split at a hyphen closed."""
    return F.regexp_replace(F.lower(text), r"([a-z])-\s+([a-z])", "$1$2")


def folded_letters(text: Column) -> Column:
    """Mathematical letters and digits read as plain ones, for detection only; other text is kept."""
    bold = "".join(chr(0x1D400 + i) for i in range(26)) + "".join(chr(0x1D41A + i) for i in range(26)) + "".join(chr(0x1D7CE + i) for i in range(10))
    italic = "".join(chr(0x1D434 + i) for i in range(26)) + "".join("ℎ" if i == 7 else chr(0x1D44E + i) for i in range(26))
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    return F.translate(text, bold + italic, plain + "0123456789" + plain)


def repaired_numbers(text: Column) -> Column:
    """Decimals whose point was read as $ put right: 0$820 and 0 $235; letters before the $ leave it alone."""
    return F.regexp_replace(text, r"(?<![A-Za-z0-9])(\d)\s?\$(\d{2,})", "$1.$2")


def without_reasoning(text: Column) -> Column:
    """A model's answer without its thinking spans; an unclosed span runs to the end."""
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?(?:</think>|$)", ""))


def rounds_to(value: Column, printed: Column) -> Column:
    """True if value, rounded to the decimals that `printed` shows, is the printed number."""
    shown = F.length(F.regexp_extract(printed, r"\.(\d+)", 1))
    scale = F.pow(F.lit(10.0), shown)
    return F.abs(F.round(value * scale) - F.round(to_number(printed) * scale)) < 0.5


def printed_general(value: Column) -> Column:
    """A number in its shortest form, as %g prints it for magnitudes without an exponent."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", F.round(value, 6)), r"(\.\d*?)0+$", "$1"), r"\.$", "")
