"""Claims, their evidence and what models said about them: strict parsing, labels, scores, resolutions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from folioscope.functions.text import doi_key, near_words

# The fields of an appraisal, its verdicts, and limits of its lists and texts.
APPRAISAL_KEYS = ("target_id", "evidence_package_id", "package_snapshot_id", "model_verdict", "relied_on_evidence_ids", "bounded_rationale", "model_unresolved_premises")
VERDICTS = ("SUPPORTED", "CONTRADICTED", "NOT_ESTABLISHED")
MOST_ITEMS, MOST_CHARS = 100, 4000
APPRAISAL = "target_id string, evidence_package_id string, package_snapshot_id string, model_verdict string, relied_on_evidence_ids array<string>, bounded_rationale string, model_unresolved_premises array<string>"


def exact_keys(json: Column, keys: tuple[str, ...]) -> Column:
    """True if a JSON object has these keys and no others."""
    found = F.json_object_keys(json)
    return F.coalesce((F.size(found) == len(keys)) & (F.size(F.array_except(found, F.array(*map(F.lit, keys)))) == 0), F.lit(False))


def appraisals(responses: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, model_verdict, fault) of df(target_id, raw) against df(target_id, evidence_package_id, package_snapshot_id, permitted_evidence_ids): the first fault, or the verdict."""
    p = F.from_json("raw", APPRAISAL)
    rows = responses.withColumnRenamed("target_id", "asked").withColumn("p", p).join(targets.withColumnRenamed("target_id", "asked"), "asked", "left")
    fault = (
        F.when(~exact_keys(F.col("raw"), APPRAISAL_KEYS), "keys")
        .when(F.col("permitted_evidence_ids").isNull(), "unknown target")
        .when(~F.coalesce((F.col("p.target_id") == F.col("asked")) & (F.col("p.evidence_package_id") == F.col("evidence_package_id")) & (F.col("p.package_snapshot_id") == F.col("package_snapshot_id")), F.lit(False)), "other target")
        .when(~F.coalesce(F.col("p.model_verdict").isin(*VERDICTS), F.lit(False)), "verdict")
        .when(F.coalesce(F.size(F.array_except("p.relied_on_evidence_ids", "permitted_evidence_ids")) > 0, F.lit(True)), "evidence not permitted")
        .when((F.size("p.relied_on_evidence_ids") > MOST_ITEMS) | (F.length("p.bounded_rationale") > MOST_CHARS), "too long")
    )
    return rows.withColumn("fault", fault).select(F.col("asked").alias("target_id"), F.when(F.col("fault").isNull(), F.col("p.model_verdict")).alias("model_verdict"), "fault")


def support_states(claims: DataFrame, searched: DataFrame, located: DataFrame) -> DataFrame:
    """(claim_id, state): located, not_located, or not_assessed where the claim's source was never searched."""
    s = searched.select("claim_id").distinct().withColumn("s", F.lit(True))
    found = located.select("claim_id").distinct().withColumn("f", F.lit(True))
    return claims.select("claim_id").join(s, "claim_id", "left").join(found, "claim_id", "left").select("claim_id", F.when(F.col("f"), "located").when(F.col("s"), "not_located").otherwise("not_assessed").alias("state"))


def with_relationships(findings: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings with the number of verified relationships of each, relationships of unknown findings)."""
    n = relationships.groupBy("finding_id").agg(F.count("*").alias("relationships"))
    return findings.join(n, "finding_id", "left").withColumn("relationships", F.coalesce("relationships", F.lit(0))), relationships.join(findings.select("finding_id"), "finding_id", "left_anti")


def contradictions_resolved(initial: DataFrame, revised: DataFrame) -> DataFrame:
    """(doi_key, resolved): a source's contradiction is cleared only if every revised claim that cites it is supported. df(doi) and df(doi, state); a source that is cited no more is resolved."""
    first = initial.select(doi_key(F.col("doi")).alias("doi_key")).filter("doi_key is not null").distinct()
    later = revised.select(doi_key(F.col("doi")).alias("doi_key"), "state").groupBy("doi_key").agg(F.bool_and(F.coalesce(F.col("state") == "supported", F.lit(False))).alias("all_supported"))
    return first.join(later, "doi_key", "left").select("doi_key", F.coalesce("all_supported", F.lit(True)).alias("resolved"))


def doi_title_conflicts(by_doi: DataFrame, by_title: DataFrame) -> DataFrame:
    """(reference_id): references whose DOI and whose title lead to records of different DOIs. Both are df(reference_id, doi)."""
    a, b = by_doi.select("reference_id", doi_key(F.col("doi")).alias("x")), by_title.select("reference_id", doi_key(F.col("doi")).alias("y"))
    return a.join(b, "reference_id").filter("x != y").select("reference_id").distinct()


def routed_points(points: DataFrame, retrieved: DataFrame, curated: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(point_id, note, heading of the best section, unrouted points): a section serves a point of df(point_id, note, heading, score) if it is retrieved, curated and judged."""
    ok = points
    for side in (retrieved, curated, judged):
        ok = ok.join(side.select("note", "heading").distinct(), ["note", "heading"], "left_semi")
    best = ok.groupBy("point_id").agg(F.max_by(F.struct("note", "heading"), F.struct("score", F.hash("note", "heading"))).alias("s")).select("point_id", "s.note", "s.heading")
    return best, points.select("point_id").distinct().join(best, "point_id", "left_anti")


def single_anchors(claims: DataFrame) -> DataFrame:
    """df(claim_id, anchor, text) of those claims whose anchor stands exactly once in their text."""
    times = F.when(F.length("anchor") > 0, (F.length("text") - F.length(F.replace("text", F.col("anchor"), F.lit("")))) / F.length("anchor"))
    return claims.filter(times == 1)


def decomposed(claims: DataFrame, atoms: DataFrame) -> DataFrame:
    """(claim_id, statement): a compound claim is replaced by its valid atomic claims where there are two or more, else kept."""
    n = atoms.groupBy("claim_id").agg(F.count("*").alias("n")).filter("n >= 2").select("claim_id")
    return claims.join(n, "claim_id", "left_anti").select("claim_id", "statement").unionByName(atoms.join(n, "claim_id", "left_semi").select("claim_id", "statement"))


@F.pandas_udf(IntegerType())
def _longest_run(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0 if x is None or y is None else SequenceMatcher(None, list(x), list(y), autojunk=False).find_longest_match().size for x, y in zip(a, b)], dtype="int32")


def longest_run(a: Column, b: Column) -> Column:
    """Most words in a row that two arrays of words share; no built-in gives it, so it is for the few survivors of a cheaper search."""
    return _longest_run(a, b)


def fallback_note(present: Column, missing: Column) -> Column:
    """What to say of a quotation that is not found, by how many of its values the source prints; null if it has none."""
    return F.when((present > 0) & (missing == 0), "wording not located, every value is present").when(present > 0, "wording not located, some values are present").when(missing > 0, "neither wording nor values located")


def evidence_label(verdicts: Column) -> Column:
    """High if every quote of an array of verdicts holds, Moderate if some evidence is located otherwise, else Low; an empty array is Low."""
    holds = F.filter(verdicts, lambda v: v.isin("exact", "elided"))
    near = F.filter(verdicts, lambda v: v.isin("exact", "elided", "numbers only"))
    return F.when((F.size(verdicts) > 0) & (F.size(holds) == F.size(verdicts)), "High").when(F.size(near) > 0, "Moderate").otherwise("Low")


def citation_scores(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, high, moderate, low, self_cites, bad_quotes, echoes): what a report's own checks concluded, counted."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    return df.select(id_column, n(r"(?i)confidence:\W*high\b").alias("high"), n(r"(?i)confidence:\W*moderate\b").alias("moderate"), n(r"(?i)confidence:\W*low\b").alias("low"), n(r"Cites this pipeline's own summary").alias("self_cites"), n(r"Quotation (?:not found|only partly found)").alias("bad_quotes"), n(r"Evidence line restates the concern").alias("echoes"))


def provenance(methods: Column, sources: Column) -> Column:
    """How a value's cells were acquired: 'method (source)', sorted, each once."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.arrays_zip(methods.alias("m"), sources.alias("s")), lambda x: F.concat(F.coalesce(x["m"], F.lit("unknown")), F.lit(" ("), F.coalesce(x["s"], F.lit("unknown")), F.lit(")"))))), "; ")


def markdown_cell(text: Column) -> Column:
    """Text that may stand in a cell of a markdown table."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")


def fenced(text: Column) -> Column:
    """Text in a fence that is longer than any in it."""
    inner = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`{3,}"), F.lit(0)), lambda f: F.length(f)))
    fence = F.expr("repeat('`', 3)")
    longer = F.repeat(F.lit("`"), F.coalesce(inner, F.lit(2)) + 1)
    return F.concat(F.when(inner.isNull(), fence).otherwise(longer), F.lit("\n"), text, F.lit("\n"), F.when(inner.isNull(), fence).otherwise(longer))


def generation_ceiling(text: Column, chars_per_token: float = 3.5, floor: int = 4000) -> Column:
    """Tokens that an answer to a text may have: as many as the text is estimated at, but never fewer than the floor."""
    return F.greatest(F.lit(floor), F.ceil(F.length(F.coalesce(text, F.lit(""))) / chars_per_token).cast("int"))


def version_stamp(files: DataFrame) -> DataFrame:
    """One row (stamp): 8 hex digits of the SHA-1 of files' bytes in order of their name. df(name, content) holds a handful of source files."""
    return files.agg(F.substring(F.sha1(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("name", F.hex("content").alias("h")))), lambda x: x["h"])).cast("binary")), 1, 8).alias("stamp"))


def unmarked_quotes(text: Column, unverified: Column) -> Column:
    """A report in which the quotations of an array that did not hold lose their marks and are tagged, once; null stays null."""
    def one(report: Column, q: Column) -> Column:
        plain = F.concat(q, F.lit(" [not a verified quotation]"))
        for a, b in (('"', '"'), ("“", "”")):
            report = F.replace(report, F.concat(F.lit(a), q, F.lit(b)), plain)
        return report

    return F.aggregate(F.coalesce(unverified, F.array().cast("array<string>")), text, one)


def shared_words(a: Column, b: Column) -> Column:
    """Share of the first text's content words that the second holds; 0 without words."""
    x = near_words(a)
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, near_words(b))) / F.size(x)).otherwise(0.0)
