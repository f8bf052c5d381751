"""Bibliographic records and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import doi_key, plain_text
from folioscope.operators import bibliography as B
from folioscope.sources.tables import sent_once, table


def _records(spark: SparkSession, d: str) -> DataFrame:
    return sent_once(table(spark, d, "reference_candidates").select("candidate_id", "source", "title", "authors", "year", "venue", "publisher", "doi", "work_type", "title_similarity"), "candidate_id")


def _references(spark: SparkSession, d: str) -> DataFrame:
    return sent_once(table(spark, d, "academic_references").select("reference_id", "draft_id", "title", "author", "year", "venue", "doi"), "reference_id")


def doi_keys(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("candidate_id", doi_key(F.col("doi")).alias("doi_key"))


def union_once(spark: SparkSession, d: str) -> DataFrame:
    return B.union_once(_records(spark, d), "candidate_id").select("candidate_id", "doi_key")


def best_records(spark: SparkSession, d: str) -> DataFrame:
    return B.best_record(_records(spark, d), "candidate_id")


def corroboration(spark: SparkSession, d: str) -> DataFrame:
    """Both databases on each DOI, by equal plain titles and venues."""
    return B.corroborated(_records(spark, d), "candidate_id")


def corroboration_by_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The same by the ratio of matching runs, 0.9 or more."""
    return B.corroborated(_records(spark, d), "candidate_id", B.title_likeness)


def reference_verification(spark: SparkSession, d: str) -> DataFrame:
    return B.verified_references(_references(spark, d), _records(spark, d))


def author_and_venue_matches(spark: SparkSession, d: str) -> DataFrame:
    """For references and records of one title and year, whether author, venue words and publisher agree."""
    key = [plain_text(F.col("title")).alias("title_key"), "year"]
    r = _references(spark, d).select("reference_id", *key, "author", F.col("venue").alias("r_venue"))
    c = _records(spark, d).select("candidate_id", *key, "authors", "venue", "publisher")
    return r.join(c, ["title_key", "year"]).select("reference_id", "candidate_id", B.author_matches(F.col("author"), F.col("authors")).alias("author_match"), B.venue_words_match(F.col("r_venue"), F.col("venue")).alias("venue_match"), B.publisher_matches(F.col("r_venue"), F.col("publisher")).alias("publisher_match"))


def retrieval_identities(spark: SparkSession, d: str) -> DataFrame:
    """What the databases say of each reference's DOI."""
    return B.retrieval_identities(_references(spark, d), B.corroborated(_records(spark, d), "candidate_id"))


def safe_titles(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d).select("reference_id", B.safe_title(F.col("title")).alias("safe"))


def dangling_references(spark: SparkSession, d: str) -> DataFrame:
    """References whose draft is not there."""
    return _references(spark, d).join(table(spark, d, "academic_drafts").select("draft_id"), "draft_id", "left_anti").select("reference_id")


QUERIES = {f.__name__: f for f in (doi_keys, union_once, best_records, corroboration, corroboration_by_ratio, reference_verification, author_and_venue_matches, retrieval_identities, safe_titles, dangling_references)}

_REC = "(SELECT DISTINCT ON (candidate_id) * FROM reference_candidates)"
_REF = "(SELECT DISTINCT ON (reference_id) * FROM academic_references)"
_DOI = r"nullif(regexp_replace(lower(trim(doi, ' ')), '^(?:https?://)?(?:dx\.)?(?:doi\.[a-z]+/)?(?:doi:\s*)?', ''), '')"
_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '<[^>]*>', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'), ' ')"
_RANK = "CASE " + " ".join(f"WHEN work_type = '{k}' THEN {v}" for k, v in B.TYPE_RANK.items()) + " ELSE 0 END"
_SET = "list_sort(list_distinct(list_filter(list_transform({}, lambda a: " + _PLAIN.format("a") + "), lambda a: a <> '')))"
_W = f"string_split({_PLAIN.format('author')}, ' ')"
_P = _PLAIN.format("a")
_GEN = ", ".join(f"'{w}'" for w in B.PUBLISHER_GENERIC)
_CORE = "list_filter(string_split(" + _PLAIN + ", ' '), lambda w: w NOT IN (" + _GEN + ") AND w <> '')"

ORACLES = {
    "doi_keys": f"SELECT candidate_id, {_DOI} AS doi_key FROM {_REC}",
    "union_once": f"WITH k AS (SELECT candidate_id, {_DOI} AS doi_key FROM {_REC}) SELECT candidate_id, doi_key FROM k WHERE doi_key IS NULL OR candidate_id IN (SELECT min(candidate_id) FROM k WHERE doi_key IS NOT NULL GROUP BY doi_key)",
    "best_records": f"SELECT doi_key, candidate_id FROM (SELECT candidate_id, {_DOI} AS doi_key, row_number() OVER (PARTITION BY {_DOI} ORDER BY coalesce(title_similarity, 0) DESC, {_RANK} DESC, candidate_id) AS r FROM {_REC}) WHERE r = 1 AND doi_key IS NOT NULL",
    "corroboration": f"""WITH k AS (SELECT *, {_DOI} AS doi_key FROM {_REC}), f AS (SELECT k.* FROM k JOIN (SELECT min(candidate_id) AS candidate_id FROM k WHERE doi_key IS NOT NULL GROUP BY doi_key, source) USING (candidate_id)),
        b AS (SELECT coalesce(x.doi_key, y.doi_key) AS doi_key, x.title AS t1, y.title AS t2, x.year AS y1, y.year AS y2, x.venue AS v1, y.venue AS v2, {_SET.format("x.authors")} AS a1, {_SET.format("y.authors")} AS a2 FROM (SELECT * FROM f WHERE source = 'crossref') x FULL JOIN (SELECT * FROM f WHERE source = 'openalex') y ON x.doi_key = y.doi_key)
        SELECT doi_key, CASE WHEN t1 IS NULL OR t2 IS NULL THEN 'single_source' WHEN {_PLAIN.format("t1")} = {_PLAIN.format("t2")} AND (coalesce(len(a1), 0) = 0 OR coalesce(len(a2), 0) = 0 OR a1 = a2)
          AND (trim(coalesce(v1, ''), ' ') = '' OR trim(coalesce(v2, ''), ' ') = '' OR {_PLAIN.format("v1")} = {_PLAIN.format("v2")}) AND coalesce(abs(y1 - y2) <= 1, true) THEN 'corroborated' ELSE 'conflict' END AS status FROM b""",
    "author_and_venue_matches": f"""WITH r AS (SELECT reference_id, author, venue AS r_venue, year, {_PLAIN.format("title")} AS k FROM {_REF}), c AS (SELECT candidate_id, authors, venue, publisher, year, {_PLAIN.format("title")} AS k FROM {_REC})
        SELECT reference_id, candidate_id, coalesce(len(list_filter(authors, lambda a: coalesce({_P} <> '' AND {_PLAIN.format("author")} <> '' AND (contains({_PLAIN.format("author")}, {_P}) OR contains({_P}, {_PLAIN.format("author")}) OR (length(string_split({_P}, ' ')[-1]) > 1 AND list_contains({_W}, string_split({_P}, ' ')[-1]))), false))) > 0, false) AS author_match,
          coalesce(len(list_filter(string_split({_PLAIN.format("r_venue")}, ' '), lambda w: length(w) >= 3)) > 0 AND len(list_filter(string_split({_PLAIN.format("r_venue")}, ' '), lambda w: length(w) >= 3 AND NOT list_contains(string_split({_PLAIN.format("venue")}, ' '), w))) = 0 AND venue IS NOT NULL, false) AS venue_match,
          coalesce({_PLAIN.format("r_venue")} <> '' AND {_PLAIN.format("publisher")} <> '' AND ({_PLAIN.format("r_venue")} = {_PLAIN.format("publisher")} OR list_contains(string_split({_PLAIN.format("r_venue")}, ' '), 'university') = list_contains(string_split({_PLAIN.format("publisher")}, ' '), 'university') AND len({_CORE.format("r_venue")}) > 0 AND len({_CORE.format("publisher")}) > 0 AND (list_has_all({_CORE.format("r_venue")}, {_CORE.format("publisher")}) OR list_has_all({_CORE.format("publisher")}, {_CORE.format("r_venue")}))), false) AS publisher_match FROM r JOIN c USING (k, year)""",
    "retrieval_identities": "",
    "safe_titles": rf"SELECT reference_id, coalesce(regexp_matches(title, '^[A-Za-z0-9 ]+$') AND len(list_filter(string_split(regexp_replace(upper(title), '\s+', ' ', 'g'), ' '), lambda w: w IN ('AND', 'OR', 'NOT'))) = 0 AND strlen(title) <= 2048, false) AS safe FROM {_REF}",
    "dangling_references": f"SELECT reference_id FROM {_REF} WHERE draft_id NOT IN (SELECT draft_id FROM academic_drafts)",
}
ORACLES["retrieval_identities"] = f"""SELECT reference_id, CASE WHEN r.doi_key IS NULL THEN 'no_doi' WHEN status IS NULL THEN 'unknown_doi' ELSE status END AS identity
    FROM (SELECT reference_id, {_DOI} AS doi_key FROM {_REF}) r LEFT JOIN ({ORACLES["corroboration"]}) USING (doi_key)"""
