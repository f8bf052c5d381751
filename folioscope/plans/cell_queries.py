"""Quantities, records and families of the table cells. Rows sent again count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import cells as C
from folioscope.sources.tables import checkpoint, sent_once, table

_COLUMNS = ("cell_id", "source_name", "page", "table_evidence_id", "caption", "section_index", "section_label", "row_index", "row_label", "row_label_header", "column_index", "column_header", "value")


def _cells(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return sent_once(table(spark, d, "table_cells").select("cell_id", *(columns or _COLUMNS[1:])), "cell_id")


def quantities(spark: SparkSession, d: str) -> DataFrame:
    """Central value and interval of every cell of the form x or x (lo, hi)."""
    return C.with_quantity(_cells(spark, d, "value")).filter("central is not null").drop("value")


def evidence_values(spark: SparkSession, d: str) -> DataFrame:
    return C.evidence_values(_cells(spark, d)).select("evidence_id", "cell_id", "analysis", "outcome", "parameter", "estimate", "interval_lower", "interval_upper")


def table_records(spark: SparkSession, d: str) -> DataFrame:
    return C.records(_cells(spark, d))


def parallel_families(spark: SparkSession, d: str) -> DataFrame:
    return C.parallel_families(C.records(_cells(spark, d)))


def repeated_families(spark: SparkSession, d: str) -> DataFrame:
    return C.repeated_families(C.records(_cells(spark, d)))


def extension_families(spark: SparkSession, d: str) -> DataFrame:
    return C.extension_families(C.records(_cells(spark, d))).withColumn("page", F.col("page").cast("int"))


def value_comparison(spark: SparkSession, d: str) -> DataFrame:
    return C.neighbours(C.evidence_values(_cells(spark, d)))


def record_correspondences(spark: SparkSession, d: str) -> DataFrame:
    return C.record_correspondences(checkpoint(C.record_fields(_cells(spark, d))))


def record_relationships(spark: SparkSession, d: str) -> DataFrame:
    """What the corresponding records have in common."""
    recs = checkpoint(C.record_fields(_cells(spark, d)))
    return C.record_relationships(C.record_correspondences(recs), recs)


def covariate_differences(spark: SparkSession, d: str) -> DataFrame:
    return C.covariate_differences(C.record_fields(_cells(spark, d)))


def observation_differences(spark: SparkSession, d: str) -> DataFrame:
    return C.observation_differences(_cells(spark, d))


def compared_values(spark: SparkSession, d: str) -> DataFrame:
    """Each value beside the first one of its source and parameter."""
    pairs = C.value_pairs(checkpoint(C.evidence_values(_cells(spark, d))))
    return C.compared_values(pairs).select("comparison_id", "left_cell", "right_cell", "state", "difference")


def table_pages(spark: SparkSession, d: str) -> DataFrame:
    return C.table_pages(_cells(spark, d, "source_name", "page", "table_evidence_id"))


def best_tables(spark: SparkSession, d: str) -> DataFrame:
    return C.best_tables(_cells(spark, d, "source_name", "page", "table_evidence_id", "caption", "column_index", "value"))


def interval_outliers(spark: SparkSession, d: str) -> DataFrame:
    return C.outside_interval(_cells(spark, d, "value"))


def table_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return C.table_ordinals(_cells(spark, d))


def row_header_cells(spark: SparkSession, d: str) -> DataFrame:
    """Table rows of which exactly one cell repeats the row's label."""
    same = F.col("value") == F.col("row_label")
    return _cells(spark, d).groupBy(*C.TABLE, "section_index", "row_index").agg(F.count_if(same).alias("same")).filter("same = 1").drop("same")


def acquisition_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cells by how they were acquired and from what, with those that hold a placeholder."""
    empty = F.lower(F.trim(F.coalesce("value", F.lit("")))).isin("", "-", "n/a", "none", "not reported")
    return _cells(spark, d, "acquisition_method", "extraction_source", "value").groupBy("acquisition_method", "extraction_source").agg(F.count("*").alias("cells"), F.count_if(empty).alias("empty"))


QUERIES = {f.__name__: f for f in (quantities, evidence_values, table_records, parallel_families, repeated_families, extension_families, value_comparison, record_correspondences, record_relationships, covariate_differences, observation_differences, compared_values, table_pages, best_tables, interval_outliers, table_ordinals, row_header_cells, acquisition_counts)}

_CELLS = "(SELECT DISTINCT ON (cell_id) * FROM table_cells)"
_NUM = r"[-+−]?\d+(?:\.\d+)?"
_Q = rf"'^\s*({_NUM})\s*(?:\(\s*({_NUM})\s*,\s*({_NUM})\s*\))?\s*$'"
_PART = "TRY_CAST(nullif(replace(regexp_extract(value, " + _Q + ", {}), '−', '-'), '') AS DOUBLE)"
_KEY = "nullif(trim(regexp_replace(lower({}), '\\s+', ' ', 'g'), ' '), '')"
_VALUES = f"(SELECT *, {_PART.format(1)} AS central, {_PART.format(2)} AS lower_, {_PART.format(3)} AS upper_ FROM {_CELLS})"
_ID = "substring(sha256(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'None')" for c in ("source_name", "page", "table_evidence_id", "section_index", "row_index", "column_index", "value")) + ")), 1, 16)"
_COV = f"coalesce({_KEY.format('row_label_header')} = 'covariate analysis', false)"
_EV = f"(SELECT {_ID} AS evidence_id, cell_id, source_name, CASE WHEN {_COV} THEN row_label END AS analysis, CASE WHEN NOT {_COV} THEN row_label END AS outcome, column_header AS parameter, central AS estimate, lower_ AS interval_lower, upper_ AS interval_upper FROM {_VALUES} WHERE central IS NOT NULL)"
_REC = f"""(SELECT source_name, page, table_evidence_id, section_index, section_label, row_index, row_label, string_agg(DISTINCT label, '; ' ORDER BY label) AS schema, count(*) AS quantities, count(*) > count(DISTINCT label) AS label_twice
  FROM (SELECT *, {_KEY.format("column_header")} AS label FROM {_VALUES} WHERE central IS NOT NULL) WHERE label IS NOT NULL GROUP BY ALL)"""

_FIELDS = f"""(SELECT source_name, page, table_evidence_id, section_index, section_label, row_index, row_label, row_label_header, min(cell_id) AS record_id, list({{'l': label, 'c': central, 'a': lower_, 'b': upper_}}) AS f
  FROM (SELECT *, {_KEY.format("column_header")} AS label FROM {_VALUES} WHERE central IS NOT NULL) WHERE label IS NOT NULL GROUP BY ALL HAVING count(*) = count(DISTINCT label))"""
_LABELS = "list_transform({}.f, lambda x: x.l)"
_PAIRS = f"""r AS (SELECT * FROM {_FIELDS}), u AS (SELECT record_id, source_name, unnest(f) AS x FROM r), k AS (SELECT a.record_id, a.source_name, a.x AS x, b.x AS y FROM u a JOIN u b USING (record_id) WHERE a.x.l < b.x.l),
  p AS (SELECT DISTINCT m AS left_record, record_id AS right_record FROM (SELECT record_id, min(record_id) OVER (PARTITION BY source_name, x, y) AS m FROM k) WHERE m <> record_id)"""

ORACLES = {
    "record_correspondences": f"""WITH {_PAIRS} SELECT left_record, right_record, len(list_filter({_LABELS.format("a")}, lambda l: list_contains({_LABELS.format("b")}, l))) AS shared,
        len(list_filter(a.f, lambda x: len(list_filter(b.f, lambda y: y.l = x.l AND y.c = x.c AND y.a IS NOT DISTINCT FROM x.a AND y.b IS NOT DISTINCT FROM x.b)) > 0)) AS exact FROM p JOIN r a ON a.record_id = left_record JOIN r b ON b.record_id = right_record""",
    "record_relationships": f"""WITH {_PAIRS} SELECT left_record, right_record, a.source_name IS NOT DISTINCT FROM b.source_name AS same_source, coalesce(a.source_name IS NOT DISTINCT FROM b.source_name AND a.page = b.page, false) AS same_page,
        coalesce(a.source_name IS NOT DISTINCT FROM b.source_name AND a.table_evidence_id = b.table_evidence_id, false) AS same_known_table, coalesce({_KEY.format("a.section_label")} = {_KEY.format("b.section_label")}, false) AS same_section_label, coalesce({_KEY.format("a.row_label")} = {_KEY.format("b.row_label")}, false) AS same_row_label,
        {", ".join(f"array_to_string(list_sort(list_filter({_LABELS.format(s)}, lambda l: {n} list_contains({_LABELS.format(o)}, l))), '; ') AS {name}" for s, n, o, name in (("a", "", "b", "shared_labels"), ("a", "NOT", "b", "left_only"), ("b", "NOT", "a", "right_only")))} FROM p JOIN r a ON a.record_id = left_record JOIN r b ON b.record_id = right_record""",
    "covariate_differences": f"""WITH l AS (SELECT DISTINCT source_name, table_evidence_id, section_index, {_KEY.format("section_label")} AS section, {_KEY.format("row_label")} AS label FROM {_FIELDS} WHERE {_KEY.format("row_label_header")} = 'covariate analysis' AND source_name IS NOT NULL AND table_evidence_id IS NOT NULL AND section_index IS NOT NULL)
        SELECT source_name, table_evidence_id, section_index, section, m AS left_label, label AS right_label FROM (SELECT *, min(label) OVER (PARTITION BY source_name, table_evidence_id, section_index, section) AS m FROM l WHERE section IS NOT NULL AND label IS NOT NULL) WHERE label > m""",
    "observation_differences": f"""WITH c AS (SELECT source_name, page, table_evidence_id, {_KEY.format("row_label")} AS label, CASE WHEN len(regexp_extract_all(lower(section_label), '(\\d+) data points', 1)) = 1 THEN TRY_CAST(regexp_extract(lower(section_label), '(\\d+) data points', 1) AS INTEGER) END AS n FROM {_CELLS})
        SELECT source_name, page, table_evidence_id, label, min(n) AS fewest, max(n) AS most FROM c WHERE n IS NOT NULL AND label IS NOT NULL GROUP BY ALL HAVING min(n) < max(n)""",
    "compared_values": f"""WITH v AS (SELECT *, {_KEY.format("parameter")} AS p, {_KEY.format("outcome")} AS o FROM {_EV} WHERE parameter IS NOT NULL), f AS (SELECT *, first_value(cell_id) OVER w AS lc, first_value(evidence_id) OVER w AS le, first_value(estimate) OVER w AS lx, first_value(interval_lower) OVER w AS ll, first_value(o) OVER w AS lo FROM v WHERE p IS NOT NULL WINDOW w AS (PARTITION BY source_name, p ORDER BY cell_id)),
        s AS (SELECT *, CASE WHEN o IS DISTINCT FROM lo OR (interval_lower IS NULL) <> (ll IS NULL) THEN 'not comparable' ELSE 'opportunity' END AS state FROM f WHERE cell_id <> lc)
        SELECT substring(sha256(least(le, evidence_id) || '|' || greatest(le, evidence_id)), 1, 16) AS comparison_id, lc AS left_cell, cell_id AS right_cell, state, round(CASE WHEN state = 'opportunity' THEN estimate - lx END, 6) AS difference FROM s""",
    "table_pages": f"SELECT source_name, page, table_evidence_id, row_number() OVER (PARTITION BY source_name, page ORDER BY m) AS table_no, n AS cells FROM (SELECT source_name, page, table_evidence_id, min(cell_id) AS m, count(*) AS n FROM {_CELLS} WHERE page IS NOT NULL AND table_evidence_id IS NOT NULL GROUP BY ALL)",
    "best_tables": f"""WITH t AS (SELECT source_name, page, {_KEY.format("caption")} AS caption, table_evidence_id, count(*) FILTER (trim(coalesce(value, ''), ' ') <> '') AS filled, count(DISTINCT column_index) AS columns FROM {_CELLS} WHERE page IS NOT NULL AND table_evidence_id IS NOT NULL AND {_KEY.format("caption")} IS NOT NULL GROUP BY ALL)
        SELECT * EXCLUDE (r) FROM (SELECT *, count(*) OVER (PARTITION BY source_name, page, caption) AS candidates, row_number() OVER (PARTITION BY source_name, page, caption ORDER BY filled DESC, columns DESC, table_evidence_id) AS r FROM t) WHERE r = 1""",
    "quantities": f"SELECT cell_id, central, lower_ AS lower, upper_ AS upper FROM {_VALUES} WHERE central IS NOT NULL",
    "evidence_values": f"SELECT evidence_id, cell_id, analysis, outcome, parameter, estimate, interval_lower, interval_upper FROM {_EV}",
    "table_records": f"SELECT * FROM {_REC}",
    "parallel_families": f"SELECT source_name, page, table_evidence_id, section_label, schema, count(*) AS members FROM {_REC} WHERE NOT label_twice GROUP BY ALL HAVING count(*) >= 2",
    "repeated_families": f"""SELECT source_name, page, table_evidence_id, {_KEY.format("row_label")} AS label, schema, count(*) AS members, count(DISTINCT coalesce(section_label, chr(1))) AS sections FROM {_REC}
        WHERE NOT label_twice AND {_KEY.format("row_label")} IS NOT NULL GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT coalesce(section_label, chr(1))) >= 2""",
    "extension_families": f"""WITH s AS (SELECT DISTINCT source_name, page, table_evidence_id, schema, string_split(schema, '; ') AS l FROM {_REC} WHERE NOT label_twice AND table_evidence_id IS NOT NULL)
        SELECT a.source_name, a.page, a.table_evidence_id, a.schema AS base_schema, b.schema, array_to_string(list_sort(list_filter(b.l, lambda x: NOT list_contains(a.l, x))), '; ') AS added
        FROM s a JOIN s b ON a.source_name IS NOT DISTINCT FROM b.source_name AND a.page IS NOT DISTINCT FROM b.page AND a.table_evidence_id = b.table_evidence_id WHERE len(a.l) < len(b.l) AND list_has_all(b.l, a.l)""",
    "value_comparison": f"""WITH l AS (SELECT *, lag(evidence_id) OVER o AS le, lag(estimate) OVER o AS lx, lag(interval_lower) OVER o AS ll, lag(interval_upper) OVER o AS lu FROM {_EV} WINDOW o AS (PARTITION BY source_name, outcome, parameter ORDER BY cell_id)),
        s AS (SELECT *, CASE WHEN outcome IS NULL OR parameter IS NULL THEN 'unresolved' WHEN (interval_lower IS NULL) <> (ll IS NULL) THEN 'not comparable'
          WHEN estimate IS NOT DISTINCT FROM lx AND interval_lower IS NOT DISTINCT FROM ll AND interval_upper IS NOT DISTINCT FROM lu THEN 'repeated' ELSE 'opportunity' END AS state FROM l WHERE le IS NOT NULL)
        SELECT substring(sha256(least(le, evidence_id) || '|' || greatest(le, evidence_id)), 1, 16) AS comparison_id, cell_id, state, round(CASE WHEN state = 'opportunity' THEN estimate - lx END, 6) AS difference FROM s""",
    "interval_outliers": f"SELECT cell_id, central, lower_ AS lower, upper_ AS upper FROM {_VALUES} WHERE lower_ < upper_ AND (central < lower_ OR central > upper_)",
    "table_ordinals": f"""WITH t AS (SELECT source_name, page, caption, table_evidence_id, min(cell_id) AS f FROM {_CELLS} WHERE table_evidence_id IS NOT NULL GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY source_name, page, caption ORDER BY f) - 1 AS ordinal FROM t)
        SELECT source_name, page, table_evidence_id, ordinal, substring(sha256(coalesce(source_name, '<no-source>') || '|' || coalesce(CAST(page AS VARCHAR), '<no-page>') || '|' || coalesce(caption, '<unlabelled>') || '|' || ordinal), 1, 16) AS table_key FROM o""",
    "row_header_cells": f"SELECT source_name, page, table_evidence_id, section_index, row_index FROM {_CELLS} GROUP BY ALL HAVING count(*) FILTER (value = row_label) = 1",
    "acquisition_counts": f"SELECT acquisition_method, extraction_source, count(*) AS cells, count(*) FILTER (lower(trim(coalesce(value, ''), ' ')) IN ('', '-', 'n/a', 'none', 'not reported')) AS empty FROM {_CELLS} GROUP BY ALL",
}
