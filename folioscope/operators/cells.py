"""Table cells: quantities, records, families of records, and comparisons of values.

A cell is (source_name, page, table_evidence_id, section_label, row_index, row_label,
column_header, value ...). A null never equals anything, but where a comment says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from folioscope.functions.text import content_id, label_key

_N = r"[-+−]?\d+(?:\.\d+)?"
QUANTITY = rf"^\s*({_N})\s*(?:\(\s*({_N})\s*,\s*({_N})\s*\))?\s*$"
STRUCTURED_TABLE = StructType([
    StructField("caption", StringType()),
    StructField("columns", ArrayType(StructType([StructField("index", IntegerType()), StructField("header", StringType())]))),
    StructField("sections", ArrayType(StructType([StructField("label", StringType()), StructField("rows", ArrayType(StructType([StructField("label", StringType()), StructField("cells", ArrayType(StructType([StructField("column_index", IntegerType()), StructField("value", StringType())])))])))]))),
])
TABLE = ("source_name", "page", "table_evidence_id")


def _part(value: Column, group: int) -> Column:
    return F.nullif(F.translate(F.regexp_extract(value, QUANTITY, group), "−", "-"), F.lit("")).try_cast("double")


def with_quantity(cells: DataFrame) -> DataFrame:
    """cells with central, lower and upper of values of the form x or x (lo, hi); of any other form all three are null."""
    v = F.col("value")
    return cells.withColumn("central", _part(v, 1)).withColumn("lower", _part(v, 2)).withColumn("upper", _part(v, 3))


def parsed_tables(observations: DataFrame) -> DataFrame:
    """(observation_id, parsed, fault) of df(observation_id, json): nothing is repaired.

    Faults: not json, unknown keys, no columns, a column index twice, a cell of an unknown
    column, two cells of a column in one row, a value that is null. A faulty table is null.
    """
    bare = F.regexp_replace(F.trim(F.col("json")), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1")
    rows = observations.withColumn("bare", bare).withColumn("p", F.from_json("bare", STRUCTURED_TABLE, {"mode": "PERMISSIVE"})).withColumn("keys", F.json_object_keys("bare"))
    indices = F.transform(F.col("p.columns"), lambda c: c["index"])
    lines = F.flatten(F.transform(F.col("p.sections"), lambda s: s["rows"]))
    own = lambda r: F.transform(r["cells"], lambda c: c["column_index"])
    fault = (
        F.when(F.col("keys").isNull(), "not json")
        .when(F.size(F.array_except("keys", F.array(*map(F.lit, ("caption", "columns", "sections"))))) > 0, "unknown keys")
        .when(F.col("p.columns").isNull() | (F.size("p.columns") == 0) | F.exists(indices, lambda i: i.isNull()), "no columns")
        .when(F.size(F.array_distinct(indices)) < F.size(indices), "column twice")
        .when(F.exists(lines, lambda r: F.size(F.array_except(own(r), indices)) > 0), "unknown column")
        .when(F.exists(lines, lambda r: F.size(F.array_distinct(own(r))) < F.size(own(r))), "cell twice")
        .when(F.exists(lines, lambda r: F.exists(r["cells"], lambda c: c["value"].isNull())), "no value")
    )
    return rows.withColumn("fault", fault).select("observation_id", F.when(F.col("fault").isNull(), F.col("p")).alias("parsed"), "fault")


def flattened(parsed: DataFrame) -> DataFrame:
    """One row per cell of df(observation_id, parsed); the row's header is named only where exactly one cell repeats the row's label."""
    rows = parsed.filter("parsed is not null").select("observation_id", "parsed.caption", F.col("parsed.columns").alias("columns"), F.posexplode("parsed.sections").alias("section_index", "s"))
    rows = rows.select("observation_id", "caption", "columns", "section_index", F.col("s.label").alias("section_label"), F.posexplode("s.rows").alias("row_index", "r"))
    header = lambda i: F.get(F.filter("columns", lambda c: c["index"] == i), 0)["header"]
    same = F.filter(F.col("r.cells"), lambda c: c["value"] == F.col("r.label"))
    rows = rows.withColumn("row_label_header", F.when(F.size(same) == 1, header(F.get(same, 0)["column_index"])))
    rows = rows.select("observation_id", "caption", "columns", "section_index", "section_label", "row_index", F.col("r.label").alias("row_label"), "row_label_header", F.explode("r.cells").alias("c"))
    return rows.select("observation_id", "caption", "section_index", "section_label", "row_index", "row_label", "row_label_header", "c.column_index", header(F.col("c.column_index")).alias("column_header"), "c.value")


def evidence_values(cells: DataFrame) -> DataFrame:
    """Typed values of the cells that hold a quantity, with an id from their identity; the row's label names an analysis only under the header 'covariate analysis', else an outcome."""
    rows = with_quantity(cells).filter("central is not null")
    covariate = F.coalesce(label_key(F.col("row_label_header")) == "covariate analysis", F.lit(False))
    return rows.select(
        content_id(F.col("source_name"), F.col("page"), F.col("table_evidence_id"), F.col("section_index"), F.col("row_index"), F.col("column_index"), F.col("value")).alias("evidence_id"),
        "cell_id", "source_name", "page", F.col("table_evidence_id").alias("table_id"), F.when(covariate, F.col("row_label")).alias("analysis"), F.when(~covariate, F.col("row_label")).alias("outcome"),
        F.col("column_header").alias("parameter"), F.col("central").alias("estimate"), F.col("lower").alias("interval_lower"), F.col("upper").alias("interval_upper"),
    )


def records(cells: DataFrame) -> DataFrame:
    """One row per table row that holds quantities: its distinct column labels as its schema, how many quantities it has, and whether a label comes twice.

    A table row holds as many cells as the table has columns, so its list is small.
    """
    named = with_quantity(cells).filter("central is not null").withColumn("label", label_key(F.col("column_header"))).filter("label is not null")
    scope = [*TABLE, "section_index", "section_label", "row_index", "row_label"]
    return named.groupBy(*scope).agg(F.array_join(F.array_sort(F.collect_set("label")), "; ").alias("schema"), F.count("*").alias("quantities"), (F.count("*") > F.count_distinct("label")).alias("label_twice"))


def parallel_families(recs: DataFrame) -> DataFrame:
    """(table, section, schema, members): records of one table section with the same schema, two or more."""
    return recs.filter("not label_twice").groupBy(*TABLE, "section_label", "schema").agg(F.count("*").alias("members")).filter("members >= 2")


def repeated_families(recs: DataFrame) -> DataFrame:
    """(table, row_label, schema, members, sections): records of one label in two or more sections of a table; a null section counts as one."""
    rows = recs.filter("not label_twice").withColumn("label", label_key(F.col("row_label"))).filter("label is not null")
    by = rows.groupBy(*TABLE, "label", "schema").agg(F.count("*").alias("members"), F.count_distinct(F.coalesce("section_label", F.lit("\0none"))).alias("sections"))
    return by.filter("members >= 2 and sections >= 2")


def extension_families(recs: DataFrame) -> DataFrame:
    """(table, base_schema, schema, added): schemas of a table of which one holds all labels of the other and more.

    Pairs are of a table's distinct schemas, not of its records.
    """
    schemas = recs.filter("not label_twice and table_evidence_id is not null").select(*[F.coalesce(F.col(c).cast("string"), F.lit("\0none")).alias(c) for c in TABLE], "schema").distinct()
    other = schemas.withColumnRenamed("schema", "base_schema")
    a, b = F.split("base_schema", "; "), F.split("schema", "; ")
    pairs = other.join(schemas, list(TABLE)).filter((F.size(a) < F.size(b)) & (F.size(F.array_except(a, b)) == 0))
    return pairs.select(*[F.nullif(F.col(c), F.lit("\0none")).alias(c) for c in TABLE], "base_schema", "schema", F.array_join(F.array_sort(F.array_except(b, a)), "; ").alias("added"))


def neighbours(values: DataFrame) -> DataFrame:
    """Each value beside the one before it of the same source, outcome and parameter: comparable or not, and the difference right - left.

    Every state but one leaves the difference null: 'unresolved' where an outcome or
    parameter is unknown, 'not comparable' between values with and without an interval,
    'repeated' where both are equal (nulls equal here), else 'opportunity'.
    """
    order = Window.partitionBy("source_name", "outcome", "parameter").orderBy("cell_id")
    rows = values
    for c in ("evidence_id", "estimate", "interval_lower", "interval_upper"):
        rows = rows.withColumn(f"left_{c}", F.lag(c).over(order))
    rows = rows.filter("left_evidence_id is not null")
    equal = F.col("estimate").eqNullSafe(F.col("left_estimate")) & F.col("interval_lower").eqNullSafe(F.col("left_interval_lower")) & F.col("interval_upper").eqNullSafe(F.col("left_interval_upper"))
    state = (
        F.when(F.col("outcome").isNull() | F.col("parameter").isNull(), "unresolved")
        .when(F.col("interval_lower").isNull() != F.col("left_interval_lower").isNull(), "not comparable")
        .when(equal, "repeated")
        .otherwise("opportunity")
    )
    rows = rows.withColumn("state", state)
    pair = F.substring(F.sha2(F.concat_ws("|", F.least("left_evidence_id", "evidence_id"), F.greatest("left_evidence_id", "evidence_id")), 256), 1, 16)
    return rows.select(pair.alias("comparison_id"), F.col("cell_id"), "state", F.round(F.when(F.col("state") == "opportunity", F.col("estimate") - F.col("left_estimate")), 6).alias("difference"))


def outside_interval(cells: DataFrame) -> DataFrame:
    """Quantities whose central value lies outside their own interval, where the interval is in order."""
    return with_quantity(cells).filter("lower < upper and (central < lower or central > upper)").select("cell_id", "central", "lower", "upper")


def table_ordinals(cells: DataFrame) -> DataFrame:
    """(table, caption, ordinal): tables of one source, page and caption numbered from 0, and an id of them; unknown page and caption have names of their own."""
    tables = cells.filter("table_evidence_id is not null").groupBy("source_name", "page", "caption", "table_evidence_id").agg(F.min("cell_id").alias("first_cell"))
    order = Window.partitionBy("source_name", "page", "caption").orderBy("first_cell")
    rows = tables.withColumn("ordinal", F.row_number().over(order).cast("long") - 1)
    ident = F.concat_ws("|", F.coalesce("source_name", F.lit("<no-source>")), F.coalesce(F.col("page").cast("string"), F.lit("<no-page>")), F.coalesce("caption", F.lit("<unlabelled>")), F.col("ordinal").cast("string"))
    return rows.select("source_name", "page", "table_evidence_id", "ordinal", F.substring(F.sha2(ident, 256), 1, 16).alias("table_key"))


def observation_differences(cells: DataFrame) -> DataFrame:
    """Rows of one table and label whose sections state different numbers of data points: (table, label, fewest, most)."""
    points = F.when(F.size(F.regexp_extract_all(F.lower("section_label"), F.lit(r"(\d+) data points"), F.lit(1))) == 1, F.regexp_extract(F.lower("section_label"), r"(\d+) data points", 1).try_cast("int"))
    rows = cells.withColumn("points", points).withColumn("label", label_key(F.col("row_label"))).filter("points is not null and label is not null")
    return rows.groupBy(*TABLE, "label").agg(F.min("points").alias("fewest"), F.max("points").alias("most")).filter("fewest < most")


def record_fields(cells: DataFrame) -> DataFrame:
    """(record_id, the record's scope, fields): each table row that holds quantities, with its labelled quantities in order of the label; rows of a label that comes twice are left out.

    record_id is the least cell_id of the row. A field is (label, central, lower, upper).
    """
    named = with_quantity(cells).filter("central is not null").withColumn("label", label_key(F.col("column_header"))).filter("label is not null")
    scope = [*TABLE, "section_index", "section_label", "row_index", "row_label", "row_label_header"]
    listed = named.groupBy(*scope).agg(F.min("cell_id").alias("record_id"), F.array_sort(F.collect_list(F.struct("label", "central", "lower", "upper"))).alias("fields"))
    return listed.filter(F.size(F.array_distinct(F.col("fields.label"))) == F.size("fields"))


def record_correspondences(recs: DataFrame) -> DataFrame:
    """(left_record, right_record, shared, exact): records of one source with two or more labels whose quantities are equal, nulls included; how many labels they share and how many of these are equal.

    Records meet under two equal fields. Those of one such key are a class, and each is
    paired with its first record, so that equal records aren't expanded into all pairs.
    """
    two = F.flatten(F.transform("fields", lambda x: F.transform(F.filter("fields", lambda y: y["label"] > x["label"]), lambda y: F.to_json(F.array(x, y)))))
    keyed = recs.filter(F.size("fields") >= 2).select("record_id", "source_name", F.explode(two).alias("key"))
    first = keyed.groupBy("source_name", "key").agg(F.min("record_id").alias("left_record"), F.count("*").alias("n")).filter("n > 1").drop("n")
    same = keyed.withColumnRenamed("record_id", "right_record").join(first, (keyed.key == first.key) & keyed.source_name.eqNullSafe(first.source_name)).filter("right_record != left_record").select("left_record", "right_record").distinct()
    of = lambda side: recs.select(F.col("record_id").alias(f"{side}_record"), F.col("fields").alias(f"{side}_fields"))
    both = same.join(of("left"), "left_record").join(of("right"), "right_record")
    shared = F.array_intersect(F.col("left_fields.label"), F.col("right_fields.label"))
    return both.select("left_record", "right_record", F.size(shared).alias("shared"), F.size(F.array_intersect("left_fields", "right_fields")).alias("exact"))


def record_relationships(pairs: DataFrame, recs: DataFrame) -> DataFrame:
    """For pairs of records (left_record, right_record) which parts of their scope are the same and known, and their labels in common and of one side only, sorted."""
    columns = [*TABLE, "section_label", "row_label", "fields"]
    of = lambda side: recs.select(F.col("record_id").alias(f"{side}_record"), F.struct(*columns).alias(side))
    both = pairs.select("left_record", "right_record").join(of("left"), "left_record").join(of("right"), "right_record")
    same = lambda c: F.coalesce(F.col(f"left.{c}") == F.col(f"right.{c}"), F.lit(False))
    label = lambda c: F.coalesce(label_key(F.col(f"left.{c}")) == label_key(F.col(f"right.{c}")), F.lit(False))
    source = F.col("left.source_name").eqNullSafe(F.col("right.source_name"))
    x, y = F.col("left.fields.label"), F.col("right.fields.label")
    listed = lambda labels: F.array_join(F.array_sort(labels), "; ")
    return both.select(
        "left_record", "right_record", source.alias("same_source"), (source & same("page")).alias("same_page"), (source & same("table_evidence_id")).alias("same_known_table"), label("section_label").alias("same_section_label"), label("row_label").alias("same_row_label"),
        listed(F.array_intersect(x, y)).alias("shared_labels"), listed(F.array_except(x, y)).alias("left_only"), listed(F.array_except(y, x)).alias("right_only"),
    )


def covariate_differences(recs: DataFrame) -> DataFrame:
    """(source_name, table_evidence_id, section_index, section, left_label, right_label): different entries of one known table's section under the header 'covariate analysis', each beside the first."""
    rows = recs.filter("section_index is not null").select("source_name", "table_evidence_id", "section_index", label_key(F.col("section_label")).alias("section"), label_key(F.col("row_label_header")).alias("header"), label_key(F.col("row_label")).alias("label"))
    rows = rows.filter("table_evidence_id is not null and source_name is not null and section is not null and label is not null and header = 'covariate analysis'").select("source_name", "table_evidence_id", "section_index", "section", "label").distinct()
    group = ["source_name", "table_evidence_id", "section_index", "section"]
    first = rows.groupBy(*group).agg(F.min("label").alias("left_label"))
    return rows.join(first, group).filter("label > left_label").select(*group, "left_label", F.col("label").alias("right_label"))


def compared_values(pairs: DataFrame) -> DataFrame:
    """pairs of values, with what may be said of each and the difference right - left.

    pairs has left_ and right_ of evidence_id, parameter, outcome, estimate and
    interval_lower. 'unresolved' where an estimate or parameter is unknown, 'not comparable'
    where the parameters differ, or the outcomes as far as either is known, or only one has
    an interval, else 'opportunity', which alone has a difference.
    """
    key = lambda c: (label_key(F.col(f"left_{c}")), label_key(F.col(f"right_{c}")))
    (p, q), (o, u) = key("parameter"), key("outcome")
    state = (
        F.when(F.col("left_estimate").isNull() | F.col("right_estimate").isNull() | p.isNull() | q.isNull(), "unresolved").when(p != q, "not comparable").when(~o.eqNullSafe(u), "not comparable")
        .when(F.col("left_interval_lower").isNull() != F.col("right_interval_lower").isNull(), "not comparable").otherwise("opportunity")
    )
    ident = F.substring(F.sha2(F.concat_ws("|", F.least("left_evidence_id", "right_evidence_id"), F.greatest("left_evidence_id", "right_evidence_id")), 256), 1, 16)
    return pairs.withColumn("comparison_id", ident).withColumn("state", state).withColumn("difference", F.when(F.col("state") == "opportunity", F.round(F.col("right_estimate") - F.col("left_estimate"), 6)))


def value_pairs(values: DataFrame) -> DataFrame:
    """Each value beside the first one (least cell_id) of its source and parameter: pairs for compared_values, as many as values and no window."""
    rows = values.filter("parameter is not null").withColumn("p", label_key(F.col("parameter")))
    first = rows.groupBy("source_name", "p").agg(F.min("cell_id").alias("first_cell"))
    columns = ("evidence_id", "parameter", "outcome", "estimate", "interval_lower")
    left = rows.join(first.select("first_cell"), F.col("cell_id") == F.col("first_cell"), "left_semi").select("source_name", "p", F.col("cell_id").alias("left_cell"), *[F.col(c).alias(f"left_{c}") for c in columns])
    right = rows.select(F.col("source_name").alias("right_source"), F.col("p").alias("right_p"), F.col("cell_id").alias("right_cell"), *[F.col(c).alias(f"right_{c}") for c in columns])
    return right.join(left, (F.col("right_p") == F.col("p")) & F.col("right_source").eqNullSafe(F.col("source_name"))).filter("right_cell != left_cell").drop("right_source", "right_p", "p")


def table_pages(cells: DataFrame) -> DataFrame:
    """(source_name, page, table_evidence_id, table_no, cells): the known tables of each known page in the order of their first cell."""
    tables = cells.filter("page is not null and table_evidence_id is not null").groupBy("source_name", "page", "table_evidence_id").agg(F.min("cell_id").alias("first_cell"), F.count("*").alias("cells"))
    return tables.withColumn("table_no", F.row_number().over(Window.partitionBy("source_name", "page").orderBy("first_cell")).cast("long")).select("source_name", "page", "table_evidence_id", "table_no", "cells")


def best_tables(cells: DataFrame) -> DataFrame:
    """(source_name, page, caption, table_evidence_id, filled, columns): of the extractions of one captioned table of a page the one with the most filled cells, then columns, then the lesser id; the others are its duplicates."""
    filled = F.trim(F.coalesce("value", F.lit(""))) != ""
    rows = cells.filter("page is not null and table_evidence_id is not null").withColumn("label", label_key(F.col("caption"))).filter("label is not null")
    tables = rows.groupBy("source_name", "page", "label", "table_evidence_id").agg(F.count_if(filled).alias("filled"), F.count_distinct("column_index").alias("columns"))
    order = Window.partitionBy("source_name", "page", "label").orderBy(F.desc("filled"), F.desc("columns"), "table_evidence_id")
    return tables.withColumn("r", F.row_number().over(order)).withColumn("candidates", F.count("*").over(Window.partitionBy("source_name", "page", "label"))).filter("r = 1").select("source_name", "page", F.col("label").alias("caption"), "table_evidence_id", "filled", "columns", "candidates")
