"""Curated references in fenced blocks of notes: parse them strictly, find them, take them out of the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.segments import line_rows

# The fields of an entry.
KEYS = ("cite", "doi", "url", "isbn", "supports", "checked", "short", "type", "access", "access_url", "access_checked")
FENCE_OPEN, FENCE_CLOSE, HEADING = r"^```references\s*$", r"^```\s*$", r"^#{1,6}\s+(\S.*)$"


def marked_lines(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """Lines of df(id, text) with block_no (0 outside of blocks), the heading above, and whether the line is a fence."""
    order = Window.partitionBy(id_column).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(id_column).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("line").rlike(FENCE_OPEN)
    rows = line_rows(df, id_column, text).withColumn("opened", F.sum(opens.cast("int")).over(order))
    # a fence closes the block that is open, if there is one
    rows = rows.withColumn("ends", F.when((F.col("opened") > 0) & ~opens & F.col("line").rlike(FENCE_CLOSE), F.col("opened")))
    rows = rows.withColumn("closed", F.coalesce(F.max("ends").over(before), F.lit(0)))
    inside = (F.col("opened") > 0) & (F.col("closed") < F.col("opened"))
    heading = F.last(F.when(~inside, F.nullif(F.regexp_extract("line", HEADING, 1), F.lit(""))), ignorenulls=True).over(order)
    return rows.select(id_column, "line_no", "line", F.when(inside, F.col("opened")).otherwise(0).alias("block_no"), heading.alias("heading"), (inside & (opens | F.col("ends").isNotNull())).alias("fence"))


def entries(lines: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """(references, faults) of marked lines: one row per entry with its fields, and one row per violation of the form.

    An entry begins with "- ", its other fields are indented; every field is one of KEYS
    and comes once; cite, supports and one of doi, url and isbn are required. Entries with
    a fault are no references.
    """
    own = lines.filter("block_no > 0 and not fence").filter(F.trim("line") != "")
    order = Window.partitionBy(id_column, "block_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = own.withColumn("entry_no", F.sum(F.col("line").startswith("- ").cast("int")).over(order))
    field = F.regexp_replace("line", r"^(?:- |\s+)", "")
    rows = rows.withColumn("key", F.lower(F.trim(F.substring_index(field, ":", 1)))).withColumn("value", F.trim(F.regexp_replace(field, r"^[^:]*:?", ""))).withColumn("has_colon", field.contains(":"))
    fault = F.when((F.col("entry_no") == 0) | ~(F.col("line").startswith("- ") | F.col("line").startswith("  ")), "neither entry nor field").when(~F.col("has_colon") | ~F.col("key").isin(*KEYS), "unknown field")
    rows = rows.withColumn("fault", fault)
    unit = [id_column, "block_no", "entry_no"]
    line_faults = rows.filter("fault is not null").select(*unit, "fault")
    good = rows.filter("fault is null")
    twice = good.groupBy(*unit, "key").count().filter("count > 1").select(*unit, F.lit("field twice").alias("fault"))
    wide = good.groupBy(*unit, F.col("heading")).agg(*[F.max(F.when(F.col("key") == k, F.nullif(F.col("value"), F.lit("")))).alias(k) for k in KEYS])
    lacking = wide.withColumn("fault", F.when(F.col("cite").isNull(), "no cite").when(F.col("supports").isNull(), "no supports").when(F.coalesce("doi", "url", "isbn").isNull(), "no doi, url or isbn")).filter("fault is not null").select(*unit, "fault")
    faults = line_faults.unionByName(twice).unionByName(lacking).distinct()
    found = wide.join(faults.select(*unit).distinct(), unit, "left_anti").withColumn("doi", F.regexp_replace("doi", r"^(?:https?://)?(?:dx\.)?(?:doi\.[a-z]+/|doi:\s*)", ""))
    return found, faults


def without_blocks(lines: DataFrame, id_column: str) -> DataFrame:
    """(id, text) of marked lines without their reference blocks."""
    kept = lines.filter("block_no = 0")
    return kept.groupBy(id_column).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


def references_for(asked: DataFrame, references: DataFrame, id_column: str) -> DataFrame:
    """References of each asked (id, heading): those of the section, or else those that stand under a references heading."""
    own = asked.select(id_column, "heading").join(references, [id_column, "heading"])
    rest = asked.select(id_column, F.col("heading").alias("asked_heading")).join(references.select(id_column, F.col("heading").alias("asked_heading")).distinct(), [id_column, "asked_heading"], "left_anti")
    general = references.filter(F.lower("heading").startswith("references")).drop("heading")
    return own.unionByName(rest.join(general, id_column).withColumnRenamed("asked_heading", "heading"))


def once(references: DataFrame) -> DataFrame:
    """References each once by the first of lower-case doi, url, isbn and cite that they have."""
    return references.withColumn("reference_key", F.coalesce(F.lower("doi"), "url", "isbn", "cite")).dropDuplicates(["reference_key"])
