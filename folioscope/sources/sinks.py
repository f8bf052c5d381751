"""Writing logs, reports and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_log(df: DataFrame, folder: str) -> None:
    """Append rows to a log of JSON lines; nulls are kept, so that every line has the same keys."""
    df.write.mode("append").option("ignoreNullFields", "false").json(folder)


def report_text(items: DataFrame, report: str, heading: str, order: str, text: str) -> DataFrame:
    """(report, markdown): a report's items under their headings, in order. A report holds a few dozen items."""
    lines = items.groupBy(report).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(heading).alias("h"), F.col(text).alias("t")))).alias("rows"))
    line = F.transform("rows", lambda x, i: F.concat(F.when((i == 0) | (x["h"] != F.get("rows", i - 1)["h"]), F.concat(F.lit("\n# "), x["h"], F.lit("\n"))).otherwise(""), F.lit("- "), x["t"]))
    return lines.select(report, F.regexp_replace(F.array_join(line, "\n"), r"^\n", "").alias("markdown"))


def write_texts(df: DataFrame, text: str, folder: str) -> None:
    """One text per row into files of a folder."""
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(folder)


def trace(df: DataFrame, *columns: str) -> DataFrame:
    """df with a column `trace`: the columns as one JSON object."""
    return df.withColumn("trace", F.to_json(F.struct(*columns)))
