"""Queries on fields that pack several values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.operators.packed import split_packed
from folioscope.sources.tables import spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of each cell that holds two or more. Rows sent again count once; cells of one value, null or blank give no row."""
    cells = spread(table(spark, sf_dir, "table_cells").select("cell_id", "value"))
    # a repeated row packs the same value, so the split may come first, and only its few rows are shuffled
    found = split_packed(cells, "value", least=2)
    return found.dropDuplicates(["cell_id", "value_position"]).select("cell_id", "value_position", "item")


QUERIES = {"p1_found": p1_found}
ORACLES: dict[str, str] = {}
