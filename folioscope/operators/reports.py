"""Report items, groups of findings, merges of passes, tallies, coverage and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import content_words, label_key
from folioscope.operators.segments import item_runs, line_rows

#: Shared words of two items from which the later one repeats the earlier.
REPEATED = 0.6
MARK = r"^\s*(?:[-*•–]|\(?\d{1,3}[.)])\s+"


def list_items(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, item_no, heading, lines, item): list items under their headings, with their continuation lines.

    An item starts at a line with a mark; lines after it belong to it until a blank line,
    a heading or the next mark. What is no item is left out; see loose_lines.
    """
    heading = lambda s: F.nullif(F.regexp_extract(s, r"^#{1,6}\s+(\S.*)$", 1), F.lit(""))
    items = item_runs(F.col(text), heading, lambda s: s.rlike(MARK), lambda s: (F.trim(s) == "") | s.rlike(r"^#{1,6}\s"))
    joined = F.array_join(F.transform("__lines", lambda s: F.trim(s)), " ")
    rows = df.select(id_column, F.inline(items)).withColumnRenamed("lines", "__lines")
    return rows.select(id_column, F.col("item_no").cast("long").alias("item_no"), "heading", F.size("__lines").cast("long").alias("lines"), F.regexp_replace(joined, MARK, "").alias("item"))


def loose_lines(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, line_no, line): lines of a report that are no heading, no blank and start no item, kept as they are."""
    return line_rows(df, id_column, text).filter((F.trim("line") != "") & ~F.col("line").rlike(r"^#{1,6}\s") & ~F.col("line").rlike(MARK))


def numbered(items: DataFrame, group: str, kind: str, order: str, prefixes: dict[str, str]) -> DataFrame:
    """items with an id for each: the prefix of its kind and its number within group and kind, in order."""
    prefix = F.create_map(*[x for k, v in prefixes.items() for x in (F.lit(k), F.lit(v))])[F.col(kind)]
    number = F.row_number().over(Window.partitionBy(group, kind).orderBy(order))
    return items.withColumn("item_id", F.concat(F.coalesce(prefix, F.lit("X")), number.cast("string")))


def grouped_findings(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, group_id, group_size): findings of the same normal text in one group, named by its lowest id; nothing is lost. Null and blank texts are groups of their own.

    Members are rows, not a list, so that a group of a third of all rows is no single value.
    """
    keyed = df.select(id_column, label_key(F.col(text)).alias("key"))
    groups = keyed.filter("key is not null").groupBy("key").agg(F.min(id_column).alias("group_id"), F.count("*").alias("group_size"))
    alone = keyed.filter("key is null").select(id_column, F.col(id_column).alias("group_id"), F.lit(1).cast("long").alias("group_size"))
    return keyed.join(groups, "key").select(id_column, "group_id", "group_size").unionByName(alone)


def merged_passes(items: DataFrame, group: str) -> DataFrame:
    """df(group, pass_no, item_no, text) without later items that repeat one of an earlier pass: kept items, and whether only a later pass has them.

    An item repeats another if at least REPEATED of the words of the shorter are shared.
    Only words meet in the join. A merge of equal passes adds nothing.
    """
    rows = items.withColumn("words", content_words(F.coalesce(F.col("text"), F.lit(""))))
    w = rows.select(group, "pass_no", "item_no", F.size("words").alias("size"), F.explode("words").alias("word"))
    earlier = w.select(group, F.col("pass_no").alias("e_pass"), F.col("item_no").alias("e_item"), F.col("size").alias("e_size"), "word")
    both = w.join(earlier, [group, "word"]).filter("e_pass < pass_no").groupBy(group, "pass_no", "item_no", "size", "e_pass", "e_item", "e_size").agg(F.count("*").alias("shared"))
    repeats = both.filter(F.col("shared") >= REPEATED * F.least("size", "e_size")).select(group, "pass_no", "item_no").distinct()
    kept = rows.drop("words").join(repeats, [group, "pass_no", "item_no"], "left_anti")
    return kept.withColumn("later_only", F.col("pass_no") > 1)


def counted_with_previews(df: DataFrame, group: str, id_column: str, most: int = 5) -> DataFrame:
    """(group, n, previews): how many rows each group has, and its lowest ids. The ids are cut to `most` in each task before the shuffle."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    order = Window.partitionBy(group).orderBy(id_column)
    few = df.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(id_column)), lambda i: i.cast("string")), ",").alias("previews"))
    return counts.join(few.withColumnRenamed(group, "__g"), counts[group].eqNullSafe(F.col("__g"))).drop("__g")


def tally(df: DataFrame, by: list[str], measure: str) -> DataFrame:
    """Count, mean, least and most of a measure by group; null measures are left aside."""
    return df.groupBy(*by).agg(F.count(measure).alias("n"), F.round(F.avg(measure), 4).alias("mean"), F.min(measure).alias("least"), F.max(measure).alias("most"))


def presence_matrix(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """(row, column, state): every row value beside every column value, present or ABSENT; nulls are left aside.

    Both sides are the distinct values of a label, not rows of df. The columns that a row
    has not are taken from the list of all columns; the joins are left to the size check.
    """
    found = df.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull()).groupBy(rows, columns).agg(F.count("*").alias("n"))
    listed = found.agg(F.array_sort(F.collect_set(columns)).alias("all"))
    own = found.groupBy(rows).agg(F.collect_set(columns).alias("has")).withColumn("k", F.lit(1))
    absent = own.join(listed.withColumn("k", F.lit(1)), "k").select(rows, F.explode(F.array_except("all", "has")).alias(columns), F.lit("ABSENT").alias("state"), F.lit(0).cast("long").alias("n"))
    return found.select(rows, columns, F.lit("present").alias("state"), "n").unionByName(absent)


def first_state(df: DataFrame, group: str, rules: list[tuple[str, Column]], otherwise: str) -> DataFrame:
    """(group, state): the first rule, in order, that any row of a group fulfils; null conditions count as unfulfilled. One partial aggregate."""
    flags = df.groupBy(group).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(f"__{i}") for i, (_, c) in enumerate(rules)])
    case = F.when(F.col("__0"), rules[0][0])
    for i, (name, _) in enumerate(rules[1:], 1):
        case = case.when(F.col(f"__{i}"), name)
    return flags.select(group, case.otherwise(otherwise).alias("state"))


def accepted_relationship(evidence: DataFrame, group: str) -> DataFrame:
    """(group, state) of df(group, kind): identity or difference if evidence of exactly one kind is there, else not established."""
    flags = evidence.groupBy(group).agg(F.coalesce(F.bool_or(F.col("kind") == "identity"), F.lit(False)).alias("i"), F.coalesce(F.bool_or(F.col("kind") == "difference"), F.lit(False)).alias("d"))
    return flags.select(group, F.when(F.col("i") & ~F.col("d"), "identity").when(F.col("d") & ~F.col("i"), "difference").otherwise("not established").alias("state"))


def reference_faults(items: DataFrame, id_column: str, refers_to: str) -> DataFrame:
    """(id, fault): items that refer to themselves, to an unknown item, or share an id."""
    twice = items.groupBy(id_column).count().filter("count > 1").select(id_column, F.lit("id twice").alias("fault"))
    edges = items.filter(F.col(refers_to).isNotNull()).select(id_column, F.col(refers_to).alias("to"))
    own = edges.filter(F.col(id_column) == F.col("to")).select(id_column, F.lit("itself").alias("fault"))
    known = items.select(F.col(id_column).alias("to")).distinct()
    unknown = edges.join(known, "to", "left_anti").select(id_column, F.lit("unknown").alias("fault"))
    return twice.unionByName(own).unionByName(unknown).distinct()


def screening(segments: DataFrame, screens: DataFrame, group: str, segment: str) -> DataFrame:
    """(group, segments, screened, complete): complete if every segment is screened exactly once. Says nothing about absence."""
    s = screens.groupBy(group, segment).agg(F.count("*").alias("times"))
    rows = segments.select(group, segment).distinct().join(s, [group, segment], "left")
    return rows.groupBy(group).agg(F.count("*").alias("segments"), F.count("times").alias("screened"), F.bool_and(F.coalesce(F.col("times") == 1, F.lit(False))).alias("complete"))


def methodological_status(consistent: Column, established: Column) -> Column:
    """conflict if inconsistent, consistent if both hold, else not_established."""
    return F.when(consistent == "no", "conflict").when((consistent == "yes") & (established == "yes"), "consistent").otherwise("not_established")


def missing_claims(discovered: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Different rows of `discovered` whose key, nulls equal, no row of `known` has."""
    a, b = discovered.dropDuplicates(key).alias("a"), known.select(*key).distinct().alias("b")
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same, "left_anti")


def ordered_by_evidence(items: DataFrame, group: str, label: str, position: str) -> DataFrame:
    """items with `place`, from 1 in each group: those whose evidence is High first, then Moderate, Low and none; those alike keep their order."""
    rank = F.when(F.col(label) == "High", 0).when(F.col(label) == "Moderate", 1).when(F.col(label) == "Low", 2).otherwise(3)
    return items.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(rank, position)).cast("long"))
