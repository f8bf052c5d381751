"""Bibliographic records: normal forms, matching of authors and venues, corroboration and verification."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from folioscope.functions.text import doi_key, plain_text
from folioscope.sources.tables import checkpoint, written

# Work types of books and chapters, ranks of the others, and words of publishers that name none.
BOOKS = ("book", "monograph", "edited-book", "reference-book")
CHAPTERS = ("book-chapter", "book-part", "book-section")
TYPE_RANK = {"journal-article": 3, "proceedings-article": 2, "posted-content": 1, **dict.fromkeys((*BOOKS, *CHAPTERS), 2)}
PUBLISHER_GENERIC = ("and", "co", "company", "corporation", "gmbh", "group", "inc", "international", "limited", "llc", "ltd", "media", "press", "publisher", "publishers", "publishing", "sons", "university", "verlag")
# Likeness of titles and venues from which they count as one, as probable, and years apart.
SAME, PROBABLE, YEARS = 0.90, 0.80, 1
#: Letters of a run by which a name is found in another; ratio of the lengths that are filed together.
RUN, LENGTHS = 4, 1.1
#: Bits of each letter of a title, by how often it stands in one.
LETTERS = {c: 12 if c in " etaoinrs" else 7 if c in "lcdhumpgf" else 4 if c in "ybvwk" else 2 for c in " abcdefghijklmnopqrstuvwxyz0123456789"}
# The dates of a record, the one that counts first.
DATES = ("published-print", "published-online", "published", "issued")
#: A record as a bibliographic service answers it.
ITEM = StructType([
    StructField("title", ArrayType(StringType())), StructField("subtitle", ArrayType(StringType())), StructField("author", ArrayType(StructType([StructField("given", StringType()), StructField("family", StringType()), StructField("name", StringType())]))),
    *[StructField(d, StructType([StructField("date-parts", ArrayType(ArrayType(IntegerType())))])) for d in DATES], StructField("container-title", ArrayType(StringType())), StructField("publisher", StringType()), StructField("DOI", StringType()), StructField("type", StringType()),
])


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching runs of two texts in plain form; null if either is null. No built-in measures this."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def title_likeness(a: Column, b: Column) -> Column:
    return ratio(plain_text(a), plain_text(b))


def _common_letters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each two rows of codes under 38, 0 being none; by bits, 64 letters of a at once."""
    n, at = len(a), np.arange(len(a))
    words = (a.shape[1] + 63) // 64
    masks = np.zeros((words, n, 38), dtype=np.uint64)
    for i in range(a.shape[1]):
        masks[i // 64, at, a[:, i]] |= np.uint64(1 << (i % 64))
    masks[:, :, 0] = 0
    rows = np.full((words, n), ~np.uint64(0))
    for j in range(b.shape[1]):
        carry = np.zeros(n, dtype=np.uint64)
        for w in range(words):
            v = rows[w]
            u = v & masks[w, at, b[:, j]]
            s = v + u
            t = s + carry
            carry = ((s < v) | (t < s)).astype(np.uint64)
            rows[w] = t | (v - u)
    return np.bitwise_count(~rows).sum(0).astype(np.int64)


_CODES = np.zeros(256, dtype=np.uint8)
_CODES[np.frombuffer(b" abcdefghijklmnopqrstuvwxyz0123456789", dtype=np.uint8)] = np.arange(1, 38)


def _may_reach(a: list[str], b: list[str], least: float) -> np.ndarray:
    """False where the ratio of two plain texts is surely less: runs in order are a common subsequence, which has no more letters than both have."""
    x, y = (_CODES[np.array([t.encode() for t in s], dtype=bytes).reshape(-1, 1).view(np.uint8)] for s in (a, b))
    n, size = len(a), np.maximum(1, np.array([len(p) + len(q) for p, q in zip(a, b)]))
    counts = [np.bincount((c + 38 * np.arange(n)[:, None]).ravel(), minlength=38 * n).reshape(n, 38)[:, 1:] for c in (x, y)]
    may = 2.0 * np.minimum(*counts).sum(1) / size >= least
    for rows in np.array_split(np.flatnonzero(may), 1 + int(may.sum()) // 2048):
        if len(rows):
            longest = [max(1, max(len(s[i]) for i in rows)) for s in (a, b)]
            may[rows] = 2.0 * _common_letters(x[rows, : longest[0]], y[rows, : longest[1]]) / size[rows] >= least
    return may


@F.pandas_udf(DoubleType())
def probable_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching runs of two plain texts, null where it is less than probable; most are told by a bound that is never less than the ratio."""
    may = _may_reach(a.tolist(), b.tolist(), PROBABLE) if len(a) else []
    found = [SequenceMatcher(None, x, y).ratio() if m else 0.0 for x, y, m in zip(a, b, may)]
    return pd.Series([r if r >= PROBABLE else None for r in found], dtype="float64")


#: A work as an open catalogue answers it: one record of another shape.
WORK = StructType([
    StructField("display_name", StringType()), StructField("authorships", ArrayType(StructType([StructField("author", StructType([StructField("display_name", StringType())]))]))), StructField("publication_year", IntegerType()),
    StructField("primary_location", StructType([StructField("source", StructType([StructField("display_name", StringType()), StructField("host_organization_name", StringType())]))])), StructField("doi", StringType()), StructField("type", StringType()),
])
CANDIDATE = ("title", "subtitle", "authors", "year", "venue", "publisher", "container_titles", "doi", "work_type")


def _items(df: DataFrame, json: str) -> DataFrame:
    p = F.from_json(F.col(json), ITEM)
    name = lambda a: F.coalesce(a["name"], F.trim(F.concat_ws(" ", a["given"], a["family"])))
    year = F.coalesce(*[F.get(F.get(F.col(f"p.`{d}`.`date-parts`"), 0), 0) for d in DATES])
    return df.withColumn("p", p).select(
        *df.columns, F.get("p.title", 0).alias("title"), F.get("p.subtitle", 0).alias("subtitle"), F.transform("p.author", name).alias("authors"), year.alias("year"), F.get("p.container-title", 0).alias("venue"),
        F.col("p.publisher").alias("publisher"), F.col("p.container-title").alias("container_titles"), F.lower("p.DOI").alias("doi"), F.col("p.type").alias("work_type"),
    )


def _works(df: DataFrame, json: str) -> DataFrame:
    p = F.from_json(F.col(json), WORK)
    venue = F.col("p.primary_location.source.display_name")
    return df.withColumn("p", p).select(
        *df.columns, F.col("p.display_name").alias("title"), F.lit(None).cast("string").alias("subtitle"), F.transform("p.authorships", lambda a: a["author"]["display_name"]).alias("authors"), F.col("p.publication_year").alias("year"), venue.alias("venue"),
        F.col("p.primary_location.source.host_organization_name").alias("publisher"), F.when(venue.isNotNull(), F.array(venue)).alias("container_titles"), F.regexp_replace(F.lower("p.doi"), r"^https?://(?:dx\.)?doi\.org/", "").alias("doi"), F.col("p.type").alias("work_type"),
    )


def parsed_records(df: DataFrame, json: str, catalogue: bool = False) -> tuple[DataFrame, DataFrame]:
    """(candidates, rejected) of df with a column of JSON: the columns of df beside a candidate's, and those of df beside `fault`.

    A year is that of print, else online, else of any publication, else of issue. Faults:
    not json, no title. catalogue is True for works of the other shape.
    """
    kept = df.select(*[c for c in df.columns if c not in (*CANDIDATE, "fault")])
    rows = (_works if catalogue else _items)(kept, json)
    fault = F.when(F.json_object_keys(F.col(json)).isNull(), "not json").when(F.trim(F.coalesce("title", F.lit(""))) == "", "no title")
    judged = rows.withColumn("fault", fault)
    return judged.filter("fault is null").drop(json, "fault"), judged.filter("fault is not null").select(*kept.columns, "fault")


def parsed_items(df: DataFrame, json: str) -> DataFrame:
    """Candidates of df(json) alone; what parsed_records rejects is left out."""
    return parsed_records(df.select(json), json)[0].select(*CANDIDATE)


def retrieval_identities(refs: DataFrame, corroboration: DataFrame) -> DataFrame:
    """(reference_id, identity) of df(reference_id, doi) by df(doi_key, status): 'corroborated' where both databases have its DOI and agree, 'conflict', 'single_source', 'unknown_doi', or 'no_doi'."""
    rows = refs.select("reference_id", doi_key(F.col("doi")).alias("doi_key")).join(corroboration, "doi_key", "left")
    return rows.select("reference_id", F.when(F.col("doi_key").isNull(), "no_doi").when(F.col("status").isNull(), "unknown_doi").otherwise(F.col("status")).alias("identity"))


def safe_title(title: Column, most_bytes: int = 2048) -> Column:
    """True for a title that may go into a search address as it is: ASCII letters, digits and spaces, no stand-alone AND, OR or NOT, and short enough."""
    words = F.split(F.upper(title), r"\s+")
    return F.coalesce(title.rlike(r"^[A-Za-z0-9 ]+$") & ~F.exists(words, lambda w: w.isin("AND", "OR", "NOT")) & (F.octet_length(title) <= most_bytes), F.lit(False))


def author_matches(author: Column, authors: Column) -> Column:
    """True if one of the authors is the supplied one: either name holds the other, or the surname is one of the supplied words. Null authors match none."""
    wanted = plain_text(author)
    words = F.split(wanted, " ")

    def one(name: Column) -> Column:
        plain = plain_text(name)
        surname = F.element_at(F.split(plain, " "), -1)
        return F.coalesce((plain != "") & (wanted != "") & (wanted.contains(plain) | plain.contains(wanted) | ((F.length(surname) > 1) & F.array_contains(words, surname))), F.lit(False))

    return F.coalesce(F.exists(authors, one), F.lit(False))


def venue_words_match(supplied: Column, venue: Column) -> Column:
    """True if all words of three letters or more of the supplied venue are words of the other; null venues match none."""
    words = F.filter(F.split(plain_text(supplied), " "), lambda w: F.length(w) >= 3)
    return F.coalesce((F.size(words) > 0) & (F.size(F.array_except(words, F.split(plain_text(venue), " "))) == 0), F.lit(False))


def publisher_matches(a: Column, b: Column, likeness=None) -> Column:
    """True if two publishers' names are alike (`likeness` of two columns; equal plain forms where it is None), or what names one is part of what names the other.

    Generic words are left aside, but a university's press is only one with another
    university's. Null and blank names match none.
    """
    words = lambda c: F.split(plain_text(c), " ")
    core = lambda c: F.filter(words(c), lambda w: ~w.isin(*PUBLISHER_GENERIC) & (w != ""))
    alike = likeness(a, b) >= SAME if likeness else plain_text(a) == plain_text(b)
    x, y = core(a), core(b)
    university = F.array_contains(words(a), "university") == F.array_contains(words(b), "university")
    part = (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))
    named = (plain_text(a) != "") & (plain_text(b) != "")
    return F.coalesce(named & (F.coalesce(alike, F.lit(False)) | university & part), F.lit(False))


def author_set(authors: Column) -> Column:
    """Sorted different authors in plain form."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(authors, lambda a: plain_text(a)), lambda a: a != "")))


def union_once(df: DataFrame, id_column: str) -> DataFrame:
    """Rows of df with each DOI once, the lowest id kept; rows without a DOI are all kept."""
    keyed = df.withColumn("doi_key", doi_key(F.col("doi")))
    first = keyed.filter("doi_key is not null").groupBy("doi_key").agg(F.min(id_column).alias(id_column)).select(id_column)
    return keyed.filter("doi_key is null").unionByName(keyed.filter("doi_key is not null").join(first, id_column, "left_semi"))


def best_record(df: DataFrame, id_column: str) -> DataFrame:
    """(doi_key, id): of each DOI the record with the best title likeness, then kind of publication, then the lowest id. One partial aggregate, no window."""
    kind = F.create_map(*[x for k, v in TYPE_RANK.items() for x in (F.lit(k), F.lit(v))])
    rank = F.struct(F.coalesce("title_similarity", F.lit(0.0)).alias("a"), F.coalesce(kind[F.col("work_type")], F.lit(0)).alias("b"), (-F.col(id_column)).alias("c"))
    return df.withColumn("doi_key", doi_key(F.col("doi"))).filter("doi_key is not null").groupBy("doi_key").agg((-F.max(rank)["c"]).alias(id_column))


def corroborated(records: DataFrame, id_column: str, likeness=None) -> DataFrame:
    """(doi_key, status): what two databases say of each DOI: single_source, corroborated or conflict.

    Of each database the record of the lowest id speaks. Titles and venues are compared by
    `likeness` (a function of two columns; equal plain forms where it is None), authors as
    sets, years within one; an unknown author or venue speaks neither way.
    """
    keyed = records.withColumn("doi_key", doi_key(F.col("doi"))).filter("doi_key is not null")
    first = keyed.groupBy("doi_key", "source").agg(F.min(id_column).alias(id_column))
    own = keyed.join(first.select(id_column), id_column, "left_semi")
    sides = [own.filter(F.col("source") == s).select("doi_key", *[F.col(c).alias(f"{s}_{c}") for c in ("title", "authors", "year", "venue")]) for s in ("crossref", "openalex")]
    both = sides[0].join(sides[1], "doi_key", "full_outer")
    same = (lambda a, b: F.coalesce(likeness(a, b) >= SAME, F.lit(False))) if likeness else (lambda a, b: F.coalesce(plain_text(a) == plain_text(b), F.lit(False)))
    c = lambda n: (F.col(f"crossref_{n}"), F.col(f"openalex_{n}"))
    x, y = (author_set(a) for a in c("authors"))
    authors = F.coalesce(F.size(x) == 0, F.lit(True)) | F.coalesce(F.size(y) == 0, F.lit(True)) | F.coalesce(x == y, F.lit(False))
    blank = lambda v: F.trim(F.coalesce(v, F.lit(""))) == ""
    venue = blank(c("venue")[0]) | blank(c("venue")[1]) | same(*c("venue"))
    year = F.coalesce(F.abs(c("year")[0] - c("year")[1]) <= YEARS, F.lit(True))
    agree = same(*c("title")) & authors & venue & year
    return both.select("doi_key", F.when(c("title")[0].isNull() | c("title")[1].isNull(), "single_source").when(agree, "corroborated").otherwise("conflict").alias("status"))


def _held_names(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer) of plain names of which the second holds the first: found by the rarest of its runs of letters, so that no common given name is a key."""
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - RUN + 1), lambda i: F.substring(c, i, RUN)))
    held = outer.filter(F.length("outer") >= RUN).select("outer", F.explode(runs(F.col("outer"))).alias("run"))
    own = inner.filter(F.length("inner") >= RUN).select("inner", F.explode(runs(F.col("inner"))).alias("run"))
    rarest = own.join(held.groupBy("run").count(), "run").groupBy("inner").agg(F.min_by("run", F.struct("count", "run")).alias("run"))
    short = inner.filter(F.length("inner") < RUN)  # few, whatever the data
    return rarest.join(held, "run").filter(F.col("outer").contains(F.col("inner"))).select("inner", "outer").unionByName(short.join(outer, F.col("outer").contains(F.col("inner"))))


def _names_held(supplied: DataFrame, names: DataFrame) -> DataFrame:
    """(author_key, name) of the plain names that author_matches takes for one though the surname is none of the supplied words, from supplied(author_key) and names(name)."""
    a, n = supplied.filter("author_key != ''").distinct(), names.filter("name != ''").distinct()
    in_supplied = _held_names(n.select(F.col("name").alias("inner")), a.select(F.col("author_key").alias("outer"))).select(F.col("outer").alias("author_key"), F.col("inner").alias("name"))
    in_name = _held_names(a.select(F.col("author_key").alias("inner")), n.select(F.col("name").alias("outer"))).select(F.col("inner").alias("author_key"), F.col("outer").alias("name"))
    surname = F.element_at(F.split("name", " "), -1)
    return in_supplied.unionByName(in_name).filter((F.length(surname) < 2) | ~F.array_contains(F.split("author_key", " "), surname)).distinct()


def _places() -> list[tuple[int, int, int]]:
    """(long, first bit, bits) of each letter of _CODES' order; no letter's bits are divided."""
    out, at, first = [], 0, 0
    for most in LETTERS.values():
        at, first = (at, first) if first + most <= 64 else (at + 1, 0)
        out.append((at, first, most))
        first += most
    return out


LONGS = 1 + _places()[-1][0]


@F.pandas_udf(StructType([*[StructField(f"b{i}", LongType()) for i in range(LONGS)], StructField("left", IntegerType())]))
def letter_bits(titles: pd.Series) -> pd.DataFrame:
    """Bits of a plain title, and how many of its letters found none: a letter that stands in it n times has the first n of its bits, which are so many that most find one."""
    size = titles.str.len().to_numpy()
    codes = _CODES[np.frombuffer("".join(titles).encode(), dtype=np.uint8)]
    counts = np.bincount(np.repeat(np.arange(len(size)), size) * 38 + codes, minlength=38 * len(size)).reshape(-1, 38)[:, 1:]
    longs, left = np.zeros((LONGS, len(size)), dtype=np.uint64), size.astype(np.int32)
    for letter, (at, first, most) in enumerate(_places()):
        found = np.minimum(counts[:, letter], most)
        longs[at] |= ((np.uint64(1) << found.astype(np.uint64)) - np.uint64(1)) << np.uint64(first)
        left -= found.astype(np.int32)
    return pd.DataFrame({**{f"b{i}": x.view(np.int64) for i, x in enumerate(longs)}, "left": left})


def near_titles(refs: DataFrame, records: DataFrame) -> DataFrame:
    """(reference_id, candidate_id, likeness) of all pairs whose titles are probable at least and whose author and year agree as far as they are known.

    refs has reference_id, title_key, author and year, records candidate_id, title_key, c_authors
    and c_year. Keys are a surname with the year, or a whole name with it where one name holds
    the other in another way; of references without an author, the year with a range of
    lengths. So a row is written under its own words and years only, however many names share
    them. A title needs no key, so no wording is missed; pairs of too few common letters are
    left out before Python. A blank title is near none.
    """
    year, c_year = F.col("year").cast("int"), F.col("c_year").cast("int")
    # an unknown year of a record is -1, and a reference that has none meets every record under -2
    years = F.when(year.isNull(), F.array(F.lit(-2))).otherwise(F.array(*[year + i for i in range(-YEARS, YEARS + 1)], F.lit(-1)))
    names = [*[f"b{i}" for i in range(LONGS)], "left"]
    coded = lambda side: [F.col(f"bits.{b}").alias(f"{side}{b}") for b in names]
    r = refs.filter("title_key != ''").withColumn("bits", letter_bits("title_key")).select("reference_id", "title_key", plain_text(F.col("author")).alias("author_key"), *coded("r"), years.alias("years"))
    plain_names = F.array_distinct(F.transform("c_authors", lambda x: plain_text(x)))
    c = records.filter("title_key != ''").withColumn("bits", letter_bits("title_key")).select("candidate_id", F.col("title_key").alias("c_key"), plain_names.alias("names"), *coded("c"), F.array(F.coalesce(c_year, F.lit(-1)), F.lit(-2)).alias("years"))
    n = max(int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * refs.sparkSession.sparkContext.defaultParallelism)
    own, theirs = [f"r{x}" for x in names], [f"c{x}" for x in names]

    held = _names_held(r.select("author_key").filter("author_key is not null"), c.select(F.explode("names").alias("name")))
    key = lambda kind, name: F.concat(F.lit(kind), name)
    words = F.filter(F.array_distinct(F.split("author_key", " ")), lambda w: F.length(w) > 1)
    last = F.filter(F.array_distinct(F.transform("names", lambda x: F.element_at(F.split(x, " "), -1))), lambda w: F.length(w) > 1)
    log = lambda x: F.floor(F.log(x) / F.log(F.lit(LENGTHS))).cast("int")
    least, most = 2 / PROBABLE - 1, 1 / (2 / PROBABLE - 1)
    ranges = F.sequence(log(F.length("title_key") * least * 0.999), log(F.length("title_key") * most * 1.001))
    keyed = r.withColumn("k", F.explode(F.when(F.col("author_key").isNull(), F.transform(ranges, lambda x: key("", x.cast("string")))).otherwise(F.transform(words, lambda w: key("s", w)))))
    by_name = r.join(held, "author_key").withColumn("k", key("n", F.col("name")))
    left = keyed.unionByName(by_name.drop("name")).select("reference_id", "title_key", *own, "k", F.explode("years").alias("y")).repartition(n, "k", "y")
    keys = F.concat(F.coalesce(F.transform(last, lambda w: key("s", w)), F.array().cast("array<string>")), F.array(key("", log(F.length("c_key")).cast("string"))))
    by_held = c.withColumn("name", F.explode("names")).join(held.select("name").distinct(), "name", "left_semi").withColumn("k", key("n", F.col("name"))).drop("name")
    right = c.withColumn("k", F.explode(keys)).unionByName(by_held.select(*c.columns, "k")).select("candidate_id", "c_key", *theirs, "k", F.explode("years").alias("y")).repartition(n, "k", "y")

    x, y = F.length("title_key"), F.length("c_key")
    common = sum((F.bit_count(F.col(f"r{b}").bitwiseAND(F.col(f"c{b}"))) for b in names[:-1]), F.least(f"r{names[-1]}", f"c{names[-1]}"))
    met = left.join(right, ["k", "y"]).filter((2.0 * F.least(x, y) >= PROBABLE * (x + y) - 1e-6) & (2.0 * common >= PROBABLE * (x + y) - 1e-6))
    return met.select("reference_id", "candidate_id", probable_ratio("title_key", "c_key").alias("likeness")).filter("likeness is not null").distinct()


def verified_references(refs: DataFrame, records: DataFrame) -> DataFrame:
    """(reference_id, status, candidate_id): verified, probable, metadata_conflict or not_verified.

    By DOI where the reference has one that a record has: titles less than probable, or an
    author, venue or year that disagrees, are a conflict. Else by title: the same plain title
    first, and for what that leaves unverified every record whose title is probable at least;
    author, year and venue must agree as far as they are known. Best match first.

    References that say the same are judged once, in the name of the lowest id; of records
    that say the same the lowest id speaks, which is the one that would be named. Each id
    comes once.
    """
    said = refs.select("reference_id", doi_key(F.col("doi")).alias("doi_key"), plain_text(F.col("title")).alias("title_key"), "author", "year", "venue")
    alike = Window.partitionBy("doi_key", "title_key", "author", "year", "venue")
    each = written(said.withColumn("first_id", F.when(F.col("reference_id").isNotNull(), F.min("reference_id").over(alike))))
    r = each.filter("reference_id = first_id").drop("first_id")
    fields = [doi_key(F.col("doi")).alias("doi_key"), plain_text(F.col("title")).alias("title_key"), F.col("authors").alias("c_authors"), F.col("year").alias("c_year"), F.col("venue").alias("c_venue")]
    c = written(records.select("candidate_id", *fields).groupBy("doi_key", "title_key", "c_authors", "c_year", "c_venue").agg(F.min("candidate_id").alias("candidate_id")))
    by_doi = r.filter("doi_key is not null").join(c.withColumnRenamed("title_key", "c_key"), "doi_key").withColumn("path", F.lit("doi")).withColumn("likeness", ratio("title_key", "c_key"))
    rest = r.join(by_doi.select("reference_id").distinct(), "reference_id", "left_anti")
    by_title = rest.join(c.drop("doi_key"), "title_key").withColumn("path", F.lit("title")).withColumn("likeness", F.lit(1.0))
    columns = ["reference_id", "path", "likeness", "candidate_id", "author", "year", "venue", "c_authors", "c_year", "c_venue"]
    first = checkpoint(_judged(by_doi.select(*columns).unionByName(by_title.select(*columns))))
    # no title is more alike than the same one, so what it verifies is settled
    open_ = rest.join(first.filter("status = 'verified'").select("reference_id").distinct(), "reference_id", "left_anti")
    near = near_titles(open_, c.drop("doi_key")).join(r, "reference_id").join(c.drop("doi_key", "title_key"), "candidate_id").withColumn("path", F.lit("title"))
    judged = first.unionByName(_judged(near.select(*columns))).filter("status != 'not_verified'")
    order = F.when(F.col("status") == "verified", 3).when(F.col("status") == "probable", 2).otherwise(1)
    best = judged.withColumn("k", F.struct(order.alias("a"), F.col("likeness").alias("b"), (-F.col("candidate_id")).alias("c"))).groupBy("reference_id").agg(F.max_by("status", "k").alias("status"), F.max_by("candidate_id", "k").alias("candidate_id"))
    return each.select("reference_id", "first_id").join(best.withColumnRenamed("reference_id", "first_id"), "first_id", "left").select("reference_id", F.coalesce("status", F.lit("not_verified")).alias("status"), "candidate_id")


def _judged(rows: DataFrame) -> DataFrame:
    """(reference_id, candidate_id, likeness, status) of references beside records."""
    author = F.col("author").isNull() | author_matches(F.col("author"), F.col("c_authors"))
    venue = F.col("venue").isNull() | F.col("c_venue").isNull() | (F.col("venue_likeness") >= SAME) | venue_words_match(F.col("venue"), F.col("c_venue"))
    year = F.coalesce(F.abs(F.col("year") - F.col("c_year")) <= YEARS, F.lit(True))
    agree = author & venue & year
    status = (
        F.when(F.col("path") == "doi", F.when(F.col("likeness") < PROBABLE, "metadata_conflict").when(~agree, "metadata_conflict").when(F.col("likeness") < SAME, "probable").otherwise("verified"))
        .when((F.col("likeness") >= SAME) & agree, "verified").when((F.col("likeness") >= PROBABLE) & agree, "probable").otherwise("not_verified")
    )
    return rows.withColumn("venue_likeness", title_likeness(F.col("venue"), F.col("c_venue"))).select("reference_id", "candidate_id", "likeness", status.alias("status"))
