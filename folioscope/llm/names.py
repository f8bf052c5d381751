"""Variant spellings of names typed by people: link those of one person or group.

Method: trie join (see tries.py) on the names' tokens in order-free form, then a check of
token-order permutations; on top of it the other ways in which one name is written
(nicknames, initials, acronyms of groups) by equal keys. Persons are told apart by
surname and given name in any of its forms.

The work is on distinct spellings only, so that copies of a name cost nothing.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from folioscope.llm.components import connected_components
from folioscope.llm.tries import trie_join
from folioscope.sources.tables import checkpoint

# English and Russian short forms that are no beginning or end of their name; the others are found by rule.
NICKNAMES = {
    "alexander": "alec sandy sasha", "alexandra": "sandy sasha", "andrew": "drew", "anthony": "tony", "antonia": "toni", "caroline": "carrie", "charlotte": "charlie lottie", "catherine": "kate kathy katie kitty cathy", "charles": "chuck charlie", "christopher": "kit topher", "dmitri": "dima mitya", "dorothy": "dot dottie dolly", "dorothea": "dot dottie thea", "edward": "ed eddie ned ted teddy", "eleanor": "ellie nell nora", "elizabeth": "beth bess betsy betty eliza libby lizzie liz",
    "frances": "fanny frankie", "frederick": "freddie fritz", "gabriela": "gabby", "helen": "nell nellie", "grigori": "grisha", "helena": "nell", "henry": "hal hank harry", "isabella": "bella izzy", "ivan": "vanya", "james": "jamie jem jim jimmy", "jennifer": "jenny jen", "john": "jack johnny", "leonard": "len lenny", "josephine": "josie jo", "katherine": "kate kathy katie kitty kay",
    "lawrence": "larry", "margaret": "greta madge maggie marge meg peggy", "maria": "masha mitzi", "martha": "patty", "mary": "molly polly", "matthew": "matty", "michael": "mick mickey mike", "mikhail": "misha", "nicholas": "nicky", "nikolai": "kolya", "patricia": "patty tricia trish", "patrick": "paddy", "rebecca": "becky", "richard": "dick rick ricky", "robert": "bob bobby rob bert", "sarah": "sadie sally",
    "stephen": "steve", "susan": "sue susie suzy", "susanna": "sue susie suzy", "theodore": "ted teddy", "thomas": "tommy", "veronica": "ronnie", "victoria": "vicky", "wilhelmina": "billie minnie wilma", "william": "bill billy liam willie",
}
#: Endings that short forms take on.
SHORT_ENDINGS = ("y", "ie", "i", "a", "o", "ey")
TITLES = frozenset("dr prof professor mr mrs ms miss mx sir dame rev".split())
SUFFIXES = frozenset("phd md msc bsc ba ma mph dphil frs jr sr ii iii iv esq rn".split())
GROUP_WORDS = ("consort", "collab", "group", "grp", "network", "netw", "study", "studies", "trial", "initiative", "committee", "investigator", "team", "society", "alliance", "cohort", "working", "registry", "task", "panel", "project", "institute", "research", "measur")
SMALL_WORDS = frozenset("on for in of the and at by to de la et und for".split())
#: Letters of a full name and of a surname from which one edit is a slip without more evidence.
SURE_NAME, SURE_SURNAME = 9, 6
_FOLDS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i"})
_PARSED = StructType([StructField("kind", StringType()), StructField("tokens", ArrayType(StringType())), StructField("initials", StringType()), StructField("settled", BooleanType())])


def folded(text: str) -> str:
    """Lower case without diacritics, and f for ph, as one sound."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold().translate(_FOLDS)) if not unicodedata.combining(c)).replace("ph", "f")


def parse_name(name: str) -> tuple[str, list[str], str, bool]:
    """(kind, tokens, initials, settled) of one spelling.

    Of a person the tokens are the given names and then the surname, as far as the
    spelling tells; settled is false where it doesn't (no comma and no initials). Of a
    group they are its place or name, and its kind: the first of the four-letter stems of
    its other words. A spelling without letters has no tokens.
    """
    raw = re.findall(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*\.?|,", unicodedata.normalize("NFC", name))
    words = [w for w in raw if w == "," or w.lower().replace(".", "") not in TITLES | SUFFIXES]
    if len(raw) == 2 and "," not in raw and len(words) == 1 and raw[1].isupper() and len(raw[1]) <= 3:
        words = raw  # initials that look like a degree
    while words and words[-1] == ",":
        words.pop()
    plain = [folded(w).rstrip(".") for w in words if w != ","]
    if not plain:
        return "none", [], "", True
    if any(p.startswith(GROUP_WORDS) for p in plain) and len([p for p in plain if p not in SMALL_WORDS]) > 1:
        own = [p for p in plain if p not in SMALL_WORDS]
        head = next((p for p in own if not p.startswith(GROUP_WORDS)), own[0])
        stems = sorted({"grou" if p == "grp" else p[:4] for p in own if p != head}) or [""]
        return "group", [head, stems[0]], "".join(sorted(p[0] for p in own if p != head)), True
    shouting = all(w == "," or w == w.upper() for w in words)

    def is_initials(w: str) -> bool:
        bare = w.rstrip(".")
        return len(bare) == 1 or (2 <= len(bare) <= 3 and bare == bare.upper() and not shouting and bare.isalpha() and len(words) > 1)

    comma = words.index(",") if "," in words else None
    if comma:
        before, after = words[:comma], [w for w in words[comma + 1 :] if w != ","]
        words = after + ["-".join(w.rstrip(".") for w in before if not is_initials(w)) or before[0]]
        long = [w for w in words[:-1] if not is_initials(w)]
        initials = "".join(folded(w).rstrip(".") if is_initials(w) else folded(w)[0] for w in words[:-1])
        return "person", [*(folded(w).rstrip(".") for w in long), folded(words[-1])], initials, True
    long = [w for w in words if not is_initials(w) or re.fullmatch(r"[A-Z][a-z]o?[A-Z]", w)]
    acronym = [w for w in words if re.fullmatch(r"[A-Z][a-z]{1,2}[A-Z]", w)]
    if acronym and len(words) == 2:
        return "person", [folded(next(w for w in words if w not in acronym)).rstrip(".")], folded("".join(c for c in acronym[0] if c.isupper())), True
    if len(long) <= 1:
        surname = long or words[-1:]
        initials = "".join(folded(w).rstrip(".") for w in words if w not in surname)
        return "person", [folded(w).rstrip(".") for w in surname], initials, True
    initials = "".join(folded(w).rstrip(".") if is_initials(w) else folded(w)[0] for w in words)
    return "person", [folded(w).rstrip(".") for w in long], initials, False


@F.pandas_udf(_PARSED)
def _parse(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_name(n) for n in names], columns=["kind", "tokens", "initials", "settled"])


def parsed_names(spellings: DataFrame) -> DataFrame:
    """(name, n, kind, surname, given, initials) of df(name, n); given is '' where only initials are written.

    Which end of an unsettled name is the surname is told by the tokens' company: a given
    name stands first with many partners, a surname does not.
    """
    # written once: the branches below would each parse all names again
    # and not deterministic in name, or the filter on its result would move it before the counting of spellings
    rows = checkpoint(spellings.withColumn("p", _parse.asNondeterministic()("name")).select("name", "n", "p.*").filter(F.size("tokens") > 0))
    first, last = F.element_at("tokens", 1), F.element_at("tokens", -1)
    two = rows.filter((F.col("kind") == "person") & (F.size("tokens") > 1))
    ends = two.select(F.inline(F.array(F.struct(first.alias("token"), F.lit(1).alias("leads"), last.alias("partner")), F.struct(last.alias("token"), F.lit(0).alias("leads"), first.alias("partner"))))).distinct()
    given = ends.groupBy("token").agg(F.sum("leads").alias("as_first"), F.sum(1 - F.col("leads")).alias("as_last")).filter((F.col("as_first") >= 3) & (F.col("as_first") > 2 * F.col("as_last"))).select("token")
    open_ = rows.filter(~F.col("settled"))
    turned = (
        open_.withColumn("token", last).join(given, "token", "left_semi").drop("token").withColumn("token", first).join(given, "token", "left_anti").select("name", F.lit(True).alias("turned"))
    )
    both = rows.join(turned, "name", "left").withColumn("turned", F.coalesce("turned", F.lit(False)))
    # two surnames written apart, known elsewhere with a hyphen
    double = F.concat_ws("-", F.element_at("tokens", 2), last)
    hyphened = rows.filter(last.contains("-")).select(last.alias("token")).unionByName(rows.filter(first.contains("-")).select(first.alias("token"))).distinct()
    apart = open_.filter(F.size("tokens") == 3).withColumn("token", double).join(hyphened, "token", "left_semi").select("name", F.lit(True).alias("apart"))
    both = both.join(apart, "name", "left").withColumn("tokens", F.when(F.col("apart"), F.array(first, double)).otherwise(F.col("tokens")))
    surname = F.when(F.col("kind") == "group", first).when(F.col("turned"), first).otherwise(last)
    name_given = F.when(F.col("kind") == "group", F.concat(F.lit("#"), last)).when(F.size("tokens") < 2, F.lit("")).when(F.col("turned"), F.element_at("tokens", 2)).otherwise(first)
    # of a turned name the first letter in order belongs to the surname
    letters = F.when(F.col("turned"), F.expr("substring(initials, 2)")).when(~F.col("settled"), F.expr("left(initials, length(initials) - if(apart, 2, 1))")).otherwise(F.col("initials"))
    return both.select("name", "n", "kind", surname.alias("surname"), name_given.alias("given"), letters.alias("initials"))


def _one_target(edges: DataFrame) -> DataFrame:
    """(source, target) of those sources that have one target only."""
    return edges.distinct().groupBy("source").agg(F.min("target").alias("target"), F.count("*").alias("k")).filter("k = 1").select("source", "target")


def _with_ph(df: DataFrame, word: str) -> DataFrame:
    """(word, plain): each folded word as it is, and with each of its f's written ph, so that a slip of one letter in ph is one edit."""
    f = F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(F.col(word), i, F.lit(1)) == "f")
    written = F.transform(f, lambda i: F.concat(F.substring(F.col(word), F.lit(1), i - 1), F.lit("ph"), F.substring(F.col(word), i + 1, F.length(word))))
    return df.filter(F.length(word) > 0).select(F.explode(F.concat(F.array(F.col(word)), written)).alias(word), F.col(word).alias("plain"))



def _likely_slips(near: DataFrame, keys: DataFrame) -> DataFrame:
    """Of df(src, dst) of keys one edit apart those that a slip explains: long ones, and short ones where the part that differs is of no other name.

    One letter makes another name of a short one; but a part that stands beside one partner
    only, while the other one's stands beside several, isn't a name in use.
    """
    parts = keys.select("key", F.explode(F.split("key", " ")).alias("part")).distinct()
    partners = parts.groupBy("part").agg(F.count("*").alias("k"))
    counts = parts.join(partners, "part").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("part", "k"))).alias("m"))
    both = near.join(counts.toDF("src", "src_m"), "src").join(counts.toDF("dst", "dst_m"), "dst")
    own = lambda m, x, y: F.array_max(F.transform(F.array_except(F.split(x, " "), F.split(y, " ")), lambda p: F.element_at(m, p)))
    src, dst = own(F.col("src_m"), "src", "dst"), own(F.col("dst_m"), "dst", "src")
    sure = F.least(F.length("src"), F.length("dst")) >= SURE_NAME
    return both.filter(sure | (F.least(src, dst) == 1) & (F.greatest(src, dst) > 1)).select("src", "dst")


def link_names(spellings: DataFrame) -> DataFrame:
    """(name, entity) for each spelling of df(name, n): spellings of one person or group have the same entity.

    Null and blank names and names without letters get no row; a name that nothing links
    is an entity of its own. Repeated rows of a name are added up. An empty df gives no row.
    """
    once = spellings.filter(F.col("name").isNotNull()).groupBy("name").agg(F.sum("n").alias("n"))
    rows = checkpoint(parsed_names(once))
    full = rows.filter("given != ''").withColumn("key", F.concat_ws(" ", F.array_sort(F.array("surname", "given"))))
    keys = full.groupBy("key").agg(F.sum("n").alias("n"), F.min("surname").alias("surname"), F.min("given").alias("given"))
    # 1: one edit apart, whatever the order of the tokens
    bare = rows.filter("given = ''")
    words = keys.select(F.col("key").alias("word")).unionByName(full.select(F.concat_ws(" ", "given", "surname").alias("word"))).unionByName(full.select(F.concat_ws(" ", "surname", "given").alias("word")))
    permuted = lambda c: F.concat_ws(" ", F.array_sort(F.split(c, " ")))
    words = _with_ph(words.distinct(), "word")
    met = trie_join(words.select("word").distinct(), "word", least_length=4)
    left, right = words.toDF("left_word", "l"), words.toDF("right_word", "r")
    near = met.join(left, "left_word").join(right, "right_word").select(permuted(F.col("l")).alias("src"), permuted(F.col("r")).alias("dst")).filter("src != dst").distinct()
    near = _likely_slips(near, keys)
    entity = connected_components(keys.select(F.col("key").alias("node")), near, known_nodes=True).withColumnRenamed("node", "key")
    named = checkpoint(full.select("key", "surname", "given", "kind", "initials").distinct().join(entity, "key"))
    # 2: a short form of a given name, under the same surname
    forms = [(folded(short), folded(formal)) for formal, shorts in NICKNAMES.items() for short in shorts.split()]
    table = rows.sparkSession.createDataFrame(forms, "short string, formal string")
    person = named.filter("kind = 'person'").select("surname", "given", "component").distinct()
    by_table = person.join(F.broadcast(table), person.given == table.short).select("surname", F.col("formal").alias("given"), F.col("component").alias("source")).join(person, ["surname", "given"]).select("source", F.col("component").alias("target"))
    size = F.length("given")
    starts = F.transform(F.sequence(F.lit(3), size - 1), lambda i: F.left(F.col("given"), i))
    tails = F.transform(F.sequence(F.lit(3), size - 1), lambda i: F.right(F.col("given"), i))
    ends = person.filter(size >= 5).select("surname", "component", F.explode(F.array_union(starts, tails)).alias("stem"))
    # a short form is a beginning or end of the name, or a beginning, its last letter doubled or not, and an ending: Vincent, Vinnie
    bare_stem = F.array_compact(F.array(*[F.when(F.col("given").endswith(e), F.expr(f"left(given, length(given) - {len(e)})")) for e in SHORT_ENDINGS]))
    single = F.transform(F.filter(bare_stem, lambda s: F.right(s, F.lit(1)) == F.substring(s, -2, 1)), lambda s: F.left(s, F.length(s) - 1))
    stems = F.array_union(F.array("given"), F.filter(F.array_union(bare_stem, single), lambda s: F.length(s) >= 3))
    by_end = person.select("surname", F.col("component").alias("source"), F.explode(stems).alias("stem")).join(ends, ["surname", "stem"]).select("source", F.col("component").alias("target"))
    short_of = _one_target(by_table.unionByName(by_end).filter("source != target"))
    # a chain of short forms ends at the form that is itself short of none
    onward = short_of.select(F.col("source").alias("target"), F.col("target").alias("further"))
    short_of = short_of.join(onward, "target", "left").select("source", F.coalesce("further", "target").alias("target"))
    resolved = checkpoint(named.join(short_of.withColumnRenamed("source", "component"), "component", "left").withColumn("entity", F.coalesce("target", "component")).select("key", "surname", "given", "kind", "initials", "entity"))
    # 3: initials, under the same surname or one that is one edit away
    people = resolved.filter("kind = 'person'")
    letter = people.select("surname", F.left("given", F.lit(1)).alias("letter"), "entity").distinct()
    several = people.filter(F.length("initials") > 1).select("entity", F.col("initials").alias("known")).distinct()
    short = bare.select("surname", "initials").distinct().withColumn("letter", F.left("initials", F.lit(1)))
    groups = resolved.filter("kind = 'group'").select("surname", F.col("initials").alias("acronym"), "entity").distinct()
    acronyms = short.join(groups, (short.surname == groups.surname) & (F.array_join(F.array_sort(F.split(short.initials, "")), "") == groups.acronym)).select(short.surname, short.initials, "entity").distinct()
    exact = short.join(letter, ["surname", "letter"]).withColumn("edits", F.lit(0))
    surnames = _with_ph(short.select("surname").unionByName(letter.select("surname")).distinct(), "surname")
    met = trie_join(surnames.select("surname").distinct(), "surname", least_length=3)
    apart = met.join(surnames.toDF("left_word", "l"), "left_word").join(surnames.toDF("right_word", "r"), "right_word").filter("l != r").select(F.col("l").alias("left_word"), F.col("r").alias("right_word")).distinct()
    either = apart.unionAll(apart.select("right_word", "left_word")).toDF("surname", "near_surname")
    # a short surname that full names have too is no slip of another one
    taken = letter.select("surname", F.lit(True).alias("taken")).distinct()
    either = checkpoint(either.join(taken, "surname", "left").filter((F.length("surname") >= SURE_SURNAME) | F.col("taken").isNull()).drop("taken"))
    typed = short.join(either, "surname").join(letter.withColumnRenamed("surname", "near_surname"), ["near_surname", "letter"]).select("surname", "letter", "initials", "entity", F.lit(1).alias("edits"))
    candidates = exact.select("surname", "letter", "initials", "entity", "edits").unionByName(typed).groupBy("surname", "initials", "entity").agg(F.min("edits").alias("edits"))
    agree = F.col("initials").startswith(F.col("known")) | F.col("known").startswith(F.col("initials"))
    fits = candidates.join(several, "entity", "left").groupBy("surname", "initials", "entity", "edits").agg(F.max(F.coalesce((F.length("initials") > 1) & agree, F.lit(False)).cast("int")).alias("fits"))
    best = Window.partitionBy("surname", "initials").orderBy("edits", F.desc("fits"))
    chosen = fits.withColumn("r", F.rank().over(best)).filter("r = 1").groupBy("surname", "initials").agg(F.min("entity").alias("entity"), F.countDistinct("entity").alias("k")).filter("k = 1").select("surname", "initials", "entity")
    chosen = acronyms.groupBy("surname", "initials").agg(F.min("entity").alias("entity")).unionByName(chosen.join(acronyms, ["surname", "initials"], "left_anti"))
    of_full = full.select("name", "key").join(resolved.select("key", "entity").distinct(), "key").select("name", "entity")
    own = F.concat(F.col("surname"), F.lit(" "), F.left("initials", F.lit(1)), F.lit("."))
    of_bare = bare.join(chosen, ["surname", "initials"], "left").select("name", F.coalesce("entity", own).alias("entity"))
    return of_full.unionByName(of_bare)


def name_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b by code point: every two spellings of one entity."""
    a = linked.select("entity", F.col("name").alias("name_a"))
    b = linked.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")
