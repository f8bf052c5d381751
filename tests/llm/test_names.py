import random

from folioscope.llm.components import connected_components
from folioscope.llm.names import link_names, name_pairs, parse_name
from folioscope.llm.tries import insert, trie_join, within


def one_edit(a, b):
    """Brute force: whether at most one edit turns a into b."""
    if a == b:
        return True
    letters = set(a + b)
    made = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in letters} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in letters} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    return b in made


def test_automaton_against_brute_force():
    r = random.Random(3)
    words = {"".join(r.choice("abc") for _ in range(r.randrange(0, 7))) for _ in range(300)}
    trie = {}
    for w in words:
        insert(trie, w)
    for q in list(words)[:80] + ["abcabc", ""]:
        assert within(trie, q) == {w for w in words if one_edit(q, w)}


def test_join_against_brute_force(spark):
    r = random.Random(4)
    words = list({"".join(r.choice("ab") for _ in range(r.randrange(6, 10))) for _ in range(160)})
    got = {(x.left_word, x.right_word) for x in trie_join(spark.createDataFrame([(w,) for w in [*words, words[0], None, "short"]], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    assert trie_join(spark.createDataFrame([], "word string")).count() == 0


def test_components(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdefgx"], "node string")
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("c", "d"), ("e", "f"), ("g", "g"), ("a", "unknown"), (None, "a")], "src string, dst string")
    got = {r.node: r.component for r in connected_components(nodes, edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e", "g": "g", "x": "x"}
    chain = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60)], "src string, dst string")
    line = connected_components(spark.createDataFrame([(f"{i:03d}",) for i in range(61)], "node string"), chain)
    assert line.select("component").distinct().count() == 1


def test_parse():
    assert parse_name("Dr Robert Munonorinov, PhD")[1] == ["robert", "munonorinov"]
    assert parse_name("MUNONORINOV, Robert")[:3] == ("person", ["robert", "munonorinov"], "r")
    assert parse_name("Munonorinov RV")[:3] == ("person", ["munonorinov"], "rv")
    assert parse_name("The Hale Cohort Study Grp")[:2] == ("group", ["hale", "coho"])
    assert parse_name("Hale Study Group, Cohort")[1] == ["hale", "coho"]
    assert parse_name("  ")[1] == [] and parse_name("12")[1] == []


def test_links(spark):
    a = ["Robert Munonorinov", "Munonorinov, Robert", "MUNONORINOV, Robert", "R. Munonorinov", "Munonorinov R", "Robert Munonorinóv", "Robert Munonoriov", "Rob Munonorinov", "Dr Robert  Munonorinov", "Munonorinov, Robert V."]
    b = ["Helena Munonorinov", "H. Munonorinov"]
    c = ["Dizaberford Cohort Study Group", "The Dizaberford Cohort Study Group", "Dizaberford CSG", "Dizaberford Study Group, Cohort"]
    names = [(n, 3) for n in [*a, *b, *c, a[0], "", "Jane Other"]] + [(None, 1)]
    got = {r.name: r.entity for r in link_names(spark.createDataFrame(names, "name string, n long")).collect()}
    for group in (a, b, c):
        assert len({got[n] for n in group}) == 1, {n: got[n] for n in group}
    assert len({got[a[0]], got[b[0]], got[c[0]], got["Jane Other"]}) == 4 and "" not in got
    pairs = name_pairs(spark.createDataFrame(list(got.items()), "name string, entity string"))
    assert pairs.count() == 10 * 9 // 2 + 1 + 4 * 3 // 2 and pairs.filter("name_a >= name_b").count() == 0
    assert link_names(spark.createDataFrame([], "name string, n long")).count() == 0


def test_a_slip_in_ph_is_one_edit(spark):
    from folioscope.llm.names import link_names

    names = ["Josephine Mivimerees", "Josepsine Mivimerees", "Josefine Mivimerees", "Christopher Laronde", "Christoper Laronde", "Miriam Laronde"]
    got = dict(map(tuple, link_names(spark.createDataFrame([(n, 1) for n in names], "name string, n long")).select("name", "entity").collect()))
    assert len({got[n] for n in names[:3]}) == 1 and got[names[3]] == got[names[4]] != got[names[5]]


def test_short_names(spark):
    names = [("Li Wei", 9), ("Li Chen", 9), ("Li Hua", 9), ("Wu Wei", 5), ("Wu Chen", 3), ("Wu Hua", 4), ("Lee Hua", 7), ("Ana Ruz", 9), ("Eva Ruz", 4), ("Ben Ruz", 4), ("Ana Rwz", 1), ("A. Ruz", 2)]
    got = dict(map(tuple, link_names(spark.createDataFrame(names, "name string, n long")).select("name", "entity").collect()))
    assert got["Ana Ruz"] == got["Ana Rwz"] == got["A. Ruz"] and len({got[n] for n, _ in names[:7]}) == 7 and got["Eva Ruz"] != got["Ana Ruz"]


def test_many_initials(spark):
    names = ["Maria Anna Beatrice Laronde", "Laronde, Maria A. B.", "Laronde MAB", "Laronde MXB", "Maria Xenia Laronde", "Markus Laronde"]
    got = dict(map(tuple, link_names(spark.createDataFrame([(n, 3) for n in names], "name string, n long")).select("name", "entity").collect()))
    assert got["Laronde MAB"] == got["Maria Anna Beatrice Laronde"] and got["Markus Laronde"] not in (got["Laronde MAB"], got["Laronde MXB"])
