"""A trie join: all pairs of strings within one edit, found by Levenshtein automata on sharded tries.

One edit (a letter put in, left out or replaced, or two neighbours exchanged) leaves the
first or the second half of a string as it is. So the tries are sharded by the half that
is left: each string is filed under its two halves, and looks for partners under the
halves that a partner of its length, or one letter more or less, would have. A shard is
the trie of the other halves; an automaton that accepts one edit walks it. A shard is read
as a sorted stream, so no group is held as a whole but its trie.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "\0"


def insert(trie: dict, word: str) -> None:
    for c in word:
        trie = trie.setdefault(c, {})
    trie[END] = word


def within(trie: dict, word: str, edits: int = 1) -> set[str]:
    """Words of the trie that at most so many edits (1 or 0) turn into word. The automaton's states are (place in word, edits left)."""
    found: set[str] = set()
    todo: list[tuple[dict, int, int]] = [(trie, 0, edits)]
    n = len(word)
    while todo:
        node, i, left = todo.pop()
        while True:  # along the exact path, with a branch for each edit
            if END in node and n - i <= left:
                found.add(node[END])
            if left:
                for c, child in node.items():
                    if c == END:
                        continue
                    todo.append((child, i, 0))  # a letter put in
                    if i < n and c != word[i]:
                        todo.append((child, i + 1, 0))  # a letter replaced
                        if i + 1 < n and c == word[i + 1] and word[i] in child:
                            todo.append((child[word[i]], i + 2, 0))  # two exchanged
                if i < n:
                    todo.append((node, i + 1, 0))  # a letter left out
            if i < n and word[i] in node:
                node, i = node[word[i]], i + 1
            else:
                break
    return found


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (shard, role): first the strings filed there (0), then those that look for partners one edit away (1) or at none, an exchange being made already (2)."""
    shard, trie, whole = None, {}, {}
    for rows in batches:
        left, right = [], []
        for key, role, rest, word in zip(rows["shard"], rows["role"], rows["rest"], rows["word"]):
            if key != shard:
                shard, trie, whole = key, {}, {}
            if role == 0:
                insert(trie, rest)
                whole.setdefault(rest, []).append(word)
            elif whole:
                for near in within(trie, rest, 2 - role):
                    for other in whole[near]:
                        if other != word:
                            left.append(min(other, word))
                            right.append(max(other, word))
        yield pd.DataFrame({"left_word": left, "right_word": right}, dtype=str)


def trie_join(words: DataFrame, column: str = "word", least_length: int = 6) -> DataFrame:
    """(left_word, right_word), left < right: the different strings of df[column] that are one edit apart, each pair once.

    Strings of fewer than least_length code points take no part: one edit makes them other
    words. Nulls take no part; repeated strings count once; an empty df gives no pair.
    """
    w = F.col("word")
    n = F.length(w)
    own = words.select(F.col(column).alias("word")).filter(F.col("word").isNotNull() & (F.length("word") >= least_length)).distinct()
    half = F.floor(n / 2).cast("int")

    def entry(role: int, length, first: bool, kept, rest):
        return F.struct(F.concat_ws("\1", F.lit("a" if first else "z"), length.cast("string"), kept).alias("shard"), F.lit(role).alias("role"), rest.alias("rest"), w.alias("word"))

    entries = [entry(0, n, True, F.left(w, half), F.substr(w, half + 1, n)), entry(0, n, False, F.substr(w, half + 1, n), F.left(w, half))]
    for more in (-1, 0, 1):
        length = n + more
        h = F.floor(length / 2).cast("int")
        entries.append(entry(1, length, True, F.left(w, h), F.substr(w, h + 1, n)))
        tail = length - h
        entries.append(entry(1, length, False, F.right(w, tail), F.left(w, n - tail)))
    # two letters exchanged across the middle change both halves
    swapped = F.concat(F.left(w, half - 1), F.substr(w, half + 1, F.lit(1)), F.substr(w, half, F.lit(1)), F.substr(w, half + 2, n))
    entries.append(entry(2, n, True, F.left(swapped, half), F.substr(swapped, half + 1, n)))
    filed = own.select(F.inline(F.array(*entries)))
    found = filed.repartition("shard").sortWithinPartitions("shard", "role").mapInPandas(_walk, "left_word string, right_word string")
    return found.distinct()
