"""Passage retrieval: TF-IDF cosine, BM25, claim location, sections, budgets and rank quality.

Postings are a long table (id, term, tf). Searches never make pairs of queries and passages
into rows: blocks of passages meet all queries, and each keeps the best of each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from folioscope.functions.text import claim_terms, numbers, tokens, widened
from folioscope.sources.tables import written

# Headings whose sections describe a note instead of answering a question, and their weight.
META_HEADINGS = ("purpose", "what reviewers should look for", "common reviewer questions", "common misconceptions", "common terminology", "common reviewer red flags", "quick reviewer checklist", "what this guide does")
META_WEIGHT = 0.5
#: Terms that a passage must share with a claim, and the share of the claim's terms.
LEAST_SHARED, LEAST_SHARE, PASSAGES_PER_CLAIM = 2, 0.25, 3
#: Passages of a block that meets the queries as a whole.
BLOCK = 1 << 16


def postings(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, term, tf); a null or empty text has none."""
    return df.select(F.col(id_column).alias("id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def idf_table(posted: DataFrame, n_passages: Column | int) -> DataFrame:
    """(term, df, idf) with the smoothed idf ln((1 + N) / (1 + df)) + 1."""
    n = n_passages if isinstance(n_passages, Column) else F.lit(n_passages)
    return posted.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)


def weights(posted: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, term, w): tf-idf weights of unit length in each passage. Terms without an idf are left out."""
    raw = posted.join(idf.select("term", "idf"), "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, "id").select("id", "term", (F.col("raw") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("w"))


def is_meta(heading: Column, note: Column | None = None) -> Column:
    """True for headings of sections that describe the note, and for the note's own title where the note is given. A null heading is none."""
    plain = F.lower(F.trim(F.coalesce(heading, F.lit(""))))
    hit = F.lit(False) if note is None else F.coalesce(plain == F.lower(F.trim(note)), F.lit(False))
    for h in META_HEADINGS:
        hit = hit | plain.startswith(h)
    return hit


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of df(query_id, id, score) per query; ties by the lower id. Scores are rounded to 4 places after ranking.

    Scores that differ in the tenth place only are a tie: the order in which a sum was made shows there.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).withColumn("score", F.round("score", 4)).select("query_id", "id", "rank", "score")


def _selected(asked: pa.Table, ids: pa.Array, terms: pa.Array, starts: np.ndarray, places: np.ndarray, gains: np.ndarray, factor: np.ndarray, k: int) -> pa.Table:
    """(query_id, id, score): the k best passages of a block for each query of asked(query_id, terms, weights), with the order of top_k.

    The postings are those of each term from starts[term] to starts[term + 1]: a passage's
    place, and what it gains by one unit of the query's weight. No product of a query and a
    passage is kept but those of one query at a time.
    """
    by_id = np.empty(len(ids), dtype=np.int64)
    by_id[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    words = pc.split_pattern(asked["terms"].combine_chunks(), " ")
    ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
    known = pc.fill_null(pc.index_in(words.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
    weights = asked["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    which, found, scores = [], [], []
    for q, (lo, hi) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
        at = [(t, w) for t, w in zip(known[lo:hi].tolist(), weights[lo:hi].tolist()) if t >= 0]
        if not at:
            continue
        total = np.zeros(len(ids))
        for t, w in at:
            total[places[starts[t] : starts[t + 1]]] += w * gains[starts[t] : starts[t + 1]]
        if all(w > 0 for _, w in at):
            met = np.flatnonzero(total)
        else:  # a score of 0 may be one of a shared term
            met = np.unique(np.concatenate([places[starts[t] : starts[t + 1]] for t, _ in at]))
        values = total[met] * factor[met]
        if len(met) > k:
            near = values >= np.partition(values, -k)[-k] - 2e-9
            met, values = met[near], values[near]
        best = np.lexsort((by_id[met], -np.floor(values * 1e9 + 0.5)))[:k]
        which.append(np.full(len(best), q)), found.append(met[best]), scores.append(values[best])
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.array([], dtype=kind)
    return pa.table({"query_id": asked["query_id"].combine_chunks().take(pa.array(join(which, np.int64))), "id": ids.take(pa.array(join(found, np.int64))), "score": pa.array(join(scores, np.float64))})


def _block_best(kind: str, k: int, k1: float, b: float):
    """A function of a block's passages(id, terms, factor, mean) and what is asked of it: rows of queries, and for cosines one row for each term of the block with its idf."""

    def best(passages: pa.Table, rows: pa.Table) -> pa.Table:
        words = pc.split_pattern(passages["terms"].combine_chunks(), " ")
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        terms, n = coded.dictionary, max(1, len(passages))
        # the postings, in order of terms and then passages
        pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(len(passages)), sizes), return_counts=True)
        term, place = pairs // n, pairs % n
        if kind == "cosine":
            own = rows.filter(pc.invert(rows["asked"]))
            idf = own["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False)[pc.index_in(terms, value_set=own["terms"].combine_chunks()).to_numpy(zero_copy_only=False)] if len(terms) else np.zeros(0)
            norm = np.sqrt(np.bincount(place, weights=(tf * idf[term]) ** 2, minlength=n))
            gains = tf / np.where(norm == 0, 1.0, norm)[place]
        else:
            longness = sizes / passages["mean"].to_numpy()
            gains = tf * (k1 + 1) / (tf + k1 * (1 - b + b * longness[place]))
        starts = np.searchsorted(term, np.arange(len(terms) + 1))
        return _selected(rows.filter(rows["asked"]), passages["id"].combine_chunks(), terms, starts, place, gains, passages["factor"].to_numpy(), k)

    return best


def _nearest(kind: str, asked: DataFrame, blocks: DataFrame, n_blocks: int, k: int, block_terms: DataFrame | None = None, k1: float = 0.0, b: float = 0.0) -> DataFrame:
    """(query_id, id, rank, score) of asked(query_id, term, w) over blocks(block, id, terms, factor, mean): each block gives the k best of each query, and the best of these are the best of all."""
    packed = asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "w")).alias("x")).select("query_id", F.array_join("x.term", " ").alias("terms"), F.col("x.w").alias("weights"), F.lit(True).alias("asked"))
    rows = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select("block", "query_id", "terms", "weights", "asked")
    if block_terms is not None:
        rows = rows.unionByName(block_terms.select("block", F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id"), F.col("term").alias("terms"), F.array("idf").alias("weights"), F.lit(False).alias("asked")))
    best = _block_best(kind, k, k1, b)
    out = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField("id", blocks.schema["id"].dataType), StructField("score", DoubleType())])
    return top_k(blocks.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(best, out), k)


def _in_blocks(passages: DataFrame, n_passages: int) -> tuple[DataFrame, int]:
    """(df(block, id, found, factor), blocks): passages with their tokens, in so many blocks that each core has some and none holds more than about BLOCK."""
    n = min(max(4 * passages.sparkSession.sparkContext.defaultParallelism, n_passages // BLOCK + 1), n_passages // 256 + 1)
    factor = F.col("factor") if "factor" in passages.columns else F.lit(1.0)
    rows = passages.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"), "id", tokens(F.col("text")).alias("found"), factor.alias("factor"))
    # read two or three times, and the tokens' pattern costs more than all that follows
    return written(rows).filter(F.size("found") > 0), n


def meta_factor(heading: Column, note: Column | None = None) -> Column:
    """What the score of a passage counts: a half in describing sections, else all."""
    return F.when(is_meta(heading, note), META_WEIGHT).otherwise(1.0)


def tfidf_nearest(queries: DataFrame, passages: DataFrame, n_passages: int, k: int) -> DataFrame:
    """(query_id, id, rank, score): the k passages of df(id, text) nearest to each query of df(query_id, text) by cosine, of those that share a term; see top_k.

    Each id comes once. The score of a passage is multiplied by its `factor` where there is
    one. Only a passage's tokens are written and shuffled, once each; pairs never are.
    """
    blocks, n = _in_blocks(passages, n_passages)
    in_block = blocks.select("block", F.explode(F.array_distinct("found")).alias("term")).groupBy("block", "term").agg(F.count("*").alias("df"))
    idf = in_block.groupBy("term").agg(F.sum("df").alias("df")).withColumn("idf", F.log((1 + F.lit(n_passages)) / (1 + F.col("df"))) + 1)
    asked = postings(queries.select("query_id", widened(F.col("text")).alias("text")), "query_id", "text")
    q = weights(asked, idf).join(idf.select("term", "idf"), "term").select(F.col("id").alias("query_id"), "term", (F.col("w") * F.col("idf")).alias("w"))
    return _nearest("cosine", q, blocks.select("block", "id", F.array_join("found", " ").alias("terms"), "factor"), n, k, in_block.join(idf.select("term", "idf"), "term"))


def bm25_nearest(queries: DataFrame, passages: DataFrame, n_passages: int, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The same by BM25 over the set of a query's terms; idf is never below 0."""
    blocks, n = _in_blocks(passages, n_passages)
    wanted = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    mean = blocks.agg((F.sum(F.size("found")) / F.lit(float(n_passages))).alias("mean"))
    total = F.lit(float(n_passages))
    df = blocks.select(F.explode(F.array_distinct("found")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", F.greatest(F.lit(0.0), F.log((total - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).alias("w"))
    # mean is one row
    return _nearest("bm25", wanted.join(idf, "term"), blocks.join(F.broadcast(mean), F.lit(True)).select("block", "id", F.array_join("found", " ").alias("terms"), "factor", "mean"), n, k, None, k1, b)


def rank_separation(scored: DataFrame) -> DataFrame:
    """One row (auc): how often a positive of df(score, positive) scores above a negative, ties a half; null without both.

    Counts by exact score stand for the rows, so no positive meets each negative; those below
    are counted within ranges of scores and over the ranges' totals, so that no window holds
    all scores.
    """
    by = scored.filter(F.col("score").isNotNull()).groupBy("score").agg(F.count_if("positive").cast("double").alias("p"), F.count_if(~F.col("positive")).cast("double").alias("n"))
    bounds = by.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    # 1,024 ranges at most; bounds is one row
    ranged = by.join(F.broadcast(bounds), F.lit(True)).withColumn("range", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(1023), F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1024))).otherwise(0).cast("int")).drop("lo", "hi")
    before = lambda group: Window.partitionBy(*group).orderBy("score" if group else "range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(F.sum("n").alias("in_range")).withColumn("earlier", F.coalesce(F.sum("in_range").over(before([])), F.lit(0.0))).drop("in_range")
    placed = ranged.withColumn("own", F.coalesce(F.sum("n").over(before(["range"])), F.lit(0.0))).join(totals, "range")
    wins = placed.agg(F.sum(F.col("p") * (F.col("earlier") + F.col("own") + F.col("n") / 2)).alias("wins"), F.sum("p").alias("ps"), F.sum("n").alias("ns"))
    return wins.select(F.round(F.when((F.col("ps") > 0) & (F.col("ns") > 0), F.col("wins") / (F.col("ps") * F.col("ns"))), 6).alias("auc"))


def with_siblings(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """All chunks of the headed sections that hits touch; the score stays on the chunk that was hit.

    hits is df(passage_id, score), corpus df(passage_id, note, heading, chunk_index). A hit
    without a heading brings only itself; a chunk hit twice keeps its best score.
    """
    best = hits.groupBy("passage_id").agg(F.max("score").alias("score"))
    found = corpus.join(best, "passage_id")
    sections = found.filter("heading is not null and note is not null").select("note", "heading").distinct()
    siblings = corpus.join(sections, ["note", "heading"], "left_semi").select("passage_id", "note", "heading", "chunk_index")
    alone = found.filter("heading is null or note is null").select("passage_id", "note", "heading", "chunk_index")
    return siblings.unionByName(alone).join(best, "passage_id", "left")


def located_claims(claims: DataFrame, passages: DataFrame, most: int = PASSAGES_PER_CLAIM) -> DataFrame:
    """(claim_id, id, rank, shared, shared_numbers): the passages that hold enough of each claim's terms.

    claims is df(claim_id, text), passages df(id, text). Ranked by numbers in common, terms
    in common, and the lower id.
    """
    c = claims.select("claim_id", F.explode(claim_terms(F.col("text"))).alias("term"))
    sizes = c.groupBy("claim_id").agg(F.count("*").alias("size"))
    p = passages.select("id", F.explode(claim_terms(F.col("text"))).alias("term"))
    shared = p.join(c, "term").groupBy("claim_id", "id").agg(F.count("*").alias("shared"), F.count_if(F.col("term").rlike(r"^\d")).alias("shared_numbers"))
    enough = shared.join(sizes, "claim_id").filter((F.col("shared") >= LEAST_SHARED) & (F.col("shared") >= LEAST_SHARE * F.col("size")))
    order = Window.partitionBy("claim_id").orderBy(F.desc("shared_numbers"), F.desc("shared"), "id")
    return enough.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most).select("claim_id", "id", "rank", "shared", "shared_numbers")


def within_budget(df: DataFrame, group: str, score: str, position: str, length: Column, budget: int) -> DataFrame:
    """Rows of each group in order of score, as long as their lengths together keep within the budget.

    The first row that doesn't fit ends the selection, so that a better passage is never
    left out for a worse one. Null scores come last. The rows keep their position for
    putting them back in document order.
    """
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), position).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used_chars", F.sum(length).over(order)).filter(F.col("used_chars") <= budget)


def fitted_front(text: Column, budget: int, note: str = " [...]") -> Column:
    """A text cut to the budget at its last space, with a note of the omission; texts within it are kept."""
    head = F.substring(text, 1, max(0, budget - len(note)))
    return F.when(F.length(text) <= budget, text).otherwise(F.concat(F.regexp_replace(head, r"\s+\S*$", ""), F.lit(note)))


def fitted_ends(text: Column, allowance: Column) -> Column:
    """Head and tail of a text, half of the allowance each; texts within it are kept."""
    half = F.floor(allowance / 2).cast("int")
    return F.when(F.length(text) <= allowance, text).otherwise(F.concat(F.left(text, half), F.lit(" ... "), F.right(text, half)))


def numeric_presence(claims: DataFrame) -> DataFrame:
    """df(claim_id, text, source) with how many of the claim's numbers the source prints."""
    said, held = F.array_distinct(numbers(F.col("text"))), numbers(F.col("source"))
    return claims.select("claim_id", F.size(said).alias("numbers_said"), F.size(F.array_intersect(said, held)).alias("numbers_found"))
