"""The queries of the subpackage, and the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import chunking, linkage, mixing, names, packing, quality, sentences, tokens
from folioscope.sources.tables import checkpoint, sent_once, spread, table


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every text and heading of the passages."""
    fields = chunking.fields_with_limits(table(spark, sf_dir, "note_passages"), table(spark, sf_dir, "split_limits"))
    return chunking.piece_rows(chunking.split_oversized(fields))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that the operator had to cut: those of two or more pieces."""
    fields = chunking.fields_with_limits(table(spark, sf_dir, "note_passages"), table(spark, sf_dir, "split_limits"))
    return chunking.split_oversized(fields).filter(F.size("pieces") > 1).select("passage_id", "field_name")


def p2_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each field: what its pieces join to without their overlaps, how many are over the limit, and how many repeat less or more than is asked for."""
    fields = chunking.fields_with_limits(table(spark, sf_dir, "note_passages"), table(spark, sf_dir, "split_limits"))
    p = chunking.split_oversized(fields).filter(F.size("pieces") > 0).withColumn("first", F.get("pieces", 0)["core_start"])
    joined = F.array_join(F.expr("transform(pieces, p -> substring(value, p.core_start + 1, p.end_offset - p.core_start))"), "")
    over = F.size(F.filter("pieces", lambda x: x["end_offset"] - x["start_offset"] > F.col("max_chars")))
    wrong = F.size(F.filter("pieces", lambda x: (x["core_start"] > F.col("first")) & (x["core_start"] - x["start_offset"] != F.least(F.col("overlap_chars"), F.col("max_chars") - 1, x["core_start"] - F.col("first")))))
    return p.select("passage_id", "field_name", F.md5(joined).alias("text_md5"), over.alias("over_limit"), wrong.alias("wrong_overlaps"))


def author_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, n): every author spelling as stored and how often it is; partly counted before the shuffle."""
    listed = table(spark, sf_dir, "reference_candidates").select(F.explode("authors").alias("name"))
    single = table(spark, sf_dir, "academic_references").select(F.col("author").alias("name"))
    return listed.unionByName(single).filter("name is not null").groupBy("name").agg(F.count("*").alias("n"))


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each author spelling with the entity that it names."""
    return names.link_names(author_spellings(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two spellings of one person or study group."""
    # written once: the pairs ask for it on both sides
    return names.name_pairs(checkpoint(names.link_names(author_spellings(spark, sf_dir))))


def p4_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of reference and record with their confidence."""
    refs = sent_once(table(spark, sf_dir, "academic_references").select("reference_id", "title", "author", "year", "venue", "doi"), "reference_id")
    records = sent_once(table(spark, sf_dir, "reference_candidates").select("candidate_id", "title", "subtitle", "authors", "year", "venue", "container_titles", "doi", "work_type"), "candidate_id")
    return linkage.link_records(refs, records, checkpoint(p3_entities(spark, sf_dir)))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and records of one work: those whose confidence is a half or more."""
    return p4_linked(spark, sf_dir).filter("confidence >= 0.5").select("reference_id", "candidate_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of all answer drafts and of all source sentences of claims."""
    drafts = table(spark, sf_dir, "academic_drafts").select(F.lit("draft").alias("record_kind"), F.col("draft_id").alias("record_id"), F.col("answer_draft").alias("text"))
    drafts = spread(drafts)
    contexts = table(spark, sf_dir, "claim_contexts").select(F.lit("context").alias("record_kind"), F.col("context_id").alias("record_id"), F.col("source_sentence").alias("text"))
    return sentences.sentence_units(drafts.unionByName(spread(contexts)))


def p5_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each draft: how many characters that aren't white space stand in its units, and how many units start before the one before them ends."""
    drafts = table(spark, sf_dir, "academic_drafts").select("draft_id", F.col("answer_draft").alias("text"))
    units = sentences.sentence_units(drafts).groupBy("draft_id").agg(F.array_sort(F.collect_list(F.struct("unit_start", "unit_end"))).alias("u"))
    inside = F.expr("aggregate(u, 0, (n, s) -> n + length(regexp_replace(substring(text, s.unit_start + 1, s.unit_end - s.unit_start), '[\\\\s\\\\p{Z}]', '')))")
    overlaps = F.expr("size(filter(sequence(1, size(u) - 1), i -> i > 0 and u[i].unit_start < u[i - 1].unit_end))")
    return units.join(drafts, "draft_id").select("draft_id", inside.alias("characters"), F.when(F.size("u") > 1, overlaps).otherwise(0).alias("overlaps"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens; written once, as both a total and each document are asked for."""
    return checkpoint(tokens.document_sizes(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or piece of one, for each spec."""
    return packing.pack(sizes(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


def p6_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of room left over for each spec."""
    filled = p6_containers(spark, sf_dir).groupBy("pack_id", "shard", "container").agg(F.sum("n_tokens").alias("tokens"))
    per = filled.groupBy("pack_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    specs = table(spark, sf_dir, "pack_specs").select("pack_id", "capacity_tokens")
    return per.join(F.broadcast(specs), "pack_id").withColumn("room_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def p6_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each spec: documents placed, containers beyond their capacity, pieces of documents that need no cut, and documents whose pieces aren't numbered without a gap."""
    specs = table(spark, sf_dir, "pack_specs").select("pack_id", "capacity_tokens")
    placed = checkpoint(p6_containers(spark, sf_dir))
    over = placed.groupBy("pack_id", "shard", "container").agg(F.sum("n_tokens").alias("tokens")).join(F.broadcast(specs), "pack_id").groupBy("pack_id").agg(F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("over_capacity"))
    whole = placed.groupBy("pack_id", "doc_id").agg(F.count("*").alias("pieces"), F.max("piece_no").alias("last"), F.sum("n_tokens").alias("tokens")).join(F.broadcast(specs), "pack_id")
    per = whole.groupBy("pack_id").agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("needless_cuts"), F.count_if(F.col("pieces") != F.col("last")).alias("gaps"))
    return per.join(over, "pack_id")


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw of every mix with its training position."""
    own = sizes(spark, sf_dir)
    return mixing.draws(own, checkpoint(mixing.plan(own, table(spark, sf_dir, "mix_targets"))))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that each mix reaches."""
    own = sizes(spark, sf_dir)
    planned = checkpoint(mixing.plan(own, table(spark, sf_dir, "mix_targets")))
    return mixing.shares(planned, mixing.draws(own, planned))


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each target: its share of its mix, the documents drawn oftener than allowed, and whether more was drawn than is there or, by more than the largest document, than was wanted."""
    own = sizes(spark, sf_dir)
    planned = checkpoint(mixing.plan(own, table(spark, sf_dir, "mix_targets")))
    drawn = checkpoint(mixing.draws(own, planned))
    uses = drawn.groupBy("mix_id", "source", "doc_id").agg(F.count("*").alias("uses")).groupBy("mix_id", "source").agg(F.max("uses").alias("uses"))
    largest = own.agg(F.max("n_tokens").alias("largest"))
    rows = mixing.shares(planned, drawn).join(uses, ["mix_id", "source"], "left").join(table(spark, sf_dir, "mix_targets").select("mix_id", "source", "max_repeats"), ["mix_id", "source"]).join(F.broadcast(largest), F.lit(True))
    return rows.select("mix_id", "source", F.round("target_share", 6).alias("target_share"), (F.coalesce("uses", F.lit(0)) > F.col("max_repeats")).alias("over_repeats"), ((F.col("drawn_tokens") > F.col("available_tokens") * F.col("max_repeats")) | (F.abs(F.col("drawn_tokens") - F.least(F.col("wanted_tokens"), F.col("available_tokens") * F.col("max_repeats"))) > F.col("largest"))).alias("off_target"))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every document's text; listed_share, whose lines are told by their form, is in p8_listed."""
    return quality.document_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"), names=[n for n in quality.STATISTICS if n != "listed_share"])


def p8_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document the share of its characters that stand in lines that hold no running text."""
    return quality.document_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"), names=["listed_share"])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are not natural prose."""
    return quality.judged_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).filter(~F.col("is_prose")).select("doc_id")


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_checked": p2_checked, "p3_found": p3_found, "p3_entities": p3_entities, "p4_found": p4_found, "p4_linked": p4_linked, "p5_found": p5_found, "p5_checked": p5_checked, "p6_containers": p6_containers, "p6_room": p6_room, "p6_checked": p6_checked, "p7_mixed": p7_mixed, "p7_shares": p7_shares, "p7_checked": p7_checked, "p8_found": p8_found, "p8_statistics": p8_statistics, "p8_listed": p8_listed}

SOURCE = r"regexp_replace(regexp_replace(lower(trim(source)), '[\s_-]+', '_', 'g'), '([^si])s$', '\1')"
TRIM = r"regexp_replace({}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"
_WORDS = "[぀-ヿ㐀-鿿]|[฀-๿]{1,4}|[^\\s぀-ヿ㐀-鿿฀-๿]+"


def _found(pattern: str, text: str = "t") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _per(part: str, whole: str) -> str:
    return f"round({part} / greatest({whole}, 1), 6)"


def _statistics_sql() -> str:
    """The statistics by other means than the operator's: lists of tokens in place of patterns that look around."""
    common = ", ".join(f"'{w}'" for w in quality.COMMON)
    counts = {
        "chars": "length(t)::DOUBLE", "words": _found(_WORDS), "lines": _found("[^\\s][^\\n]*"), "letters": "length(t) - length(regexp_replace(t, '[\\p{L}\\p{M}\\p{N}]+', '', 'g'))",
        "symbols": _found("[=<>|_\\\\^~+{}$@]"), "digits": _found("[0-9]"), "capitals": _found("\\p{Lu}"), "commas": _found("[,;]"),
        "stops": _found("[.!?…ก-๙][\"''”’»)\\]]*(?:\\s|$)|[。！？।؟]"), "stopped": _found("[.!?。！？।؟…:;][\"''”’»)」]*[ \\t\\r]*(?:\\n|$)"),
        "short_words": "len(list_filter(regexp_extract_all(t, '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '\\p{L}{1,3}')))",
        "common": f"len(list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{M}}]+'), lambda w: w IN ({common}))) + " + _found("|".join(quality.COMMON_ANYWHERE), "lower(t)"),
        "singles": "len(list_filter(regexp_extract_all(t, '\\S+'), lambda w: regexp_full_match(w, '[\\p{L}\\p{N},.]')))",
        "miscoded": _found("[\\x{80}-\\x{9F}]|[ÃÂÐÑÎÏãàèéäåç][\\x{80}-¿‐-›€™šœžŸ]"),
        "said": "list_filter(list_transform(string_split_regex(regexp_replace(t, '[0-9]+', '', 'g'), '[.!?。！？।؟\\n]'), lambda s: trim(s, ' ')), lambda s: s <> '')",
    }
    shares = {
        "n_chars": "chars", "n_words": "words::DOUBLE", "n_lines": "lines::DOUBLE", "mean_word_length": _per("letters", "words"), "words_per_line": _per("words", "lines"), "symbol_share": _per("symbols", "chars"), "digit_share": _per("digits", "chars"),
        "upper_share": _per("capitals", "chars"), "line_end_stop_share": _per("stopped", "lines"), "short_word_share": _per("short_words", "words"), "common_word_share": _per("common", "words"), "words_per_stop": _per("words", "stops"), "comma_share": _per("commas", "words"),
        "single_share": _per("singles", "words"), "miscoded_share": _per("miscoded", "chars"),
        "distinct_share": "CASE WHEN len(said) < 2 THEN 1.0 ELSE round(list_sum(list_transform(list_distinct(said), lambda s: length(s))) / list_sum(list_transform(said, lambda s: length(s))), 6) END",
    }
    return f"SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in shares.items())} FROM (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in counts.items())} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"


ORACLES = {
    "p8_statistics": _statistics_sql(),
    "p2_found": f"""
        SELECT passage_id, field_name FROM (
          SELECT passage_id, 'text' AS field_name, text AS value FROM note_passages
          UNION ALL SELECT passage_id, 'heading', heading FROM note_passages) AS v
        JOIN split_limits USING (field_name)
        WHERE length({TRIM.format("value")}) > max_chars""",
    # what must hold of any cutting, sentences, mix and filling
    "p2_checked": f"""
        SELECT passage_id, field_name, md5({TRIM.format("value")}) AS text_md5, 0 AS over_limit, 0 AS wrong_overlaps FROM (
          SELECT passage_id, 'text' AS field_name, text AS value FROM note_passages
          UNION ALL SELECT passage_id, 'heading', heading FROM note_passages) AS v
        JOIN split_limits USING (field_name) WHERE {TRIM.format("value")} <> ''""",
    "p5_checked": r"SELECT draft_id, length(regexp_replace(answer_draft, '[\s\p{Z}]', '', 'g')) AS characters, 0 AS overlaps FROM academic_drafts WHERE regexp_replace(answer_draft, '[\s\p{Z}]', '', 'g') <> ''",
    "p7_checked": """
        SELECT mix_id, source, round(CASE WHEN sum(greatest(coalesce(target_weight, 0), 0)) OVER (PARTITION BY mix_id) > 0 THEN greatest(coalesce(target_weight, 0), 0) / sum(greatest(coalesce(target_weight, 0), 0)) OVER (PARTITION BY mix_id) ELSE 0 END, 6) AS target_share,
          false AS over_repeats, false AS off_target FROM mix_targets""",
    "p6_checked": f"""
        SELECT pack_id, count(*) AS documents, 0 AS over_capacity, 0 AS needless_cuts, 0 AS gaps
        FROM pack_specs JOIN documents ON scope_source IS NULL OR {SOURCE} = scope_source
        WHERE capacity_tokens > 0 GROUP BY pack_id""",
}
