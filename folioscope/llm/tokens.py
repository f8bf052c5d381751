"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: The rank file of a byte-level BPE; another one may be given wherever this is the default.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    """The tokenizer of a rank file, as it was sent with the session's files or else at its path; loaded once in each Python process."""
    import tiktoken

    sent = SparkFiles.get(os.path.basename(path)) if SparkFiles._is_running_on_worker else path
    path = sent if os.path.exists(sent) else path

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of a text; 0 for null and empty ones."""

    def count(texts: pd.Series) -> pd.Series:
        own = encoding(path)
        return pd.Series([0 if not t else len(own.encode_ordinary(t)) for t in texts], dtype="int32")

    return F.pandas_udf(count, IntegerType())(text)


def source_name(source: Column) -> Column:
    """A source's name brought into line: lower case, words joined by _, singular; null stays null."""
    joined = F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_")
    return F.when(joined.rlike(r"[^si]s$"), F.regexp_replace(joined, "s$", "")).otherwise(joined)


def document_sizes(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of df(doc_id, source, text): all that packing and mixing need of a text.

    The rank file is sent to the executors with the session's files; none of them needs it.
    """
    sc = documents.sparkSession.sparkContext
    if os.path.exists(path) and os.path.basename(path) not in {f.rpartition("/")[2] for f in sc.listFiles}:
        sc.addFile(path)
    return documents.select("doc_id", source_name(F.col("source")).alias("source"), token_count(F.col("text"), path).alias("n_tokens"))
