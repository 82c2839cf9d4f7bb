"""Posting triples as the term operators below need them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_postings(spill: DataFrame) -> DataFrame:
    """``term, file_id, freq``: one row per file and term.

    Replayed rows count once, null and empty terms and null files are out, a null ``freq`` is one
    occurrence. Repeats are combined before the shuffle, whose key is the pair, so a hot
    term or a hot file spreads over all tasks.
    """
    held = spill.filter("term is not null and term <> '' and file_id is not null")
    return held.groupBy("term", "file_id").agg(F.max(F.coalesce("freq", F.lit(1))).cast("bigint").alias("freq"))


def valid_docs(docs: DataFrame) -> DataFrame:
    """``file_id, doc_length``: the row with the greatest ``indexed_at``; its length may be null."""
    best = F.max_by("doc_length", F.struct("indexed_at", "doc_length"))
    return docs.filter("file_id is not null").groupBy("file_id").agg(best.alias("doc_length"))
