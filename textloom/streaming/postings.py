"""Posting facts of an arriving stream of documents.

The batch expressions work on a stream as they are; this adds the state-free
flat postings, to be appended to the table the batch operators read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.terms import term_freq


def stream_postings(docs: DataFrame, doc_id: str = "doc_id", body: str = "text") -> DataFrame:
    """``file_id, term, tf`` of each arriving document, without state: a document's terms are counted inside its row."""
    return term_freq(docs, doc_id, text.words(F.col(body)))
