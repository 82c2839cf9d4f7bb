"""How characteristic a term is of a file: BM25 weights.

score = ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))

N counts the files that have postings or a document row, the average is over the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .postings import distinct_postings, valid_docs

#: Saturation of term frequency and weight of the length, the usual values.
K1, B = 1.2, 0.75
#: A term in more than 1 / HOT of all postings joins by broadcast: at most HOT terms can be that frequent.
HOT = 2000


def term_scores(spill: DataFrame, docs: DataFrame, only: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """``file_id, term, tf, df, score`` for every file and term.

    ``only``: a frame of ``file_id``; statistics still cover all files, scores
    come out for these alone. A missing or null length is the sum of the
    file's frequencies. Document frequencies are counted from the distinct
    pairs with a combine before the shuffle. Very frequent terms, whose rows
    would all meet in one task of the join, get theirs by broadcast; the rest
    join by shuffle.
    """
    pairs = materialize(distinct_postings(spill), "pairs")
    sums = pairs.groupBy("file_id").agg(F.sum("freq").alias("summed"))
    lengths = materialize(valid_docs(docs).join(sums, "file_id", "full").select("file_id", F.coalesce("doc_length", "summed", F.lit(0)).alias("length")), "lengths")
    total = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("avg")).first()
    n, average = total["n"], max(total["avg"] or 1.0, 1e-9)
    df = pairs.groupBy("term").agg(F.count("*").alias("df"))
    chosen = pairs if only is None else pairs.join(only.select("file_id").filter("file_id is not null").distinct(), "file_id", "left_semi")
    df = materialize(df, "df")
    floor = max(1, df.agg(F.sum("df")).first()[0] or 0) / HOT
    hot = df.filter(F.col("df") > floor)
    marked = chosen.join(F.broadcast(hot), "term", "left")
    rest = marked.filter("df is null").drop("df").join(df.filter(F.col("df") <= floor), "term")
    with_df = marked.filter("df is not null").select("term", "file_id", "freq", "df").union(rest.select("term", "file_id", "freq", "df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("freq") * (k1 + 1) / (F.col("freq") + k1 * (1 - b + b * F.col("length") / average))
    return with_df.join(lengths, "file_id").select("file_id", "term", F.col("freq").alias("tf"), "df", (idf * tf).alias("score"))


def top_term(scores: DataFrame) -> DataFrame:
    """``file_id, term, score``: the best term of each file, of equal ones the first in byte order."""
    best = F.min_by(F.struct("term", "score"), F.struct((-F.col("score")).alias("s"), F.col("term")))
    return scores.groupBy("file_id").agg(best.alias("b")).select("file_id", "b.term", "b.score")
