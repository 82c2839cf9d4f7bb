"""Term indexes: the flat posting facts and the views over them.

All take a frame with one row per file and derive ``file_id, term, tf``.
The flat form is the primary one; a term's whole list is built only where
the byte format needs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(docs: DataFrame, file_id: str, terms: Column) -> DataFrame:
    """One row per occurrence: ``file_id, term``."""
    return docs.select(F.col(file_id).alias("file_id"), F.explode(terms).alias("term"))


def counted_terms(docs: DataFrame, file_id: str, terms: Column) -> DataFrame:
    """``file_id, terms``: array of (term, tf) by term, empty without terms. ``docs`` has one row per file.

    A file's occurrences lie in one row, so they are sorted and counted there, without a
    shuffle: the runs of equal words start where a word differs from the one before. The steps are projections of
    their own, as a lambda would evaluate what it refers to for each element.
    """
    words = docs.select(F.col(file_id).alias("file_id"), F.sort_array(F.coalesce(terms, F.array().cast("array<string>"))).alias("_w"))
    n = F.size("_w")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("_w", i) != F.get("_w", i - 1)))
    placed = words.select("file_id", "_w", F.when(n > 0, starts).otherwise(F.array().cast("array<int>")).alias("_at"))
    run = lambda i, k: F.struct(F.get("_w", i).alias("term"), (F.coalesce(F.get("_at", k + 1), n) - i).cast("bigint").alias("tf"))
    return placed.select("file_id", F.transform("_at", run).alias("terms"))


def term_freq(docs: DataFrame, file_id: str, terms: Column) -> DataFrame:
    """``file_id, term, tf`` of a frame with one row per file. No shuffle."""
    # The outer form: for the inner one the optimizer would infer a filter on the array's size and
    # evaluate the whole chain inside its lambdas.
    return counted_terms(docs, file_id, terms).select("file_id", F.inline_outer("terms")).filter("term is not null")


def merged_term_freq(occurrences: DataFrame) -> DataFrame:
    """``file_id, term, tf`` from ``file_id, term`` rows in any order, combined before the shuffle."""
    return occurrences.groupBy("file_id", "term").agg(F.count("*").alias("tf"))


def doc_length(docs: DataFrame, file_id: str, terms: Column) -> DataFrame:
    """``file_id, doc_length``: a row for every file, 0 without terms. No shuffle."""
    return docs.select(F.col(file_id).alias("file_id"), F.coalesce(F.size(terms), F.lit(0)).cast("bigint").alias("doc_length"))


def term_stats(tf: DataFrame) -> DataFrame:
    """``term, df, cf``: files and occurrences."""
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def postings(tf: DataFrame) -> DataFrame:
    """``term, postings``: array of (file_id, tf) by file_id."""
    return tf.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("file_id", "tf"))).alias("postings"))


def forward(tf: DataFrame, docs: DataFrame, file_id: str) -> DataFrame:
    """``file_id, terms``: array of (term, tf) by term from flat postings; empty for files of ``docs`` without terms.

    Where the texts themselves are at hand ``counted_terms`` gives the same without a shuffle.
    """
    blocks = tf.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("terms"))
    ids = docs.select(F.col(file_id).alias("file_id"))
    empty = F.array().cast("array<struct<term:string,tf:bigint>>")
    return ids.join(blocks, "file_id", "left").withColumn("terms", F.coalesce("terms", empty))


#: Ids in a range of files; a term has at most as many postings in one.
ID_RANGE = 1 << 20


def postings_delta(tf: DataFrame, id_range: int = ID_RANGE) -> DataFrame:
    """``term, file_id, delta, tf``: distance to the term's file before, the id itself for the first.

    A window holds one term's postings of one range of ids, so a hot term spreads over tasks. What a range's
    first posting needs, the last id of the term's range before, comes into the range as a row of
    its own; those are combined before the shuffle, one per term and range.
    """
    ranged = tf.select("term", "file_id", "tf", F.floor(F.col("file_id") / id_range).alias("_range"))
    last = ranged.groupBy("term", "_range").agg(F.max("file_id").alias("file_id"))
    before = F.lag("file_id").over(Window.partitionBy("term").orderBy("_range"))
    carried = last.select("term", before.alias("file_id"), F.lit(None).cast("bigint").alias("tf"), "_range").filter("file_id is not null")
    previous = F.lag("file_id").over(Window.partitionBy("term", "_range").orderBy("file_id"))
    both = ranged.unionByName(carried).withColumn("delta", F.col("file_id") - F.coalesce(previous, F.lit(0)))
    return both.filter("tf is not null").select("file_id", "term", "tf", "delta")


def block_bytes(deltas: DataFrame) -> DataFrame:
    """``term, bytes``: the length of each term's postings block, from sums alone; no list of a term's postings is built."""
    from ..functions.codec import varint_size

    sums = deltas.groupBy("term").agg(F.count("*").alias("n"), F.sum(varint_size(F.col("delta")) + varint_size(F.col("tf"))).alias("body"))
    return sums.select("term", (F.col("body") + varint_size(F.col("n"))).cast("bigint").alias("bytes"))


def block_segments(tf: DataFrame, id_range: int = ID_RANGE) -> DataFrame:
    """``term, segment, block``: each term's postings block cut at ranges of ids; the segments in order are the block.

    The first one starts with the count of all postings. No row holds more than a range's postings.
    """
    from ..functions import codec

    body = F.concat(codec.varint_hex(F.col("delta")), codec.varint_hex(F.col("tf")))
    parts = postings_delta(tf, id_range).groupBy("term", F.floor(F.col("file_id") / id_range).alias("segment"))
    parts = parts.agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file_id", body.alias("b")))), lambda x: x["b"]), "").alias("block"))
    heads = parts.groupBy("term").agg(F.sum("n").alias("total"), F.min("segment").alias("first"))
    head = F.when(F.col("segment") == F.col("first"), codec.varint_hex(F.col("total"))).otherwise("")
    return parts.join(heads, "term").select("term", "segment", F.concat(head, "block").alias("block"))


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Range-partitioned and sorted, with each row's partition and place in it.

    Written to the shared folder first: the two passes below must see the same
    partition bounds, which a second sampling need not give.
    """
    from ..session import materialize

    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    return materialize(placed, "ranged")


def dense_ids(df: DataFrame, order: list[str], name: str = "file_id") -> DataFrame:
    """Ids 0..N-1 by the byte order of ``order``, whose values must be unique.

    Range partition, count per partition, add the counts before: no task sees
    more than its range. The counts (one row per partition) are joined by
    broadcast; their number is bounded by the partitions, not the rows.
    """
    return _prefix(df, order, F.lit(1), name)


def running_offset(df: DataFrame, order: list[str], length: Column, name: str = "offset") -> DataFrame:
    """Sum of ``length`` over all rows before, as ``dense_ids`` does it."""
    return _prefix(df, order, length, name)


def _prefix(df: DataFrame, order: list[str], length: Column, name: str) -> DataFrame:
    placed = _ranged(df.withColumn("_len", length.cast("bigint")), order)
    totals = placed.groupBy("_part").agg(F.sum("_len").alias("_sum"))
    starts = totals.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.coalesce(F.sum("_len").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = placed.withColumn("_in", within).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_start") + F.col("_in")).drop("_part", "_len", "_start", "_in")


def run_stats(files: DataFrame, status: Column) -> DataFrame:
    """``indexed, skipped, ignored`` from a status column."""
    s = files.select(status.alias("s"))
    return s.agg(*[F.coalesce(F.sum((F.col("s") == k).cast("bigint")), F.lit(0)).alias(k) for k in ("indexed", "skipped", "ignored")])
