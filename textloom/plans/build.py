"""The index build: tree -> terms -> docs, postings, terms, forward and vectors, published together."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, text, vectors
from ..functions.identifiers import code_identifiers
from ..operators import terms as T
from ..sources.tree import read_tree
from .project import Project, default_storage


@dataclass
class Stats:
    indexed: int
    skipped: int
    project: Project


def path_terms(files: DataFrame) -> DataFrame:
    """``path, term, tf`` of indexed files given as ``path, ext, content, kind``: identifiers, json keys or words.

    ``kind`` is the column the files are partitioned by, so each of the three reads only its own.
    """
    body = text.lossy_text(F.col("content"))
    code = code_identifiers(files.filter("kind = 'code'"), "path", "path", key="string")
    keys = T.term_freq(files.filter("kind = 'json'"), "path", text.json_keys(body))
    words = T.term_freq(files.filter("kind = 'words'"), "path", text.words(body))
    return code.toDF("path", "term", "tf").union(keys.toDF("path", "term", "tf")).union(words.toDF("path", "term", "tf"))


def build_index(spark: SparkSession, root: str, storage: str | None = None, excludes=(), model: str | None = None, ignore_files: bool = False) -> Stats:
    """Indexes a tree and publishes it as one generation of its project.

    Contents are read from the tree once, extracted once, and never shuffled: terms and vectors are taken per
    path, ids join the small rows. A run that fails removes what it wrote and leaves the published generation.
    """
    project = Project.resolve(root, storage or default_storage(), spark)
    at = project.new_generation()
    try:
        stats = _write_generation(spark, project.root, at, excludes, model, ignore_files)
    except BaseException:
        project.discard(at)
        raise
    project.store.delete(f"{at}/work")
    project.publish(at)
    return Stats(stats["indexed"], stats["skipped"], project)


def _write_generation(spark: SparkSession, root: str, at: str, excludes, model: str | None, ignore_files: bool):
    work = f"{at}/work"
    kind = F.when(F.col("status") != "indexed", "none").when(F.col("ext") == "json", "json").when(F.col("ext").isin(*text.WORD_EXTENSIONS), "words").otherwise("code")
    read_tree(spark, root, excludes, ignore_files=ignore_files).withColumn("kind", kind).write.partitionBy("kind").parquet(f"{work}/files")
    files = spark.read.schema("path string, ext string, content binary, status string, kind string").parquet(f"{work}/files")
    good = files.filter("kind <> 'none'")
    T.dense_ids(good.select("path"), ["path"]).write.parquet(f"{work}/ids")
    ids = spark.read.parquet(f"{work}/ids")
    path_terms(good).write.parquet(f"{work}/terms")
    # The primary table: flat postings, sorted by term within range partitions, so a lookup reads few row groups.
    flat = spark.read.parquet(f"{work}/terms").join(ids, "path").select("file_id", "term", "tf")
    flat.repartitionByRange("term", "file_id").sortWithinPartitions("term", "file_id").write.parquet(f"{at}/postings")
    tf = spark.read.parquet(f"{at}/postings")
    tf.repartitionByRange("file_id").sortWithinPartitions("file_id", "term").write.parquet(f"{at}/forward")
    T.term_stats(tf).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/terms")
    lengths = tf.groupBy("file_id").agg(F.sum("tf").alias("doc_length"))
    ids.join(lengths, "file_id", "left").select("file_id", "path", F.coalesce("doc_length", F.lit(0)).alias("doc_length")).write.parquet(f"{at}/docs")
    if model:
        embed = vectors.embed_udf(spark, vectors.TokenTable.load(model))
        by_path = good.select("path", vectors.to_f16(embed(text.lossy_text(F.col("content")))).alias("vector"))
        by_path.join(ids, "path").select("file_id", "vector").write.parquet(f"{at}/vectors")
    return T.run_stats(files.select("status"), F.col("status")).first()


def export_blocks(spark: SparkSession, generation: str, out: str) -> None:
    """The byte formats: postings blocks by term in segments, forward blocks and doc entries by file, with their offsets."""
    tf = spark.read.parquet(f"{generation}/postings")
    docs = spark.read.parquet(f"{generation}/docs")
    post = T.block_segments(tf).select("term", "segment", F.unhex("block").alias("block"))
    T.running_offset(post, ["term", "segment"], F.octet_length("block")).write.parquet(f"{out}/postings")
    blocks = T.forward(tf, docs, "file_id").select("file_id", F.unhex(codec.forward_block_hex(F.col("terms"))).alias("block"))
    T.running_offset(blocks, ["file_id"], F.octet_length("block")).write.parquet(f"{out}/forward")
    docs.select("file_id", F.unhex(codec.docs_entry_hex(F.col("path"), F.col("doc_length"))).alias("entry")).write.parquet(f"{out}/docs")


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="textloom", description="Index the terms of a source tree.")
    p.add_argument("root")
    p.add_argument("--storage-root")
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--threads", type=int, help="cores of a local session; a cluster's session ignores it")
    p.add_argument("--embedding-model")
    p.add_argument("--ignore-files", action="store_true", help="leave out what .gitignore and .ignore files name")
    a = p.parse_args(argv)
    from ..session import local_session

    spark = SparkSession.getActiveSession() or local_session(a.threads or "*")
    s = build_index(spark, a.root, a.storage_root, a.exclude, a.embedding_model, a.ignore_files)
    print(f"indexed {s.indexed} files, skipped {s.skipped}\nroot {s.project.root}\nindex {s.project.index_dir}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
