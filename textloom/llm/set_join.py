"""All pairs of records with similar sets: recursive chosen-path splitting.

Each set is embedded by minima under ``HASHES`` hash functions. In every tree
a node with more than ``leaf`` records branches on ``BRANCHES`` coordinates
drawn at random for the node: a record goes to the child named by its value
there, so similar records tend to share a child. Small nodes are compared all
with all. A node that its parent's branching did not make much smaller is dense, its records are similar to each other;
it is not cut further, but compared in blocks. All others branch on, however deep. Trees are repeated to
the target recall, and every candidate is verified on the sets themselves.

Equal sets are one class, represented by its smallest id, before anything
else: copies never meet in a node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

HASHES, BRANCHES = 64, 2
#: Records of a block of a dense node; what a node keeps of its parent's records to be dense, and the levels before one is judged: a
#: single coordinate on which a frequent item has the minimum says nothing about a node.
BLOCK, DENSE, JUDGED = 1024, 0.6, 6
#: Levels after which all that is large counts as dense; after ``JUDGED`` nodes shrink to 0.6 at most per level, so it takes 10^13 records to get there.
LEVELS = 64
#: Members of a class that are joined under one key; larger classes are salted.
MEMBERS = 256
_MASK = (1 << 61) - 1


def path_recall(threshold: float, depth: int, branches: int = BRANCHES) -> float:
    """Chance that a pair at the threshold shares a leaf of one tree after ``depth`` levels. It has a limit above 0 if ``threshold * branches`` is above 1."""
    q = 1.0
    for _ in range(depth):
        q = 1 - (1 - threshold * q) ** branches
    return q


def trees_for(threshold: float, depth: int, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - path_recall(threshold, depth))))


def set_classes(df: DataFrame, key: str, items: Column, least: int) -> tuple[DataFrame, DataFrame]:
    """``(classes, members)``: ``rep, items`` with distinct sorted hashes, and ``key, rep``.

    Null sets and null items are out, and so are sets with fewer than ``least`` different items. Of
    several rows of a key the largest set counts. The digest of a set is 128 bits of
    hash over its sorted items.
    """
    distinct = F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull())))
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), distinct.alias("terms")).filter(F.size("terms") >= least)
    hashed = rows.select("key", F.md5(F.array_join(F.transform("terms", lambda t: F.concat(F.length(t).cast("string"), F.lit(":"), t)), "")).alias("digest"), F.array_sort(F.transform("terms", lambda t: F.xxhash64(t))).alias("items"))
    one = hashed.groupBy("key").agg(F.max_by(F.struct("digest", "items"), F.struct(F.size("items"), "digest")).alias("r")).select("key", "r.digest", "r.items")
    one = materialize(one, "sets")
    classes = one.groupBy("digest").agg(F.min("key").alias("rep"), F.first("items").alias("items"))
    # The digest join is skewed where a class is huge; its small side has one row per class, so it is split by AQE or broadcast.
    members = one.select("key", "digest").join(classes.select("digest", "rep"), "digest").select("key", "rep")
    return materialize(classes.select("rep", "items"), "classes"), members


def _hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def _signatures(seed: int):
    a, b = _hash_family(HASHES, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            offsets = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            size = np.diff(lists.offsets.to_numpy()).astype(np.int32)
            signature = np.empty((batch.num_rows, HASHES), np.int16)
            for i in range(HASHES):
                h = flat * a[i] + b[i]
                h ^= h >> np.uint64(29)
                h *= np.uint64(0x9E3779B97F4A7C15)
                signature[:, i] = (np.minimum.reduceat(h, offsets) >> np.uint64(23)).astype(np.uint16).view(np.int16)
            values = pa.ListArray.from_arrays(np.arange(0, len(signature.ravel()) + 1, HASHES, dtype=np.int32), signature.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), values], ["rep", "size", "sig"])

    return run


def _chosen(node: Column, i: int, level: int) -> Column:
    """The ``i``-th coordinate a node branches on; distinct for the node's branches."""
    step = HASHES // BRANCHES
    return F.pmod(F.xxhash64(node, F.lit(level)), F.lit(step)).cast("int") + i * step


def similar_classes(classes: DataFrame, threshold: float, recall: float = 0.995, leaf: int = 96, levels: int = LEVELS, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """``a, b, similarity``: pairs of classes with Jaccard similarity of at least ``threshold``, a < b.

    ``threshold`` above 1 / ``BRANCHES``, so that the recall has a limit however deep the trees get. Per level the sizes of all nodes
    are counted with a combine before the shuffle, ids alone are written, and signatures (128 bytes) are joined only to those
    that branch on; the others get theirs once, for the comparison. A dense node of n records makes (n / block)^2 / 2 block pairs in as many
    tasks as there are, never one, and copies each record n / block times.
    """
    trees = trees_for(threshold, levels, recall)
    signed = materialize(classes.mapInArrow(_signatures(seed), "rep bigint, size int, sig array<smallint>"), "signatures")
    node = F.explode(F.array(*[F.lit(t).cast("bigint") for t in range(trees)]))
    # Children are hashes of (node, coordinate, value); the root differs by tree.
    branch = lambda level: F.explode(F.array(*[F.xxhash64("node", _chosen(F.col("node"), i, level), F.get("sig", _chosen(F.col("node"), i, level))) for i in range(BRANCHES)]))
    open_rows = signed.select("rep", "sig", node.alias("node")).select("rep", branch(0).alias("node"), F.lit(None).cast("bigint").alias("above"))
    leaves, dense = [], []
    for level in range(1, levels + 1):
        placed = materialize(open_rows, "nodes")
        sizes = placed.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        counted = materialize(placed.join(sizes, "node"), "counted")
        leaves.append(counted.filter(F.col("n") <= leaf).select("node", "rep"))
        large = counted.filter(F.col("n") > leaf)
        is_dense = F.lit(level >= JUDGED) & F.coalesce(F.col("n") > F.lit(DENSE) * F.col("above"), F.lit(False)) | F.lit(level == levels)
        dense.append(large.filter(is_dense).select("node", "rep", "n"))
        going = large.filter(~is_dense)
        if not going.take(1):
            break
        open_rows = going.select("rep", "node", "n").join(signed.select("rep", "sig"), "rep").select("rep", branch(level).alias("node"), F.col("n").alias("above"))
    # Leaves: grouped by node. Dense nodes: blocks, each compared with itself and every later one.
    small = reduce(DataFrame.union, leaves).select("node", "rep", F.lit(0).alias("side"))
    cut = reduce(DataFrame.union, dense).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    paired = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("node"),
        "rep",
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    nodes = small.union(paired).join(signed, "rep")
    sorted_nodes = nodes.repartition("node").sortWithinPartitions("node").select("node", "rep", "size", "side", "sig")
    pairs = sorted_nodes.mapInArrow(_compare(threshold), "a bigint, b bigint").distinct()
    return verified(pairs, classes, threshold)


def _compare(threshold: float):
    """Compares the rows of each node, sorted by node, many nodes at a time.

    Rows ``d`` places apart are paired for d = 1, 2, ... while any two share a
    node; a node that goes on in the next batch is kept for it.
    """
    # Number of equal minima below which a pair at the threshold falls with a chance under 1e-4; such pairs are left out before the exact
    # check, as a part of what the recall leaves open.
    floor = int(HASHES * threshold - 3.9 * math.sqrt(HASHES * threshold * (1 - threshold)))

    def pairs(node, rep, size, side, sig) -> pa.RecordBatch:
        found = [np.zeros((2, 0), np.int64)]
        for d in range(1, len(node)):
            i = np.flatnonzero(node[:-d] == node[d:])
            if not len(i):
                break
            j = i + d
            # Within a block, or from the earlier block to the later one.
            fits = (side[i] + side[j] == 3 * (side[i] > 0)) & (rep[i] != rep[j]) & (np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]))
            i, j = i[fits], j[fits]
            for at in range(0, len(i), 65_536):
                x, y = i[at : at + 65_536], j[at : at + 65_536]
                near = (sig[x] == sig[y]).sum(axis=1) >= floor
                a, b = rep[x[near]], rep[y[near]]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            new.append(batch.column(4).flatten().to_numpy().reshape(-1, HASHES))
            rows = new if kept is None else [np.concatenate(z) for z in zip(kept, new)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield pairs(*(r[:cut] for r in rows))
            kept = [r[cut:] for r in rows]
        if kept is not None:
            yield pairs(*kept)

    return run


def verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Candidates with the exact similarity of their sets."""
    left = classes.select(F.col("rep").alias("a"), F.col("items").alias("x"))
    right = classes.select(F.col("rep").alias("b"), F.col("items").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("shared", shared)
    similarity = F.col("shared") / (F.size("x") + F.size("y") - F.col("shared"))
    return joined.withColumn("similarity", similarity).filter(F.col("similarity") >= threshold).select("a", "b", "similarity")


def member_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``key_a, key_b, similarity``: all pairs of different records, from pairs of classes and membership.

    The result itself has a row per pair. Members of one class are similar at 1. Both
    joins are on the class and a salt: a class of many copies has its members in parts of about
    ``MEMBERS``, and its pairs of classes are repeated for each part.
    """
    members = materialize(members, "members")
    sizes = members.groupBy("rep").agg(F.count("*").alias("n"))
    own = sizes.filter("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity"))
    # At most one row per MEMBERS records; all other classes have one part.
    large = materialize(sizes.filter(F.col("n") > MEMBERS).select("rep", F.ceil(F.col("n") / MEMBERS).cast("int").alias("parts")), "large")
    parts = F.coalesce("parts", F.lit(1))
    salted = members.join(large, "rep", "left").select("rep", "key", F.pmod(F.xxhash64("key"), parts).cast("int").alias("part"))
    left = salted.select(F.col("rep").alias("a"), F.col("part").alias("part_a"), F.col("key").alias("key_a"))
    right = salted.select(F.col("rep").alias("b"), F.col("part").alias("part_b"), F.col("key").alias("key_b"))
    out = pairs.select("a", "b", "similarity").union(own)
    for end in ("a", "b"):
        out = out.join(large.withColumnRenamed("rep", end), end, "left").withColumn(f"part_{end}", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    inside = F.col("a") == F.col("b")
    # Two parts of one class meet once, a part with itself in one order.
    out = out.filter(~inside | (F.col("part_a") <= F.col("part_b"))).join(left, ["a", "part_a"])
    # The last join's input is small next to its output; with a given number of partitions adaptive execution does not merge the parts again.
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = out.repartition(tasks, "b", "part_b").join(right, ["b", "part_b"])
    out = out.filter(~inside | (F.col("part_a") < F.col("part_b")) | (F.col("key_a") < F.col("key_b")))
    return out.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), "similarity")
