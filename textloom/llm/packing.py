"""Filling containers of fixed capacity by the sum-of-squares rule.

Every item goes into the open container, or a new one, for which the sum over
all gaps of (open containers with that gap) squared becomes smallest. Items
are packed in shards of bounded size; then the containers that still have room are packed
again, as items of their own, across many shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Items per shard, and shards whose open containers are packed together.
SHARD, FAN_IN = 50_000, 64


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, numbered from 0. ``0 < size <= capacity``. Larger items are placed first."""
    count = np.zeros(capacity + 1, np.int32)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), np.int64)
    made = 0
    none = np.iinfo(np.int32).max
    for k in np.argsort(-sizes, kind="stable"):
        s = int(sizes[k])
        # Change of the sum, halved, less the constant: a new container, an exact fit, or one with gap g > s.
        best, gap = 2 * int(count[capacity - s]) + 1 if s < capacity else 0, capacity
        if s < capacity:
            if count[s] and 1 - 2 * int(count[s]) <= best:
                best, gap = 1 - 2 * int(count[s]), s
            held = count[s + 1 : capacity]
            change = np.where(held > 0, count[1 : capacity - s] - held, none)
            if len(change):
                g = int(change.argmin())
                if change[g] != none and 2 * int(change[g]) + 2 < best:
                    gap = g + s + 1
        if gap == capacity:
            at, made = made, made + 1
        else:
            at = bins[gap].pop()
            count[gap] -= 1
        left = gap - s
        if left:
            bins[left].append(at)
            count[left] += 1
        out[k] = at
    return out


def pack(sizes: DataFrame, specs: list[tuple[int, int]], shard: int = SHARD) -> DataFrame:
    """``spec_id, doc_id, piece, tokens, container`` for each document and spec.

    ``sizes``: ``doc_id, tokens``. ``specs``: (spec_id, capacity) pairs. A document larger than the capacity is
    cut into full pieces, each a container of its own, and a rest, which is an item;
    no other document is split. Documents without tokens need no room: ``container`` is null. Capacities
    that are null or below 1 are refused.
    """
    if any(c is None or c < 1 for _, c in specs):
        raise ValueError("a capacity of at least 1 is needed")
    sizes = materialize(sizes.select("doc_id", F.col("tokens").cast("bigint").alias("tokens")), "sizes")
    shards = max(1, -(-sizes.count() // shard))
    spec = F.explode(F.array(*[F.struct(F.lit(i).alias("spec_id"), F.lit(c).cast("bigint").alias("capacity")) for i, c in specs])).alias("s")
    asked = sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("tokens"), spec).select("doc_id", "tokens", "s.*")
    full = F.floor(F.col("tokens") / F.col("capacity")).cast("bigint")
    whole = asked.filter(F.col("tokens") > F.col("capacity")).select("spec_id", "doc_id", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"), F.col("capacity").alias("tokens"))
    whole = whole.withColumn("container", F.concat_ws("-", F.lit("d"), "doc_id", "piece")).select("spec_id", "doc_id", F.col("piece").cast("bigint").alias("piece"), "tokens", "container")
    rest = F.when(F.col("tokens") > F.col("capacity"), F.col("tokens") % F.col("capacity")).otherwise(F.col("tokens"))
    items = asked.select("spec_id", "capacity", "doc_id", F.when(F.col("tokens") > F.col("capacity"), full).otherwise(F.lit(0)).cast("bigint").alias("piece"), rest.alias("tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))
    empty = items.filter("tokens = 0 and piece = 0").select("spec_id", "doc_id", "piece", "tokens", F.lit(None).cast("string").alias("container"))
    first = items.filter("tokens > 0").groupBy("spec_id", "shard").applyInArrow(_pack_items, "spec_id int, capacity bigint, doc_id bigint, piece bigint, tokens bigint, shard bigint, at bigint")
    first = materialize(first, "packed")
    # Open containers, a small part of all, once more.
    bins = first.groupBy("spec_id", "capacity", "shard", "at").agg(F.sum("tokens").alias("tokens")).filter(F.col("tokens") < F.col("capacity"))
    again = bins.withColumn("wide", F.floor(F.col("shard") / FAN_IN)).groupBy("spec_id", "wide").applyInArrow(_pack_bins, "spec_id int, shard bigint, at bigint, joined string")
    named = first.join(again, ["spec_id", "shard", "at"], "left")
    placed = named.select("spec_id", "doc_id", "piece", "tokens", F.coalesce("joined", F.concat_ws("-", F.lit("s"), "shard", "at")).alias("container"))
    return placed.union(whole).union(empty)


def _pack_items(group: pa.Table) -> pa.Table:
    group = group.combine_chunks().sort_by("doc_id")
    at = sum_of_squares(group["tokens"].to_numpy(), group["capacity"][0].as_py())
    return group.select(["spec_id", "capacity", "doc_id", "piece", "tokens", "shard"]).append_column("at", pa.array(at))


def _pack_bins(group: pa.Table) -> pa.Table:
    group = group.combine_chunks().sort_by([("shard", "ascending"), ("at", "ascending")])
    at = sum_of_squares(group["tokens"].to_numpy(), group["capacity"][0].as_py())
    wide = group["wide"][0].as_py()
    return group.select(["spec_id", "shard", "at"]).append_column("joined", pa.array([f"w-{wide}-{a}" for a in at], pa.string()))


def fill_report(packed: DataFrame, specs: list[tuple[int, int]]) -> DataFrame:
    """``spec_id, capacity, containers, tokens, least, filled``: ``least`` is the least number of containers that could do."""
    capacity = F.element_at(F.create_map(*[F.lit(x) for s in specs for x in s]), F.col("spec_id"))
    used = packed.filter("container is not null").groupBy("spec_id").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    out = used.withColumn("capacity", capacity)
    return out.select("spec_id", "capacity", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("filled"))
