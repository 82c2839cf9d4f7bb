"""Most frequent items in bounded memory: mergeable Misra-Gries summaries.

Every partition keeps at most ``capacity`` counters. A batch is counted
exactly, added to the counters, and the next-largest counter (the one at place
``capacity`` + 1) is subtracted from all; what reaches zero is dropped. Two
summaries merge in the same way. An item's counter is below its true count by
at most the sum of what was subtracted, which is at most rows / (capacity + 1).
So every item with a larger share of the rows is among the counters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Summaries merged by one task.
FAN_IN = 32
_SUMMARY = "part bigint, item string, counter bigint, lost bigint, rows bigint"


class Summary:
    """Counters of one partition; ``lost`` bounds how much each may be too low."""

    def __init__(self, capacity: int):
        self.capacity, self.lost, self.rows = capacity, 0, 0
        self.table = pa.table({"item": pa.array([], pa.string()), "counter": pa.array([], pa.int64())})

    def add(self, items: pa.Array, counts: pa.Array, lost: int, rows: int) -> None:
        """Adds counters, for a batch its exact counts with ``lost`` 0."""
        both = pa.concat_tables([self.table, pa.table({"item": items.cast(pa.string()), "counter": counts})])
        both = both.group_by("item").aggregate([("counter", "sum")]).rename_columns(["item", "counter"])
        self.lost, self.rows = self.lost + lost, self.rows + rows
        if both.num_rows > self.capacity:
            order = pc.sort_indices(both, [("counter", "descending"), ("item", "ascending")])
            cut = both["counter"][order[self.capacity].as_py()].as_py()
            both = both.set_column(1, "counter", pc.subtract(both["counter"], cut)).filter(pc.field("counter") > 0)
            self.lost += cut
        self.table = both.combine_chunks()

    def out(self, part: int) -> pa.RecordBatch:
        """The counters, and a row with a null item that carries ``lost`` and ``rows`` in any case."""
        n = self.table.num_rows
        item = pa.concat_arrays([*self.table["item"].chunks, pa.nulls(1, pa.string())])
        counter = pa.concat_arrays([*self.table["counter"].chunks, pa.array([0], pa.int64())])
        one = lambda v: pa.array([0] * n + [v], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([part] * (n + 1), pa.int64()), item, counter, one(self.lost), one(self.rows)], ["part", "item", "counter", "lost", "rows"])


def misra_gries(df: DataFrame, item: str, capacity: int) -> DataFrame:
    """``item, counter, lost, rows`` of the merged summary: at most ``capacity`` rows.

    Null items are not counted; an empty table gives no rows. ``counter`` <= true count <=
    ``counter + lost``. Merging goes in rounds of ``FAN_IN`` summaries, so no
    task reads more than ``FAN_IN * capacity`` counters at any input size.
    """
    one = df.select(F.col(item).cast("string").alias("item")).filter("item is not null")
    # Written, so that the rounds go by the summaries there are, and none is made again.
    parts = materialize(one.mapInArrow(_summarize(capacity), _SUMMARY), "summaries")
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        grouped = parts.withColumn("part", F.floor(F.col("part") / FAN_IN))
        parts = grouped.groupBy("part").applyInArrow(_merge(capacity), _SUMMARY)
        left = -(-left // FAN_IN)
    # The only task of the last round holds one summary; its totals lie in the row without item.
    return parts.repartition(1).mapInArrow(_totals, "item string, counter bigint, lost bigint, rows bigint")


def _summarize(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s = Summary(capacity)
        for b in batches:
            counted = pc.value_counts(b.column(0))
            s.add(counted.field("values"), counted.field("counts"), 0, b.num_rows)
        yield s.out(TaskContext.get().partitionId())

    return run


def _merge(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        s, part = Summary(capacity), group["part"][0].as_py()
        total = group.filter(pc.is_null(group["item"]))
        held = group.filter(pc.is_valid(group["item"]))
        s.add(held["item"].combine_chunks(), held["counter"].combine_chunks(), pc.sum(total["lost"]).as_py(), pc.sum(total["rows"]).as_py())
        return pa.Table.from_batches([s.out(part)])

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(batches), schema=pa.schema([("part", pa.int64()), ("item", pa.string()), ("counter", pa.int64()), ("lost", pa.int64()), ("rows", pa.int64())]))
    total = t.filter(pc.is_null(t["item"]))
    lost, rows = (pc.sum(total[c]).as_py() or 0 for c in ("lost", "rows"))
    held = t.filter(pc.is_valid(t["item"]))
    n = held.num_rows
    for b in pa.table({"item": held["item"], "counter": held["counter"], "lost": pa.array([lost] * n, pa.int64()), "rows": pa.array([rows] * n, pa.int64())}).to_batches():
        yield b


def frequent_items(df: DataFrame, item: str, share: float, oversample: int = 8) -> DataFrame:
    """``item, count, rows``: items with at least ``share`` of the non-null rows, counted exactly.

    The summary keeps ``oversample / share`` counters, so each reached item is
    a candidate; a second pass counts only the candidates, of which there are
    at most ``2 / share`` (their counts sum to no more than the rows), so they
    are broadcast.
    """
    found = misra_gries(df, item, int(oversample / share))
    near = found.filter((F.col("counter") + F.col("lost")) >= F.lit(share) * F.col("rows")).select("item", "rows")
    all_rows = df.select(F.col(item).cast("string").alias("item")).filter("item is not null")
    counted = all_rows.join(F.broadcast(near), "item").groupBy("item", "rows").agg(F.count("*").alias("count"))
    return counted.filter(F.col("count") >= F.lit(share) * F.col("rows")).select("item", "count", "rows")
