"""Frequencies of all terms by burst tries.

A burst trie keeps terms in containers, each under a prefix; a container that
grows past its capacity bursts into one container per next character. Here a trie is held
as one sorted table, in which every node, inner or container, is a range of rows; bursting a node finds the
places where the next character changes, so no step of it is a loop over terms.

The routing trie is burst from a sample of the terms, so all workers agree on the
subtrees; it only decides which task merges what. Each worker fills tries from its share of the distinct (term, file)
pairs and hands on one counter row per term, under the route of its container. The worker that owns a route
merges the matching subtrees: their rows come sorted by route and term, so equal terms lie together and
a subtree of any size passes through in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .postings import distinct_postings

#: Terms sampled for the routing trie per container of it, and containers per shuffle partition: they only balance the tasks.
SAMPLE, ROUTES = 50, 8
#: Characters of the longest route.
DEEPEST = 64
_COUNTERS = "route string, term string, occurrences bigint, files bigint"
_COUNTER_SCHEMA = pa.schema([("route", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("files", pa.int64())])


class BurstTrie:
    """Term -> occurrences and files. ``terms``: sorted, different; ``prefixes``, ``starts``: the containers in order.

    ``inner``: prefixes that are burst in any case, as those of a routing trie. A container of a prefix p holds the terms that
    start with p; the term equal to an inner prefix has a container of its own.
    """

    def __init__(self, table: pa.Table, capacity: int, inner: frozenset[str] = frozenset()):
        self.table = table.group_by("term").aggregate([("occurrences", "sum"), ("files", "sum")]).rename_columns(["term", "occurrences", "files"]).sort_by("term").combine_chunks()
        self.prefixes, self.starts = self._burst(capacity, inner)

    def _burst(self, capacity: int, inner: frozenset[str]) -> tuple[list[str], np.ndarray]:
        terms, n = pa.concat_arrays(self.table["term"].chunks) if self.table.num_rows else pa.array([], pa.string()), self.table.num_rows
        prefixes: list[str] = []
        starts: list[int] = []
        nodes = [(0, n, "", False)] if n else []
        while nodes:
            low, high, prefix, whole = nodes.pop()
            if whole or prefix not in inner and high - low <= capacity:
                prefixes.append(prefix)
                starts.append(low)
                continue
            # What the first and the last of sorted terms share, all share: a path without branches is passed at once.
            first, last = terms[low].as_py(), terms[high - 1].as_py()
            shared = next((k for k, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))
            runs = pc.run_end_encode(pc.utf8_slice_codeunits(terms.slice(low, high - low), 0, shared + 1))
            ends = runs.run_ends.to_pylist()
            children = list(zip([0, *ends[:-1]], ends, runs.values.to_pylist()))
            # A child no longer than what all share is the term that ends here.
            nodes += [(low + a, low + b, p, len(p) <= shared) for a, b, p in reversed(children)]
        return prefixes, np.array(starts, np.int64)

    def routes(self, inner: frozenset[str]) -> pa.Array:
        """The route of every term, found once per container: its first prefix that is not inner to the routing trie."""
        named = []
        for p in self.prefixes:
            k = 0
            while k < len(p) and p[:k] in inner:
                k += 1
            named.append(p[:k])
        count = np.diff(np.append(self.starts, self.table.num_rows))
        return pa.array(named, pa.string()).take(pa.array(np.repeat(np.arange(len(named)), count)))


def routing_trie(spark: SparkSession, terms: DataFrame, routes: int | None = None, sample: int = SAMPLE) -> frozenset[str]:
    """Inner prefixes of a trie burst from about ``sample`` terms per route, to be shared by all workers.

    ``routes``: by default ``ROUTES`` per shuffle partition, so their number follows the size of the cluster's work. The
    sample steers the balance alone; every term is counted whatever its route.
    """
    routes = routes or ROUTES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = terms.count()  # from the files' footers
    seen = terms.select("term").filter("term is not null and term <> ''").sample(min(1.0, sample * routes / max(1, rows)), seed=7).toPandas()["term"]
    # Occurrences weigh, so a hot term gets a route of its own.
    inner: set[str] = set()
    open_nodes, capacity = {"": sorted(seen)}, max(1, sample // 4)
    while open_nodes:
        deeper: dict[str, list[str]] = {}
        for prefix, held in open_nodes.items():
            if len(held) > capacity and held[0] != held[-1] and len(prefix) < DEEPEST:
                inner.add(prefix)
                for t in held:
                    if len(t) > len(prefix):
                        deeper.setdefault(t[: len(prefix) + 1], []).append(t)
        open_nodes = deeper
    return frozenset(inner)


def term_counts(spill: DataFrame, capacity: int = 4096, routes: int | None = None) -> DataFrame:
    """``term, occurrences, files`` of every term; see ``distinct_postings`` for repeats and nulls.

    ``capacity``: terms in a container. A worker hands its trie on once it
    holds 64 containers' worth of rows, and merges in batches, so its memory has a bound at any input and any skew of prefixes.
    """
    spark = spill.sparkSession
    pairs = distinct_postings(spill).select("term", "freq")
    inner = spark.sparkContext.broadcast(routing_trie(spark, spill, routes))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            counted = pa.Table.from_batches([b]).group_by("term").aggregate([("freq", "sum"), ("freq", "count")]).rename_columns(["term", "occurrences", "files"])
            held.append(counted)
            rows += counted.num_rows
            if rows > 64 * capacity:
                yield from _hand_on(BurstTrie(pa.concat_tables(held), capacity, inner.value), inner.value)
                held, rows = [], 0
        if held:
            yield from _hand_on(BurstTrie(pa.concat_tables(held), capacity, inner.value), inner.value)

    parts = pairs.mapInArrow(fill, _COUNTERS)
    return parts.repartition("route").sortWithinPartitions("route", "term").mapInArrow(_merge, "term string, occurrences bigint, files bigint")


def _hand_on(trie: BurstTrie, inner: frozenset[str]) -> Iterator[pa.RecordBatch]:
    t = trie.table
    out = pa.table([trie.routes(inner), t["term"], t["occurrences"], t["files"]], schema=_COUNTER_SCHEMA)
    yield from out.to_batches(max_chunksize=20_000)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up equal terms of sorted rows; the last term of a batch may go on in the next."""
    left: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]).select(["term", "occurrences", "files"])
        t = t if left is None else pa.concat_tables([left, t])
        runs = pc.run_end_encode(pa.concat_arrays(t["term"].chunks))
        starts = np.concatenate([[0], runs.run_ends.to_numpy()[:-1]])
        sums = [pa.array(np.add.reduceat(t[c].to_numpy(), starts)) for c in ("occurrences", "files")]
        t = pa.table([runs.values, *sums], ["term", "occurrences", "files"])
        left = t.slice(t.num_rows - 1)
        yield from t.slice(0, t.num_rows - 1).combine_chunks().to_batches()
    if left is not None:
        yield from left.combine_chunks().to_batches()


def marked(counts: DataFrame, n_files: int, rare_below: int = 3, common_share: float = 0.45) -> DataFrame:
    """Adds ``mark``: ``rare`` in fewer than ``rare_below`` files, ``common`` in more than ``common_share`` of ``n_files``, else null."""
    mark = F.when(F.col("files") < rare_below, "rare").when(F.col("files") > F.lit(common_share) * F.lit(n_files), "common")
    return counts.withColumn("mark", mark)
