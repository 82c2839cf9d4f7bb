"""Mixing sources to target shares by weighted sampling without replacement.

Each source gets a budget of tokens. As many complete epochs as fit come first;
the rest is filled in the order of exponential keys -ln(u) / weight, where u is a
hash of the document and the weight its quality, up to the budget. Order and
prefix sums are distributed: each source's keys are cut into ranges of about equally many
documents, at approximate quantiles of the keys themselves, the tokens of the ranges are summed, and only
the one range per source in which the budget ends is looked at row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Key ranges per source, and the relative error of their bounds' ranks.
RANGES, ACCURACY = 1 << 11, 1 << 14


def source_name(source: Column) -> Column:
    """Spelling variants of a source as one name: lower case, blanks and hyphens as underscores; null stays null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(source)), r"[\s\-_]+", "_"), F.lit(""))


def budgets(available: DataFrame, targets: DataFrame, total: int | None = None, reach: bool = False) -> list[dict]:
    """A dict per target source with its budget in tokens.

    ``available``: ``source, tokens``; ``targets``: ``source, target_share, max_repeats``. Both have a row per source, few by nature.
    Shares of sources without texts go to the others in proportion. ``total`` is the size of the selection, by default
    that of all texts of the target sources or, with ``reach``, the largest at which every source reaches its share. A
    source that cannot reach its share stays at its repeats, and what it lacks is shared out among the rest by their targets.
    """
    have = {r["source"]: r["tokens"] for r in available.join(targets.select(source_name(F.col("source")).alias("source")), "source", "left_semi").collect()}
    rows = []
    for r in targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").collect():
        tokens = have.get(r["source"]) or 0
        rows.append({"source": r["source"], "target_share": float(r["target_share"] or 0), "max_repeats": int(r["max_repeats"] or 0), "available": tokens})
    for r in rows:
        r["cap"] = r["available"] * max(0, r["max_repeats"])
    live = [r for r in rows if r["cap"] > 0 and r["target_share"] > 0]
    if total is None and reach:
        whole = sum(r["target_share"] for r in live)
        total = min((r["cap"] * whole / r["target_share"] for r in live), default=0)
    elif total is None:
        total = sum(r["available"] for r in live)
    left, open_rows = float(total), list(live)
    for r in rows:
        r["budget"] = 0.0
    while open_rows:
        weight = sum(r["target_share"] for r in open_rows)
        full = [r for r in open_rows if left * r["target_share"] / weight > r["cap"]]
        if not full:
            for r in open_rows:
                r["budget"] = left * r["target_share"] / weight
            break
        for r in full:
            r["budget"] = float(r["cap"])
            left -= r["cap"]
            open_rows.remove(r)
    for r in rows:
        r["epochs"] = min(r["max_repeats"], int(r["budget"] / r["available"] + 1e-9)) if r["available"] else 0
        r["rest"] = r["budget"] - r["epochs"] * r["available"] if r["epochs"] < r["max_repeats"] else 0.0
    return rows


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, reach: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(selection, shares)``.

    ``docs``: ``doc_id, tokens, quality, source``. ``selection``: ``doc_id, source, tokens, repeats``, repeats of at
    least 1 and at most the source's ``max_repeats``. ``shares``: a row per target source with its budget and actual share.
    ``total`` and ``reach`` are those of ``budgets``. Documents of sources without target, of
    null source, and without tokens are not selected. Weights are the quality, at least 0.01; ``tokens.text_quality`` is one, any column of a
    table's own may take its place.
    """
    spark = docs.sparkSession
    held = docs.filter("tokens > 0").select("doc_id", source_name(F.col("source")).alias("source"), F.col("tokens").cast("bigint").alias("tokens"), F.greatest(F.coalesce("quality", F.lit(0.0)), F.lit(0.01)).alias("weight"))
    # A uniform number from the id, then the exponential key.
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = held.withColumn("key", -F.log(u) / F.col("weight"))
    keyed = materialize(keyed.select("doc_id", "source", "tokens", "key"), "keyed")
    rows = budgets(keyed.groupBy("source").agg(F.sum("tokens").alias("tokens")), targets, total, reach)
    plan = spark.createDataFrame([(r["source"], r["target_share"], r["max_repeats"], r["available"], r["budget"], r["epochs"], r["rest"]) for r in rows], "source string, target_share double, max_repeats int, available bigint, budget double, epochs int, rest double")
    # Bounds of the ranges of the sources with a target: ``RANGES`` numbers each, from sketches of bounded size.
    cuts = [i / RANGES for i in range(1, RANGES)]
    bounds = keyed.join(F.broadcast(plan.filter("rest > 0").select("source")), "source", "left_semi").groupBy("source").agg(F.percentile_approx("key", cuts, ACCURACY).alias("cuts"))
    bounds = {r["source"]: np.unique(r["cuts"]) for r in bounds.collect()}
    shared = spark.sparkContext.broadcast(bounds)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources, keys = b.column(1).to_pylist(), b.column(3).to_numpy()
            at = np.zeros(len(keys), np.int32)
            for source in set(sources) & shared.value.keys():
                own = np.array([s == source for s in sources])
                at[own] = np.searchsorted(shared.value[source], keys[own], side="left")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], [*b.schema.names, "range"])

    keyed = keyed.select("doc_id", "source", "tokens", "key").mapInArrow(place, "doc_id bigint, source string, tokens bigint, key double, range int")
    sums = keyed.groupBy("source", "range").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))).join(F.broadcast(plan.select("source", "rest")), "source")
    # Of a source's ranges one at most holds the end of the rest; those before are taken whole.
    ends = ranges.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("sum") >= F.col("rest"))).select("source", F.col("range").alias("last"), "before")
    marks = plan.join(ends, "source", "left").select("source", "epochs", "rest", "last", "before")
    rated = keyed.join(F.broadcast(marks), "source")
    inner = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    at_end = rated.filter("range = last").withColumn("to", F.col("before") + F.sum("tokens").over(inner))
    # The document in which the rest ends is taken if that comes nearer.
    at_end = at_end.withColumn("taken", F.col("to") - F.col("tokens") / 2 <= F.col("rest")).select("doc_id", "source", "tokens", "epochs", "taken")
    others = rated.filter("range <> last or last is null").withColumn("taken", (F.col("rest") > 0) & (F.col("last").isNull() | (F.col("range") < F.col("last"))))
    both = others.select("doc_id", "source", "tokens", "epochs", "taken").union(at_end)
    selection = both.withColumn("repeats", F.col("epochs") + F.col("taken").cast("int")).filter("repeats > 0").select("doc_id", "source", "tokens", "repeats")
    selection = materialize(selection, "mixed")
    used = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    share = F.round(F.coalesce("tokens", F.lit(0)) / F.sum("tokens").over(Window.partitionBy()), 6)
    shares = plan.join(used, "source", "left").select("source", "target_share", share.alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "available", "max_repeats", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce("documents", F.lit(0)).alias("documents"))
    return selection, shares
