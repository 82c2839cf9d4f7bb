"""Problems 1 to 3: frequent items, term scores, term counts."""

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from textloom.llm import burst_trie, distinctive, heavy_hitters

SPILL = "term string, file_id bigint, freq int, n string, count string, df int"


def spill(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SPILL)


def test_misra_gries_bounds():
    rng = random.Random(1)
    items = [f"t{int(rng.paretovariate(0.7))}" for _ in range(20_000)]
    truth = Counter(items)
    parts = []
    for i in range(0, len(items), 5000):
        s = heavy_hitters.Summary(40)
        for j in range(i, i + 5000, 700):
            c = Counter(items[j : min(j + 700, i + 5000)])
            s.add(pa.array(list(c)), pa.array(list(c.values())), 0, sum(c.values()))
        parts.append(s)
    whole = heavy_hitters.Summary(40)
    for s in parts:
        whole.add(s.table["item"].combine_chunks(), s.table["counter"].combine_chunks(), s.lost, s.rows)
    assert whole.rows == 20_000 and whole.table.num_rows <= 40 and whole.lost <= 20_000 / 41
    held = dict(zip(whole.table["item"].to_pylist(), whole.table["counter"].to_pylist()))
    for item, n in truth.items():
        assert held.get(item, 0) <= n <= held.get(item, 0) + whole.lost


def test_frequent_items(spark):
    rng = random.Random(2)
    terms = [f"t{int(rng.paretovariate(0.8))}" for _ in range(5000)] + [None] * 100 + ["tie1", "tie2"] * 60
    rng.shuffle(terms)
    df = spark.createDataFrame([(t, i, "c") for i, t in enumerate(terms)], "item string, rows bigint, counter string").repartition(5)
    truth = Counter(t for t in terms if t)
    n = sum(truth.values())
    got = {r["item"]: (r["count"], r["rows"]) for r in heavy_hitters.frequent_items(df, "item", 0.01).collect()}
    assert got == {t: (c, n) for t, c in truth.items() if c >= 0.01 * n} and {"tie1", "tie2"} <= set(got)


@pytest.mark.parametrize("values", [[], [None, None]])
def test_frequent_items_of_nothing(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "item string")
    assert heavy_hitters.frequent_items(df, "item", 0.01).collect() == []
    assert heavy_hitters.misra_gries(df, "item", 10).collect() == []


def postings(seed, files=60):
    rng = random.Random(seed)
    rows = []
    for f in range(files):
        for t in {f"w{int(rng.paretovariate(0.6))}" for _ in range(30)} | {"hot"}:
            row = (t, f, rng.choice([1, 2, 5, None]))
            rows += [row] * rng.choice([1, 1, 1, 3])
    return rows + [(None, 1, 2), ("", 1, 2), ("ghost", None, 1)]


def distinct(rows):
    return {(t, f): q or 1 for t, f, q in rows if t and f is not None}


def test_scores(spark):
    rows = postings(3)
    docs = [(f, 40 + f, "2031-01-02 00:00:00", "x") for f in range(50)] + [(5, 1, "2030-01-01 00:00:00", "x"), (6, None, "2032-01-01 00:00:00", "x")] + [(99, 10, "2031-01-01 00:00:00", "x")] * 2
    d = spark.createDataFrame(docs, "file_id bigint, doc_length bigint, indexed_at string, term string")
    pairs = distinct(rows)
    length = defaultdict(int)
    for (_, f), q in pairs.items():
        length[f] += q
    length |= {f: n for f, n, _, _ in docs[:50] if f != 6} | {99: 10}
    df = Counter(t for t, _ in pairs)
    n, average = len(length), sum(length.values()) / len(length)
    want = {(f, t): math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * q * 2.2 / (q + 1.2 * (0.25 + 0.75 * length[f] / average)) for (t, f), q in pairs.items()}
    got = {(r["file_id"], r["term"]): r["score"] for r in distinctive.term_scores(spill(spark, rows), d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    probe = spark.createDataFrame([(3,), (3,), (7,), (1234,), (None,)], "file_id bigint")
    some = distinctive.term_scores(spill(spark, rows), d, probe)
    assert {(r["file_id"], r["term"]): r["score"] for r in some.collect()} == pytest.approx({k: v for k, v in got.items() if k[0] in (3, 7)})
    for r in distinctive.top_term(some).collect():
        assert r["term"] == min((-s, t) for (f, t), s in want.items() if f == r["file_id"])[1]


def test_scores_of_nothing(spark):
    d = spark.createDataFrame([], "file_id bigint, doc_length bigint, indexed_at string")
    assert distinctive.term_scores(spill(spark, []), d).collect() == []


def counters(terms):
    return pa.table({"term": pa.array(terms, pa.string()), "occurrences": pa.array([2] * len(terms), pa.int64()), "files": pa.array([1] * len(terms), pa.int64())})


def test_burst_trie():
    rng = random.Random(4)
    terms = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(4000)]
    inner = frozenset(["", "a", "ab", "é"])
    for routing in (frozenset(), inner):
        trie = burst_trie.BurstTrie(counters(terms), 8, routing)
        held = trie.table.to_pylist()
        assert {r["term"]: (r["occurrences"], r["files"]) for r in held} == {t: (2 * n, n) for t, n in Counter(terms).items()}
        ends = [*trie.starts[1:].tolist(), len(held)]
        for prefix, low, high in zip(trie.prefixes, trie.starts.tolist(), ends):
            assert low < high <= low + 8 and all(r["term"].startswith(prefix) for r in held[low:high])
            assert prefix not in routing or high == low + 1
        for r, route in zip(held, trie.routes(routing).to_pylist()):
            t = r["term"]
            assert route == next((t[:k] for k in range(len(t)) if t[:k] not in routing), t)
    long = burst_trie.BurstTrie(counters(["x" * 30_000 + "a", "x" * 300 + "b", "x" * 300]), 1)
    assert long.prefixes == ["x" * 300, "x" * 300 + "b", "x" * 301]
    assert burst_trie.BurstTrie(counters([]), 4).prefixes == []


def test_merge_holds_one_batch():
    # A million different terms under one route, in batches; what is held over is one row.
    batches = (pa.RecordBatch.from_arrays([pa.array(["r"] * 10_000), pa.array([f"t{i // 2:09d}" for i in range(k, k + 10_000)]), pa.array([3] * 10_000), pa.array([1] * 10_000)], ["route", "term", "occurrences", "files"]) for k in range(1, 1_000_001, 10_000))
    seen, last = 0, ""
    for b in burst_trie._merge(batches):
        for t, o, f in zip(*(c.to_pylist() for c in b.columns)):
            assert t > last and (o, f) == ((3, 1) if t in ("t000000000", "t000500000") else (6, 2))
            seen, last = seen + 1, t
    assert seen == 500_001


def test_term_counts(spark):
    rows = postings(5) + [("w" * 5000, 1, 1), ("A", 1, 1), ("a", 1, 1)]
    pairs = distinct(rows)
    got = {r["term"]: (r["occurrences"], r["files"]) for r in burst_trie.term_counts(spill(spark, rows).repartition(6), capacity=4).collect()}
    files, occurrences = Counter(t for t, _ in pairs), Counter()
    for (t, _), q in pairs.items():
        occurrences[t] += q
    assert got == {t: (occurrences[t], n) for t, n in files.items()}
    assert got == {r["term"]: (r["occurrences"], r["files"]) for r in burst_trie.term_counts(spill(spark, rows), routes=3).collect()}
    marks = {r["term"]: r["mark"] for r in burst_trie.marked(burst_trie.term_counts(spill(spark, rows)), 60).collect()}
    assert marks == {t: "rare" if n < 3 else "common" if n > 27 else None for t, n in files.items()}


def test_term_counts_of_nothing(spark):
    assert burst_trie.term_counts(spill(spark, [])).collect() == []
    assert burst_trie.term_counts(spill(spark, [(None, 1, 1), ("", 2, 1)])).collect() == []
