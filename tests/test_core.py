import random
import string
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom import queries
from textloom.functions import codec, lexers, text, vectors
from textloom.operators import terms as T
from textloom.plans import build, project
from textloom.sources import tree

DATA = "/root/testdata/sf0.001"


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_words(spark):
    out = column(spark, ["foo_bar foo-bar Foo", "", "--- ...", "a�b", "Ⅰ ा ² Ⓐ", None], "string", text.words)
    assert out == [["foo_bar", "foo", "bar", "Foo"], [], [], ["a", "b"], ["Ⅰ", "ा", "²", "Ⓐ"], None]


def test_json_keys(spark):
    cases = ['{"a":{"b":[{"a":1,"c":":"}]},"a":2}', '["x", ":"]', r'{"foo\nbar":1,"":2}', '{"a": 1, "b": ']
    out = column(spark, cases, "string", text.json_keys)
    assert [sorted(o) for o in out] == [["a", "a", "a", "b", "c"], [], ["foobar"], ["a", "b"]]


def test_varint(spark):
    values = [0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**40 + 5, 2**62]
    assert column(spark, values, "bigint", codec.varint_hex) == [codec.encode_varint(v).hex().upper() for v in values]


@given(st.integers(0, 2**64 - 1))
def test_varint_round_trip(v):
    assert codec.decode_varint(codec.encode_varint(v)) == (v, len(codec.encode_varint(v)))


def test_fnv(spark):
    cases = ["", "a", "foobar", "/héllo/wörld", "日本"]
    out = column(spark, cases, "string", codec.fnv1a64_hex)
    assert out == [f"{project.fnv1a64(c.encode()):016x}" for c in cases]
    assert out[:3] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]


def test_blocks(spark):
    row = spark.sql("select array(named_struct('file_id', 3L, 'tf', 2L), named_struct('file_id', 10L, 'tf', 1L)) p, array(named_struct('term', 'a', 'tf', 1), named_struct('term', 'bc', 'tf', 2)) f, cast(null as array<struct<term:string,tf:int>>) n, 'a.py' d")
    out = row.select(codec.postings_block_hex(F.col("p")), codec.forward_block_hex(F.col("f")), codec.forward_block_hex(F.col("n")), codec.docs_entry_hex(F.col("d"), F.lit(300))).first()
    assert list(out) == ["0203020701", "0201610102626302", "00", "04612E7079AC02"]


def test_extension_and_filters(spark):
    paths = ["a.py", "A.PY", "x/.hid", "noext", "a.b.Rs", "d.x/y", "a.Kt", "b .md"]
    assert column(spark, paths, "string", text.extension) == ["py", "py", "", "", "rs", "", "Kt", "md"]
    out = column(spark, ["a/out/x", "a/outer/x", "q/gen1/x", "gen/x", "lib/a.py"], "string", lambda c: text.is_excluded(c, ["out", "!q/*"]))
    assert out == [True, False, True, False, False]


def test_binary_and_lossy(spark):
    rows = spark.createDataFrame([(bytearray(b"a\xffb"),), (bytearray(b"a\0"),), (bytearray(b""),), (bytearray(b"\xff\xfea\0"),), (bytearray(b"%PDF-1"),), (bytearray(b"a" * 1024 + b"\0"),), (bytearray(b"\xef\xbb\xbfa\0"),)], "content binary")
    got = [tuple(r) for r in rows.select(text.is_binary(F.col("content")), text.lossy_text(F.col("content")), "content").collect()]
    assert [g[:2] for g in got[:3]] == [(False, "a�b"), (True, "a\0"), (False, "")]
    assert [g[0] for g in got[3:]] == [False, True, False, False]
    assert [text.looks_binary(bytes(g[2])) for g in got] == [g[0] for g in got]


@pytest.mark.parametrize(
    ("language", "source", "want"),
    [
        ("python", "import os # no\nx = f'{y} z'\nclass A: pass", {"os": 1, "x": 1, "y": 1, "A": 1}),
        ("javascript", "let a = `t ${b}`; // c\nfoo.bar('q', /x/g);", {"a": 1, "b": 1, "foo": 1, "bar": 1}),
        ("rust", "fn f<'a>(x: &'a T) { let s = r#\"q\"#; /* a /* b */ c */ }", {"f": 1, "x": 1, "T": 1, "s": 1}),
        ("go", "package p\nfunc F(a B) { c := `d` }", {"p": 1, "F": 1, "a": 1, "B": 1, "c": 1}),
        ("java", "class A { char c = '\"'; B d; }", {"A": 1, "c": 1, "B": 1, "d": 1}),
        ("kotlin", 'val a = "x ${b} $c"', {"a": 1, "b": 1, "c": 1}),
        ("toml", 'a.b = 1\n["q r"]\n[[t]]\nx = [1, "y"]\nz = { k = 2 }', {"a": 1, "b": 1, '"q r"': 1, "t": 1, "x": 1, "z": 1, "k": 1}),
        ("xml", '<a b="c"><d/>&amp;</a><!-- <e> -->', {"a": 2, "b": 1, "d": 1, "amp": 1}),
    ],
)
def test_identifiers(language, source, want):
    assert dict(lexers.identifiers(language, source)) == want


@pytest.mark.parametrize("language", lexers.PATTERNS)
def test_lexers_take_anything(language):
    rng = random.Random(1)
    for _ in range(50):
        body = "".join(rng.choice("\"'`/*{}()[]\\\n #abc1.=<>$é") for _ in range(200))
        assert "".join(t for _, t, _ in lexers.tokenize(language, body)) == "".join(t for _, t, _ in lexers.tokenize(language, body))
        lexers.identifiers(language, body)


def test_pooling():
    class Ids:
        pass

    m = vectors.TokenTable(np.array([[3, 0], [0, 4], [1, 1], [9, 9]]), None, 3, 10)
    assert np.allclose(m.pool([0, 1]), [0.6, 0.8])
    assert not m.pool([3]).any() and not m.pool([]).any() and not m.pool([99]).any()
    assert np.allclose(m.pool([0, 99, 3]), [1, 0])
    assert vectors.upper_median([1, 2, 3, 4]) == 3 and vectors.upper_median([]) == 1


def test_f16_round_trip(spark):
    rows = spark.createDataFrame([([0.5, -1.0],), (None,)], "v array<float>")
    assert [r[0] for r in rows.select(vectors.from_f16(vectors.to_f16(F.col("v")))).collect()] == [[0.5, -1.0], None]


def test_dense_ids_and_offsets(spark):
    names = ["".join(random.Random(i).choices(string.ascii_letters, k=6)) + str(i) for i in range(500)]
    df = spark.createDataFrame([(n, len(n)) for n in names], "path string, n int").repartition(7)
    got = {r["path"]: r["file_id"] for r in T.dense_ids(df, ["path"]).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}
    total = 0
    for r in sorted(T.running_offset(df, ["path"], F.col("n")).collect(), key=lambda r: r["path"]):
        assert r["offset"] == total
        total += r["n"]


def test_tree_build(spark, tmp_path):
    root = tmp_path / "tree"
    for path, body in {
        "a.py": b"x = y", "A2.PY": b"x", "pkg/__init__.py": b"", "pkg/_u.py": b"u", ".hid/b.py": b"h", "pkg/.c.py": b"c", "out/x.py": b"o", "config/y.json": b"{}",
        "noext": b"n", "x.yaml": b"n", "empty.txt": b"", "bad.txt": b"a\xffb", "nul.json": b"\0", "k.json": b'{"k": {"l": 1}}',
    }.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(body)
    s = build.build_index(spark, str(root), str(tmp_path / "store"))
    assert (s.indexed, s.skipped) == (7, 1)
    gen = s.project.current()
    docs = {r["path"]: (r["file_id"], r["doc_length"]) for r in spark.read.parquet(f"{gen}/docs").collect()}
    assert docs == {p: (i, n) for i, (p, n) in enumerate([("A2.PY", 1), ("a.py", 2), ("bad.txt", 2), ("empty.txt", 0), ("k.json", 2), ("pkg/__init__.py", 0), ("pkg/_u.py", 1)])}
    post, forward = (spark.read.parquet(f"{gen}/{t}").select("file_id", "term", "tf") for t in ("postings", "forward"))
    assert post.exceptAll(forward).isEmpty() and forward.exceptAll(post).isEmpty()
    again = build.build_index(spark, str(root), str(tmp_path / "store"))
    assert again.project.current() != gen and not Path(gen).exists()
    build.export_blocks(spark, again.project.current(), str(tmp_path / "blocks"))
    assert spark.read.parquet(str(tmp_path / "blocks/forward")).count() == 7


def test_project_collision(spark, tmp_path):
    (tmp_path / "r").mkdir()
    p = project.Project.resolve(str(tmp_path / "r"), str(tmp_path / "s"), spark)
    project.Project.resolve(str(tmp_path / "r"), str(tmp_path / "s"), spark)
    p.store.write(f"{p.index_dir}/{project.SIDECAR}", "/other")
    with pytest.raises(ValueError):
        project.Project.resolve(str(tmp_path / "r"), str(tmp_path / "s"), spark)
    with pytest.raises(FileNotFoundError):
        project.Project.resolve(str(tmp_path / "none"), str(tmp_path / "s"), spark)


def test_publish_leaves_runs_under_way(spark, tmp_path):
    p = project.Project.resolve(str(tmp_path), str(tmp_path / "s"), spark)
    first, running, second = (p.new_generation() for _ in range(3))
    for g in (first, running, second):
        p.store.write(f"{g}/part", "x")
    assert p.current() is None
    p.publish(first)
    assert p.current() == first
    p.publish(second)
    assert p.current() == second and p.store.exists(running) and not p.store.exists(first)


def test_failed_build_leaves_the_published_generation(spark, tmp_path, monkeypatch):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("x = 1")
    s = build.build_index(spark, str(root), str(tmp_path / "store"))
    monkeypatch.setattr(build.T, "term_stats", lambda tf: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        build.build_index(spark, str(root), str(tmp_path / "store"))
    assert len(list(Path(s.project.index_dir).glob("gen=*"))) == 1 and spark.read.parquet(f"{s.project.current()}/docs").count() == 1


@pytest.mark.parametrize("fan_out", [1, 3, 1000])
def test_tree_is_listed_by_tasks(spark, tmp_path, fan_out):
    want = set()
    for i in range(5):
        for j in range(4):
            at = tmp_path / f"d{i}" / f"e{j}"
            at.mkdir(parents=True)
            (at / "f.py").write_text("x")
            want.add(f"d{i}/e{j}/f.py")
    (tmp_path / "g.md").write_text("x")
    got = [r["path"] for r in tree.read_tree(spark, str(tmp_path), fan_out=fan_out).collect()]
    assert sorted(got) == sorted(want | {"g.md"})


def test_ignore_files(tmp_path):
    for path in ("a.py", "gen/a.py", "x/gen/b.py", "x/keep.py", "x/drop.py", "x/y/z.md", "x/y/drop.py", "only.txt", "x/only.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    (tmp_path / ".gitignore").write_text("# c\n/gen/\n*.md\n!x/y/z.md\n/only.txt\n")
    (tmp_path / "x/.ignore").write_text("drop.py\n")
    assert {p for p, _ in tree.walk(str(tmp_path), (), ignore_files=True)} == {"a.py", "x/gen/b.py", "x/keep.py", "x/y/z.md", "x/only.txt"}
    assert len(list(tree.walk(str(tmp_path), ()))) == 9


def test_postings_across_id_ranges(spark):
    rng = random.Random(5)
    rows = [(i, t, rng.randint(1, 300)) for t in ("hot", "b", "c") for i in sorted(rng.sample(range(3000), 700 if t == "hot" else 5))] + [(0, "z", 1)]
    tf = spark.createDataFrame(rows, "file_id bigint, term string, tf bigint").repartition(5)
    by = {}
    for i, t, n in rows:
        by.setdefault(t, []).append((i, n))
    want = {(t, i, i - (p[k - 1][0] if k else 0)) for t, p in by.items() for k, (i, _) in enumerate(p)}
    for size in (1, 64, 1 << 20):
        assert {(r["term"], r["file_id"], r["delta"]) for r in T.postings_delta(tf, size).collect()} == want
    blocks = {r["term"]: r["h"] for r in T.postings(tf).select("term", codec.postings_block_hex(F.col("postings")).alias("h")).collect()}
    assert {r["term"]: r["bytes"] * 2 for r in T.block_bytes(T.postings_delta(tf, 64)).collect()} == {t: len(h) for t, h in blocks.items()}
    parts = {}
    for r in sorted(T.block_segments(tf, 64).collect(), key=lambda r: r["segment"]):
        parts[r["term"]] = parts.get(r["term"], "") + r["block"]
    assert parts == blocks


def test_written_tables_can_be_released(spark):
    from textloom import session

    session.release(spark)
    df = session.materialize(spark.range(5))
    assert df.count() == 5 and session.release(spark) == 1 and session.release(spark) == 0
    assert not any(Path(f.removeprefix("file:")).exists() for f in df.inputFiles())


def test_streamed_postings_match_batch(spark, tmp_path):
    from textloom.streaming.postings import stream_postings

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "in"))
    stream = stream_postings(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got, want = spark.read.parquet(str(tmp_path / "out")), queries.term_freq(spark, DATA)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got = queries.QUERIES[name](spark, DATA)
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    clean = lambda rows: sorted(repr(tuple(round(float(x), 5) if isinstance(x, float) else x for x in r)) for r in rows)
    assert clean(got.select(*[f"`{c}`" for c in columns]).collect()) == clean(want.fetchall())


def test_counted_terms(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["é"])], "id int, w array<string>")
    got = {r["file_id"]: [tuple(t) for t in r["terms"]] for r in T.counted_terms(rows, "id", F.col("w")).collect()}
    assert got == {1: [("a", 1), ("b", 2)], 2: [], 3: [], 4: [("é", 1)]}
    plan = T.term_freq(rows, "id", F.col("w"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_model_load(tmp_path):
    import json
    import struct

    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = {"a": 0, "bb": 1, "ccc": 2, "[UNK]": 3}
    tokenizer = Tokenizer(models.WordLevel(vocab, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "tokenizer.json"))
    (tmp_path / "config.json").write_text("{}")
    table = np.array([[3, 0], [0, 4], [1, 1], [9, 9]], "<f2")

    def save(dtype, shape, end):
        head = json.dumps({"t": {"dtype": dtype, "shape": shape, "data_offsets": [0, end]}}).encode()
        (tmp_path / "model.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + table.tobytes())

    save("F16", [4, 2], 16)
    m = vectors.TokenTable.load(str(tmp_path))
    assert np.allclose(m.embed("a bb zzz"), [0.6, 0.8]) and not m.embed("").any() and m.truncate == 512 * 3
    for bad in (("F32", [4, 2], 16), ("F16", [8], 16), ("F16", [4, 2], 14)):
        save(*bad)
        with pytest.raises(ValueError):
            vectors.TokenTable.load(str(tmp_path))
