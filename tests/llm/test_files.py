"""Problems 4 and 7: source files that do not parse, and that nobody wrote."""

import base64
import random

import pytest

from textloom.llm import handwritten, syntax

VALID = {
    "python": ['def f(a, *b):\n    """x\n<<<<<<< ours\n=======\n"""\n    return {"(": a[1:], \'c]\': f"{a} ("}\n', "", "# only a comment (", "x = 'it\\'s'\r\ny = 1\r\n"],
    "javascript": [
        "'use strict';\nvar a = /[(\"{]+/.test(b); // (\nlet t = `${a} of (${b.map(x => `{${x}`)}`;\nfor (const k of q) { k['it\\'s {'] ??= 1 }\nasync function f() { await g?.(1) }\n",
        "import * as a from 'b'; import {c as d} from \"e\";\nswitch (x) { case 1: y = z ? a : b; break; default: }\nclass A { static get b() { return new.target } }",
        "(()=>{if(a){b()}else{c()}})();\n//# sourceMappingURL=x\n",
        "",
    ],
    "typescript": ["import { a } from './b';\nexport async function f<T>(x: T, y?: number): Promise<Array<T>> {\n  const z: T[] = [];\n  return (x as unknown) as T[];\n}\ninterface I { a: string; readonly b?: number }\ntype U = 'a' | 'b';\n"],
    "java": ["package a.b;\nimport static c.D.*;\n@X(y = {1, 2})\npublic class A<T> extends B {\n  enum C { D, E }\n  int[] f = {1, 2};\n  char c = '{';\n  String s = \"\"\"\n  ( \"\n  \"\"\";\n  T g(int x) throws E { for (T t : f) { r(() -> { return; }); } return x > 1 ? null : (T) h; }\n}\n"],
    "go": ["// c\npackage p\n\nimport q \"r/s\"\n\nfunc (a *B) C(x int) (y D, err error) {\n\tz := `raw { ( \"`\n\tw := '{'\n\tfor _, v := range x {\n\t}\n\treturn\n}\n"],
    "rust": ["use super::a;\n/* a /* ( */ b */\npub fn f<'a>(x: &'a T) -> Option<&'a U> {\n    let r = r#\"raw \" } text\"#;\n    let c = '\\'';\n    match x { Some(y) => z(y), None => (), }\n    println!(\"{{ {}\", x);\n    let v = &y[1..];\n    for i in 0..n { }\n}\n"],
    "kotlin": ["package a\nimport b.c as d\n\nprivate fun f(x: T?): U {\n    val s = \"\"\"raw \" ) text\"\"\"\n    val t = \"${x} of {\"\n    val p = a to b\n    x?.y ?: z\n    when (x) { 1 -> g() else -> h() }\n    list.map { it.q }\n    return s\n}\n"],
    "json": ['{"a": [1, -2.5e3, null, true, "\\u00e9 {"], "a": {}}', "3", "[]"],
    "toml": ['a = "[" # (\n[b."c d"]\ne = """\nfirst [line\n<<<<<<< x\n"""\nf = [1,\n 2]\ng = {h = 1}\n', ""],
    "xml": ['<?xml version="1.0"?>\n<a b="&lt;"><!-- <c> --><d/><![CDATA[ <e> & ( ]]>=======</a>\n'],
}
INVALID = {
    "python": ["def f(:\n  pass", "x = (1,", "class :\n    pass\n", "value = 'open\n", "<<<<<<< HEAD\na = 1\n=======\na = 2\n>>>>>>> b\n", "def f()\n    pass\n", "if x:\ny = 1\n", "function a() { return 1; }", '"""never'],
    "javascript": ["function f( { }", "var a = 'open\n", "var x = `never", "/* never", "if (a) { b();", "a = b];", "<<<<<<< ours\nlet a;\n=======\nlet b;\n>>>>>>> theirs\n", "def f(a):\n    return b\n", '{\n  "a": 1,\n  "b": [2]\n}\n', "var a: number = 1;", "function f(a): T {\n}\n", "package a\nfunc f() {\n\tb := c\n}\n"],
    "typescript": ["let a = [1;", '{ "a": 1 }', "package p\nfunc f(x int) T {\n\ty := z\n}\n", "const a = \"open\n"],
    "java": ["class A { void f() { }", "class A { String s = \"open; }", "package a\nimport b.c\nfun f(x: T): U {\n    return x\n}\n", "class A { int f() { return 1 } }", "class A } {"],
    "go": ["", "func f() {}\n", "package p\nfunc f() {\n", "package a.b;\npublic class C {\n}\n", "package p\nvar s = \"open\n", "package p\nvar r = `never\n"],
    "rust": ["fn f() { let x = (1; }", "package a.b;\npublic class C {\n  private static T f(U x) {\n    return x;\n  }\n}\n", "fn f() { let s = \"never; }", "/* /* */ fn f() {}"],
    "kotlin": ["fun f() {", "package a;\npublic class C {\n  private static T f(U x) {\n    char c = '{';\n  }\n}\n", 'val s = "open\n', "import a as b\nfrom c import d\n", "def f(x, *a):\n    return x\n", "if x:\n    y = 1\n"],
    "json": ["", '{"a": 1,}', "{'a': 1}", '{"a": 1 "b": 2}', '{"a": [1, 2}', '{"a": "open}', "// c\n{}", '{"a": NaN}', '{"a": 1}{}', "{\n<<<<<<< a\n}"],
    "toml": ["a = ", "[late\nx = 1", 'a = "open', '{"a": 1}', "a = [1", "<<<<<<< x\na = 1\n"],
    "xml": ["", "<a><b></a>", "<a>", "<a b=c/>", "<a/><b/>", "<a>x & y</a>", "a = 1\n", "<a><b</a>"],
}


@pytest.mark.parametrize(("language", "body"), [(k, b) for k, v in VALID.items() for b in v])
def test_valid(language, body):
    assert syntax.fault(language, body.encode()) is None


@pytest.mark.parametrize(("language", "body"), [(k, b) for k, v in INVALID.items() for b in v])
def test_invalid(language, body):
    assert syntax.fault(language, body.encode()) is not None


def test_python_automaton_on_the_standard_library():
    # No false alarm on valid sources; the parser's word is not needed for them.
    import os
    from pathlib import Path

    alarms = []
    for f in sorted(Path(os.__file__).parent.glob("*.py"))[:120]:
        bare = syntax._SKIP["python"].sub(syntax._reduce, f.read_text("utf-8", "replace"))
        if syntax._python_fault(bare):
            alarms.append(f.name)
    assert not alarms


@pytest.mark.parametrize(
    ("body", "reason"),
    [
        ("def f()\n    pass\n", "statement head"), ("class :\n    pass\n", "statement head"), ("if x\n    y\n", "statement head"), ("for x of y:\n    z\n", "statement head"),
        ("if x:\ny = 1\n", "indentation"), ("x = 1\n  y = 2\n", "indentation"), ("if x:\n    a\n  b\n", "indentation"), ("if x:\n    a\n\tb\n", "indentation"), ("def f():\n", "indentation"),
        ("x = 1\nelse:\n    y\n", "clause without its statement"), ("if x:\n    y\nfinally:\n    z\n", "clause without its statement"),
        ("x = a b\n", "operands and operators"), ("x = f(a) b\n", "operands and operators"), ("x = (a +)\n", "operands and operators"), ("x =\n", "operands and operators"), ("x = lambda a\n", "operands and operators"), ("del\n", "operands and operators"),
    ],
)
def test_python_automaton(body, reason):
    assert syntax._python_fault(body) == reason and syntax.fault("python", body.encode()) == reason


@pytest.mark.parametrize(
    ("language", "body"),
    [
        ("rust", "use a::b;\nuse c::d"), ("rust", "fn f() {}\npub fn g(x: T) -> U"), ("java", "package a;\nimport b.c.D"), ("javascript", "let a = 1;\nfunction f(a, b)"), ("javascript", "let a ="), ("javascript", "import { a } from"),
        ("typescript", "const x: T =\n"), ("typescript", "import * as x"), ("go", "package p\nimport"), ("go", "package p\nfunc (a *B)"), ("go", "package p\nimpor\n"), ("kotlin", "package p\nimport a."), ("kotlin", "package p\nfun"), ("kotlin", "package p\nimpor\n"),
    ],
)
def test_truncated_between_delimiters(language, body):
    assert syntax.fault(language, body.encode()) is not None


@pytest.mark.parametrize(
    ("language", "body"),
    [
        ("rust", "#![no_std]\n"), ("rust", "m! { x }\n// end"), ("javascript", "i++"), ("javascript", "let x"), ("javascript", "export default a\n"), ("javascript", "x => y"), ("typescript", "declare function f(): void;\nlet a: B\n"),
        ("go", "package p\nvar (\n\ta = 1\n)\ntype T struct {\n\tx int\n}\nfunc f() int\n"), ("kotlin", "package p\n@A\ninternal val x: T\n    get() = 1\nval y =\n    z\n"), ("kotlin", "fun f(x: T): U =\n    x\n        .y()\n"),
    ],
)
def test_whole_ends(language, body):
    assert syntax.fault(language, body.encode()) is None


def test_json_automaton_against_the_parser():
    import json

    rng = random.Random(8)
    whole = '{"a": [1, -2.5e3, {"b": null}, []], "c\\n": {"d": "x,y", "e": true}, "f": {}}'
    for _ in range(4000):
        body = list(whole)
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(body))
            body[i : i + rng.randint(0, 2)] = rng.choice(["", ",", ":", "]", "}", "[", "{", '"', "1", "a", " "])
        body = "".join(body)
        try:
            json.loads(body)
            ok = True
        except ValueError:
            ok = False
        assert (syntax._json_automaton(body) is None) == ok, body


def test_toml_automaton_against_the_parser():
    import tomllib

    rng = random.Random(9)
    whole = 'a = "x"\n[b."c d"]\ne.f = [1, 2.5,\n 3]\ng = {h = true, i = 1979-05-27}\n[[j]]\nk = \'l\'\n'
    assert syntax._toml_automaton(whole) is None
    missed = 0
    for _ in range(3000):
        body = list(whole)
        i = rng.randrange(len(body))
        body[i : i + rng.randint(0, 2)] = rng.choice(["", ",", "=", "]", "}", "[", "{", '"', "1", "\n", " "])
        body = "".join(body)
        try:
            tomllib.loads(body)
            assert syntax._toml_automaton(body) is None, body
        except tomllib.TOMLDecodeError:
            missed += syntax._walk(syntax._TOML_LEX, body) is None and syntax._toml_automaton(body) is None
    assert missed < 60


@pytest.mark.parametrize("body", ["<a b='1' b='2'/>", "<a>&x</a>", "x<a/>", "<a/>x", "<a/><?xml version='1.0'?>", "<a b='1'c='2'/>", "<a>]]></a>", "<1a/>"])
def test_xml_automaton(body):
    assert syntax._xml_automaton(body) is not None and syntax.fault("xml", body.encode()) is not None


def test_deep_nesting_changes_no_verdict():
    for language, body in (("json", b"[" * 50_000 + b"]" * 50_000), ("python", b"x = " + b"(" * 3000 + b"1" + b")" * 3000), ("toml", b"x = " + b"[" * 20_000 + b"]" * 20_000)):
        assert syntax.fault(language, body) is None
        assert syntax.fault(language, body[:-1]) is not None


@pytest.mark.parametrize("language", syntax.text.LANGUAGE_OF.values())
def test_any_bytes(language):
    rng = random.Random(5)
    for n in (0, 1, 10, 300):
        syntax.fault(language, bytes(rng.randrange(256) for _ in range(n)))
    syntax.fault(language, b"(" * 100_000)
    syntax.fault(language, b"[1," * 30_000 + b"]" * 30_000)


def test_check_files(spark):
    rows = [(1, "a.py", b"x = 1"), (1, "a.py", b"x = 1"), (2, "B.JSON", b"{"), (3, "c.md", b"("), (4, "d.go", None), (5, "e", b"("), (6, "f.py", b"x = ("), (6, "f.py", b"x = 1"), (7, None, b"(")]
    df = spark.createDataFrame([(*r, "s", "l") for r in rows], "file_id bigint, rel_path string, content binary, status string, language string")
    got = {r["file_id"]: (r["language"], r["status"]) for r in syntax.check_files(df).collect()}
    assert got == {1: ("python", "valid"), 2: ("json", "invalid"), 3: (None, "no syntax"), 4: ("go", "unreadable"), 5: (None, "no syntax"), 6: ("python", "invalid"), 7: (None, "no syntax")}
    docs = spark.createDataFrame([(1, "p", 1), (1, "old", 0), (6, "p", 1)], "file_id bigint, project string, indexed_at int")
    rates = {(r["project"], r["language"]): (r["files"], r["invalid"], r["rate"]) for r in syntax.invalid_rates(syntax.check_files(df), docs).collect()}
    assert rates == {("p", "python"): (2, 1, 0.5), (None, "json"): (1, 1, 1.0)}
    assert syntax.check_files(df.limit(0)).collect() == []


WRITTEN = "import os\n\n# the code generated by the planner ends up in this table\ndef read_folder(path, limit):\n    entries = sorted(os.listdir(path))\n    for entry in entries[:limit]:\n        print(entry)\n    return entries\n"
MANGLED = "(()=>{" + "".join(f"var {a}={b}.xx,{b}1=[2,9];if({a}){{{b}.q={a}}}else{{{b}()}}" for a in ("ab", "qx", "zk", "jw", "pv", "wq") for b in ("vv", "hq", "yx", "t", "jz", "kx")) + "})();"


def kinds_of(path, language, body):
    found = handwritten.file_features(path, language, body if isinstance(body, bytes) else body.encode())["evidence"]
    return list(dict.fromkeys(e.split(":")[0] for e in found))


@pytest.mark.parametrize(
    ("path", "language", "body", "want"),
    [
        ("a/b.py", "python", WRITTEN, []),
        ("lib/codegen/b.py", "python", "# Emits the header 'DO NOT EDIT' (form 3) for the stub writer.\n" + WRITTEN, []),
        ("a/b.py", "python", "# Checks (4) that generated files are skipped by the walker.\n" + WRITTEN, []),
        ("a/b.py", "python", "# Replaces the vendored copy used until step 4; this one is ours.\n" + WRITTEN, []),
        ("a/b.py", "python", "# Code generated by quillc 4.2. DO NOT EDIT.\n" + WRITTEN, ["generated"]),
        ("a/b.go", "go", "/*\n * 由 weldgen 自动生成\n */\npackage p\n", ["generated"]),
        ("a/b_pb2.py", "python", WRITTEN, ["generated"]),
        ("x/c-lock.json", "json", "{}", ["generated"]),
        ("x/c.json", "json", '{"_note": "AUTOGENERATED (mill 4.1)", "a": 1}', ["generated"]),
        ("a/b.rs", "rust", "// Vendored from libquorn 2.1, no local changes.\nfn f() {}\n", ["vendored"]),
        ("web/node_modules/q/b.js", "javascript", "var a;", ["vendored"]),
        ("a/b.py", "python", 'K = "' + base64.b64encode(random.Random(1).randbytes(900)).decode() + '"\n', ["data"]),
        ("a/b.js", "javascript", "var t = [\n" + "  12, 5.25, -7, 1, 2, 3,\n" * 40 + "];\n", ["data"]),
        ("a/b.ts", "typescript", "function w() {\n" + "".join(f"  var w_f{i}: w_g{i} = w_r{i}(w_v{i});\n" for i in range(60)) + "}\n", ["generated"]),
        ("p/b.min.js", "javascript", MANGLED, ["minified"]),
        ("a/b.py", "python", b"", []),
    ],
)
def test_kinds(path, language, body, want):
    assert kinds_of(path, language, body) == want


def test_kinds_of_table(spark):
    rows = [(i, f"a/b{i}.js", (WRITTEN * 3).replace("entries", f"names_{i}").encode()) for i in range(30)]
    rows += [(100, "z/m.js", MANGLED.encode()), (100, "z/m.js", MANGLED.encode()), (101, "vendor/q/c.js", b"var a = 1; // " + b"x" * 300), (102, "own/c.js", b"var a = 1; // " + b"x" * 300), (103, "d.js", None), (104, "e.md", b"x"), (105, None, b"x"), (106, "f.js", b"")]
    df = spark.createDataFrame([(*r, "k", b"d") for r in rows], "file_id bigint, rel_path string, content binary, kinds string, digest binary")
    docs = spark.createDataFrame([(100, "p", 5, 1), (100, "old", None, 0), (101, None, None, None), (None, "p", 1, 1)], "file_id bigint, project string, doc_length bigint, indexed_at int")
    for d in (None, docs):
        got = {r["file_id"]: r["evidence"] for r in handwritten.kinds(df, d).collect()}
        assert got == {i: [] for i in range(30)} | {100: ["minified:entropy"], 101: ["vendored:path"], 102: ["vendored:copy"], 106: []}
    left = {r["file_id"]: r["kinds"] for r in handwritten.stated_out(handwritten.kinds(df)).collect() if r["kinds"]}
    assert left == {100: ["minified"]}
    assert handwritten.kinds(df.limit(0)).collect() == []


WORDS = "read write open close table index count value entry field queue stack"


def styled(rng, camel):
    names = [[rng.choice(WORDS.split()) for _ in range(3)] for _ in range(50)]
    joined = [n[0] + "".join(w.title() for w in n[1:]) if camel else "_".join(n) for n in names]
    return "".join(f"{a} = {b}(1)\n" for a, b in zip(joined, joined[1:])).encode()


def test_style_foreign_to_the_project(spark):
    # The same style is at home in one project and foreign in the other.
    rng = random.Random(3)
    rows = [(i, f"a{i}.py", styled(rng, i == 5)) for i in range(20)] + [(100 + i, f"a{i}.py", styled(rng, True)) for i in range(20)]
    df = spark.createDataFrame(rows, "file_id bigint, rel_path string, content binary")
    docs = spark.createDataFrame([(r[0], "p" if r[0] < 100 else "q", 60, 1) for r in rows], "file_id bigint, project string, doc_length bigint, indexed_at int")
    got = {r["file_id"]: r["evidence"] for r in handwritten.kinds(df, docs).filter("size(evidence) > 0").collect()}
    assert got == {5: ["vendored:style"]}


def test_name_model():
    names = [w.encode() for w in WORDS.split()]
    blob = b"\n".join(names)
    batch = handwritten.pa.RecordBatch.from_arrays([handwritten.pa.array(["python"] * 40), handwritten.pa.array([blob] * 40)], ["language", "names"])
    out = next(handwritten._count_grams([batch]))
    model = handwritten.NameModel(handwritten.np.zeros((10, handwritten.CELLS)))
    model.counts.ravel()[out["cell"].to_numpy()] = out["n"].to_numpy()
    # Every character and end mark is counted in each order.
    assert model.counts.sum() == 7 * 40 * sum(len(n) + 1 for n in names)
    known, mangled = model.bits("python", names), model.bits("python", [b"zq", b"x", b"kj"])
    assert known.max() < 1.5 and mangled.min() > 5 and len(mangled) == 3
