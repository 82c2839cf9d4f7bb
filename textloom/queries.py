"""Registered queries over the test tables, with the SQL that checks them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import codec, text, vectors
from .functions.identifiers import code_identifiers
from .operators import terms as T


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _docs(spark, sf):
    """Documents with their words, split once."""
    return _read(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), text.words(F.col("text")).alias("words"))


def _tf(spark, sf):
    return T.term_freq(_docs(spark, sf), "file_id", F.col("words"))


def tokens(spark, sf):
    return T.tokens(_docs(spark, sf), "file_id", F.col("words"))


def term_freq(spark, sf):
    return _tf(spark, sf)


def doc_length(spark, sf):
    return T.doc_length(_docs(spark, sf), "file_id", F.col("words"))


def term_stats(spark, sf):
    return T.term_stats(_tf(spark, sf))


def _listed(pairs, first):
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p[first].cast("string"), p["tf"].cast("string"))), " ")


def postings(spark, sf):
    return T.postings(_tf(spark, sf)).select("term", _listed(F.col("postings"), "file_id").alias("postings"))


def postings_delta(spark, sf):
    return T.postings_delta(_tf(spark, sf))


def postings_block(spark, sf):
    return T.postings(_tf(spark, sf)).select("term", codec.postings_block_hex(F.col("postings")).alias("block"))


def postings_segments(spark, sf):
    """The blocks in pieces of bounded size, as an export writes them; the ranges are small here, so that terms have several."""
    return T.block_segments(_tf(spark, sf), 100)


def forward(spark, sf):
    return T.counted_terms(_docs(spark, sf), "file_id", F.col("words")).select("file_id", _listed(F.col("terms"), "term").alias("terms"))


def forward_merged(spark, sf):
    """The forward view from flat postings, as an index build that only has those makes it."""
    docs = _docs(spark, sf)
    tf = T.merged_term_freq(T.tokens(docs, "file_id", F.col("words")))
    return T.forward(tf, docs, "file_id").select("file_id", _listed(F.col("terms"), "term").alias("terms"))


def forward_block(spark, sf):
    one = F.row_number().over(Window.partitionBy("file_id").orderBy(F.col("terms").isNull()))
    rows = _read(spark, sf, "forward_bin").withColumn("rn", one).filter("rn = 1")
    return rows.select("file_id", codec.forward_block_hex(F.col("terms")).alias("block"))


def forward_offsets(spark, sf):
    blocks = forward_block(spark, sf).select("file_id", (F.length("block") / 2).cast("bigint").alias("bytes"))
    return T.running_offset(blocks, ["file_id"], F.col("bytes")).select("file_id", "offset", "bytes")


def term_dictionary(spark, sf):
    blocks = T.block_bytes(T.postings_delta(_tf(spark, sf)))
    return T.running_offset(blocks, ["term"], F.col("bytes")).select("term", "offset")


def doc_table(spark, sf):
    """The valid row of every file: the one indexed last."""
    best = F.max_by(F.struct("project", "rel_path", "doc_length"), F.struct("indexed_at", "doc_length"))
    return _read(spark, sf, "docs_bin").groupBy("file_id").agg(best.alias("b")).select("file_id", "b.project", "b.rel_path", "b.doc_length")


def docs_entry(spark, sf):
    return doc_table(spark, sf).select("file_id", codec.docs_entry_hex(F.col("rel_path"), F.coalesce("doc_length", F.lit(0))).alias("entry"))


def dense_ids(spark, sf):
    paths = _read(spark, sf, "docs_bin").select("project", "rel_path").distinct()
    return T.dense_ids(paths, ["project", "rel_path"], "dense_id").select("project", "rel_path", "dense_id")


def fnv1a64(spark, sf):
    return _read(spark, sf, "project_dir").select("root", codec.fnv1a64_hex(F.col("root")).alias("hash"))


def fnv1a64_paths(spark, sf):
    return _read(spark, sf, "docs_bin").select("rel_path").distinct().select("rel_path", codec.fnv1a64_hex(F.col("rel_path")).alias("hash"))


def varint(spark, sf):
    return _read(spark, sf, "orders").select("o_orderkey", codec.varint_hex(F.col("o_orderkey") * 8191).alias("bytes"))


def json_keys(spark, sf):
    files = _read(spark, sf, "source_file").filter(text.extension(F.col("rel_path")) == "json")
    # Counted inside the file's row; repeated rows meet as small rows, the contents are not shuffled.
    keys = T.term_freq(files, "file_id", text.json_keys(text.lossy_text(F.col("content"))))
    return keys.groupBy("file_id", F.col("term").alias("key")).agg(F.max("tf").alias("tf"))


def event_keys(spark, sf):
    return _read(spark, sf, "events").select("event_id", F.explode(text.json_keys(F.col("props"))).alias("key"))


def ext_filter(spark, sf):
    ext = text.extension(F.col("rel_path"))
    return _read(spark, sf, "docs_bin").filter(text.is_indexed(ext)).select("file_id", "rel_path", ext.alias("ext"), text.language(ext).alias("language"))


def exclude_filter(spark, sf):
    return _read(spark, sf, "docs_bin").filter(~text.is_excluded(F.col("rel_path"), [*text.DEFAULT_EXCLUDES, "report", "**/gen*/**"])).select("file_id", "rel_path")


def binary_filter(spark, sf):
    return _read(spark, sf, "source_file").filter("content is not null").filter(~text.is_binary(F.col("content"))).select("file_id")


def lossy_decode(spark, sf):
    files = _read(spark, sf, "source_file").filter(text.extension(F.col("rel_path")).isin(*text.WORD_EXTENSIONS))
    return files.select("file_id", text.lossy_text(F.col("content")).alias("text"))


def char_truncate(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.substring("text", 1, 100).alias("text"))


def upper_median(spark, sf):
    lengths = tokens(spark, sf).select("term").distinct().select(F.length("term").cast("bigint").alias("n"))
    # Counts per length, then the first length at which half of all terms are reached: no list of all values.
    counts = lengths.groupBy("n").agg(F.count("*").alias("c"))
    w = Window.orderBy("n")
    cum = counts.withColumn("to", F.sum("c").over(w)).withColumn("all", F.sum("c").over(Window.partitionBy()))
    return cum.filter(F.col("to") > F.floor(F.col("all") / 2)).agg(F.greatest(F.min("n"), F.lit(1)).cast("bigint").alias("median"))


def run_stats(spark, sf):
    ext, content = text.extension(F.col("rel_path")), F.col("content")
    status = F.when(~text.is_indexed(ext), "ignored").when(content.isNull() | text.is_binary(content), "skipped").otherwise("indexed")
    return T.run_stats(_read(spark, sf, "source_file"), status)


def code_identifiers_query(spark, sf):
    return code_identifiers(_read(spark, sf, "source_file")).groupBy("file_id", "term").agg(F.max("tf").alias("tf"))


#: One small file per language with terms set by hand from the languages' grammars. Language extension, source, terms.
IDENTIFIER_CASES = [
    ("rs", "use a::b;\nfn f<'x>(p: &'x T) -> Option<u32> { let s = r#\"q\"#; p.len(S { h, k: 1 }); /* a /* b */ c */ }", "T f h k len p p s a b Option S"),
    ("go", "package m\nimport q \"r/s\"\nfunc (a *B) C(x int) error { y := `raw`; a.D.e(x, nil); return y }", "m q a B C x int error y a D e x y"),
    ("java", "package a.b;\n@X class A<T> extends B { char c = '\"'; int f(D d) { return d.g.h(this.c); } }", "a b X A T B c f D d d g h c"),
    ("kt", "package p\ndata class C(val open: Int, var b: T?) { fun get(i: Int) = list.map { it.data.open } }", "p C open Int b T get i Int list map it data open"),
    ("py", "import os.path as p\nclass A(B):\n    def f(self, *x):\n        return f'{self.y} z' or p.join(match=x)  # no", "os path p A B f self x self y p join match x"),
    ("js", "m.get(k); m.delete(k); p.then(f).catch(g);\nconst o = {default: 1, class: a, get x() { return this.#z }, of};\nlabel: for (const v of o) { continue label }", "m get k m delete k p then f catch g o default class a x #z of label v o label"),
    ("ts", "action.type; x.string; o.number;\ninterface I { type: string; from?: number }\nfunction f(type: any, as = type): I { return type as I }", "action type x string o number I type from f type as type I type I"),
    ("toml", "a.b = 1\n[\"q r\"]\n[[t]]\nx = [1, \"y\"]\nz = { k = 2 }", 'a b "q_r" t x z k'),
    ("xml", "<a b=\"c\"><d/>&amp;</a><!-- <e> -->", "a b d amp a"),
]


def identifier_cases(spark, sf):
    """The cases above through the same operator as whole tables."""
    files = spark.createDataFrame([(i, f"c.{ext}", body.encode()) for i, (ext, body, _) in enumerate(IDENTIFIER_CASES)], "file_id bigint, rel_path string, content binary")
    return code_identifiers(files)


def embed_mean(spark, sf):
    return vectors.mean_by(_read(spark, sf, "embeddings"), "label", "embedding").select("label", "pos", F.round("mean", 6).alias("mean"))


def embed_normalize(spark, sf):
    """Norm and all components of the unit vector of each file; repeats are exact."""
    v = _read(spark, sf, "file_vector").filter("vec is not null").groupBy("file_id").agg(F.max("vec").alias("vec"))
    unit = v.select("file_id", F.round(vectors.l2_norm(F.col("vec")), 6).alias("norm"), vectors.normalized(F.col("vec")).alias("unit"))
    return unit.select("file_id", "norm", F.posexplode("unit").alias("pos", "x")).withColumn("x", F.round("x", 6))


def embedding_f16(spark, sf):
    v = _read(spark, sf, "file_vector").filter("vec is not null")
    return v.select("file_id", F.hex(vectors.to_f16(F.col("vec"))).alias("f16"))


def embed_pool(spark, sf):
    """Pooling with a made-up table of 4 x 2 and a word-length tokenizer: no real model is needed to check the arithmetic."""
    model = vectors.TokenTable(np.array([[3, 0], [0, 4], [1, 1], [9, 9]]), _LengthTokenizer(), 3, 1 << 20)
    pooled = vectors.embed_udf(spark, model)(F.coalesce("text", F.lit("")))
    v = _read(spark, sf, "documents").select("doc_id", pooled.alias("v"))
    return v.select("doc_id", *[F.round(F.get("v", F.lit(i)).cast("double"), 4).alias(n) for i, n in enumerate(("x", "y"))])


class _LengthTokenizer:
    """Token id of a blank-separated word: its length modulo 5."""

    def encode(self, text, add_special_tokens=False):
        from types import SimpleNamespace

        return SimpleNamespace(ids=[len(w) % 5 for w in text.split(" ") if w])


QUERIES = {
    f.__name__.removesuffix("_query"): f
    for f in (
        term_stats, tokens, term_freq, doc_length, postings, postings_delta, postings_block, postings_segments, forward, forward_merged, forward_block, forward_offsets, term_dictionary,
        doc_table, docs_entry, dense_ids, fnv1a64, fnv1a64_paths, varint, json_keys, event_keys, ext_filter, exclude_filter, binary_filter, lossy_decode,
        char_truncate, upper_median, run_stats, code_identifiers_query, identifier_cases, embed_mean, embed_normalize, embedding_f16, embed_pool,
    )
}

# The words of a text for the checking SQL: letters, numbers and, as that
# engine's classes lack them, the alphabetic combining marks of the scripts used.
_MARKS = r"\x{0345}\x{0610}-\x{061A}\x{064B}-\x{0657}\x{0659}-\x{065F}\x{0670}\x{06D6}-\x{06DC}\x{0900}-\x{0903}\x{093A}-\x{093B}\x{093E}-\x{094C}\x{094E}-\x{094F}\x{0955}-\x{0957}\x{0962}-\x{0963}\x{0E31}\x{0E34}-\x{0E3A}\x{0E4D}\x{24B6}-\x{24E9}"
_WORDS = rf"list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}{_MARKS}_]+'), lambda x: x <> '')"
_SQL_TOKENS = f"select doc_id as file_id, unnest({_WORDS}) as term from documents"
_SQL_TF = f"select file_id, term, count(*) as tf from ({_SQL_TOKENS}) group by all"
_SQL_VARINT = "list_aggregate(list_transform(list_filter(range(0, 9), lambda i: i = 0 or ({v} >> (7 * i)::int) > 0), lambda i: lpad(hex(((({v} >> (7 * i)::int) & 127) + case when i < 8 and ({v} >> (7 * (i + 1))::int) > 0 then 128 else 0 end)::bigint), 2, '0')), 'string_agg', '')"
_SQL_FNV = "lower(lpad(hex(list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(1, octet_length(encode({s})) + 1), lambda i: (('0x' || substr(hex(encode({s})), (2 * i - 1)::bigint, 2))::int)::hugeint)), lambda a, b: (xor(a, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint)), 16, '0'))"


def _v(expression: str) -> str:
    return _SQL_VARINT.format(v=f"({expression})::bigint")


_SQL_EXT = "translate(regexp_extract(rel_path, '[^/]\\.([^./]*)$', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_LANGUAGE = "case {e} when 'rs' then 'rust' when 'go' then 'go' when 'java' then 'java' when 'kt' then 'kotlin' when 'py' then 'python' when 'js' then 'javascript' when 'ts' then 'typescript' when 'toml' then 'toml' when 'xml' then 'xml' when 'json' then 'json' end"
_SQL_INDEXED = "('rs','go','java','kt','py','js','ts','toml','xml','json','txt','md')"
_SQL_DELTA = f"select term, file_id, tf, file_id - coalesce(lag(file_id) over (partition by term order by file_id), 0) as delta from ({_SQL_TF})"
_SQL_BLOCK = f"select term, {_v('count(*)')} || string_agg({_v('delta')} || {_v('tf')}, '' order by file_id) as block from ({_SQL_DELTA}) group by term"
_SQL_FORWARD_BLOCK = f"select file_id, {_v('coalesce(len(terms), 0)')} || coalesce(list_aggregate(list_transform(terms, lambda t: {_v('octet_length(encode(t.term))')} || hex(encode(t.term)) || {_v('t.tf')}), 'string_agg', ''), '') as block from (select file_id, max(terms) as terms from forward_bin group by file_id)"
_SQL_DOCS = "select file_id, project, rel_path, doc_length from (select *, row_number() over (partition by file_id order by indexed_at desc, doc_length desc nulls last) as rn from docs_bin) where rn = 1"
_SQL_KEYS = r"list_filter(list_transform(list_filter(regexp_extract_all({t}, '\"(?:[^\"\\\n]|\\.)*\"\s*:?'), lambda s: suffix(s, ':')), lambda s: regexp_replace(regexp_replace(s, '^\"|\"\s*:$', '', 'g'), '\\.', '', 'g')), lambda s: s <> '')"

#: A half float by its definition: nearest of the 10-bit fractions, ties to even, bytes low first.
_SQL_F16_BITS = "(case when x < 0 then 32768 else 0 end + case when x = 0 then 0 else (greatest(floor(log2(abs(x::double))), -14) + 14) * 1024 + round_even(abs(x::double) * pow(2, 10 - greatest(floor(log2(abs(x::double))), -14)), 0) end)::bigint"
_SQL_F16 = f"printf('%02X%02X', {_SQL_F16_BITS} & 255, {_SQL_F16_BITS} >> 8)"
#: Bytes that are no UTF-8 become U+FFFD; a true question mark is kept apart from those that the engine's decoder writes.
_SQL_LOSSY = "replace(replace(decode(unhex(coalesce(list_aggregate(list_transform(range(0, octet_length(content)), lambda i: case substr(hex(content), (2 * i + 1)::bigint, 2) when '3F' then 'EE8080' else substr(hex(content), (2 * i + 1)::bigint, 2) end), 'string_agg', ''), '')), 'replace'), '?', chr(65533)), chr(57344), '?')"

ORACLE_SQL = {
    "tokens": _SQL_TOKENS,
    "term_freq": _SQL_TF,
    "doc_length": f"select doc_id as file_id, coalesce(len({_WORDS}), 0)::bigint as doc_length from documents",
    "term_stats": f"select term, count(*) as df, sum(tf)::bigint as cf from ({_SQL_TF}) group by term",
    "postings": f"select term, string_agg(file_id || ':' || tf, ' ' order by file_id) as postings from ({_SQL_TF}) group by term",
    "postings_delta": _SQL_DELTA,
    "postings_block": _SQL_BLOCK,
    "forward": f"select doc_id as file_id, coalesce(terms, '') as terms from documents left join (select file_id, string_agg(term || ':' || tf, ' ' order by term) as terms from ({_SQL_TF}) group by file_id) on file_id = doc_id",
    "forward_block": _SQL_FORWARD_BLOCK,
    "forward_offsets": f"select file_id, coalesce(sum(bytes) over (order by file_id rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\", bytes from (select file_id, (length(block) // 2)::bigint as bytes from ({_SQL_FORWARD_BLOCK}))",
    "term_dictionary": f"select term, coalesce(sum(length(block) // 2) over (order by term rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from ({_SQL_BLOCK})",
    "doc_table": _SQL_DOCS,
    "docs_entry": f"select file_id, {_v('octet_length(encode(rel_path))')} || hex(encode(rel_path)) || {_v('coalesce(doc_length, 0)')} as entry from ({_SQL_DOCS})",
    "dense_ids": "select project, rel_path, row_number() over (order by project, rel_path) - 1 as dense_id from (select distinct project, rel_path from docs_bin)",
    "fnv1a64": "select root, project as hash from project_dir",
    "fnv1a64_paths": f"select rel_path, {_SQL_FNV.format(s='rel_path')} as hash from (select distinct rel_path from docs_bin)",
    "varint": f"select o_orderkey, {_v('o_orderkey * 8191')} as bytes from orders",
    "json_keys": f"select file_id, key, count(*) as tf from (select file_id, unnest({_SQL_KEYS.format(t='decode(content)')}) as key from (select file_id, any_value(content) as content from source_file where {_SQL_EXT} = 'json' group by file_id)) group by all",
    "event_keys": f"select event_id, unnest({_SQL_KEYS.format(t='props')}) as key from events",
    "ext_filter": f"select file_id, rel_path, {_SQL_EXT} as ext, {_SQL_LANGUAGE.format(e=_SQL_EXT)} as language from docs_bin where {_SQL_EXT} in {_SQL_INDEXED}",
    "exclude_filter": "select file_id, rel_path from docs_bin where not list_has_any(string_split(rel_path, '/'), ['out', 'build', 'system', 'config', 'target', 'node_modules', '.git', 'report']) and not regexp_matches(rel_path, '(^|/)gen[^/]*/')",
    "binary_filter": "select file_id from source_file where content is not null and (regexp_matches(hex(content), '^(EFBBBF|FFFE|FEFF|0000FEFF)') or not (list_contains(list_transform(range(0, least(1024, octet_length(content))), lambda i: substr(hex(content), (2 * i + 1)::bigint, 2)), '00') or regexp_matches(hex(content), '^(25504446|89504E47)')))",
    "char_truncate": "select doc_id, substr(text, 1, 100) as text from documents",
    "upper_median": f"select list_extract(list_sort(list(n)), (count(*) // 2 + 1)::bigint) as median from (select distinct term, length(term) as n from ({_SQL_TOKENS}))",
    "run_stats": f"select count(*) filter (e in {_SQL_INDEXED} and content is not null) as indexed, count(*) filter (e in {_SQL_INDEXED} and content is null) as skipped, count(*) filter (e not in {_SQL_INDEXED}) as ignored from (select *, {_SQL_EXT} as e from source_file)",
    "embed_mean": "select label, pos, round(avg(x), 6) as mean from (select label, unnest(embedding)::double as x, (unnest(range(0, len(embedding))))::int as pos from embeddings) group by all",
    "embed_normalize": "select file_id, round(n, 6) as norm, pos, round(x / n, 6) as x from (select file_id, n, unnest(vec)::double as x, (unnest(range(0, len(vec))))::int as pos from (select distinct file_id, vec, sqrt(list_sum(list_transform(vec, lambda x: x::double * x::double))) + 1e-32 as n from file_vector where vec is not null))",
    "postings_segments": f"select term, segment, case when segment = min(segment) over (partition by term) then {_v('sum(n) over (partition by term)')} else '' end || block as block from (select term, file_id // 100 as segment, count(*) as n, string_agg({_v('delta')} || {_v('tf')}, '' order by file_id) as block from ({_SQL_DELTA}) group by all)",
    "identifier_cases": "select file_id, replace(term, 'q_r', 'q r') as term, count(*) as tf from (select i::bigint as file_id, unnest(string_split(t, ' ')) as term from (values " + ", ".join(f"({i}, '{t}')" for i, (_, _, t) in enumerate(IDENTIFIER_CASES)) + ") v(i, t)) group by all",
    "embed_pool": "select doc_id, round(coalesce(x / greatest(sqrt(x * x + y * y), 1e-32), 0)::float::double, 4) as x, round(coalesce(y / greatest(sqrt(x * x + y * y), 1e-32), 0)::float::double, 4) as y from (select doc_id, list_sum(list_transform(ids, lambda i: case i when 0 then 3.0 when 2 then 1.0 else 0.0 end)) / len(ids) as x, list_sum(list_transform(ids, lambda i: case i when 1 then 4.0 when 2 then 1.0 else 0.0 end)) / len(ids) as y from (select doc_id, list_filter(list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: length(w) % 5), lambda i: i < 3) as ids from documents))",
    "embedding_f16": "select file_id, list_aggregate(list_transform(vec, lambda x: " + _SQL_F16 + "), 'string_agg', '') as f16 from file_vector where vec is not null",
    "lossy_decode": f"select file_id, {_SQL_LOSSY} as text from source_file where content is not null and {_SQL_EXT} in ('txt', 'md')",
}
ORACLE_SQL["forward_merged"] = ORACLE_SQL["forward"]
