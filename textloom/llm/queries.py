"""Registered queries pN_... with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import materialize
from . import burst_trie, distinctive, handwritten, heavy_hitters, mixing, packing, sentences, set_join, syntax, tokens, vector_graph

P1_SHARE = 0.004


def _read(spark, sf, table):
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _spill_terms(spark, sf):
    return _read(spark, sf, "spill_file").filter("term is not null and term <> ''")


def p1_found(spark, sf):
    return heavy_hitters.frequent_items(_spill_terms(spark, sf), "term", P1_SHARE).select(F.col("item").alias("term"))


def p1_summary(spark, sf):
    """The approximate counts themselves, with what each may be too low."""
    return heavy_hitters.misra_gries(_spill_terms(spark, sf), "term", 2000).select(F.col("item").alias("term"), "counter", "lost", "rows")


def p1_bounds(spark, sf):
    """How many counters of the summary are outside of their bounds, and how many items above the bound it lacks: none of either."""
    summary = materialize(p1_summary(spark, sf), "summary")
    true = _spill_terms(spark, sf).groupBy("term").agg(F.count("*").alias("n"))
    rows, most = summary.agg(F.max("rows"), F.max("lost")).first()
    both = true.join(summary, "term", "left")
    wrong = (F.col("counter") > F.col("n")) | (F.col("n") > F.col("counter") + F.col("lost"))
    missed = F.col("counter").isNull() & (F.col("n") > F.lit(min((rows or 0) / 2001, most or 0)))
    return both.agg(F.count_if(wrong).alias("wrong"), F.count_if(missed).alias("missed"))


def p2_found(spark, sf):
    scores = distinctive.term_scores(_read(spark, sf, "spill_file"), _read(spark, sf, "docs_bin"), _read(spark, sf, "probe_file"))
    return distinctive.top_term(scores).select("file_id", "term")


def p2_scores(spark, sf):
    scores = distinctive.term_scores(_read(spark, sf, "spill_file"), _read(spark, sf, "docs_bin"))
    return scores.select("file_id", "term", "tf", "df", F.round("score", 6).alias("score"))


def p3_counts(spark, sf):
    n = _read(spark, sf, "docs_bin").agg(F.countDistinct("file_id")).first()[0]
    return burst_trie.marked(burst_trie.term_counts(_read(spark, sf, "spill_file")), n)


def p3_found(spark, sf):
    return p3_counts(spark, sf).filter("mark is not null").select("term", "mark")


def p4_files(spark, sf):
    return syntax.check_files(_read(spark, sf, "source_file"))


def p4_found(spark, sf):
    return p4_files(spark, sf).filter("status = 'invalid'").select("file_id")


def p4_rates(spark, sf):
    return syntax.invalid_rates(p4_files(spark, sf), _read(spark, sf, "docs_bin"))


#: p5_found: the similarity of its pairs, and a width of the beam that is enough for them; p5_nearest also has to find the
#: neighbours among near-random vectors, which takes a wider one.
P5_LEAST, P5_BEAM, P5_WIDE_BEAM = 0.9, 48, 160


def p5_found(spark, sf):
    near = vector_graph.nearest(_read(spark, sf, "file_vector"), "file_id", "vec", k=5, beam=P5_BEAM, least=P5_LEAST)
    close = near.filter(F.col("similarity") >= P5_LEAST)
    return close.select(F.least("key", "other").alias("file_id_a"), F.greatest("key", "other").alias("file_id_b")).distinct()


def p5_nearest(spark, sf):
    """The five nearest of every file whose id is divisible by 50, against all files in every shard."""
    near = vector_graph.nearest(_read(spark, sf, "file_vector"), "file_id", "vec", k=5, beam=P5_WIDE_BEAM, only=lambda key: F.pmod(key, F.lit(50)) == 0)
    return near.select(F.col("key").alias("file_id"), "other", F.round("similarity", 3).alias("similarity"))


def _p6(spark, sf):
    classes, members = set_join.set_classes(_read(spark, sf, "forward_bin"), "file_id", F.filter(F.col("terms.term"), lambda t: t != ""), 5)
    return set_join.similar_classes(classes, 0.7), members


def p6_found(spark, sf):
    pairs, members = _p6(spark, sf)
    return set_join.member_pairs(pairs, members).select(F.col("key_a").alias("file_id_a"), F.col("key_b").alias("file_id_b"))


def p6_classes(spark, sf):
    """Each file with the representative of its set and how many other sets are similar to that."""
    pairs, members = _p6(spark, sf)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(ends, "rep", "left").select(F.col("key").alias("file_id"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p7_files(spark, sf):
    return handwritten.kinds(_read(spark, sf, "source_file"), _read(spark, sf, "docs_bin"))


def p7_statistics(spark, sf):
    """The files that the statistics of names and literals find, without notices, paths, lock patterns and copies."""
    return handwritten.stated_out(p7_files(spark, sf)).filter("size(kinds) > 0").select("file_id", "kinds")


def p7_found(spark, sf):
    return p7_files(spark, sf).filter("size(kinds) > 0").select("file_id")


def _specs(spark, sf):
    return [(r["spec_id"], r["capacity"]) for r in _read(spark, sf, "container_spec").orderBy("spec_id").collect()]


def p8_containers(spark, sf):
    """Sizes are tokens of ``byte_bpe_multi_50k``."""
    return packing.pack(tokens.token_sizes(_read(spark, sf, "documents")), _specs(spark, sf))


def p8_checked(spark, sf):
    """Per spec the documents, and what must not be: overfull containers, documents split that fit, tokens lost or doubled, more than a hundredth of the room unused."""
    sizes = materialize(tokens.token_sizes(_read(spark, sf, "documents")), "sizes")
    specs = _specs(spark, sf)
    packed = materialize(packing.pack(sizes, specs), "packed")
    capacity = F.element_at(F.create_map(*[F.lit(x) for s in specs for x in s]), F.col("spec_id"))
    full = packed.filter("container is not null").groupBy("spec_id", "container").agg(F.sum("tokens").alias("n")).groupBy("spec_id")
    full = full.agg(F.count_if(F.col("n") > capacity).alias("overfull"), (F.sum("n") / F.count("*")).alias("held"))
    by_document = packed.groupBy("spec_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("n")).join(sizes, "doc_id", "full")
    wrong = F.coalesce(F.col("n") != F.col("tokens"), F.lit(True))
    docs = by_document.groupBy("spec_id").agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= capacity)).alias("split"), F.count_if(wrong).alias("lost"))
    waste = (F.col("held") < 0.99 * capacity).alias("wasteful")
    return docs.join(full, "spec_id").select("spec_id", capacity.alias("capacity"), "documents", "overfull", "split", "lost", waste)


def p8_filled(spark, sf):
    return packing.fill_report(p8_containers(spark, sf), _specs(spark, sf))


def _mixed(spark, sf):
    sizes = tokens.token_sizes(_read(spark, sf, "documents"), keep=("source",), rated=True)
    return mixing.mix(sizes, _read(spark, sf, "mix_target"), reach=True)


def p9_selection(spark, sf):
    """Sizes are tokens of ``byte_bpe_multi_50k``."""
    return _mixed(spark, sf)[0]


def p9_shares(spark, sf):
    return _mixed(spark, sf)[1]


def p9_checked(spark, sf):
    """Per target source whether its repeats are kept to, and whether its tokens are its share but for one document a source; sources without texts have none."""
    sizes = materialize(tokens.token_sizes(_read(spark, sf, "documents"), keep=("source",), rated=True), "sizes")
    shares = materialize(mixing.mix(sizes, _read(spark, sf, "mix_target"), reach=True)[1], "shares")
    largest = sizes.agg(F.max("tokens")).first()[0] or 0
    live, total, sources = shares.filter("available > 0").agg(F.sum("target_share"), F.sum("tokens"), F.count("*")).first()
    near = F.abs(F.col("tokens") - F.lit(total or 0) * F.col("target_share") / F.lit(live or 1.0)) <= F.lit(largest * sources)
    reached = F.when(F.col("available") > 0, near).otherwise(F.col("tokens") == 0)
    return shares.select("source", "target_share", "max_repeats", (F.col("most_repeats") <= F.col("max_repeats")).alias("kept"), reached.alias("reached"))


def p10_found(spark, sf):
    return sentences.sentence_units(_read(spark, sf, "documents"), lang="lang")


QUERIES = {f.__name__: f for f in (p1_found, p1_summary, p1_bounds, p2_found, p2_scores, p3_found, p3_counts, p4_found, p4_files, p4_rates, p5_found, p5_nearest, p6_found, p6_classes, p7_found, p7_files, p7_statistics, p8_containers, p8_filled, p8_checked, p9_selection, p9_shares, p9_checked, p10_found)}

_PAIRS = "(select term, file_id, max(coalesce(freq, 1)) as freq from spill_file where term <> '' and file_id is not null group by all)"
_LENGTHS = f"(select file_id, coalesce(arg_max(doc_length, indexed_at), max(summed), 0) as length from (select file_id, doc_length, indexed_at, null as summed from (select * from docs_bin qualify row_number() over (partition by file_id order by indexed_at desc, doc_length desc nulls last) = 1) union all select file_id, null, null, sum(freq) from {_PAIRS} group by file_id) group by file_id)"
_SCORES = f"select file_id, term, freq::bigint as tf, df, ln(1 + (n - df + 0.5) / (df + 0.5)) * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * length / average)) as score from {_PAIRS} join (select term, count(*) as df from {_PAIRS} group by term) using (term) join {_LENGTHS} using (file_id), (select count(*) as n, avg(length) as average from {_LENGTHS})"
_COUNTS = f"(select term, sum(freq)::bigint as occurrences, count(*) as files, case when count(*) < 3 then 'rare' when count(*) > 0.45 * (select count(distinct file_id) from docs_bin) then 'common' end as mark from {_PAIRS} group by term)"

_SET_TERMS = "(select file_id, term, count(*) over (partition by file_id) as n from (select distinct file_id, u.term as term from (select file_id, unnest(terms) as u from forward_bin) where u.term <> '') qualify n >= 5)"
_SET_PAIRS = f"(select x.file_id as a, y.file_id as b from {_SET_TERMS} x join {_SET_TERMS} y on x.term = y.term and x.file_id < y.file_id group by all having count(*) >= 0.7 * (min(x.n) + min(y.n) - count(*)))"
_CLASSES = f"(select file_id, min(file_id) over (partition by s) as rep from (select file_id, string_agg(term, chr(1) order by term) as s from {_SET_TERMS} group by file_id))"
_CLASS_LINKS = f"(select rep, count(distinct other) as links from (select x.rep as rep, y.rep as other from {_SET_PAIRS} join {_CLASSES} x on a = x.file_id join {_CLASSES} y on b = y.file_id union all select y.rep, x.rep from {_SET_PAIRS} join {_CLASSES} x on a = x.file_id join {_CLASSES} y on b = y.file_id) where rep <> other group by rep)"
_UNIT = "(select file_id, list_transform(vec, lambda x: x::double / n) as v from (select distinct file_id, vec, sqrt(list_sum(list_transform(vec, lambda x: x::double * x::double))) as n from file_vector where vec is not null) where n > 0)"

ORACLE_SQL = {
    "p1_found": "select term from spill_file where term <> '' group by term having count(*) >= 0.004 * (select count(*) from spill_file where term <> '')",
    "p1_bounds": "select 0::bigint as wrong, 0::bigint as missed",
    "p5_nearest": f"select a as file_id, b as other, round(c, 3) as similarity from (select a.file_id as a, b.file_id as b, list_dot_product(a.v, b.v) as c from {_UNIT} a join {_UNIT} b on a.file_id <> b.file_id where a.file_id % 50 = 0 qualify row_number() over (partition by a.file_id order by c desc, b.file_id) <= 5)",
    "p8_checked": "select spec_id, capacity, (select count(distinct doc_id) from documents) as documents, 0::bigint as overfull, 0::bigint as split, 0::bigint as lost, false as wasteful from container_spec",
    "p9_checked": "select source, target_share, max_repeats, true as kept, true as reached from mix_target",
    "p2_found": f"select file_id, arg_min(term, (-score, term)) as term from ({_SCORES}) where file_id in (select file_id from probe_file) group by file_id",
    "p2_scores": f"select file_id, term, tf, df, round(score, 6) as score from ({_SCORES})",
    "p3_found": f"select term, mark from {_COUNTS} where mark is not null",
    "p3_counts": f"select * from {_COUNTS}",
    "p5_found": f"select distinct least(a, b) as file_id_a, greatest(a, b) as file_id_b from (select a.file_id as a, b.file_id as b, list_dot_product(a.v, b.v) as c from {_UNIT} a join {_UNIT} b on a.file_id <> b.file_id qualify row_number() over (partition by a.file_id order by c desc, b.file_id) <= 5) where c >= 0.9",
    "p6_found": f"select a as file_id_a, b as file_id_b from {_SET_PAIRS}",
    "p6_classes": f"select file_id, rep as class_id, coalesce(links, 0) as links from {_CLASSES} left join {_CLASS_LINKS} using (rep)",
}
