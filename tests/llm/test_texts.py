"""Problems 8 to 10: packing, mixing, sentences."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import mixing, packing, queries, sentences, tokens

PATH = f"{tokens.FOLDER}/{tokens.VOCABULARY}"


def test_token_counts_in_pieces(monkeypatch):
    rng = random.Random(1)
    body = "".join(rng.choice(["word ", "a", "  ", "\n", "漢字", "don't ", "12 ", "\n\n x"]) for _ in range(4000))
    whole = tokens.count_tokens(body, PATH)
    monkeypatch.setattr(tokens, "PIECE", 300)
    assert tokens.count_tokens(body, PATH) == whole
    assert tokens.count_tokens("", PATH) == 0 and tokens.count_tokens("<|endoftext|>", PATH) > 1


def test_token_sizes(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "", None), (4, "x" * 300_000, "t"), (None, "q", "s")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, text string, source string, tokens int")
    got = {r["doc_id"]: (r["tokens"], r["source"]) for r in tokens.token_sizes(df, keep=("source",)).collect()}
    assert got[1] == (3, "s") and got[2] == (0, "s") and got[3] == (0, None) and got[4][0] > 1000 and len(got) == 4


def squares(gaps, capacity, old, size):
    """The sum of squares after an item of ``size`` went into a container with gap ``old``."""
    left = dict(gaps)
    if old != capacity:
        left[old] -= 1
    if old - size:
        left[old - size] = left.get(old - size, 0) + 1
    return left, sum(n * n for n in left.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_sum_of_squares(sizes):
    at = packing.sum_of_squares(np.array(sizes, np.int64), 20)
    fill = np.bincount(at, weights=sizes) if sizes else np.zeros(0)
    assert (fill <= 20).all() and (fill > 0).all()
    gaps, level = {}, {}
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        least = min(squares(gaps, 20, old, sizes[k])[1] for old in [20, *(g for g, n in gaps.items() if n and g >= sizes[k])])
        gaps, reached = squares(gaps, 20, 20 - level.get(at[k], 0), sizes[k])
        level[at[k]] = level.get(at[k], 0) + sizes[k]
        assert reached == least


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 5, 30, 64, 65, 200, 640])) for i in range(400)] + [(900, None)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id bigint, tokens bigint, container string, piece int")
    specs = [(1, 64), (2, 256)]
    packed = packing.pack(df, specs, shard=100)
    out = packed.collect()
    for spec, capacity in specs:
        own = [r for r in out if r["spec_id"] == spec]
        fill, pieces = {}, {}
        for r in own:
            pieces.setdefault(r["doc_id"], []).append(r)
            if r["container"] is not None:
                fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
        assert max(fill.values()) <= capacity and sum(fill.values()) == sum(t or 0 for _, t in rows)
        for i, t in rows:
            assert sum(r["tokens"] for r in pieces[i]) == (t or 0)
            assert [r["piece"] for r in sorted(pieces[i], key=lambda r: r["piece"])] == list(range(max(1, -(-(t or 0) // capacity))))
            assert (t or 0) > 0 or pieces[i][0]["container"] is None
        least = -(-sum(fill.values()) // capacity)
        assert len(fill) <= 1.1 * least + 3
    report = {r["spec_id"]: r["containers"] for r in packing.fill_report(packed, specs).collect()}
    assert set(report) == {1, 2}
    assert packing.pack(df.limit(0), specs).collect() == []
    with pytest.raises(ValueError):
        packing.pack(df, [(1, 0)])


def mix_inputs(spark):
    rng = random.Random(4)
    docs = [(i, rng.randint(1, 200), rng.random(), rng.choice(["big", "Big", "mid one", "mid-one", " big"])) for i in range(3000)]
    docs += [(5000 + i, 50, 1.0, "small") for i in range(40)] + [(6000, 0, 1.0, "big"), (6001, 10, None, None), (6002, 10, 1.0, "other")]
    targets = [("big", 0.5, 1), ("mid_one", 0.3, 2), ("small", 0.15, 3), ("none", 0.05, 2)]
    d = spark.createDataFrame([(*r, "k", 1) for r in docs], "doc_id bigint, tokens bigint, quality double, source string, key string, range int")
    return docs, d, spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_mix(spark):
    docs, d, targets = mix_inputs(spark)
    selection, shares = mixing.mix(d, targets, total=35_000)
    rows = selection.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and not {r["doc_id"] for r in rows} & {6000, 6001, 6002}
    s = {r["source"]: r for r in shares.collect()}
    assert abs(s["small"]["actual_share"] - 0.15 / 0.95) < 0.01 and abs(s["big"]["actual_share"] - 0.5 / 0.95) < 0.01 and s["none"]["tokens"] == 0
    assert all(r["most_repeats"] <= r["max_repeats"] for r in s.values()) and s["small"]["most_repeats"] == 3
    sizes = {i: t for i, t, *_ in docs}
    for r in rows:
        assert r["tokens"] == sizes[r["doc_id"]]
    # The fractional part is the head of the order by key: better documents are drawn more often.
    quality = {i: q for i, _, q, _ in docs}
    taken = [quality[r["doc_id"]] for r in rows if r["source"] == "big"]
    assert np.mean(taken) > np.mean([q for _, _, q, _ in docs[:3000]]) + 0.03
    again = mixing.mix(d.repartition(7), targets, total=35_000)[0]
    assert again.exceptAll(selection).isEmpty() and selection.exceptAll(again).isEmpty()


def test_mix_of_the_size_of_the_corpus(spark):
    docs, d, targets = mix_inputs(spark)
    tokens_of = {name: sum(t for _, t, _, s in docs if s and s.strip().lower().replace(" ", "_").replace("-", "_") == name) for name in ("big", "mid_one", "small")}
    s = {r["source"]: r for r in mixing.mix(d, targets)[1].collect()}
    # The small source stays at its repeats; the others share what is left by their targets, unless they are used up too.
    assert s["small"]["tokens"] == 3 * tokens_of["small"]
    left = sum(tokens_of.values()) - 3 * tokens_of["small"]
    big = min(tokens_of["big"], left * 0.5 / 0.8)
    assert abs(s["big"]["tokens"] - big) < 300 and abs(s["mid_one"]["tokens"] - min(2 * tokens_of["mid_one"], left - big)) < 300
    assert {k: r["available"] for k, r in s.items()} == tokens_of | {"none": 0}


def test_mix_queries_reach_every_share(spark, tmp_path):
    docs = [(i, "one two three four", "large") for i in range(2000)] + [(5000 + i, "one two three four", "small") for i in range(10)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    targets = [("large", 0.8, 2), ("small", 0.1, 3), ("none", 0.1, 4)]
    spark.createDataFrame(targets, "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_target.parquet")
    s = {r["source"]: r for r in queries.p9_shares(spark, str(tmp_path)).collect()}
    # The small source at its repeats is the ninth part of the selection; the large one has 8 times its 30 texts.
    assert s["small"]["most_repeats"] == 3 and abs(s["small"]["actual_share"] - 1 / 9) < 0.005 and abs(s["large"]["actual_share"] - 8 / 9) < 0.005
    selection = queries.p9_selection(spark, str(tmp_path)).groupBy("source").sum("repeats")
    assert dict(selection.collect()) == {"large": 240, "small": 30}


@pytest.mark.parametrize("weight", [1.0, 0.01])
def test_key_ranges_are_even(spark, monkeypatch, weight):
    # With low weights the keys are large; the range in which the budget ends still holds few documents.
    monkeypatch.setattr(mixing, "RANGES", 64)
    d = spark.range(6000).selectExpr("id as doc_id", "10L as tokens", f"{weight}D as quality", "'a' as source")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    seen = []
    real = mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, name: seen.append(df) or real(df, name))
    selection, _ = mixing.mix(d, targets, total=30_000)
    assert selection.count() == 3000
    keyed = real(seen[0], "k").toPandas().sort_values(["key", "doc_id"])
    assert set(keyed["doc_id"][:3000]) == {r["doc_id"] for r in selection.select("doc_id").collect()}


def test_text_quality():
    from textloom.llm.tokens import text_quality

    assert text_quality("") == text_quality("... !!!\n") == 0
    good = "The reader opens every block once and closes it.\nThen it writes the table."
    assert 0 < text_quality("ok") < text_quality("ok " * 50 + "\nok") and text_quality(good) > text_quality(good + "\n" + good)
    assert text_quality(good) > text_quality(good + " #### $$$$ ---- ====") and text_quality("读取块。" * 30) <= 1


def test_mix_saturates(spark):
    docs, d, targets = mix_inputs(spark)
    big = sum(t for _, t, _, s in docs if s and s.strip().lower() == "big")
    selection, shares = mixing.mix(d, targets, total=10**9)
    s = {r["source"]: r for r in shares.collect()}
    assert s["big"]["tokens"] == big and s["small"]["tokens"] == 3 * 40 * 50 and s["mid_one"]["most_repeats"] == 2
    assert mixing.mix(d.limit(0), targets)[0].collect() == []
    assert {r["tokens"] for r in mixing.mix(d.limit(0), targets)[1].collect()} == {0}


CASES = [
    "Dr. Ferrow and Prof. Brask met. ¦ It is due on Jan. 8 at the latest.",
    "Use 5.12, not 3.7.6. ¦ Version 6.1 drops a.py. ¦ 7 runs were late.",
    "Items 1. and 2. of the list are dense. ¦ Q. Osanke owns it, A. Velt the rest.",
    "It stops at 4 p.m. on weekdays. ¦ It stores ids, etc. ¦ No. 5 is next.",
    "Lindqa wrote: \"The block failed. We tried again.\" ¦ The rest is fine.",
    "“Stop the lock!” said Velt, and it stopped. ¦ What does \"shared?\" mean here?",
    "It is stale. ¦ (See p. 2 of the notes.) ¦ The reader (see a.py!) is late.",
    "Nobody saw it… ¦ Why? ¦ He took 1.26% ... and 3% more.",
    "It grew. ¦ gauge_sum reads it. ¦ bucketSort runs.",
    "Am 13. März war er z. B. 2 MB groß. ¦ Er ist alt, d. h. 4 fehlen usw. ¦ Dr. Velt prüfte Nr. 2 bzw. Abb. 3.",
    "Brask schrieb: „Er fehlt. Bitte neu bauen.“ ¦ „Ist er alt?“, fragte Velt.",
    "« Le bloc est vide ? » demanda Velt. ¦ Voir p. 3 et fig. 2. ¦ M. Brask a noté 3 Mo, p. ex. ici.",
    "—¿Está viejo? —preguntó Velt. ¦ ¡No cambie! ¦ El Sr. Velt usa rutas, etc. ¦ ¿Por qué?",
    "Автор пишет: «путь потерян. Начнём снова». ¦ В 7 г. блок вырос, т. е. вдвое. ¦ Ключи и т. д. ¦ Затем.",
    "«Почему?» — спросил S. Velt. ¦ См. рис. 3 и стр. 4.",
    "Γιατί είναι παλιός; ¦ «Είναι κενός;» ρώτησε ο κ. Velt. ¦ Έφτασε π.χ. στο a.py.",
    "यह खाली है | ¦ यह पुरानी है। ¦ \"क्या सूची है?\" उन्होंने पूछा। ¦ डॉ. Velt ने देखा।",
    "لماذا قديم؟ ¦ راجع د. Velt الملف أمس. ¦ «هل فارغ؟» سأل المراجع.",
    "ክፍል ለምን ባዶ ነው፧ ¦ ስሪት 1.2 አይጠቀምም።",
    "버전 1.2은 쓰지 않는다. ¦ \"비어 있나요?\"라고 Velt 씨가 물었다.",
    "ไฟล์ใหม่ปิดบล็อกเดิม ¦ ระบบปิด 3 บล็อกก่อนปิด ¦ รุ่น 2.5 ไม่ใช้ a.rs แล้ว",
    "the lock is stale. ¦ is it late? ¦ it grew, i.e. a lot. ¦ \"is it cold?\" asked velt.",
]
WIDE = ["等一下……还没有关闭。|真的吗？！|（见第5页。）|“空的吗？”审阅者问道。|版本2.1不再使用a.md。", "新しい索引を試す．|担当者は「失敗した。やり直す。」と書いた。|なぜ空なのか？"]


@pytest.mark.parametrize("case", CASES)
def test_sentences(case):
    want = case.split(" ¦ ")
    body = " ".join(want)
    assert [body[a:b] for a, b in sentences.sentences(body)] == want


@pytest.mark.parametrize("case", WIDE)
def test_sentences_without_blanks(case):
    want = case.split("|")
    body = "".join(want)
    assert [body[a:b] for a, b in sentences.sentences(body)] == want


def test_blocks():
    body = "# St. Velt layout\nFirst line\r\ngoes on. Then\nmore\n\nNAME\n\n- one. Two\n* three\n  4. four\n\n```py\nx = 1. Y\n```\n~~~\n```\nNo.\n~~~\nlast"
    want = ["# St. Velt layout", "First line\r\ngoes on.", "Then\nmore", "NAME", "- one.", "Two", "* three", "4. four", "last"]
    assert [body[a:b] for a, b in sentences.sentences(body)] == want


LANGUAGE_CASES = [
    "We chose option d. ¦ Then we left.",
    "He climbed the col. ¦ Then he rested. ¦ We met Col. Brask.",
    "He wore a cap. ¦ 20 men followed.",
    "The U.S. Senate met today. ¦ He lives in the U.S. ¦ The Senate met.",
    "Sen. Warren and Gov. Brown met J. K. Velt there.",
    "O Exmo. Sr. Silva não veio. ¦ A Dra. Lima veio.",
    "To jest hab. Nowak. ¦ Nie ma go.",
    "Bu Bkz. Şekil 3 ve 4. ¦ O da var.",
    "It answers in 35.81 s. ¦ Dr. Velt saw it. ¦ M. D. Velt did not.",
    "Das war z. B. 2 MB groß. ¦ Siehe Abb. 3 und S. 4.",
    "Is it “late”? ¦ It is v. 3 (see p. 4). ¦ Never!",
]


@pytest.mark.parametrize("case", LANGUAGE_CASES)
def test_abbreviations_by_language(case):
    want = case.split(" ¦ ")
    body = " ".join(want)
    assert [body[a:b] for a, b in sentences.sentences(body)] == want


#: One case for each rule of the standard property, as tailored.
RULE_CASES = {
    "SB5": "He said no.\u0301 ¦ Then left.",
    "SB6": "It is 3.4 or .5 of it.",
    "SB7": "See U.N and a.B today.",
    "SB8": "It runs approx. (so they say) daily etc. and nightly.",
    "SB8 digits": "It grew. ¦ 14 blocks are left.",
    "SB8a": "Is it late?, he asked. ¦ Why?! ¦ Yes.",
    "SB9": "(It is late.) ¦ He left.”) ¦ Then came.",
    "SB10": "It is late.  \t ¦ It is cold.",
    "SB11": "One. ¦ Two! ¦ Three? ¦ Four።  ¦ Five.",
}


@pytest.mark.parametrize("case", RULE_CASES.values(), ids=RULE_CASES.keys())
def test_rules(case):
    want = [c.strip() for c in case.split("¦")]
    body = "".join(c for c in case.replace(" ¦ ", " "))
    assert [body[a:b] for a, b in sentences.sentences(body)] == want


def test_fences():
    body = "One. Two.\n```py\nx = 1.\nThree goes on. Four."
    assert [body[a:b] for a, b in sentences.sentences(body)] == ["One.", "Two.", "x = 1.", "Three goes on.", "Four."]
    body = "~~~\nin\n```\nin\n~~~~\nOut.\n```\nin\n```  \nEnd\n````\nopen."
    assert [body[a:b] for a, b in sentences.sentences(body)] == ["Out.", "End", "open."]
    assert sentences.sentences("```\nx.\n```\n") == []


def test_label_is_the_last_resort():
    body = "xx cap. 20 yy."
    assert len(sentences.sentences(body, "EN")) == 2 and len(sentences.sentences(body, "es")) == 1 and len(sentences.sentences(body, None)) == 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB é1.!?…。(\"“”)«» \n\r|#-*`ก😀", max_size=60))
def test_units_are_ordered_and_trimmed(body):
    end = 0
    for a, b in sentences.sentences(body):
        assert end <= a < b and body[a:b] == body[a:b].strip()
        end = b


def test_sentence_units(spark):
    rows = [(1, "A b. C d."), (1, "A b. C d."), (2, None), (3, ""), (4, " \n "), (5, "😀 x. Y" + " z" * 100_000), (None, None)]
    df = spark.createDataFrame([(*r, "e", 3) for r in rows], "doc_id bigint, text string, lang string, sent_start int")
    got = sorted(tuple(r) for r in sentences.sentence_units(df).collect())
    assert got == [(1, 0, 4), (1, 5, 9), (5, 0, 4), (5, 5, 200_006)]
