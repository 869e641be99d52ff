"""Worked values of the string expressions."""

import pytest
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import heads


@pytest.fixture(scope="module")
def run(spark):
    def f(expr, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
        return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]

    return f


def test_sentences(run):
    out = run(T.split_sentences, "Dr. A. Smith paid 3.5 dollars. Then he left! Why?", "One", "", "Fig. 3 shows it. e.g. here. End.")
    assert out[0] == ["Dr. A. Smith paid 3.5 dollars.", "Then he left!", "Why?"]
    assert out[1] == ["One"] and out[2] == []
    assert out[3] == ["Fig. 3 shows it.", "e.g. here.", "End."]


def test_resplit(run):
    assert run(T.resplit_sentences, "Smith vs. Jones won. See Fig. Three. (a) Next one. (b) The end? Yes. 1. Go") == [["Smith vs. Jones won.", "See Fig.", "Three.", "(a) Next one.", "(b) The end?", "Yes. 1.", "Go"]]


def test_lemmas(run):
    assert run(T.lemma_candidates, "studies", "boxes", "is", "baking", "added", "glass") == [
        ["studies", "study", "studi", "studie"], ["boxes", "box", "boxe"], ["is"], ["baking", "bak", "bake"], ["added", "add", "adde", "ade"], ["glass"]]


def test_gloss(spark):
    df = spark.createDataFrame([("n. 顺序；序列",), ("名词 河",), ("plain",)], "t string")
    tag, rest = T.clean_gloss("t")
    assert [tuple(r) for r in df.select(tag, rest).collect()] == [("n.", "顺序；序列"), ("名词", "河"), ("", "plain")]


def test_small_functions(run):
    assert run(T.format_pos, "n:46/v:54/n:1/a:2/b:3") == ["n./v./a."]
    assert run(T.first_lines, "a\\nb; c；\n d") == ["a；b；c；d"]
    assert run(T.expand_ligatures, "proﬁt eﬃcient Œuvre") == ["profit efficient OEuvre"]
    assert run(T.fix_double_stem, "macmacroeconomics", "Micmicroeconomic") == ["macroeconomics", "Microeconomic"]
    assert run(lambda t: T.fix_drop_caps(t, {"WENTY": "TWENTY", "HIS": "THIS"}), "WENTY YEARS AGO", "HIS dog") == ["TWENTY YEARS AGO", "HIS dog"]
    assert run(lambda t: T.fix_words(t, (("jirst", "first"), ("Keyndsian", "Keynesian"))), "Jirst jirsts Keyndsian keyndsian") == ["first jirsts Keynesian keyndsian"]
    assert run(lambda t: T.strip_volume_head(t, "December", "1990"), "Vol. XXVIII (December 1990) Body", "Vol. XXVIII (May 1990) Body") == ["Body", "Vol. XXVIII (May 1990) Body"]
    assert run(T.strip_chinese_volume, " 第XXVIII卷（1990年12月）正文", "第一卷 正文") == ["正文", "第一卷 正文"]
    assert run(T.ends_sentence, "It ends.", "see Vol.", 'He said "yes."', "no end") == [True, False, True, False]
    assert run(T.math_score, "x", "∑=1", None) == [0.0, pytest.approx((1 + 0.7 + 0.5) / 3), None]
    assert run(heads.strip_heads, "1655 Vol. XX (May 1990) 1655 Body", "Body") == ["Body", "Body"]
    assert run(T.naive_sentences, "A. B! C") == [["A.", "B!", "C"]]
    assert run(T.split_chinese, "一。二！", "三", "") == [["一。", "二！"], ["三"], []]


def test_join(spark):
    df = spark.createDataFrame([("repre-", "sentative"), ("the", "end"), ("A-", "B")], "a string, b string")
    assert [r[0] for r in df.select(T.join_lines(F.col("a"), F.col("b"))).collect()] == ["representative", "the end", "A- B"]


def test_math_line(spark):
    df = spark.createDataFrame([("GDP = C + I + G + NX", "Times"), ("the rate = of return", "Times"), ("αβ", "CMMI10"), ("Consumption", "Times"), ("a + b", "Times"), ("a = is b", "Times"), ("a − b or c + d", "CMMI10"), ("Cost + Rent - Tax", "CMMI10")], "t string, f string")
    assert [r[0] for r in df.select(T.is_math_line("t", "f")).collect()] == [True, False, True, False, True, True, True, True]


def test_learned_pieces(spark, make_elements):
    said = lambda d, i, s: {"doc_id": d, "idx": i, "sentences": [s]}
    e = make_elements(said(1, 0, "1655 Vol. XX (May"), said(1, 1, "Course in  Macro: text"), said(1, 2, "vol. v ("), said(1, 3, "Plain prose"), said(1, 4, "Plain prose"), said(2, 0, "Vol. X (1)"), {"doc_id": 1, "idx": 5, "sentences": None})
    t = spark.createDataFrame([(1, 1, 0, ["曼昆：快速回顾 在实际"]), (1, 1, 1, ["曼昆：快速回顾在经济"]), (1, 1, 2, ["宏观课程 1655 困扰"]), (1, 1, 3, ["在第一种情形中"]), (1, 1, 4, ["在第一种情形中"]), (2, 1, 0, ["只有一个 1655 头"]), (1, 1, 5, None)], "doc_id bigint, page int, idx int, segs array<string>")
    assert {tuple(r) for r in heads.learn_pieces(e, t, ("Course in Macro",)).collect()} == {(1, "曼昆：快速回顾"), (1, "宏观课程")}
    assert heads.learn_pieces(e.limit(0), t).count() == 0


def test_stub_pages(make_elements):
    texts = ["http://www.example.org", "An article"]
    links = "https://a.b " * 20
    e = make_elements(*[{"doc_id": 1, "idx": i, "text": t} for i, t in enumerate(texts)], {"doc_id": 2, "text": " http://www.example.org "}, {"doc_id": 3, "text": "LINKED citations"}, {"doc_id": 4, "text": links}, {"doc_id": 5, "text": None}, {"doc_id": 6, "text": links + "prose " * 500})
    marks = (r"(?i)linked citations", r"(?i)^\s*http://www\.example\.org\s*\z")
    assert {r.doc_id for r in heads.stub_pages(e, marks).collect()} == {2, 3, 4} and {r.doc_id for r in heads.stub_pages(e).collect()} == {4}


def test_acronyms(make_elements):
    from quirefold.operators import lexicon

    e = make_elements({"doc_id": 1, "text": "BLEU", "sentences": ["WMT and BLEU- x", "A IS NATO's NATO"]}, {"doc_id": 1, "idx": 1, "text": "ONLY text"}, {"doc_id": 1, "idx": 2, "sentences": None})
    assert {(r.word, r.n) for r in lexicon.acronyms(e).collect()} == {("WMT", 1), ("NATO", 1)}


def test_lookup_words(run):
    assert run(T.lookup_tokens, "naïve don't x-ray") == [["na", "ve", "don't", "x-ray"]]
    assert run(T.is_lookup_word, "the", "x", "tree") == [False, False, True]
