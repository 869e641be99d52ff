"""Repairs that rewrite elements and translations together: worked cases and edges."""

import pytest

from quirefold.operators import render, rewrites

T = "doc_id bigint, page int, idx int, segs array<string>, ingested_at timestamp"
PAGES = "doc_id bigint, page int, width double, height double, flow boolean"


@pytest.fixture(scope="module")
def zh(spark):
    return lambda *rows: spark.createDataFrame([(*r, None) for r in rows], T)


def box(x0, y0, x1, y1):
    return {"bbox": (float(x0), float(y0), float(x1), float(y1))}


def test_heads_on_both_sides(make_elements, zh):
    e = make_elements({"doc_id": 1, "sentences": ["1655 Vol. XX (May 1990) , Body goes on.", "1656 ", "Next one."]}, {"doc_id": 1, "sentences": ["Vol. II ("]}, {"doc_id": 1, "sentences": ["Plain 1655."]}, {"doc_id": 1, "sentences": None}, {"doc_id": 1, "idx": 4, "sentences": ["Vol. V (May 1990) x", None]})
    t = zh((1, 1, 0, ["1655 《期刊》（1990），正文继续。", "《期刊》", "下一个。"]), (1, 1, 4, None))
    got = {r.idx: (r.sentences, r.text, r.segs, r.dropped, r.dropped_segs) for r in rewrites.strip_both(e, t).collect()}
    assert got[0] == (["Body goes on.", "Next one."], "Body goes on. Next one.", ["正文继续。", "下一个。"], 1, 1)
    assert got[4] == (["x"], "x", [], 1, 0) and got[1][0] == ["Vol. II ("] and set(got) == {0, 1, 4}
    assert rewrites.strip_both(make_elements(), t).count() == 0


def test_folios(spark, make_elements, zh):
    pages = spark.createDataFrame([(1, 1, 500.0, 700.0, False)], PAGES)
    e = make_elements({"doc_id": 1, "text": " 17 ", "sentences": ["17"], **box(240, 10, 260, 20)}, {"doc_id": 1, "text": "17", **box(240, 300, 260, 310)}, {"doc_id": 1, "text": None, **box(1, 1, 2, 2)}, {"doc_id": 1, "text": "3"}, {"doc_id": 9, "text": "3", **box(1, 1, 2, 2)})
    done, t = rewrites.blank_folios(e, pages, zh((1, 1, 0, ["十七"]), (1, 1, 1, ["十七"])))
    got = {(r.doc_id, r.idx): (r.text, r.sentences) for r in done.collect()}
    assert got[1, 0] == ("", []) and got[1, 1] == ("17", None) and got[1, 2] == (None, None) and got[1, 3][0] == "3" and got[9, 4][0] == "3"
    assert [r.idx for r in t.collect()] == [1]
    assert rewrites.self_checks(e, pages, zh()).count() == 0


def test_references(spark, make_elements, zh):
    pages = spark.createDataFrame([(1, 1, 500.0, 700.0, False), (1, 2, 500.0, 700.0, False)], PAGES)
    entry = {"doc_id": 1, "text": " A. B. Title. ", "sentences": ["A.", "B. Title."]}
    e = make_elements({**entry, **box(0, 0, 160, 9)}, {**entry, **box(0, 0, 140, 9)}, {**entry, "page": 2, **box(0, 0, 200, 9)})
    got = rewrites.unified_references(e, pages, pages.filter("page = 1")).collect()
    assert [(r.page, r.idx, r.sentences) for r in got] == [(1, 0, ["A. B. Title."])]
    e = make_elements({"doc_id": 1, "text": "Quart. "}, {"doc_id": 1, "text": "J., Dec-"}, {"doc_id": 1, "text": "ember"}, {"doc_id": 1, "kind": "formula", "text": "x"}, {"doc_id": 1, "text": "Own"}, {"doc_id": 2, "text": "First"}, {"doc_id": 2, "text": " "})
    marks = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (2, 1, 5), (2, 1, 6), (1, 1, 2)], "doc_id bigint, page int, idx int")
    got = {(r.doc_id, r.idx): (r.sentences, r.text, r.segs) for r in rewrites.rejoined(e, zh((1, 1, 0, ["季", " "]), (1, 1, 1, ["刊"])), marks).collect()}
    assert got == {(1, 0): (["Quart. J., Dec ember"], "Quart. J., Dec ember", ["季刊"]), (1, 1): ([], "", []), (1, 2): ([], "", [])}


def test_tails(spark, make_elements, zh):
    e = make_elements({"doc_id": 1, "sentences": ["A one.", "It is repre-"]}, {"doc_id": 1, "page": 2, "sentences": ["sentative here.", "Next."]}, {"doc_id": 1, "page": 2, "sentences": ["other"]})
    c = spark.createDataFrame([(1, 1, 0, 2, 1, "here."), (1, 1, 0, 2, 2, "nothing"), (1, 7, 7, 2, 1, "here.")], "doc_id bigint, page int, idx int, tail_page int, tail_idx int, expected string")
    changed, failed = rewrites.moved_tails(e, zh((1, 1, 0, ["一。", "二"]), (1, 2, 1, ["三。", "四。"])), c)
    got = {(r.page, r.idx): (r.sentences, r.text, r.segs) for r in changed.collect()}
    assert got == {(1, 0): (["A one.", "It is representative here."], "A one. It is representative here.", ["一。", "二"]), (2, 1): (["Next."], "Next.", ["四。"])}
    assert failed.count() == 2


def test_laid_pages(spark, make_elements, zh):
    pages = spark.createDataFrame([(1, 1, 500.0, 700.0, False), (2, 1, 595.0, 842.0, True)], PAGES)
    e = make_elements(
        {"doc_id": 1, "text": "Trees & more of a longer line", "sentences": ["Trees & more of a longer line"], "size": 10.0, **box(50, 100, 250, 112)}, {"doc_id": 1, "text": "12", "sentences": ["12"], **box(50, 200, 60, 212)},
        {"doc_id": 1, "kind": "formula", "text": "a<b", **box(50, 690, 90, 702)}, {"doc_id": 1, "kind": "image", "image": bytearray(b"xy"), **box(300, 300, 350, 340)}, {"doc_id": 1, "text": "", **box(0, 0, 1, 1)}, {"doc_id": 2, "text": "Flow", **box(0, 0, 595, 0)},
    )
    hot = spark.createDataFrame([(1, 1, 3, 200, 100, [("word", 20.0, 10.0, 0.1, 30.0)])], "doc_id bigint, page int, idx int, nat_w int, nat_h int, words array<struct<w:string,x:double,y:double,w_px:double,h_px:double>>")
    latex = spark.createDataFrame([(1, 1, 2, "a \\lt b")], "doc_id bigint, page int, idx int, latex string")
    t = zh((1, 1, 0, ["树"]), (1, 1, 1, ["十二"]))
    got = {r.doc_id: r.html for r in render.laid_pages(e, pages, t, hot, latex).collect()}
    one = got[1]
    assert '<w data-w="trees" data-s="1#0:0">Trees</w> &amp; ' in one and ">树</span>" in one and "十二" not in one and 'class="el txt short"' in one
    assert 'data-latex="a \\lt b"><span class="fx">a&lt;b</span>' in one and "base64,eHk=" in one
    assert 'left:10.000%;top:10.000%;width:0.600%;height:30.000%" data-w="word"' in one and one.count("class=\"el") == 4
    assert one.startswith('<section class="page" data-page="1" style="width:500.0px;height:7') and got[2].startswith('<section class="page flow" data-page="1"><div class="flowbody">')
    assert len({r.html for r in render.laid_pages(e, pages, t).collect()}) == 2 and render.laid_pages(make_elements(), pages, t).count() == 0
