from pyspark.sql import functions as F

from quirefold.operators import rules
from quirefold.operators.rules import Rule


def test_rules_in_order(spark):
    df = spark.createDataFrame([(1, 1, "REINABOUT Reinabout aaa regress-that, of (x."), (2, 1, "aaa $1")], "doc_id bigint, page int, t string")
    table = [Rule("reinabout", "rein about", True, True), Rule("regress-that", "regress -- that"), Rule("(x", "[x", exact=True), Rule("aaa", "b$1", doc_id=2)]
    got = [r[0] for r in df.orderBy("doc_id").select(rules.apply_rules(F.col("t"), table, F.col("doc_id"), F.col("page"))).collect()]
    assert got == ["REIN ABOUT rein about aaa regress -- that, of [x.", "b$1 $1"]


def test_repair_keeps_rows(make_elements):
    e = make_elements({"doc_id": 1, "text": "bad word", "sentences": ["bad word", None]}, {"doc_id": 1, "text": None})
    got = rules.repair_elements(e, [Rule("bad", "good")]).orderBy("idx").collect()
    assert [(r.text, r.sentences) for r in got] == [("good word", ["good word", None]), (None, None)]


def test_overrides(spark, make_elements):
    e = make_elements({"doc_id": 1, "kind": "formula", "text": "MPL  =\nW/P"}, {"doc_id": 1, "kind": "formula", "text": "x"}, {"doc_id": 1, "text": "MPL = W/P"})
    fixes = spark.createDataFrame([("MPL = W/P", "MPL = W / P"), ("gone", "y"), (None, "z")], "src_text string, new_text string")
    assert [(r.idx, r.new_text) for r in rules.override_formulas(e, fixes).collect()] == [(0, "MPL = W / P")]
    assert [r.src_text for r in rules.stale_overrides(e, fixes).collect()] == ["gone"]


def test_renumbering(make_elements):
    e = make_elements({"doc_id": 1, "page": 1, "text": "a"}, {"doc_id": 1, "page": 2, "text": "Linked citations"}, {"doc_id": 1, "page": 3, "text": "b"})
    assert sorted((r.page, r.new_page) for r in rules.without_stubs(e, (r"(?i)linked citations",)).collect()) == [(1, 1), (3, 2)]


def test_small_parts(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452000001F400000258")
    df = spark.createDataFrame([(bytearray(png), 18, "Times New Roman"), (bytearray(b"x"), 4, "Courier"), (None, 0, None)], "i binary, f int, n string")
    size = [r[0] for r in df.select(rules.png_size(F.col("i"))).collect()]
    assert (size[0].width, size[0].height) == (500, 600) and size[1] is None and size[2] is None
    assert [tuple(r[0]) for r in df.select(rules.style_of(F.col("f"))).collect()] == [(True, True, False), (False, False, True), (False, False, False)]
    assert [r[0] for r in df.select(rules.font_stack("n")).collect()] == ["serif", "monospace", "sans-serif"]
    w = spark.createDataFrame([("a", 200, 100, 10.0, 10.0, 1.0, 20.0), ("b", 0, 100, 1.0, 1.0, 1.0, 1.0)], "w string, nat_w int, nat_h int, x double, y double, w_px double, h_px double")
    r = rules.hotspots(w).collect()
    assert [(x.left, x.top, x.wide, x.high) for x in r] == [(5.0, 10.0, 0.6, 20.0)]
