"""Geometry on small pages whose results are known, and against brute force."""

import pytest

from quirefold.operators import align, folds, layout


@pytest.fixture(scope="module")
def sizes(spark):
    return spark.createDataFrame([(1, 1, 504.0, 696.0, False), (1, 1, 504.0, 696.0, False), (2, 1, 504.0, 696.0, False)], "doc_id bigint, page int, width double, height double, flow boolean")


def box(x0, y0, x1, y1):
    return (float(x0), float(y0), float(x1), float(y1))


@pytest.fixture(scope="module")
def two_columns(make_elements):
    at = [(36, 60, 236, 160), (261, 60, 461, 160), (36, 200, 236, 320), (262, 200, 461, 520), (36, 330, 236, 500)]
    return make_elements(*[{"doc_id": 1, "bbox": box(*b), "text": f"Text {i} goes on.", "size": 10.0, "sentences": [f"Text {i} goes on."]} for i, b in enumerate(at)])


def test_gutter_and_columns(two_columns, sizes):
    assert [r.gutter for r in layout.gutters(two_columns, sizes).collect()] == [261.0]
    assert [r.side for r in layout.columns(two_columns, sizes).orderBy("idx").collect()] == ["left", "right", "left", "right", "left"]
    assert layout.columns(two_columns, sizes).orderBy("idx").first().column_right == 253.0


def test_pairing(two_columns, sizes):
    r = layout.column_pairing(two_columns, sizes).first()
    assert r.ratio > 0.6 and not r.collapsed


def test_pushdown_matches_cursors(two_columns, sizes, spark):
    segs = [(1, 1, i, ["中文。" * 30], None) for i in range(5)]
    tr = spark.createDataFrame(segs, "doc_id bigint, page int, idx int, segs array<string>, ingested_at timestamp")
    got = {r.idx: (r.top, r.bottom) for r in layout.relayout(two_columns, sizes, tr).collect()}
    high = {r.idx: r.est_height for r in layout.estimated_heights(two_columns, tr).collect()}
    y = {r.idx: (r.bbox.y0, r.bbox.y1, r.bbox.x0) for r in two_columns.collect()}
    side = {r.idx: r.side for r in layout.columns(two_columns, sizes).collect()}
    cursor = {"left": -1e9, "right": -1e9}
    for i in sorted(y, key=lambda i: (y[i][0], y[i][2])):
        top = max(y[i][0], cursor[side[i]] + layout.GAP)
        cursor[side[i]] = top + max(high[i], y[i][1] - y[i][0], 10.0)
        assert got[i] == (pytest.approx(top), pytest.approx(cursor[side[i]]))


def test_widened_boxes(make_elements, sizes, spark):
    long = "Some words that need room. " * 3
    made = [(36, 100, "text", 10.0, long), (36, 100, "text", 10.0, "ab"), (36, 100, "text", 14.0, "A Head Line Over All"), (36, 470, "text", 10.0, long * 9), (36, 100, "image", 14.0, None), (36, 100, "text", None, None)]
    e = make_elements(*[{"doc_id": 1, "idx": i, "kind": k, "bbox": box(x0, 20 * i, x1, 20 * i + 12), "text": t, "size": z} for i, (x0, x1, k, z, t) in enumerate(made)], {"doc_id": 1, "idx": 9, "text": "no box"})
    got = {r.idx: r.bbox and r.bbox.x1 for r in layout.widened(e, sizes).collect()}
    need = {i: spark.range(1).select(layout.T.text_advance(layout.F.lit(made[i][4]), layout.F.lit(made[i][3]))).first()[0] for i in (0, 2)}
    want = {i: 36 + min(432 - 36, max(64.0, need[i] * 1.02)) for i in (0, 2)}
    assert got == {0: pytest.approx(want[0]), 1: 100.0, 2: pytest.approx(want[2]), 3: 470.0, 4: 100.0, 5: 100.0, 9: None}
    assert want[0] > 100 and want[2] > 100
    none = spark.createDataFrame([], "doc_id bigint, page int, idx int, segs array<string>, ingested_at timestamp")
    bottom = lambda x: {r.idx: r.bottom - r.top for r in layout.relayout(x, sizes, none).collect()}
    assert bottom(layout.widened(e, sizes))[0] < bottom(e)[0]


def test_coverage_and_bands(make_elements, sizes):
    e = make_elements({"doc_id": 1, "bbox": box(0, 0, 10, 100), "text": "a"}, {"doc_id": 1, "bbox": box(0, 50, 10, 200), "text": "b"}, {"doc_id": 1, "bbox": box(0, 400, 10, 500), "text": "c"}, {"doc_id": 1, "kind": "image", "bbox": box(0, 0, 504, 696)})
    assert layout.coverage(e, sizes).first().covered == pytest.approx(300 / 696)
    assert sorted((r.band_top, r.band_bottom) for r in layout.uncovered_bands(e, sizes).collect()) == [(200.0, 400.0), (500.0, 696.0)]
    assert [r.skipped for r in layout.scan_marks(e, sizes).collect()] == [False]
    assert [r.skipped for r in layout.scan_marks(e, sizes, "drop").collect()] == [True]


def test_overlap_contained_slots(make_elements):
    e = make_elements(
        {"doc_id": 1, "bbox": box(0, 0, 100, 100), "text": "a"}, {"doc_id": 1, "kind": "formula", "bbox": box(10, 10, 20, 20), "text": "b"}, {"doc_id": 1, "bbox": box(0.2, 0.1, 5, 5), "text": "c"}, {"doc_id": 1, "text": "no box"},
    )
    assert {(r.idx_a, r.idx_b) for r in layout.overlapping(e).collect()} == {(0, 1), (0, 2)}
    assert [(r.idx, r.host) for r in layout.contained(e).collect()] == [(1, 0)]
    assert [r.n for r in layout.coincident(e).collect()] == [2]


def test_runs_and_paragraphs(make_elements):
    e = make_elements({"doc_id": 1, "bbox": box(0, 0, 50, 10), "text": "repre-", "size": 10.0}, {"doc_id": 1, "bbox": box(52, 0, 90, 10), "text": "sentative", "size": 10.0}, {"doc_id": 1, "bbox": box(0, 12, 90, 22), "text": "of all.", "size": 10.0})
    assert [r.text for r in folds.text_runs(e).orderBy("run").collect()] == ["representative", "of all."]
    p = make_elements({"doc_id": 1, "bbox": box(0, 0, 90, 10), "text": "It goes"}, {"doc_id": 1, "bbox": box(0, 12, 90, 22), "text": "on here."}, {"doc_id": 1, "bbox": box(0, 24, 90, 34), "text": "New one"})
    assert [r.text for r in folds.paragraphs(p).orderBy("run").collect()] == ["It goes on here.", "New one"]
    assert [r.n for r in folds.baseline_lines(e).orderBy("line").collect()] == [2, 1]


def test_fraction_and_orphan(make_elements):
    f = lambda t, *b: {"doc_id": 1, "kind": "formula", "text": t, "bbox": box(*b)}
    e = make_elements(f("MPL =", 0, 20, 60, 30), f("W", 40, 8, 50, 18), f("P", 40, 32, 50, 42))
    r = folds.fractions(e).collect()
    assert [(x.idx, x.text) for x in r if x.idx == 0] == [(0, "MPL = W / P")]
    o = make_elements({"doc_id": 1, "text": "n", "bbox": box(10, 0, 14, 8)}, f("x = y", 0, 10, 50, 20))
    assert [(x.idx, x.host) for x in folds.orphans(o).collect()] == [(0, 1)]


def test_align(spark):
    from pyspark.sql import functions as F

    cases = [(["a。", "b。"], 2, "a。|b。", ""), (["a。b。"], 2, "a。|b。", "split"), (["a", "b", "c"], 2, "a|bc", "merged"), (["a。", "b", "。"], 2, "a。|b。", "resplit"), ([], 1, "", "empty"), (["a"], 2, "a|", "split+padded"), (["a", None, " "], 1, "a", "")]
    df = spark.createDataFrame([(i, s, w) for i, (s, w, _, _) in enumerate(cases)], "i int, segs array<string>, want int")
    s, n = align.aligned(F.col("segs"), F.col("want"))
    assert [(r[0], r[1]) for r in df.orderBy("i").select(F.array_join(s, "|"), n).collect()] == [(a, b) for _, _, a, b in cases]


def test_empty_tables(make_elements, sizes, spark):
    e = make_elements()
    tr = spark.createDataFrame([], "doc_id bigint, page int, idx int, segs array<string>, ingested_at timestamp")
    for df in (layout.gutters(e, sizes), layout.columns(e, sizes), layout.coverage(e, sizes), layout.relayout(e, sizes, tr), folds.text_runs(e), folds.baseline_lines(e), align.translation_audit(e, tr)):
        assert df.count() == 0
