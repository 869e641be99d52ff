import io
import sqlite3
import zipfile

from quirefold.operators import audit, heads, lexicon, render
from quirefold.sources import readers


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("One.", " ", "Two."))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    got = readers.read_docx(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.page, r.idx, r.text) for r in got] == [(1, 0, "One."), (1, 1, "Two.")]


def test_word_lists(spark, tmp_path):
    (tmp_path / "w.csv").write_text("word,phonetic,definition,translation,pos,c5,c6,c7,c8,frq\nTree,tri,,n. 树\\n木,n:46/v:54,,,,,12\nrare,r,,x,,,,,,\nshort,s\ntree,tri2,,树,n:1,,,,,3\nflag,f,,旗,n:1,1,,,,bad\n")
    got = {r.word: (r.p, r.t, r.m) for r in readers.read_word_list(spark, str(tmp_path / "w.csv")).collect()}
    assert got == {"tree": ("tri2", "n.", "树"), "flag": ("f", "n.", "旗")}
    with sqlite3.connect(tmp_path / "w.db") as con:
        con.execute("CREATE TABLE stardict (word, phonetic, translation, pos, frq)")
        con.executemany("INSERT INTO stardict VALUES (?, ?, ?, ?, ?)", [("Tree", "t", "树", "n:1", "5"), ("tree", "t2", "木", "n:1", None), ("far", "f", "远", "a:1", "900")])
    got = {r.word: r.p for r in readers.read_word_base(spark, str(tmp_path / "w.db"), 100, 2).collect()}
    assert got == {"tree": "t2"}


def test_model_round_trip(spark, make_elements, tmp_path):
    e = make_elements({"doc_id": 1, "text": "a", "bbox": (0.0, 1.0, 2.0, 3.0), "sentences": ["a"]}, {"doc_id": 1, "text": "b"})
    pages = spark.createDataFrame([(1, 1, 504.0, 696.0)], "doc_id bigint, page int, width double, height double")
    readers.write_model(e, pages, str(tmp_path / "m"))
    import glob

    part = next(p for p in glob.glob(str(tmp_path / "m" / "part-*")) if open(p).read().strip())
    back = readers.read_model(spark, part).orderBy("idx").collect()
    assert [(r.page, r.idx, r.text) for r in back] == [(1, 0, "a"), (1, 1, "b")] and back[0].bbox.y1 == 3.0


def test_seam_and_cache(spark):
    rows = spark.createDataFrame([("a",)], "word string")
    assert readers.through(rows, None, "word string, m string").count() == 0
    assert readers.through(rows, lambda fs: (f.assign(m="x") for f in fs), "word string, m string", 1).first().m == "x"
    old, new = spark.createDataFrame([("a", "1"), ("b", "1")], "word string, m string"), spark.createDataFrame([("a", "2")], "word string, m string")
    assert {r.word: r.m for r in readers.upsert_cache(old, new).collect()} == {"a": "2", "b": "1"}


def test_lexicon_order(spark):
    d = spark.createDataFrame([("Tree", None, None, "cached", None, "cache"), (" tree ", None, None, "listed", None, "ecdict"), ("run", None, None, "go", None, "terms"), (None, None, None, "x", None, None)], "word string, p string, t string, m string, l string, src string")
    words = spark.createDataFrame([("tree",), ("runs",), ("none",)], "word string")
    assert {r.word: (r.m, r.candidate) for r in lexicon.resolve(words, d).collect()} == {"tree": ("listed", 0), "runs": ("go", 1)}
    assert [r.word for r in lexicon.unresolved(words, d).collect()] == ["none"]


def test_render(spark, make_elements):
    e = make_elements({"doc_id": 1, "text": "A <b> tree", "sentences": ["A <b> tree & more"], "bbox": (0.0, 0.0, 1.0, 1.0)})
    tr = spark.createDataFrame([(1, 1, 0, ["树"], None)], "doc_id bigint, page int, idx int, segs array<string>, ingested_at timestamp")
    html = render.page_html(e, tr).first().html
    assert '&lt;b&gt; <w data-w="tree" data-s="1#0:0">tree</w> &amp; <w data-w="more"' in html and '<p class="zh">树</p>' in html
    assert "section" in render.document_html(render.page_html(e, tr), "t").first().html


def test_heads_and_gates(spark, make_elements):
    es = make_elements(*[{"doc_id": 1, "page": p, "idx": 0, "text": f"Journal of Old Things {p}00 begins", "sentences": [f"Journal of Old Things {p}00 begins here."]} for p in range(1, 5)])
    assert [r.pages for r in heads.probe(es).collect()] == [4]
    assert [r.n for r in audit.repeated_header(es).collect()] == [4]
    stub = make_elements({"doc_id": 1, "text": "http://a http://b http://c http://d " + "x" * 170}, {"doc_id": 2, "text": "Linked Citations"}, {"doc_id": 3, "text": "prose"})
    assert sorted(r.doc_id for r in heads.stub_pages(stub, ("(?i)linked citations",)).collect()) == [1, 2]


def test_stream(spark, make_elements, tmp_path):
    import datetime

    from quirefold.streaming import deliveries

    t = datetime.datetime(2024, 2, 5)
    make_elements({"doc_id": 1, "idx": 0, "text": "ab", "ingested_at": t}, {"doc_id": 1, "idx": 0, "text": "ab", "ingested_at": t}, {"doc_id": 1, "idx": 1, "text": "c", "ingested_at": t}).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = deliveries.first_deliveries(stream).writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 2
    q = deliveries.volumes(stream).writeStream.format("memory").queryName("vol").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.characters) for r in spark.table("vol").collect()] == [(3, 5)]


def test_rows_once(spark, monkeypatch):
    from quirefold import session
    from quirefold.sources import tables

    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "b", "y"), (None, "c", "z")], "doc_id bigint, text string, n string")
    for limit in (session.BROADCAST_LIMIT, -1):
        monkeypatch.setattr(tables, "is_small", lambda t, limit=limit: limit > 0)
        assert sorted(r.doc_id for r in tables.rows_once(df, ["doc_id"]).collect()) == [1, 2]
    assert tables.rows_once(df.filter("doc_id = 2"), ["doc_id"]).count() == 1 and tables.rows_once(df.limit(0), ["doc_id"]).count() == 0
