"""Problems 2, 3, 4 and 6: worked cases, brute force, held-out accuracy, edge cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quirefold.llm import bitext, lookalike, scans, segment

LONG = "Ein langer Satz steht hier. " * 8_000


# --- look-alikes ---

SAME = [("рaypal", "paypal"), ("ｗｉｄｅ １２", "wide 12"), ("café", "café"), ("ﬁt", "fit"), ("a b", "a b"), ("c　d", "c d"), ("zero​width", "zerowidth"), ("so­ft", "soft"), ("x‑y", "x-y"), ("νot", "vot"), ("Å", "Å"), ("ｶﾞ", "ガ")]
OTHER = [("A", "a"), ("e", "é"), ("x²", "x2"), ("①", "1"), ("a–b", "a-b"), ("a.", "a"), ("a\nb", "a b"), ("a  b", "a b"), ("l", "1"), ("O", "0"), ("I", "l")]


def test_units():
    for a, b in SAME:
        assert lookalike.units(a) == lookalike.units(b), (a, b)
    for a, b in OTHER:
        assert lookalike.units(a) != lookalike.units(b), (a, b)
    for t in [x for p in SAME + OTHER for x in p]:
        once = lookalike.by_table(t)
        assert lookalike.by_table(once) == once and lookalike.units(once) == lookalike.units(t)


def test_pattern_sees_all_that_units_change(spark):
    import sys
    import unicodedata

    signs = [chr(i) for i in range(sys.maxunicode) if not 0xD800 <= i <= 0xDFFF and unicodedata.category(chr(i)) not in ("Cn", "Co") and i != 10 and i != 13 and lookalike.by_table(chr(i)) != chr(i)]
    df = spark.createDataFrame([(s,) for s in signs], "t string")
    missed = [r.t for r in df.filter(~lookalike.suspicious("t")).collect()]
    assert not missed, [hex(ord(c)) for c in missed[:40]]


def test_trie():
    t = lookalike.Trie()
    for w, n in (("Где", 5), ("Гдe", 1), ("дом", 2)):
        t.add(w, n)
    assert {x[1] for x in t.search("Гдe​")} == {"Гдe", "Где"}
    assert lookalike.canonical(t, "Гдe", "LATIN") == "Где" and lookalike.canonical(t, "рaypal", "LATIN") == "paypal" and lookalike.canonical(t, "cop", "CYRILLIC") == "сор"
    assert {x[1] for x in t.search("дум", 1)} == {"дом"} and not t.search("дум")


def test_pairs(spark, make_elements):
    texts = [x for p in SAME for x in p] + [x for p in OTHER for x in p] + ["same", "same", None, "", "​", LONG + "é", LONG + "é"]
    e = make_elements(*[{"doc_id": 1 + i % 1, "idx": i, "text": t} for i, t in enumerate(texts)], {"doc_id": 2, "idx": 0, "text": "paypal"}).withColumn("canonical", F.lit("x"))
    got = {(r.idx_a, r.idx_b) for r in lookalike.lookalike_pairs(e.unionByName(e)).collect()}
    u = [None if t is None else lookalike.units(t) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if u[i] is not None and u[i] == u[j] and texts[i] != texts[j]}
    assert got == want and want
    canon = {r.idx: r.canonical for r in lookalike.consistent_text(e.filter("doc_id = 1")).collect()}
    for i, j in itertools.combinations(canon, 2):
        assert (canon[i] == canon[j]) == (u[i] == u[j])
    assert lookalike.lookalike_pairs(make_elements()).count() == 0


def test_scripts_survive(spark, make_elements):
    """Letters of a script stay in it, tokens of nothing but look-alikes follow their neighbours."""
    cases = {"Где оса и у а с о поэтому": None, "поэтoм она": "поэтом она", "oна у нас": "она у нас", "the оса is here": "the oca is here", "слово cop и дом": "слово сор и дом", "Ελενη ο Τομ": None, "Ζeldogate tо": "Zeldogate to", "a о": "a o"}
    e = make_elements(*[{"doc_id": 1, "idx": i, "text": t} for i, t in enumerate(cases)])
    got = {r.text: r.canonical for r in lookalike.consistent_text(e).collect()}
    assert got == {t: c or t for t, c in cases.items()}


def test_tokens_of_several_scripts(spark, make_elements):
    """Where no single script has all letters, the spelling that the texts use most stands for all that look like it."""
    cyrillic, latin = "в Windowsами", "в Windowsaми"  # the a alone differs
    for most, other in ((cyrillic, latin), (latin, cyrillic)):
        e = make_elements(*[{"doc_id": 1, "idx": i, "text": t} for i, t in enumerate([most] * 3 + [other, most.replace("Win", "Win\u200b")] + ["xไทย", "хไทย", "γo−N"])])
        got = {r.text: r.canonical for r in lookalike.consistent_text(e).collect()}
        assert {got[t] for t in got if "ind" in t or "Win" in t} == {most}
        assert got["γo−N"] == "γo−N" and got["xไทย"] == got["хไทย"] == "xไทย"
        pairs = {(r.idx_a, r.idx_b) for r in lookalike.lookalike_pairs(e).collect()}
        assert pairs == {(0, 3), (1, 3), (2, 3), (0, 4), (1, 4), (2, 4), (3, 4), (5, 6)}
    few, many = "Zoom-дом", "Zооm-дом"  # few and many changes of script
    for n, want in ((1, few), (2, many)):
        t = lookalike.Trie()
        t.add(few, 1), t.add(many, n)
        assert lookalike.canonical(t, few, "LATIN") == lookalike.canonical(t, many, "LATIN") == want


# --- sentence boundaries ---

UNITS = {
    "en": ["Dr. Low measured 3.5 cm of rain.", "“Is it safe?” asked J. K. Low.", "She said: “It is late. It will come.”", "They sold ropes, lamps, etc.", "The plan costs $2.5 million!", "Wait ... it may come.", "The mill is old."],
    "zh": ["水库真的重要吗？", "他说：“灯塔坏了。我们走吧！”", "磨坊在74.9公里之外。", "价格上涨了7%。"],
    "ru": ["Дом стоит 3,42 руб. за кг.", "«Где дом?» — спросил он.", "Это, т. е. дом, важно.", "Почему так?"],
    "th": ["โรงสีอยู่ที่ไหนครับ", "ในปี 28 มีโรงสีมากมาย", "ราคาตลาดน้ำคือ 8.31 บาท", "“โรงสีหายไปแล้ว” เธอกล่าว"],
}


def made(seed, n=160):
    rng, out = random.Random(seed), []
    for lang, units in UNITS.items():
        for _ in range(n):
            picked = [rng.choice(units) for _ in range(rng.randrange(1, 6))]
            sep = "" if lang == "zh" else " "
            text, ends = "", []
            for u in picked:
                text += (sep if text else "") + u
                ends.append(len(text))
            out.append((text, ends))
    return out


def test_boundaries_of_made_texts(spark, make_elements):
    cases = made(5)
    e = make_elements(*[{"doc_id": 1, "idx": i, "text": t} for i, (t, _) in enumerate(cases)])
    got = {(r.idx, r.sent_end) for r in segment.sentence_ends(e).collect()}
    want = {(i, x) for i, (_, ends) in enumerate(cases) for x in ends}
    hit = len(got & want)
    assert hit / len(got) > 0.97 and hit / len(want) > 0.97


def test_certain_places(spark, make_elements):
    texts = ["A Heading / Here\n\nThe text begins. It ends.  ", "no end at all", " ", None, "", LONG, "x" * 100_000]
    e = make_elements(*[{"doc_id": 1, "idx": i, "text": t} for i, t in enumerate(texts)], {"doc_id": 1, "idx": 50, "kind": "image", "text": "a. B."}, {"doc_id": 1, "idx": 51, "text": "Has one. Two.", "sentences": ["Has one.", "Two."]}, {"doc_id": None, "idx": 52, "text": "No key."})
    e = e.withColumn("_ends", F.lit(1)).drop("_ends").withColumn("level", F.lit("B"))
    got = {}
    for r in segment.sentence_ends(e.unionByName(e)).collect():
        got.setdefault(r.idx, []).append(r.sent_end)
    assert set(got) == {0, 1, 5, 6}
    assert sorted(got[0])[0] == 16 and max(got[0]) == len(texts[0].rstrip()) and got[1] == [13] and got[6] == [100_000] and len(got[5]) == 8_000
    filled = {r.idx: r.sentences for r in segment.with_sentences(e.filter("doc_id is not null")).collect()}
    assert filled[1] == ["no end at all"] and filled[51] == ["Has one.", "Two."] and filled[0][0] == "A Heading / Here" and filled[3] is None
    assert segment.sentence_ends(make_elements()).count() == 0


def test_all_labelled_elements_count(spark, make_elements):
    """Every element that has sentences teaches, however many there are, and once per key."""
    text, n = "Orm met Dr. Low. He left.", 21_000
    some = spark.range(n).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("idx"), F.lit("text").alias("kind"), F.lit(text).alias("text"), F.array(F.lit("Orm met Dr. Low."), F.lit("He left.")).alias("sentences"))
    e = make_elements({"doc_id": 1, "text": text + " Dr. Orm"}).unionByName(some.unionByName(some.limit(5)), allowMissingColumns=True)
    m, _ = segment.train(e, segment.to_cut(e), 1)
    assert m.c["U", "dr."][1] == n + 2 and m.c["U", "low."][0] == pytest.approx(n + 1, abs=1)


def test_gaps_inside_quotes():
    kinds = [g[1] for g in segment.gaps("He said: “It is late. We go.” Then he left. End")]
    assert kinds.count(-1) == 1
    assert segment.labels("A b. C d. E", ["A b.", "C d. E"], segment.gaps("A b. C d. E")) == [1, 0, 1]


@pytest.mark.parametrize("text", ["水库仍然充足……“水库在哪里？”", "水库仍然充足……《果园》是86年出版的。", "水库仍然充足……Brefuck表明不同。", "他说“充足”……1853年，货币削弱。"])
def test_gap_without_blank(text):
    at = text.index("……") + 2
    assert (at, 0) in [(g[0], g[1]) for g in segment.gaps(text)]
    assert not [g for g in segment.gaps("版本3.5很好 e.g.fine") if g[1] == 0]


def test_boundaries_do_not_depend_on_what_tasks_hold(spark, make_elements, monkeypatch):
    texts = [t for t, _ in made(9, 60)] + ["Mr. Low met Dr. Orm. Dr. Orm sold etc. to us. Then Dr. Low left."] * 40
    e = make_elements(*[{"doc_id": 1, "idx": i, "text": t} for i, t in enumerate(texts)], *[{"doc_id": 2, "idx": i, "text": "Prof. Um rose. Etc. Ah.", "sentences": ["Prof. Um rose.", "Etc. Ah."]} for i in range(3)])

    def model():
        """All that a task would know, and what it cuts."""
        cut = segment.to_cut(e).cache()
        m, rest = segment.train(e, cut)
        known = {("O", k): v for k, v in m.odds.items()} | {k: v[:2] for k, v in (m.ends | m.c).items() if k[0] != "I"}
        known |= {(r.level, r["name"]): r.b if r.level == "O" else (r.b, r.n) for r in (rest.collect() if rest is not None else [])}
        return known, m.rate, len(m.ends) + len(m.c), sorted((r.idx, r.sent_end) for r in segment.sentence_ends(e).collect())

    want, rate, most, ends = model()
    for n in (0, 60):
        monkeypatch.setattr(segment, "NGRAMS", n)
        got, other, held, cut = model()
        assert held < most and cut == ends and other == pytest.approx(rate, abs=1e-6)
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)


# --- bilingual documents ---

EN = ["The harvest follows the law in {p}.", "The council delays the price in {p}.", "The market reaches the school in {p}.", "The bridge limits the water in {p}."]
DE = ["Die Ernte begleitet die Verordnung in {p}.", "Das Gremium verzögert den Preis in {p}.", "Der Handel erreicht die Schule in {p}.", "Die Brücke begrenzt das Wasser in {p}."]


def test_alignment(spark, make_elements):
    rng = random.Random(3)
    rows, pairs, want = [], [], set()
    for k in range(12):
        a, b = 100 + 2 * k, 101 + 2 * k
        pairs += [(a, "en", b, "de", "x"), (a, "en", b, "de", "x")]
        kinds = [rng.randrange(4) for _ in range(8)]
        names = [f"Zel{k}ra{i}dal" for i in range(8)]
        en = [EN[t].format(p=n) for t, n in zip(kinds, names)]
        de = [DE[t].format(p=n) for t, n in zip(kinds, names)]
        order = list(range(1, 8))  # the first is left out
        order[2], order[3] = order[3], order[2]
        merged = [de[i] for i in order[:-2]] + [de[order[-2]][:-1] + ", und d" + de[order[-1]][1:]]
        rows.append({"doc_id": a, "idx": 0, "sentences": en[:4]})
        rows.append({"doc_id": a, "idx": 1, "sentences": [*en[4:], None, " "]})
        rows.append({"doc_id": b, "idx": 0, "sentences": merged})
        for j, i in enumerate(order[:-2]):
            want.add((a, i // 4, i % 4, b, j))
        want |= {(a, order[-2] // 4, order[-2] % 4, b, 5), (a, order[-1] // 4, order[-1] % 4, b, 5)}
    e = make_elements(*rows, {"doc_id": 999, "sentences": ["The harvest follows the law in Zel0ra1dal."]}).withColumn("pair", F.lit(1))
    p = spark.createDataFrame(pairs, "doc_a bigint, lang_a string, doc_b bigint, lang_b string, w string")
    got = {(r.doc_a, r.idx_a, r.sent_a, r.doc_b, r.sent_b) for r in bitext.aligned_sentences(e.unionByName(e), p).collect()}
    assert len(got & want) / len(got) > 0.95 and len(got & want) / len(want) > 0.95


def test_alignment_edges(spark, make_elements):
    p = spark.createDataFrame([(1, "en", 2, None), (3, "en", 4, "de"), (None, "en", 5, "de")], "doc_a bigint, lang_a string, doc_b bigint, lang_b string")
    e = make_elements({"doc_id": 1, "sentences": ["Only here in Ulmdal."]}, {"doc_id": 3, "sentences": None})
    assert bitext.aligned_sentences(e, p).count() == 0
    assert bitext.aligned_sentences(make_elements(), p).count() == 0


def test_blocks_change_nothing(spark, make_elements, monkeypatch):
    rows = [(EN[i % 4].format(p=f"Zel{i}dal"), DE[i % 4].format(p=f"Zel{i}dal")) for i in range(30)]
    e = make_elements(*[{"doc_id": 1, "idx": i, "sentences": [x]} for i, (x, _) in enumerate(rows)], *[{"doc_id": 2, "idx": i, "sentences": [y]} for i, (_, y) in enumerate(rows)])
    p = spark.createDataFrame([(1, "en", 2, "de")], "doc_a bigint, lang_a string, doc_b bigint, lang_b string")
    got = lambda: sorted(tuple(r) for r in bitext.aligned_sentences(e, p).collect())
    whole = got()
    monkeypatch.setattr(bitext, "BLOCK", 7)
    assert got() == whole and len(whole) == 30
    monkeypatch.setattr(bitext, "LEXICON_BYTES", 0)
    monkeypatch.setattr(bitext, "is_small", lambda t: False)
    assert got() == whole


def test_all_translations_and_frequent_terms(spark):
    side = lambda ts: spark.createDataFrame([(1, 0, s, 7, t) for s in range(3) for t in ts], "pair bigint, block int, sid int, direction int, term bigint")
    concepts = spark.createDataFrame([(1, 0, s, s) for s in range(3)], "pair bigint, block int, sid_a int, sid_b int")
    got = bitext._lexicon(concepts, bitext._listed(side([1])), bitext._listed(side(range(10, 22)))).collect()
    assert {x.as_term for r in got if r.term == 1 for x in r.to} == set(range(10, 22))
    t = spark.createDataFrame([(1, "a", "en", s, x) for s in range(40) for x in ("1", f"{100 + s}")], "pair bigint, side string, lang string, sid int, term string")
    kept = bitext._weighted(t, t.select("lang", "sid").distinct()).groupBy("term").count().collect()
    assert max(r["count"] for r in kept) == 40 and len(kept) == 41


def test_merged_sentence_keeps_all_counterparts(spark):
    """Sentence 1 of b holds the terms 1 to 4; 1 to 4 of a render one each, 5 says the same as 4, 6 shares a term and has others."""
    x = {1: [1], 2: [2], 3: [3], 4: [4], 5: [4], 6: [1, 90, 91, 92]}
    vector = lambda rows, name: spark.createDataFrame([(1, 0, s, 0.0, t, 1.0, len(ts) ** 0.5) for s, ts in rows.items() for t in ts], "pair bigint, block int, sid int, pos float, term bigint, v double, norm double")
    a, b = vector(x, "a"), vector({1: [1, 2, 3, 4]}, "b")
    cells = bitext._ranked(bitext._cells(a, b), 0.0)
    got = bitext._spans(cells, cells.filter("sid_a = 1"), lambda asked: (a, b)).collect()
    assert {(r.sid_a, r.sid_b) for r in got} in ({(k, 1) for k in (2, 3, 4)}, {(k, 1) for k in (2, 3, 4, 5)}, {(k, 1) for k in (2, 3, 5)})
    assert all(r.sid_a != 6 for r in got)


# --- scanned pages ---


def test_distance_and_deletes():
    assert scans.weighted_distance("that", "tliat") == pytest.approx(0.3) and scans.weighted_distance("that", "fhat") == pytest.approx(0.3)
    assert scans.weighted_distance("rn", "m") == pytest.approx(0.3) and scans.weighted_distance("abc", "abx") == 1.0
    assert scans.deletes("abc") == {"abc", "ab", "ac", "bc"} and "tt" in scans.deletes("that") and "he" in scans.deletes("hare")


def test_page_numbers():
    for t in ("12", "– 310 –", "[39]", "ciii", "Page 3 of 9", "l11", "2 88", "Page 75 of 8O"):
        assert scans.PAGE_NUMBER.match(t), t
    for t in ("The End", "Chapter I: on law", "1903 was good", ""):
        assert not scans.PAGE_NUMBER.match(t), t


@pytest.fixture(scope="module")
def scanned(make_elements):
    body = "The harvest follows the law and the council delays the price."
    rows = []
    for p in range(1, 7):
        at = lambda i, y0, y1, t, kind="text", x1=400.0, p=p: {"doc_id": 1, "page": p, "idx": i, "kind": kind, "bbox": (40.0, float(y0), x1, float(y1)), "text": t}
        rows.append({"doc_id": 1, "page": p, "idx": 0, "kind": "image", "bbox": (0.0, 0.0, 500.0, 700.0)})
        rows.append(at(1, 30, 40, "A HISTORY OF THINGS" if p % 2 else "On a law"))
        rows.append(at(2, 60, 200, {2: "A hist0ry of things\nthe " + body, 3: "the har-\nvest and the long-\nterm law", 4: "the harvcst is here", 5: body + " It is per-"}.get(p, body + "\n" + body)))
        rows.append(at(3, 210, 400, "cent of the long-term law. The " + body))
        rows.append(at(4, 680, 690, f"{p + 20}" if p != 4 else "2 4"))
    for i in range(60):
        rows.append({"doc_id": 2, "page": 1, "idx": i, "text": f"{body} percent and long-term history of things {i}"})
    return make_elements(*rows, {"doc_id": 1, "page": 6, "idx": 9, "text": None}, {"doc_id": 1, "page": 6, "idx": 10, "text": LONG}, {"doc_id": 2, "idx": 99, "kind": "image", "bbox": (0.0, 0.0, 100.0, 100.0)})


def test_scan_noise(spark, scanned):
    pages = spark.createDataFrame([(d, p, 500.0, 700.0, "x") for d in (1, 2) for p in range(1, 6)] + [(1, 1, 500.0, 700.0, "x"), (1, 6, None, None, "x")], "doc_id bigint, page int, width double, height double, noise string")
    got = {(r.page, r.idx, r.noise) for r in scans.scan_noise(scanned.unionByName(scanned), pages).collect() if r.doc_id == 1}
    assert {(p, 1, "header") for p in range(1, 7)} <= got and {(p, 4, "pagenum") for p in range(1, 7)} <= got
    assert (2, 2, "header") in got and (2, 2, "misread") in got and (4, 2, "misread") in got
    assert (3, 2, "hyphen") in got and (5, 2, "hyphen") in got
    assert not [x for x in got if x[1] == 3 or x[2] == "misread" and x[:2] not in ((2, 2), (4, 2))]
    assert not [r for r in scans.scan_noise(scanned, pages).collect() if r.doc_id == 2]


def test_held_words_change_nothing(spark, scanned, monkeypatch):
    """What a task holds decides nothing: hyphens, misreadings and choices are the same with one word in tasks."""
    pages = spark.createDataFrame([(d, p, 500.0, 700.0) for d in (1, 2) for p in range(1, 7)], "doc_id bigint, page int, width double, height double")
    both = lambda: (sorted(map(tuple, scans.scan_noise(scanned, pages).collect())), sorted(map(tuple, scans.repaired_paragraphs(scanned, pages).collect())))
    whole = both()
    monkeypatch.setattr(scans, "KNOWN", 1)
    assert both() == whole


def test_repair(spark, scanned):
    pages = spark.createDataFrame([(d, p, 500.0, 700.0) for d in (1, 2) for p in range(1, 7)], "doc_id bigint, page int, width double, height double")
    got = {(r.page, r.idx): r.text for r in scans.repaired_paragraphs(scanned, pages).collect()}
    assert {k[0] for k in got} == set(range(1, 7)) and (2, 2) in got
    assert "istory" not in got[2, 2] and "21" not in " ".join(t for k, t in got.items() if k[0] == 1)
    assert "the harvest and the long-term law" in got[3, 2] and "the harvest is here" in got[4, 2] and "It is percent of the long-term law." in got[5, 2]
    assert scans.mended("A B\nTHE HARVCST is Harvcst", {"first"}, {"harvcst": "harvest"}, set()) == "THE HARVEST is Harvest"


def test_scan_noise_empty(spark, make_elements):
    pages = spark.createDataFrame([], "doc_id bigint, page int, width double, height double")
    assert scans.scan_noise(make_elements(), pages).count() == 0 and scans.repaired_paragraphs(make_elements(), pages).count() == 0
    assert scans.scan_noise(make_elements({"doc_id": 1, "text": "a b"}), pages).count() == 0
