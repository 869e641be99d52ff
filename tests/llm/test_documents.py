"""Problems 7, 8 and 9: brute force, exactness, worked cases, edge cases."""

import os
import random

import pytest

from quirefold.llm import leaks, mixture, queries, stuffing

LONG = "Eine lange Geschichte geht weiter und weiter. " * 5_000
DOC = "doc_id bigint, text string, source string, gram bigint"


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(10, 50)))) for i in range(30)] + [(0, "again"), (98, None), (99, "")]
    docs = []
    for d in range(200):
        text = " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 80)))
        if d % 3 == 0:
            w = items[rng.randrange(30)][1].split()
            n = rng.randrange(10, 20)
            text += " " + " ".join(x.upper() + rng.choice(["", ",", "\u200b"]) for x in w[:n])
        docs.append((d, text, "s", 1))
    docs += [(500, None, "s", 1), (501, "", "s", 1), (502, LONG, "s", 1), (None, items[1][1], "s", 1), (503, docs[0][1], None, 1)]
    got_rows = leaks.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame([(i, t) for i, t in items if t != "again"], "item_id bigint, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in got_rows if r.run >= 14}
    runs = lambda w: {tuple(w[i : i + 14]) for i in range(len(w) - 13)}
    held = {d: runs(leaks.words(t)) for d, t, _, _ in docs if d is not None}
    want = {(d, i) for i, t in items if t and t != "again" for d in held if held[d] & runs(leaks.words(t))}
    assert got == want and want
    assert all(r.score <= 2 * r.item_words for r in got_rows)


def test_alignment_scores():
    a = "one two three four five".split()
    assert leaks.align(a, a) == (10, 5) and leaks.align(a, "one two x four five".split()) == (7, 2) and leaks.align(a, []) == (0, 0)
    assert leaks.align(a, "one two four five".split()) == (7, 2)


def test_leaks_join_instead_of_sets(spark, monkeypatch):
    item = " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "x " + item, "s", 1), (2, "nothing", "s", 1)], DOC)
    monkeypatch.setattr(leaks, "GRAM_LIMIT", 3)
    got = leaks.leaks(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.item_id, r.run) for r in got] == [(1, 7, 30)]


def test_leaks_empty(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks.leaks(spark.createDataFrame([(1, "a", "s", 1)], DOC), none).count() == 0
    assert leaks.leaks(spark.createDataFrame([], DOC), none).count() == 0


TOKENIZER = f"{queries.TOKENIZERS}/{queries.SIZE_TOKENIZER}"
needs_tokenizer = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer")


@needs_tokenizer
def test_mixture_is_exact(spark):
    rng = random.Random(6)
    docs = [(i, "word " * rng.randrange(1, 40), rng.choice("aaaaaabbc") if i % 50 else None, 1) for i in range(600)] + [(700, None, "a", 1), (701, "", "b", 1), (702, LONG, "z", 1), (5, "again", "a", 1)]
    df = spark.createDataFrame(docs, DOC).dropDuplicates(["doc_id"]).cache()
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.3, 2), ("gone", 0.1, 5), ("b", 0.5, 3), (None, 0.2, 1), ("q", None, None)], "source string, target_share double, max_repeats int")
    rows, shares = mixture.mixture(df, targets, TOKENIZER, 8_000)
    sizes = mixture.token_sizes(df, TOKENIZER).toPandas()
    got = {r.source: r.mixed_tokens for r in shares.collect()}
    for s, share, most in (("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.3, 2)):
        g = sizes[sizes.source == s].sort_values("place")
        have, cum = int(g.tokens.sum()), g.tokens.cumsum()
        budget = min(int(8_000 * share), have * most)
        part = budget % have
        assert got[s] == budget // have * have + int(cum[cum <= part].max() if (cum <= part).any() else 0)
    assert got["gone"] == 0 and got["q"] == 0
    used = rows.collect()
    assert len({r.doc_id for r in used}) == len(used) and max(r.repeats for r in used) <= 3
    for s in "abc":
        assert sum(r.tokens * r.repeats for r in used if r.source == s) == got[s]


@needs_tokenizer
def test_larger_budgets_hold_smaller_ones(spark):
    df = spark.createDataFrame([(i, "word " * (i % 7 + 1), "a", 1) for i in range(300)], DOC)
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    ids = lambda n: {r.doc_id for r in mixture.mixture(df, t, TOKENIZER, n)[0].collect()}
    assert ids(100) < ids(400)
    assert mixture.mixture(df.limit(0), t, TOKENIZER)[1].first().mixed_tokens == 0


SPAM = [
    "cheap ropes cheap ropes buy cheap ropes best cheap ropes cheap ropes", "Home\nAbout\nContact\nGallery\nHome\nPrices", "www.a.test/x\nhttps://b.test\nwww.c.test", "#buy #cheap #ropes #sale #best",
    "oak tables SKU 12-B blue 8.99; stone tiles Art. 34-C 9.99; copper kettles 56-X M 7.99; river tours SKU 78-B 3.99", "Home > About > Prices > Oldtown > Log in > FAQ",
    "Our cheap ropes are the best cheap ropes. Choose cheap ropes because cheap ropes beat other cheap ropes. Our cheap ropes are the best cheap ropes.", "便宜绳索 4701-A 43.99\n橡木桌子 Art. 2300-B 54.99\n羊毛毯 Art. 3446-A 36.99",
]
PROSE = [
    "The harvest follows the law. The council, however, delays the price by a third.", "1. The harvest follows the law.\n2. The council delays the price.\n3. It is late.", "See https://a.test for details. The rest is described in the second part of the report.",
    "The harvest follows\nthe law and the\ncouncil delays the\nprice of the bridge.", "收成影响当地的城市，而能源仍然明显。选举超过北方的方法是一致的。", "In 2013, the bank replaces the law", "",
]


PROSE_LONG = " ".join(f"In {i} the harvest of Oldtown{i} reached {i * 7 % 90} carts, as the council said." for i in range(5_000))


def test_pages(spark):
    docs = [(i, t, "s", 1) for i, t in enumerate(SPAM)] + [(100 + i, t, None, 1) for i, t in enumerate(PROSE)] + [(300, None, "s", 1), (301, PROSE_LONG, "s", 1), (302, " \n ", "s", 1), (303, LONG, "s", 1), (None, SPAM[0], "s", 1), (0, SPAM[0], "s", 1)]
    got = {r.doc_id for r in stuffing.stuffed_pages(spark.createDataFrame(docs, DOC)).collect()}
    assert got == {*range(len(SPAM)), 303}  # one sentence over and over is stuffing, a long text is not
    assert stuffing.stuffed_pages(spark.createDataFrame([], DOC)).count() == 0


def test_shapes_cover_the_text():
    for t in SPAM + PROSE:
        chars = sum(n for n, _ in stuffing.shapes(t).values())
        assert chars <= len(t) and (not t or chars >= 0.5 * len(t))
