"""Problems 1 and 5 against SQL and brute force, and their edge cases."""

import collections
import random
import re

import numpy as np
import pytest

from quirefold.llm import queries, repeats, terms
from tests.oracle import connect, same

LONG = "word " * 40_000


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, data, name):
    same(queries.queries()[name](spark, data), connect(data), queries.oracle_sql()[name])


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id bigint, source string, rank int")


NOTICE, SECOND = "This notice stands in every single paper", "And so does this other line of the notice!"


def test_blocks_span_lines(spark, make_elements):
    d = docs(spark, *[(i, "s" if i < 6 else "t", 0) for i in range(8)], (9, None, 0), (0, "s", 0))
    e = make_elements(*[{"doc_id": i, "idx": 0, "text": f"Own {i}\n{NOTICE}\n{SECOND.upper()}\nTail"} for i in range(4)], {"doc_id": 0, "idx": 0, "text": f"Own 0\n{NOTICE}\n{SECOND.upper()}\nTail"},
                      {"doc_id": 9, "idx": 0, "text": NOTICE}, {"doc_id": 6, "idx": 0, "text": None}, {"doc_id": 7, "idx": 0, "text": ""}, {"doc_id": 5, "idx": 0, "text": LONG}, {"doc_id": 77, "idx": 0, "text": NOTICE})
    found, blocks = repeats.repeated_blocks(e, d)
    assert sorted((r.doc_id, r.line_no) for r in found.collect()) == sorted((i, n) for i in range(4) for n in (1, 2))
    assert sorted((r.doc_id, r.depth) for r in blocks.collect()) == sorted((i, n) for i in range(4) for n in (4, 3, 2, 1))  # Own and Tail stand in all
    assert sorted((r.depth, r.blocks, r.places, r.docs) for r in repeats.block_counts(blocks).collect()) == [(n, 1, 4, 4) for n in (1, 2, 3, 4)]
    clean = {r.doc_id: r.text for r in repeats.without_repeats(e.dropDuplicates(["doc_id"]), found).collect()}
    assert clean[1] == "Own 1\nTail" and clean[6] is None and clean[7] == "" and clean[9] == NOTICE


def test_longest_blocks_against_brute_force(spark, make_elements):
    """Blocks run over elements and pages, lines without letters in between don't part them."""
    rng = random.Random(8)
    rows, seqs = [], {}
    for i in range(9):
        seq = [rng.choice("abc") * 30 for _ in range(12)]
        if i % 2:
            seq[3:8] = ["p" * 30, "q", "r" * 31, "s" * 30, "t" * 40]
        seqs[i] = seq
        for j, x in enumerate(seq):
            rows.append({"doc_id": i, "page": 1 + j // 5 * 3000, "idx": j % 5, "text": x.upper() + "\n12 -"})
    source = lambda i: "s" if i < 6 else "t"
    found, blocks = repeats.repeated_blocks(make_elements(*rows, *rows[:30]), docs(spark, *[(i, source(i), 0) for i in range(9)]))
    want = {}
    for i, seq in seqs.items():
        for p in range(12):
            holds = lambda n: sum(source(o) == source(i) and any(other[k : k + n] == seq[p : p + n] for k in range(13 - n)) for o, other in seqs.items())
            longest = max((n for n in range(1, 13 - p) if holds(n) >= 3), default=0)
            if longest:
                want[i, p] = longest
    assert {(r.doc_id, r.pos): r.depth for r in blocks.collect()} == want and max(want.values()) >= 5
    inside = {(i, p + k) for (i, p), n in want.items() for k in range(n) if len(seqs[i][p + k]) >= 30}
    assert {(r.doc_id, r.pos) for r in found.collect()} == inside


def test_share_and_count(spark, make_elements):
    line = "x" * 30
    for n_docs, holders, hit in ((3, 2, False), (3, 3, True), (10, 3, False), (8, 3, True), (20, 7, True), (21, 7, False)):
        d = docs(spark, *[(i, "s", 0) for i in range(n_docs)])
        e = make_elements(*[{"doc_id": i, "idx": 0, "text": f"{line}\n{line}"} for i in range(holders)])
        assert (repeats.repeated_blocks(e, d)[0].count() == 2 * holders) is hit


def test_short_lines_and_empty_tables(spark, make_elements):
    d = docs(spark, *[(i, "s", 0) for i in range(3)])
    assert repeats.repeated_blocks(make_elements(*[{"doc_id": i, "idx": 0, "text": "too short 123456789 123456789 1234"} for i in range(3)]), d)[0].count() == 0
    assert repeats.repeated_blocks(make_elements(), docs(spark))[0].count() == 0


def brute(records, n):
    occ, rec = collections.Counter(), collections.Counter()
    for r in records:
        mine = collections.Counter()
        for s in r:
            w = re.findall(r"[a-z](?:[a-z'’-]*[a-z])?", s.lower())
            mine.update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
        occ.update(mine)
        rec.update(mine.keys())
    return occ, rec


def test_ngrams_against_brute_force(spark, make_elements):
    rng = random.Random(1)
    records = [[" ".join(rng.choice(["a", "b", "c-d", "E's", "1", "-"]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 4))] for _ in range(60)]
    e = make_elements(*[{"doc_id": 1, "idx": i, "sentences": r} for i, r in enumerate(records)])
    got = terms.term_counts(e.unionByName(e), depth=5, emit=(1, 2, 3, 4, 5)).collect()
    for n in range(1, 6):
        occ, rec = brute(records, n)
        assert {r.term: (r.occurrences, r.records) for r in got if r.n == n} == {t: (occ[t], rec[t]) for t in occ}
    assert [r.records for r in got if r.n == 0] == [60]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 3, 200)
    ids[::17] = -1
    sa, classes = terms.suffix_intervals(ids, 4)
    live = [i for i in range(200) if i + 4 <= 200 and (ids[i : i + 4] >= 0).all()]
    order = [p for p in sa if p in set(live)]
    keys = [tuple(ids[p : p + 4]) for p in order]
    assert keys == sorted(keys) and sorted(order) == live


def test_marks_edge_cases(spark, make_elements):
    e = make_elements({"doc_id": 1, "sentences": ["Tree tree", None, ""]}, {"doc_id": 1, "sentences": []}, {"doc_id": 1, "sentences": None}, {"doc_id": 1, "kind": "image", "sentences": ["tree top"]}, {"doc_id": 2, "idx": 0, "sentences": [LONG]})
    d = spark.createDataFrame([("TREE ", 1), ("leaf", 1), ("leaf", 1), (None, 1), (" ", 1)], "word string, records int")
    got = sorted((r.word, r.mark) for r in terms.marked_words(e, d).collect())
    assert got == [("leaf", "unseen"), ("top", "common"), ("top", "rare"), ("tree", "common"), ("tree", "rare"), ("word", "common"), ("word", "rare")]
    assert [(r.word, r.mark) for r in terms.marked_words(make_elements(), d).collect() if r.word == "leaf"] == [("leaf", "unseen")]
