"""Problem 5: occurrences of every term and of the records that hold it.

Each partition builds suffix arrays over the token sequences of its records, by prefix doubling on integer ranks. In a
suffix array sorted stably, an n-gram is an interval of common prefixes of length n; its size is the n-gram's number of
occurrences. A record that holds an n-gram k times has k suffixes in the interval; linking every suffix with the one
before it of the same record, and subtracting the links that stay inside an interval, leaves its number of records.
A record lies in one batch, so both numbers add up over batches: only (n-gram, occurrences, records) is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.session import materialize

WORD = re.compile(r"[a-z](?:[a-z'’-]*[a-z])?")
RARE, COMMON = 2, 0.1
#: Characters per suffix array; it bounds a task's memory and changes no count.
BATCH_CHARS = 4_000_000


def suffix_intervals(ids: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, classes): positions sorted by their first `depth` tokens, stably, and for n = 1..depth the interval
    number of each position of the array. Ids below 0 are separators, unequal to all others; intervals of prefixes that
    hold one are marked -1."""
    n, ranks, h = len(ids), [], 1
    own = np.where(ids < 0, -np.arange(1, n + 1), ids)  # separators differ from each other
    _, rank = np.unique(own, return_inverse=True)
    by_len = {1: rank.astype(np.int64)}
    while h < depth:
        nxt = np.full(n, -1, np.int64)
        nxt[: n - h] = by_len[h][h:]
        _, r = np.unique(by_len[h] * (n + 1) + nxt + 1, return_inverse=True)
        by_len[2 * h] = r.astype(np.int64)
        h *= 2
    sa = np.argsort(by_len[h], kind="stable")
    dead = np.zeros(n, bool)
    for d in range(1, depth + 1):
        p = 1 << (d.bit_length() - 1)
        here = by_len[p][sa]
        key = here if p == d else np.stack([here, np.concatenate([by_len[p], np.full(d, -1)])[sa + d - p]], 1)
        same = np.zeros(n, bool)
        same[1:] = (key[1:] == key[:-1]) if p == d else (key[1:] == key[:-1]).all(1)
        at = np.minimum(np.arange(n) + d - 1, n - 1)
        dead |= (ids[at] < 0) | (np.arange(n) + d - 1 >= n)
        ranks.append(np.where(dead[sa], -1, np.cumsum(~same) - 1))
    return sa, ranks


def count_ngrams(ids: np.ndarray, records: np.ndarray, depth: int, emit: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n in emit: (n, a position where each n-gram stands, occurrences, records)."""
    if not len(ids):
        return
    sa, classes = suffix_intervals(ids, depth)
    rec = records[sa]
    order = np.argsort(rec, kind="stable")  # suffix-array order within each record
    linked = np.zeros(len(sa), bool)
    for n in emit:
        c = classes[n - 1]
        by_rec, r = c[order], rec[order]
        linked[:] = False
        linked[order[1:]] = (by_rec[1:] == by_rec[:-1]) & (r[1:] == r[:-1])
        live = np.flatnonzero(c >= 0)
        if not len(live):
            continue
        k = c[live]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        occ = np.diff(np.r_[starts, len(k)])
        dup = np.add.reduceat(linked[live].astype(np.int64), starts)
        yield n, sa[live[starts]], occ, occ - dup


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[str]]]:
    """Records of about BATCH_CHARS characters, of each key the first; rows are sorted by key."""
    held, size, last = [], 0, None
    for b in batches:
        keys = zip(*(b.column(c).to_pylist() for c in ("doc_id", "page", "idx")))
        for k, s in zip(keys, b.column("sentences").to_pylist()):
            if k == last:
                continue
            last = k
            s = [x for x in s if x]
            held.append(s)
            size += sum(map(len, s))
            if size >= BATCH_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _count(depth: int, emit: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in _batches(batches):
            vocab: dict[str, int] = {}
            ids: list[int] = []
            lens = np.zeros(len(records), np.int64)
            number = vocab.setdefault
            for i, sentences in enumerate(records):
                before = len(ids)
                for s in sentences:
                    ids += [number(w, len(vocab)) for w in WORD.findall(s.lower())]
                    ids.append(-1)
                lens[i] = len(ids) - before
            words = list(vocab)
            ids_a = np.array(ids, np.int64)
            yield pa.RecordBatch.from_pydict({"term": [None], "n": [0], "occurrences": [len(records)], "records": [len(records)]}, schema=SCHEMA_A)
            for n, at, occ, rec in count_ngrams(ids_a, np.repeat(np.arange(len(records)), lens), depth, emit):
                terms = [words[ids[p]] for p in at] if n == 1 else [" ".join(words[ids[p + j]] for j in range(n)) for p in at]
                yield pa.RecordBatch.from_pydict({"term": terms, "n": np.full(len(at), n, np.int32), "occurrences": occ, "records": rec}, schema=SCHEMA_A)

    return run


SCHEMA = "term string, n int, occurrences bigint, records bigint"
SCHEMA_A = pa.schema([("term", pa.string()), ("n", pa.int32()), ("occurrences", pa.int64()), ("records", pa.int64())])


def term_counts(elements: DataFrame, depth: int = 2, emit: tuple[int, ...] = (1,)) -> DataFrame:
    """(term, n, occurrences, records) for the n-grams of words of every length in `emit`, each at most `depth`, over all
    elements with non-empty sentences; the row with null term and n = 0 has the number of those elements.

    An element delivered more than once counts once. Null sentences inside an array are ignored; n-grams don't cross
    sentences. A word is a longest run of ASCII letters, apostrophes and hyphens that begins and ends with a letter, after
    lower-casing. An empty table gives no rows."""
    key = ["doc_id", "page", "idx"]
    rows = elements.filter(F.size("sentences") > 0).select(*key, "sentences")
    partial = rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(_count(depth, emit), SCHEMA)
    return partial.groupBy("term", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_words(elements: DataFrame, dictionary: DataFrame, rare: int = RARE, common: float = COMMON) -> DataFrame:
    """(word, mark): `rare` for words in at most `rare` elements, `common` for those in more than a share `common` of the
    elements with sentences, `unseen` for dictionary words (trimmed, lower-cased; nulls and blanks left out) in none.
    In a collection so small that a word is both, it is given with both marks."""
    counts = materialize(term_counts(elements), "p5-counts")
    head = counts.filter("n = 0").select("records").first()
    total = head[0] if head else 0
    words = counts.filter("n = 1").select(F.col("term").alias("word"), "records")
    low = words.filter(F.col("records") <= rare).select("word", F.lit("rare").alias("mark"))
    high = words.filter(F.col("records") > F.lit(common) * total).select("word", F.lit("common").alias("mark"))
    listed = dictionary.select(F.lower(F.regexp_replace("word", r"(?U)^\s+|\s+\z", "")).alias("word")).filter("word <> ''").distinct()
    unseen = listed.join(words.select("word"), "word", "left_anti").select("word", F.lit("unseen").alias("mark"))
    return low.unionByName(high).unionByName(unseen)
