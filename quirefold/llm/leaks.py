"""Problem 7: evaluation passages inside training documents.

Every window of `run` consecutive words of an item has one seed: its n-gram that is rarest in the corpus. A document that
holds the window holds the seed, so no leak is missed. Seeds join documents to items; Smith-Waterman alignment then scores
each candidate, which also finds edited copies, and gives the longest run of equal words.

Two passes over the corpus count and then locate item n-grams; only n-grams of items leave the first, only seeds the
second. The set of evaluation items is small by nature; their n-grams are handed to the tasks while they number at most
GRAM_LIMIT, beyond that they are joined.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.lookalike import by_table
from quirefold.session import is_small, join_hot, materialize, small

RUN, GRAM = 14, 5
#: Item n-grams held by each task at most; about 100 bytes each.
GRAM_LIMIT = 500_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words that a window of an edited copy has; share of an item's score from which a copy counts as one.
EDITED, LEAST_SHARE = 7, 0.5

_WORDS = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, regardless of case, punctuation, spacing and the choice among look-alikes."""
    if not text:
        return []
    if not text.isascii():
        text = by_table(text).casefold()
        text = unicodedata.normalize("NFC", text)
    return _WORDS.findall(text.lower())


def grams(tokens: list[str], n: int) -> list[int]:
    """Signed 64-bit hashes of all n-grams, by position."""
    return [xxhash.xxh64_intdigest(" ".join(tokens[i : i + n])) - (1 << 63) for i in range(len(tokens) - n + 1)]


def _item_grams(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, g) for k, t in zip(f.item_id, f.text) for i, g in enumerate(grams(words(t), n))]
            yield pd.DataFrame(rows, columns=["item_id", "pos", "gram"]).astype({"item_id": "int64", "pos": "int32", "gram": "int64"})

    return run


def _count_known(known: set | None, n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seen: Counter = Counter()
            for t in f.text:
                seen.update(g for g in grams(words(t), n) if known is None or g in known)
            yield pd.DataFrame({"gram": np.fromiter(seen.keys(), np.int64, len(seen)), "n": np.fromiter(seen.values(), np.int64, len(seen))})

    return run


def _locate(known: set | None, n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = {(k, g) for k, t in zip(f.doc_id, f.text) for g in grams(words(t), n) if known is None or g in known}
            yield pd.DataFrame(list(rows), columns=["doc_id", "gram"]).astype("int64")

    return run


def align(a: list[str], b: list[str]) -> tuple[int, int]:
    """(Smith-Waterman score, longest run of equal words) of two token sequences."""
    ids: dict[str, int] = {}
    x = [ids.setdefault(w, len(ids)) for w in a]
    y = np.array([ids.setdefault(w, len(ids)) for w in b], np.int64)
    m = len(y)
    if not x or not m:
        return 0, 0
    step = GAP * np.arange(m + 1)
    h, run, best, longest = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64), 0, 0
    for w in x:
        same = y == w
        nxt = np.zeros(m + 1, np.int64)
        nxt[1:] = np.maximum(np.maximum(h[:-1] + np.where(same, MATCH, MISMATCH), h[1:] + GAP), 0)
        h = np.maximum.accumulate(nxt - step) + step  # gaps along the row
        r = np.zeros(m + 1, np.int64)
        r[1:] = np.where(same, run[:-1] + 1, 0)
        run = r
        best, longest = max(best, int(h.max())), max(longest, int(r.max()))
    return best, longest


def _score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    items: dict[int, list[str]] = {}
    for f in frames:
        out = []
        last, toks = None, []
        for d, i, t, it in zip(f.doc_id, f.item_id, f.text, f.item_text):
            if d != last:
                last, toks = d, words(t)
            if i not in items:
                if len(items) > 10_000:
                    items.clear()
                items[i] = words(it)
            out.append((d, i, *align(items[i], toks), len(items[i])))
        yield pd.DataFrame(out, columns=["doc_id", "item_id", "score", "run", "item_words"]).astype("int64")


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, n: int = GRAM) -> DataFrame:
    """(doc_id, item_id, score, run, item_words) for every document and item that share a seed: the alignment's score
    (2 a matching word, -1 a mismatch or gap) and the longest run of equal words.

    Every pair with `run` or more consecutive equal words is among them. Null and empty texts, and items shorter than
    `run` words, give none; documents of equal text each give their rows; an item given twice counts once."""
    items = items.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").dropDuplicates(["item_id"])
    docs = documents.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    of_items = materialize(items.mapInPandas(_item_grams(n), "item_id bigint, pos int, gram bigint"), "p7-grams")
    listed = of_items.select("gram").distinct().limit(GRAM_LIMIT + 1).toPandas().gram  # to decide between the two ways only
    few = set(listed.tolist()) if len(listed) <= GRAM_LIMIT else None
    counted = docs.select("text").mapInPandas(_count_known(few, n), "gram bigint, n bigint")
    if few is None:
        counted = counted.join(of_items.select("gram").distinct(), "gram", "left_semi")
    counts = counted.groupBy("gram").agg(F.sum("n").alias("n"))
    wide = Window.partitionBy("item_id").orderBy("pos").rowsBetween(0, run - n)
    ranked = of_items.join(small(counts), "gram", "left").withColumn("rare", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))
    full = ranked.withColumn("seed", F.min("rare").over(wide)).withColumn("held", F.count("*").over(wide)).filter(F.col("held") == run - n + 1)
    seeds = materialize(full.filter("seed.n > 0").select("item_id", F.col("seed.gram").alias("gram")).distinct(), "p7-seeds")
    wanted = set(seeds.select("gram").distinct().toPandas().gram.tolist()) if few is not None else None
    found = docs.mapInPandas(_locate(wanted, n), "doc_id bigint, gram bigint")
    pairs = join_hot(found, seeds, ["gram"], salt_from=["doc_id"]).select("doc_id", "item_id").distinct()
    pairs = materialize(pairs, "p7-pairs")
    held = pairs.select("doc_id").distinct()
    # texts of candidates only are shuffled: ids that are few are broadcast, of many a Bloom filter is made by the planner
    texts = docs.join(F.broadcast(held) if is_small(pairs) else held, "doc_id", "left_semi")
    with_item = join_hot(pairs, items.withColumnRenamed("text", "item_text"), ["item_id"], salt_from=["doc_id"])
    return with_item.join(texts, "doc_id").mapInPandas(_score, "doc_id bigint, item_id bigint, score bigint, run bigint, item_words bigint")


def leak_scores(documents: DataFrame, items: DataFrame, window: int = EDITED, share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, item_id, score, share, run, item_words): documents that hold an item or a copy of it with edits, by the alignment.

    share is the score over that of the whole item; pairs with `share` or more are given, and those with a run of RUN equal
    words. Seeds are the rarest n-grams of windows of `window` words, so that a copy is found that is unchanged over one
    window at least."""
    found = leaks(documents, items, window).withColumn("share", F.round(F.col("score") / F.greatest(F.col("item_words") * MATCH, F.lit(1)), 4))
    return found.filter((F.col("share") >= share) | (F.col("run") >= RUN)).select("doc_id", "item_id", "score", "share", "run", "item_words")
