"""Problem 8: mixing sources to target shares of the total size.

Sizes are tokens of a public tokenizer. Every row has a place in [0, 2^62) by the hash of its id. Of each source, a
histogram of tokens by hash bucket tells in which bucket the source's budget ends; only the rows of that bucket are
counted again, in finer buckets, until the budget's threshold is exact to a row. A row's repeats then follow from its
place and its source's threshold: a filter, without sorting rows. Thresholds are nested: a larger budget takes all rows of
a smaller one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.session import discard, join_hot, materialize
from quirefold.sources.tables import rows_once

#: Bits of the hash that place a row, and bits that each round of the histogram resolves.
BITS, STEP = 60, 10


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _count_tokens(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tokenizer(path)
        for f in frames:
            texts = f.text.tolist()
            n = [len(e.ids) for i in range(0, len(texts), 500) for e in t.encode_batch(texts[i : i + 500], add_special_tokens=False)]
            yield f.drop(columns=["text"]).assign(tokens=n).astype({"tokens": "int64"})

    return run


def token_sizes(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, place, tokens): whole texts counted by the tokenizer in file `tokenizer`. Null texts have size 0;
    rows without a source keep it null; a doc_id given twice counts once."""
    rows = rows_once(documents.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")), ["doc_id"])
    placed = rows.withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITS))
    return placed.select("doc_id", "source", "place", "text").mapInPandas(_count_tokens(tokenizer), "doc_id bigint, source string, place bigint, tokens bigint")


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): the rows of a source placed below the threshold have the largest sum of tokens that doesn't
    exceed budgets.part. budgets has (source, part)."""
    state = budgets.select("source", "part", F.lit(0).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("taken"))
    for done in range(0, BITS, STEP):
        shift = BITS - done - STEP
        inside = join_hot(sizes, state, ["source"], salt_from=["place"]).filter(F.shiftright("place", shift + STEP) == F.shiftright("low", shift + STEP))
        if done == STEP:  # from here on only the rows of the boundary buckets are read
            boundary = materialize(inside.select(*sizes.columns), "p8-boundary")
            sizes, inside = boundary, join_hot(boundary, state, ["source"], salt_from=["place"])
        cells = inside.groupBy("source", "part", "low", "taken", F.shiftright("place", shift).alias("cell")).agg(F.sum("tokens").alias("tokens"))
        # 2^STEP cells a source at most: the running sum is over cells, never over rows
        upto = cells.withColumn("upto", F.col("taken") + F.sum("tokens").over(Window.partitionBy("source").orderBy("cell")))
        fits = upto.groupBy("source").agg(
            F.max(F.when(F.col("upto") <= F.col("part"), F.col("upto"))).alias("upto"), F.min(F.when(F.col("upto") > F.col("part"), F.col("cell"))).alias("cell")
        )
        joined = state.join(fits, "source", "left")
        last, state = state, materialize(joined.select(
            "source", "part",
            F.when(F.col("cell").isNull(), F.shiftleft(F.shiftright("low", shift + STEP) + 1, shift + STEP) - F.when(F.lit(shift > 0), F.lit(1)).otherwise(F.lit(0))).otherwise(F.shiftleft("cell", shift)).cast("bigint").alias("low"),
            F.coalesce("upto", "taken").alias("taken"),
        ), "p8-thresholds")
        discard(last)
    return state.select("source", F.col("low").alias("threshold"))


def mixture(documents: DataFrame, targets: DataFrame, tokenizer: str, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, shares). rows(doc_id, source, tokens, repeats) of every row used at least once; shares(source, target_share,
    max_repeats, available_tokens, mixed_tokens, actual_share) of every source in targets.

    The mixture aims at `total` tokens, by default those of all documents. A source whose tokens times max_repeats don't
    reach its share gives all it may, and the actual shares tell. Rows of null sources and of sources without target are
    not used; sources without rows have actual share 0; targets that are null or repeated count as 0 and once."""
    sizes = materialize(token_sizes(documents, tokenizer), "p8-sizes")
    want = targets.filter(F.col("source").isNotNull()).dropDuplicates(["source"]).select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    if total is None:
        total = have.agg(F.sum("available_tokens")).first()[0] or 0
    goal = want.join(have, "source", "left").fillna(0, ["available_tokens"])
    goal = goal.withColumn("budget", F.least(F.floor(F.lit(float(total)) * F.col("target_share")), F.col("available_tokens") * F.col("max_repeats")).cast("bigint"))
    goal = goal.withColumn("whole", F.when(F.col("available_tokens") > 0, F.floor(F.col("budget") / F.col("available_tokens"))).otherwise(0).cast("int"))
    goal = materialize(goal.withColumn("part", F.col("budget") - F.col("whole") * F.col("available_tokens")), "p8-goals")
    used = join_hot(sizes, goal.select("source", "whole", "part").join(thresholds(sizes, goal.filter("part > 0").select("source", "part")), "source", "left"), ["source"], salt_from=["place"])
    rows = used.withColumn("repeats", F.col("whole") + F.when(F.col("place") < F.col("threshold"), 1).otherwise(0)).filter("repeats > 0").select("doc_id", "source", "tokens", "repeats")
    mixed = rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"))
    sums = goal.join(mixed, "source", "left").fillna(0, ["mixed_tokens"])
    share = F.col("mixed_tokens") / F.greatest(F.lit(1), F.sum("mixed_tokens").over(Window.partitionBy()))
    shares = sums.select("source", "target_share", "max_repeats", "available_tokens", "mixed_tokens", F.round(share, 6).alias("actual_share"))
    return rows, shares
