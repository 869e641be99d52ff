"""Vocabulary and dictionary resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.session import small

KEY = ["doc_id", "page", "idx"]
#: Order of the sources of entries: glossary, word list, cache, others.
TIERS = {"terms": 0, "ecdict": 1, "cache": 2}


def tokens(elements: DataFrame) -> DataFrame:
    """(doc_id, page, idx, sent, pos, word): lookup words of text elements, from their sentences, or their text if they have none."""
    units = F.when(F.size("sentences") > 0, F.col("sentences")).otherwise(F.array(F.coalesce("text", F.lit(""))))
    sents = elements.filter("kind = 'text'").select(*KEY, F.posexplode(units).alias("sent", "s"))
    return sents.select(*KEY, "sent", F.posexplode(T.lookup_tokens("s")).alias("pos", "word")).filter(T.is_lookup_word("word"))


def vocabulary(elements: DataFrame) -> DataFrame:
    """(doc_id, word, page, idx, sent, pos): distinct lower-cased lookup words of each document at their first place."""
    place = F.struct("page", "idx", "sent", "pos")
    first = tokens(elements).groupBy("doc_id", F.lower("word").alias("word")).agg(F.min(place).alias("at"))
    return first.select("doc_id", "word", "at.page", "at.idx", "at.sent", "at.pos")


def acronyms(elements: DataFrame) -> DataFrame:
    """(word, n): tokens of sentences that are capitals throughout, which general dictionaries get wrong. Here a token may end
    with an apostrophe or a hyphen, and is then none; elements without sentences have no tokens."""
    said = elements.filter("kind = 'text' and size(sentences) > 0").select(F.explode("sentences").alias("s"))
    words = said.select(F.explode(F.regexp_extract_all("s", F.lit(r"[A-Za-z][A-Za-z'’\-]*"), F.lit(0))).alias("word"))
    return words.filter(T.is_lookup_word("word") & F.col("word").rlike(r"^[A-Z]{2,}\z")).groupBy("word").agg(F.count("*").alias("n"))


def entries(dictionary: DataFrame) -> DataFrame:
    """One entry per lower-cased word: of several the one of the first source that has a meaning, then by content."""
    tier = F.coalesce(*[F.when(F.col("src") == k, v) for k, v in TIERS.items()], F.lit(len(TIERS)))
    d = dictionary.select(F.lower(T.trimmed("word")).alias("word"), "p", "t", "m", "l", tier.alias("tier")).filter("word <> ''")
    rank = Window.partitionBy("word").orderBy(F.col("m").isNull(), "tier", *[F.coalesce(c, F.lit("")) for c in ("m", "t", "p", "l")])
    return d.withColumn("_k", F.row_number().over(rank)).filter("_k = 1").drop("_k")


def resolve(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, entry, candidate, tier, m): each word with its first base form that the dictionary knows."""
    cands = words.select("word").distinct().select("word", F.posexplode(T.lemma_candidates("word")).alias("candidate", "entry"))
    known = entries(dictionary).select(F.col("word").alias("entry"), "tier", "m")
    hit = cands.join(small(known), "entry")
    best = hit.groupBy("word").agg(F.min(F.struct("candidate", "tier", "entry", "m")).alias("b"))
    return best.select("word", "b.entry", "b.candidate", "b.tier", "b.m")


def unresolved(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Words without entry, acronyms of the surface aside."""
    return words.select("word").distinct().join(resolve(words, dictionary).select("word"), "word", "left_anti")


def coverage(vocab: DataFrame, dictionary: DataFrame, by: str) -> DataFrame:
    """(by, words, direct, via_lemma, missing, coverage, thin): share of each group's distinct words with an entry, in
    percent; thin under 95."""
    w = vocab.select(by, "word").distinct()
    r = w.join(resolve(vocab, dictionary).select("word", "candidate"), "word", "left")
    out = r.groupBy(by).agg(
        F.count("*").alias("words"), F.count_if(F.col("candidate") == 0).alias("direct"), F.count_if(F.col("candidate") > 0).alias("via_lemma"), F.count_if(F.col("candidate").isNull()).alias("missing")
    )
    rate = F.round(100.0 * (F.col("words") - F.col("missing")) / F.greatest("words", F.lit(1)), 1)
    return out.withColumn("coverage", rate).withColumn("thin", F.col("coverage") < 95.0)
