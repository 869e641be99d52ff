"""Translations: newest delivery, segment alignment, audit of completeness, realignment by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T

KEY = ["doc_id", "page", "idx"]


def newest(translations: DataFrame) -> DataFrame:
    """One row per key, the last to arrive; of equal times the one with more segments, then by content."""
    order = Window.partitionBy(*KEY).orderBy(F.col("ingested_at").desc_nulls_last(), F.size("segs").desc(), F.to_json("segs").desc())
    return translations.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def _nonblank(segs: Column) -> Column:
    return F.filter(F.coalesce(segs, F.array().cast("array<string>")), lambda z: F.coalesce(T.trimmed(z), F.lit("")) != "")


def aligned(segs: Column, want: Column) -> tuple[Column, Column]:
    """(segments, note): exactly `want` segments. Too many are cut anew at end marks, else joined in even buckets whose last
    takes the rest; too few are cut at end marks, then padded, and shortened to the number wanted."""
    zh = _nonblank(segs)
    n = F.size(zh)
    whole = F.array_join(zh, "")
    pieces = T.split_chinese(whole)
    per = F.greatest(F.lit(1), F.floor(n / F.greatest(want, F.lit(1)))).cast("int")
    bucket = lambda i: F.array_join(F.slice(zh, i * per + 1, F.when(i < want - 1, per).otherwise(F.greatest(F.lit(0), n - i * per))), "")
    buckets = F.transform(F.sequence(F.lit(0), F.greatest(want, F.lit(1)) - 1), bucket)
    blanks = lambda k: F.array_repeat(F.lit(""), F.greatest(k, F.lit(0)).cast("int"))
    out = (
        F.when(n == 0, blanks(want)).when(n == want, zh)
        .when((n > want) & (F.size(pieces) == want), pieces).when((n > want) & (want == 1), F.array(whole)).when(n > want, buckets)
        .otherwise(F.slice(F.concat(pieces, blanks(want - F.size(pieces))), F.lit(1), F.greatest(want, F.lit(0))))
    )
    note = (
        F.when(n == 0, "empty").when(n == want, "").when((n > want) & (F.size(pieces) == want), "resplit").when(n > want, "merged")
        .when(F.size(pieces) < want, "split+padded").otherwise("split")
    )
    return out, note


def wanted(elements: DataFrame) -> DataFrame:
    """(key, sentences, want) of text elements with sentences."""
    return elements.filter("kind = 'text' and size(sentences) > 0").select(*KEY, "text", "sentences", F.size("sentences").alias("want"))


def align_segments(elements: DataFrame, translations: DataFrame) -> DataFrame:
    """(doc_id, page, idx, want, segs, note) of every translated text element."""
    j = wanted(elements).join(newest(translations).select(*KEY, "segs"), KEY)
    segs, note = aligned(F.col("segs"), F.col("want"))
    return j.select(*KEY, "want", segs.alias("aligned"), note.alias("note"))


def reconcile(elements: DataFrame, translations: DataFrame) -> DataFrame:
    """(doc_id, page, idx, want, n_segs, fixed, blanks): equal counts stay; one wanted takes all joined; else by place, padded or cut. Segments lose a leading volume head."""
    j = wanted(elements).join(newest(translations).select(*KEY, "segs"), KEY)
    zh = F.transform(F.coalesce("segs", F.array().cast("array<string>")), lambda z: T.strip_chinese_volume(F.coalesce(z, F.lit(""))))
    j = j.withColumn("zh", zh)
    padded = F.transform(F.sequence(F.lit(1), F.col("want")), lambda i: F.coalesce(F.try_element_at("zh", i), F.lit("")))
    fixed = F.when(F.size("zh") == F.col("want"), F.col("zh")).when(F.col("want") == 1, F.array(F.array_join(_nonblank(F.col("zh")), ""))).otherwise(padded)
    j = j.withColumn("fixed", fixed)
    return j.select(*KEY, "want", F.size("zh").alias("n_segs"), "fixed", F.size(F.filter("fixed", lambda z: T.trimmed(z) == "")).alias("blanks"))


def translation_audit(elements: DataFrame, translations: DataFrame) -> DataFrame:
    """(doc_id, page, idx, sent, problem): missing, count, blank, placeholder or echoed translations, of documents that have
    translations at all. Bare numbers of up to three digits need none. sent is -1 where the whole element is meant."""
    t = newest(translations).select(*KEY, "segs", F.lit(True).alias("has"))
    scope = translations.select("doc_id").distinct()
    j = wanted(elements).join(scope, "doc_id", "left_semi").join(t, KEY, "left")
    missing = j.filter(F.col("has").isNull() & ~F.coalesce(T.trimmed("text"), F.lit("")).rlike(r"^\d{1,3}\z")).select(*KEY, F.lit(-1).alias("sent"), F.lit("missing").alias("problem"))
    null = j.filter(F.col("has") & F.col("segs").isNull()).select(*KEY, F.lit(-1).alias("sent"), F.lit("not an array").alias("problem"))
    count = j.filter(F.col("has") & (F.size("segs") != F.col("want")) & F.col("segs").isNotNull()).select(*KEY, F.lit(-1).alias("sent"), F.lit("count").alias("problem"))
    even = j.filter(F.col("has") & (F.size("segs") == F.col("want"))).select(*KEY, F.posexplode(F.arrays_zip("sentences", "segs")).alias("sent", "p"))
    zt, src = F.coalesce(T.trimmed("p.segs"), F.lit("")), F.coalesce(T.trimmed("p.sentences"), F.lit(""))
    marks = "(?i)(" + "|".join(T.PLACEHOLDERS) + ")"
    problems = F.when(zt == "", F.array(F.lit("blank"))).otherwise(F.array_compact(F.array(F.when(zt.rlike(marks), "placeholder"), F.when((zt == src) & src.rlike("[A-Za-z]{3,}"), "echo"))))
    parts = even.select(*KEY, "sent", F.explode(problems).alias("problem"))
    return missing.unionByName(null).unionByName(count).unionByName(parts)


def unify_references(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, idx, n_before): elements of several sentences as wide as 60 % of a half page, to be kept as one."""
    w = pages.groupBy("doc_id", "page").agg(F.max("width").alias("width"))
    j = elements.filter("kind = 'text' and size(sentences) >= 2 and bbox is not null").join(w, ["doc_id", "page"])
    return j.filter(F.col("bbox.x1") - F.col("bbox.x0") >= 0.6 * F.col("width") / 2).select(*KEY, F.size("sentences").alias("n_before"))


def stitch(elements: DataFrame) -> DataFrame:
    """(doc_id, page, idx, next_idx, head, tail): the last sentence of an element that doesn't end, and the first of the
    next text element of its page, which continues it in lower case."""
    t = elements.filter("kind = 'text' and size(sentences) > 0").select(*KEY, F.element_at("sentences", -1).alias("head"), F.element_at("sentences", 1).alias("first"))
    w = Window.partitionBy("doc_id", "page").orderBy("idx")
    n = t.withColumn("next_idx", F.lead("idx").over(w)).withColumn("tail", F.lead("first").over(w))
    return n.filter(F.col("tail").rlike("^[a-z]") & ~T.ends_sentence("head")).select(*KEY, "next_idx", "head", "tail", T.join_lines(F.col("head"), F.col("tail")).alias("joined"))


def realign(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, page, old_idx, new_idx): elements matched by their text without blanks, where it is unique on its page on both sides."""
    k = lambda df, c: df.filter("text is not null").select("doc_id", "page", F.col("idx").alias(c), F.regexp_replace("text", r"(?U)\s+", "").alias("k"))
    one = lambda df, c: df.groupBy("doc_id", "page", "k").agg(F.min(c).alias(c), F.count("*").alias("n")).filter("n = 1 and k <> ''").drop("n")
    return one(k(old, "old_idx"), "old_idx").join(one(k(new, "new_idx"), "new_idx"), ["doc_id", "page", "k"]).select("doc_id", "page", "old_idx", "new_idx")
