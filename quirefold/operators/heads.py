"""Running heads and pages without article content."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import text as T

PAGE, KEY = ["doc_id", "page"], ["doc_id", "page", "idx"]
# Heads of any journal scan, and their translated forms.
ENGLISH = (r"^\s*\d{3,4}\s+", r"(?i)^\s*Vol\.\s*[IVXL]+\s*\(\s*[A-Z][a-z]+\s+\d{4}\s*\)\s*[,.]?\s*", r"^\s*[（(]\s*[A-Z][a-z]+\s+\d{4}\s*[）)]\s*[,.]?\s*")
CHINESE = (r"^\s*\d{3,4}\s*", r"^\s*《[^》]{1,60}》\s*(?:[（(][^）)]{0,40}[）)])?\s*[，,、]?\s*", r"^\s*[（(]\s*[A-Za-z][^）)]{0,60}[）)]\s*[，,、]?\s*", r"^\s*[，,、]\s*")
VOLUME = r"Vol\.\s*[IVXL]+\s*\("
ROUNDS = 8


def literal(piece: str) -> str:
    """A literal piece of a head as a pattern that takes any blanks between its words."""
    return r"\s*".join(map(re.escape, piece.split()))


def head_patterns(english: tuple[str, ...] = (), chinese: tuple[str, ...] = ()) -> tuple[tuple[str, ...], tuple[str, ...], str]:
    """(English patterns, Chinese patterns, signature): what strip_heads peels off, the general heads first and then the
    caller's pieces; the signature is that of an English sentence which begins with a head."""
    own = lambda p, flag: rf"{flag}^\s*{literal(p)}\s*[:：]?\s*"
    signature = rf"(?i)^(\s*\d{{3,4}}\s+)?\s*({'|'.join([VOLUME, *map(literal, english)])})"
    return ENGLISH + tuple(own(p, "(?i)") for p in english), CHINESE + tuple(own(p, "") for p in chinese), signature


def strip_heads(t: str | Column, patterns: tuple[str, ...] = ENGLISH) -> Column:
    """Peel heads off the front until nothing changes, at most ROUNDS times."""
    x = F.col(t) if isinstance(t, str) else t
    peel = lambda s: _chain(s, patterns)
    return T.trimmed(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, lambda acc, _: peel(acc)))


def _chain(x: Column, patterns: tuple[str, ...]) -> Column:
    for p in patterns:
        x = F.regexp_replace(x, p, "")
    return x


def has_substance(t: str | Column) -> Column:
    return (F.col(t) if isinstance(t, str) else t).rlike("[0-9A-Za-z一-鿿]")


def probe(elements: DataFrame, translations: DataFrame | None = None, least: int = 3, width: int = 28, zh_width: int = 16) -> DataFrame:
    """(doc_id, side, head, pages): begins of first sentences, and of first translations, on several pages of a document."""
    en = elements.filter("kind = 'text' and size(sentences) > 0").select(*PAGE, F.lit("en").alias("side"), T.head_of(F.element_at("sentences", 1), width, True).alias("head"))
    if translations is not None:
        zh = translations.filter("size(segs) > 0").select(*PAGE, F.lit("zh").alias("side"), T.head_of(F.element_at("segs", 1), zh_width, False).alias("head"))
        en = en.unionByName(zh)
    return en.filter(F.length("head") >= 8).groupBy("doc_id", "side", "head").agg(F.countDistinct("page").alias("pages")).filter(F.col("pages") >= least)


def learn_pieces(elements: DataFrame, translations: DataFrame, english: tuple[str, ...] = (), least: int = 2, longest: int = 14) -> DataFrame:
    """(doc_id, piece): Chinese forms of the running head, from the first segments of elements whose first English sentence has
    the head's signature: what stands before a page number, and the longest begin before any digit that at least `least`
    of these heads share. Documents with fewer such heads have none; elements delivered twice count once.

    Each head looks up its own begins, at most `longest`, so that heads of one document never meet in pairs."""
    _, _, signature = head_patterns(english)
    signed = elements.filter("kind = 'text' and size(sentences) > 0").filter(F.element_at("sentences", 1).rlike(signature)).select(*KEY).distinct()
    h = translations.filter("size(segs) > 0").select(*KEY, T.trimmed(F.element_at("segs", 1)).alias("head")).filter("head <> ''").join(signed, KEY, "left_semi")
    enough = h.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("doc_id")
    h = h.join(enough, "doc_id", "left_semi")
    before = T.trimmed(F.regexp_extract("head", r"^[^\d]*", 0))
    begins = F.transform(F.sequence(F.lit(2), F.least(F.length("before"), F.lit(longest))), lambda n: F.substring(F.col("before"), F.lit(1), n))
    cuts = h.withColumn("before", before).filter(F.length("before") >= 2).select(*KEY, F.explode(begins).alias("piece"))
    shared = cuts.groupBy("doc_id", "piece").agg(F.count("*").alias("n")).filter(F.col("n") >= least).drop("n")
    best = cuts.join(shared, ["doc_id", "piece"]).groupBy(*KEY).agg(F.max_by("piece", F.length("piece")).alias("piece")).select("doc_id", T.trimmed("piece").alias("piece"))
    numbered = h.select("doc_id", T.trimmed(F.regexp_extract("head", r"^([^\d《》\s][^\d《》]{1,13}?)\s*\d{3,4}\b", 1)).alias("piece")).filter("piece <> ''")
    return best.filter(F.length("piece") >= 3).unionByName(numbered).distinct()


def stub_pages(elements: DataFrame, marks: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, page): pages of links rather than text: over 200 characters with three links and one per 60, or one of the
    caller's `marks`, patterns that the texts of the page joined by newlines are searched for. Only pages are joined."""
    t = F.when(F.col("kind") == "text", F.coalesce("text", F.lit("")))
    sums = [F.sum(F.length(t) + 1).alias("n1"), F.sum(T.count_matches(t, "https?://")).alias("urls")]
    if marks:
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", t.alias("t")))), lambda s: s.t), "\n")
        sums.append(reduce(Column.__or__, [whole.rlike(m) for m in marks]).alias("mark"))
    per = elements.filter("kind = 'text'").groupBy(*PAGE).agg(*sums)
    n = F.col("n1") - 1
    links = (n > 200) & (F.col("urls") >= 3) & (F.col("urls") * 60 > n)
    return per.filter((F.col("mark") | links) if marks else links).select(*PAGE)
