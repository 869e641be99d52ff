"""Repairs that rewrite elements and their translations together: heads, page numbers, references and sentences cut by a page's
end. Slots are kept, so that ids stay; each returns new elements, or only those that change, with segments beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import heads, layout
from quirefold.operators.align import newest

PAGE, KEY = layout.PAGE, layout.KEY


def _strings(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _peeled(strings: str, patterns: tuple[str, ...], edge: str) -> Column:
    """Strings without heads, the first also without the signs of `edge` before it; those that say nothing any more are dropped."""
    clean = F.transform(_strings(strings), lambda s: heads.strip_heads(F.coalesce(s, F.lit("")), patterns))
    first = F.transform(clean, lambda s, i: F.when((i == 0) & heads.has_substance(s), T.trimmed(F.regexp_replace(s, f"^[{edge} ]+", ""))).otherwise(s))
    return F.filter(first, heads.has_substance)


def strip_both(elements: DataFrame, translations: DataFrame, english: tuple[str, ...] = (), chinese: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, page, idx, sentences, text, segs, dropped, dropped_segs) of the elements whose first sentence begins with a
    running head: heads stripped from every sentence and segment alike, text made of the sentences anew. Elements without
    translation have no segments."""
    en, zh, signature = heads.head_patterns(english, chinese)
    hit = elements.filter("kind = 'text' and size(sentences) > 0").filter(F.element_at("sentences", 1).rlike(signature))
    j = hit.select(*KEY, "sentences").join(newest(translations).select(*KEY, "segs"), KEY, "left")
    out = j.withColumns({"_en": _peeled("sentences", en, ".,;:"), "_zh": _peeled("segs", zh, "，,。；;：")})
    return out.select(*KEY, F.col("_en").alias("sentences"), F.array_join("_en", " ").alias("text"), F.col("_zh").alias("segs"), (F.size("sentences") - F.size("_en")).alias("dropped"), (F.size(_strings("segs")) - F.size("_zh")).alias("dropped_segs"))


def blank_folios(elements: DataFrame, pages: DataFrame, translations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, translations): page numbers at head and foot emptied, their translations removed. Elements without bbox, and
    pages of unknown size, have none."""
    hit = layout.boxes(elements).join(layout.page_sizes(pages), PAGE).filter(layout.is_page_number()).select(*KEY).distinct().withColumn("_hit", F.lit(True))
    marked = elements.join(hit, KEY, "left")
    done = marked.withColumn("text", F.when(F.col("_hit"), "").otherwise(F.col("text"))).withColumn("sentences", F.when(F.col("_hit"), F.array().cast("array<string>")).otherwise(F.col("sentences")))
    return done.select(*elements.columns), translations.join(hit.select(*KEY), KEY, "left_anti")


def unified_references(elements: DataFrame, pages: DataFrame, reference_pages: DataFrame, share: float = 0.6) -> DataFrame:
    """(doc_id, page, idx, sentences, text): entries on the named pages (doc_id, page) that were cut into several sentences and
    are as wide as a share of half the page, as one sentence each."""
    wide = layout.boxes(elements).filter("kind = 'text' and size(sentences) >= 2").join(layout.page_sizes(pages), PAGE).join(reference_pages.select(*PAGE).distinct(), PAGE, "left_semi")
    kept = wide.filter((F.col("x1") - F.col("x0") >= share * F.col("width") / 2) & (F.coalesce(T.trimmed("text"), F.lit("")) != ""))
    return kept.select(*KEY, F.array(T.trimmed("text")).alias("sentences"), T.trimmed("text").alias("text"))


def rejoined(elements: DataFrame, translations: DataFrame, continuations: DataFrame) -> DataFrame:
    """(doc_id, page, idx, sentences, text, segs) of the elements that change: text elements named in continuations (doc_id, page,
    idx) are folded into the text element before them on their page, a hyphen at its end dropped, and are emptied; their
    segments follow. Of several in a row all go to the one before the first; one at a page's begin, or blank, stays."""
    t = elements.filter("kind = 'text'").select(*KEY, "text").join(continuations.select(*KEY).distinct().withColumn("goes", F.lit(True)), KEY, "left")
    t = t.withColumn("goes", F.coalesce("goes", F.lit(False)) & (F.coalesce(T.trimmed("text"), F.lit("")) != ""))
    order = Window.partitionBy(*PAGE).orderBy("idx")
    t = t.withColumn("host", F.last(F.when(~F.col("goes"), F.col("idx")), True).over(order)).filter(F.col("host").isNotNull())
    t = t.join(newest(translations).select(*KEY, F.array_join(F.filter(_strings("segs"), lambda z: F.coalesce(T.trimmed(z), F.lit("")) != ""), "").alias("zh")), KEY, "left")
    rows = F.array_sort(F.collect_list(F.struct("idx", T.trimmed("text").alias("text"), F.coalesce("zh", F.lit("")).alias("zh"))))
    runs = t.groupBy(*PAGE, "host").agg(rows.alias("rows")).filter(F.size("rows") > 1)
    ends = lambda s: F.regexp_replace(F.regexp_replace(s, r"(?U)\s+\z", ""), r"-\z", "")
    whole = F.aggregate(F.slice("rows", 2, F.size("rows")), F.col("rows")[0]["text"], lambda a, x: F.concat(ends(F.coalesce(a, F.lit(""))), F.lit(" "), x.text))
    zh = F.array_join(F.transform("rows", lambda r: r.zh), "")
    host = F.struct(F.col("host").alias("idx"), F.array(whole).alias("sentences"), whole.alias("text"), F.when(zh == "", F.array().cast("array<string>")).otherwise(F.array(zh)).alias("segs"))
    empty = F.array().cast("array<string>")
    gone = F.transform(F.slice("rows", 2, F.size("rows")), lambda r: F.struct(r.idx.alias("idx"), empty.alias("sentences"), F.lit("").alias("text"), empty.alias("segs")))
    return runs.select(*PAGE, F.explode(F.concat(F.array(host), gone)).alias("r")).select(*PAGE, "r.*").select(*KEY, "sentences", "text", "segs")


def moved_tails(elements: DataFrame, translations: DataFrame, continuations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed, failed) for continuations (doc_id, page, idx, tail_page, tail_idx, expected). The tail's first sentence, which must
    end as expected, moves to the host's last one; a hyphen there is dropped. The tail's first segment goes with it if the tail
    has one segment more than sentences then. changed(doc_id, page, idx, sentences, text, segs) has hosts and tails;
    failed are the continuations whose host or tail is missing, or whose tail begins otherwise."""
    said = elements.filter("kind = 'text' and size(sentences) > 0").select(*KEY, "sentences")
    tail = said.select("doc_id", F.col("page").alias("tail_page"), F.col("idx").alias("tail_idx"), F.col("sentences").alias("tail"))
    j = continuations.join(said, KEY, "left").join(tail, ["doc_id", "tail_page", "tail_idx"], "left")
    first = T.trimmed(F.element_at("tail", 1))
    fits = F.coalesce(F.col("sentences").isNotNull() & F.endswith(first, F.col("expected")), F.lit(False))
    good, failed = j.filter(fits), j.filter(~fits).select(*continuations.columns)
    last = F.element_at("sentences", -1)
    joined = F.when(last.endswith("-"), F.concat(F.regexp_replace(last, r"-\z", ""), first)).otherwise(F.concat(last, F.lit(" "), first))
    hosts = good.select(*KEY, F.concat(F.slice("sentences", 1, F.size("sentences") - 1), F.array(joined)).alias("sentences"), F.lit(False).alias("cut"))
    rest = good.select("doc_id", F.col("tail_page").alias("page"), F.col("tail_idx").alias("idx"), F.slice("tail", 2, F.size("tail")).alias("sentences"), F.lit(True).alias("cut"))
    both = hosts.unionByName(rest).join(newest(translations).select(*KEY, "segs"), KEY, "left")
    more = F.col("cut") & (F.size(_strings("segs")) == F.size("sentences") + 1)
    segs = F.when(more, F.slice(_strings("segs"), F.lit(2), F.greatest(F.size(_strings("segs")), F.lit(1)))).otherwise(_strings("segs"))
    return both.select(*KEY, "sentences", F.array_join("sentences", " ").alias("text"), segs.alias("segs")), failed


def self_checks(elements: DataFrame, pages: DataFrame, translations: DataFrame, english: tuple[str, ...] = ()) -> DataFrame:
    """(check, doc_id, page, idx): what the repairs leave undone: `folio` page numbers after blank_folios, `stem` doubled stems after
    their repair, `head` sentences that still begin with a head after strip_both, `count` translated elements whose sentences
    and segments differ in number after it. The first three must be empty."""
    done, _ = blank_folios(elements, pages, translations)
    left = layout.boxes(done).join(layout.page_sizes(pages), PAGE).filter(layout.is_page_number())
    stems = elements.filter(F.col("kind").isin("text", "formula")).filter(T.fix_double_stem("text").rlike("(?i)(^|\\W)(mac|mic)(mac|mic)ro"))
    both = strip_both(elements, translations, english)
    signature = heads.head_patterns(english)[2]
    still = both.filter(F.exists("sentences", lambda s: s.rlike(signature)))
    uneven = both.join(newest(translations).select(*KEY), KEY, "left_semi").filter(F.size("sentences") != F.size("segs"))
    out = None
    for name, rows in (("folio", left), ("stem", stems), ("head", still), ("count", uneven)):
        part = rows.select(F.lit(name).alias("check"), *KEY)
        out = part if out is None else out.unionByName(part)
    return out
