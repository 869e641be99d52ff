"""Quality gates: each rule gives (severity, rule, doc_id, page, idx); all together are the findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import align, layout

PAGE, KEY = layout.PAGE, layout.KEY


def _found(df: DataFrame, severity: str, rule: str, idx: str | None = "idx") -> DataFrame:
    at = F.col(idx).cast("int") if idx else F.lit(-1)
    return df.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), "doc_id", F.col("page").cast("int").alias("page"), at.alias("idx"))


def folio(elements: DataFrame, pages: DataFrame) -> DataFrame:
    e = layout.boxes(elements).join(layout.page_sizes(pages), PAGE)
    return _found(e.filter(layout.is_page_number(bottom=0.88)), "P0", "folio")


def gutter_missed(elements: DataFrame, pages: DataFrame) -> DataFrame:
    e = layout.boxes(elements).filter(F.col("kind").isin("text", "formula") & ~layout.is_blank()).join(layout.page_sizes(pages), PAGE).join(layout.gutters(elements, pages), PAGE, "left_anti")
    right = F.col("x0") > F.col("width") * 0.45
    of = lambda f, c, on: f(F.when(on, F.col(c)))
    s = e.groupBy(*PAGE).agg(F.count_if(right).alias("nr"), F.count_if(~right).alias("nl"), of(F.min, "y0", right).alias("rt"), of(F.max, "y1", right).alias("rb"), of(F.min, "y0", ~right).alias("lt"), of(F.max, "y1", ~right).alias("lb"))
    span = F.col("rb") - F.col("rt")
    return _found(s.filter((F.col("nr") >= 2) & (F.col("nl") >= 2) & (span > 0) & (F.least("rb", "lb") - F.greatest("rt", "lt") >= 0.75 * span)), "P0", "gutter", None)


def column_collapse(elements: DataFrame, pages: DataFrame) -> DataFrame:
    e = layout.boxes(elements).filter(F.col("kind").isin("text", "formula") & ~layout.is_blank()).join(layout.page_sizes(pages), PAGE).join(layout.gutters(elements, pages), PAGE)
    text = F.col("kind") == "text"
    over = text & (F.col("x0") < F.col("gutter")) & (F.col("x1") > F.col("gutter") + 6.0)
    wide = text & (F.col("x1") - F.col("x0") > 0.6 * F.col("width"))
    s = e.groupBy(*PAGE).agg(F.count_if(over).alias("over"), F.count_if(wide).alias("wide"), F.count("*").alias("n"))
    return _found(s.filter((F.col("over") >= 2) | (F.col("wide") > F.greatest(F.lit(1.0), 0.15 * F.col("n")))), "P0", "collapse", None)


def uncropped_scan(elements: DataFrame, pages: DataFrame) -> DataFrame:
    e = layout.boxes(elements).filter("kind = 'image' and not coalesce(skip, false)").join(layout.page_sizes(pages), PAGE)
    return _found(e.filter((F.col("width") > 0) & (F.col("height") > 0) & (F.col("y1") - F.col("y0") >= 0.8 * F.col("height"))), "P0", "scan")


def translations_missing(elements: DataFrame, translations: DataFrame) -> DataFrame:
    said = F.size(F.filter("sentences", lambda s: F.coalesce(T.trimmed(s), F.lit("")) != ""))
    scope = translations.select("doc_id").distinct()
    e = elements.filter("kind = 'text' and size(sentences) > 0").withColumn("said", said).filter("said > 0").join(scope, "doc_id", "left_semi")
    j = e.join(align.newest(translations).select(*KEY, F.greatest(F.size("segs"), F.lit(0)).alias("got")), KEY, "left")
    number = F.coalesce(T.trimmed("text"), F.lit("")).rlike(r"^\d{1,4}\z")
    return _found(j.filter((F.col("got").isNull() & ~number) | (F.col("got") != F.col("said"))), "P0", "zh")


def repeated_header(elements: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, head, n): begins that at least three elements of a document share."""
    e = elements.filter(F.col("kind") == "text").filter(~layout.is_blank())
    heads = e.select("doc_id", T.head_of("text", 48, False).alias("head")).filter(F.length("head") >= 12)
    return heads.groupBy("doc_id", "head").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def double_stem(elements: DataFrame) -> DataFrame:
    return _found(elements.filter(F.col("kind").isin("text", "formula") & F.col("text").rlike("(?i)(^|\\W)(mac|mic)(mac|mic)ro")), "P1", "fusion")


def orphan_tail(elements: DataFrame) -> DataFrame:
    said = F.filter("sentences", lambda s: F.coalesce(T.trimmed(s), F.lit("")) != "")
    e = elements.filter("kind = 'text' and size(sentences) > 0").withColumn("first", F.try_element_at(said, F.lit(1)))
    return _found(e.filter(F.regexp_replace("first", r"(?U)^\s+", "").rlike(r"^\p{Ll}")), "P1", "orphan")


def retained_scan(elements: DataFrame) -> DataFrame:
    return _found(elements.filter("kind = 'image' and not coalesce(skip, false)"), "P2", "cover")


def scrambled_caps(elements: DataFrame) -> DataFrame:
    run = r"(^|[^\p{L}\p{N}_'-])([A-Z][A-Z'\-]+(?:\s+[A-Z][A-Z'\-]+)+)"
    s = elements.filter("kind = 'text' and size(sentences) > 0").select(*KEY, F.explode("sentences").alias("s")).select(*KEY, T.trimmed("s").alias("s")).filter(F.length("s") >= 20)
    at = s.withColumn("caps", F.regexp_extract("s", run, 2)).filter("caps <> ''").withColumn("share", (F.expr("locate(caps, s)") - 1) / F.length("s"))
    return _found(at.filter((F.col("share") > 0.15) & (F.col("share") < 0.85)).select(*KEY).distinct(), "P2", "caps")


def slots(elements: DataFrame) -> DataFrame:
    return _found(layout.coincident(elements), "P2", "slot", None)


def findings(elements: DataFrame, pages: DataFrame, translations: DataFrame) -> DataFrame:
    """All findings, one row each; per document and rule they may repeat where several spots of a page are concerned."""
    heads = repeated_header(elements).withColumn("page", F.lit(-1))
    parts = [
        folio(elements, pages), gutter_missed(elements, pages), column_collapse(elements, pages), uncropped_scan(elements, pages), translations_missing(elements, translations),
        _found(heads, "P1", "header", None), double_stem(elements), orphan_tail(elements), retained_scan(elements), scrambled_caps(elements), slots(elements),
    ]
    return reduce(DataFrame.unionByName, parts)


def severities(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "rule").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))
