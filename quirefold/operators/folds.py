"""Operators whose result depends on order within a page: runs, lines, paragraphs, fractions. Folds over a page's sorted
elements with accumulators in the JVM; greedy matching that no fold expresses goes page by page through pandas."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators.layout import KEY, PAGE, boxes

_RUN = "array<struct<kind:string,text:string,size:double,x0:double,y0:double,x1:double,y1:double,n:int>>"


def _sorted_rows(e: DataFrame, *cols: str | Column) -> DataFrame:
    """One row per page with its elements in reading order."""
    row = F.struct(F.bround("y0", 1).alias("r"), F.col("x0").alias("x"), "idx", *cols)
    return e.groupBy(*PAGE).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def _merge_fold(rows: DataFrame, goes_on: Callable[[Column, Column], Column], join: Callable[[Column, Column], Column]) -> DataFrame:
    """Left fold: an element that continues the last output is merged into it, boxes growing to their hull."""
    one = lambda x: F.struct(x.kind.alias("kind"), x.text.alias("text"), x.size.alias("size"), *[x[c].alias(c) for c in ("x0", "y0", "x1", "y1")], F.lit(1).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        hull = F.struct(
            last.kind.alias("kind"), join(last, x).alias("text"), last.size.alias("size"), F.least(last.x0, x.x0).alias("x0"), F.least(last.y0, x.y0).alias("y0"),
            F.greatest(last.x1, x.x1).alias("x1"), F.greatest(last.y1, x.y1).alias("y1"), (last.n + 1).alias("n"),
        )
        return F.when(F.size(acc) == 0, F.array(one(x))).when(goes_on(last, x), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(hull))).otherwise(F.concat(acc, F.array(one(x))))

    out = rows.select(*PAGE, F.posexplode(F.aggregate("rows", F.array().cast(_RUN), step)).alias("run", "m"))
    return out.select(*PAGE, "run", "m.*")


def _text_rows(elements: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    e = boxes(elements).filter(F.col("kind").isin(*kinds) & F.col("text").isNotNull()).withColumn("size", F.coalesce("size", F.lit(11.0)))
    return _sorted_rows(e, "kind", "text", "size", "x0", "y0", "x1", "y1")


def text_runs(elements: DataFrame) -> DataFrame:
    """(doc_id, page, run, kind, text, size, x0..y1, n): neighbours on one baseline joined into runs."""

    def goes_on(a: Column, b: Column) -> Column:
        gap = b.x0 - a.x1
        level = F.abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) < F.greatest(a.size * 0.55, F.lit(3.0))
        return (F.abs(a.size - b.size) < 0.6) & (a.kind == b.kind) & level & (gap >= -1.5) & (gap <= F.greatest(a.size * 1.6, F.lit(8.0)))

    def join(a: Column, b: Column) -> Column:
        near = b.x0 - a.x1 < 0.35
        cut = ~near & a.text.rlike("[-‐]\\z") & (F.length(a.text) > 2)
        return F.when(near, F.concat(a.text, b.text)).when(cut, F.concat(F.substring(a.text, F.lit(1), F.length(a.text) - 1), b.text)).otherwise(F.concat(a.text, F.lit(" "), b.text))

    return _merge_fold(_text_rows(elements, ("text", "formula")), goes_on, join)


def paragraphs(elements: DataFrame) -> DataFrame:
    """(doc_id, page, run, kind, text, size, x0..y1, n): text elements joined to the last output of the page while it doesn't
    end a sentence, the step down is small and the boxes overlap sideways."""

    def goes_on(a: Column, b: Column) -> Column:
        return ~T.ends_sentence(a.text) & (b.y0 - a.y1 <= 14.0) & (F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0) > 20.0)

    return _merge_fold(_text_rows(elements, ("text",)), goes_on, lambda a, b: T.join_lines(a.text, b.text))


def same_line(fragments: DataFrame) -> DataFrame:
    """Fragments of one line that stand next to each other, joined; input like elements."""
    near = lambda a, b: (F.abs(a.y1 - b.y1) <= 3.0) & (b.x0 - a.x1 <= 6.0)
    return _merge_fold(_text_rows(fragments, ("text",)), near, lambda a, b: T.join_lines(a.text, b.text))


def line_blocks(elements: DataFrame) -> DataFrame:
    """(doc_id, page, block, text, n): runs of elements up to one that ends like a sentence or begins a new unit (sessions by a running sum)."""
    e = boxes(elements).filter("kind = 'text'").filter(F.coalesce(T.trimmed("text"), F.lit("")) != "")
    w = Window.partitionBy(*PAGE).orderBy(F.bround("y0", 1), "x0", "idx")
    before = F.lag(T.trimmed("text")).over(w)
    starts = before.isNull() | before.rlike(r"[.!?:;]\z") | T.trimmed("text").rlike(r"^(\(?[a-z\d]{1,3}[.)]\s|[•–-]\s)")
    b = e.withColumn("block", F.sum(F.when(starts, 1).otherwise(0)).over(w)).withColumn("_o", F.row_number().over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", T.trimmed("text").alias("t")))), lambda s: s.t), " ")
    return b.groupBy(*PAGE, "block").agg(F.regexp_replace(joined, r"([a-z])- ([a-z])", "$1$2").alias("text"), F.count("*").alias("n"))


_BASE = "doc_id bigint, page int, line int, kind string, text string, x0 double, y0 double, x1 double, y1 double, n int"


def baseline_lines(elements: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """(doc_id, page, line, kind, text, x0..y1, n): greedy bucketing of text and formulas by the running mean of their
    middles; a line is a formula if most of its elements are. Order-dependent, hence page by page."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(_r=f.y0.round(1)).sort_values(["_r", "x0", "idx"], kind="stable")
        lines: list[list] = []
        for r in f.itertuples():
            mid = (r.y0 + r.y1) / 2
            home = next((b for b in lines if abs(b[0] / len(b[1]) - mid) <= tolerance), None)
            if home is None:
                lines.append([mid, [r]])
            else:
                home[0] += mid
                home[1].append(r)
        out = []
        for i, (_, rs) in enumerate(lines):
            rs = sorted(rs, key=lambda r: (r.x0, r.idx))
            text = rs[0].text
            for a, b in zip(rs, rs[1:]):
                text += (" " if b.x0 - a.x1 > 0.16 * (b.size or 11.0) else "") + b.text
            kind = "formula" if sum(r.kind == "formula" for r in rs) * 2 > len(rs) else "text"
            out.append((rs[0].doc_id, rs[0].page, i, kind, text, min(r.x0 for r in rs), min(r.y0 for r in rs), max(r.x1 for r in rs), max(r.y1 for r in rs), len(rs)))
        return pd.DataFrame(out, columns=["doc_id", "page", "line", "kind", "text", "x0", "y0", "x1", "y1", "n"])

    e = boxes(elements).filter(F.col("kind").isin("text", "formula") & F.col("text").isNotNull()).select(*KEY, "kind", "text", F.coalesce("size", F.lit(11.0)).alias("size"), "x0", "y0", "x1", "y1")
    return e.groupBy(*PAGE).applyInPandas(run, _BASE)


def fractions(elements: DataFrame, reach: float = 1.7) -> DataFrame:
    """(doc_id, page, idx, above, below, text): formulas with their nearest short neighbour above and below, as `head = a / b tail`.
    A neighbour serves one formula, the topmost."""
    f = boxes(elements).filter("kind = 'formula' and text is not null").select(*KEY, "text", "x0", "y0", "x1", "y1")
    o = boxes(elements).filter(F.col("kind").isin("text", "formula") & (F.length(F.coalesce("text", F.lit(""))).between(1, 40)) & (F.coalesce(F.size("sentences"), F.lit(0)) <= 1))
    o = o.select(*PAGE, F.col("idx").alias("other"), F.col("text").alias("part"), *[F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")])
    near = f.join(o, PAGE).filter((F.col("idx") != F.col("other")) & (F.least("x1", "ox1") > F.greatest("x0", "ox0")))
    high = F.col("y1") - F.col("y0")
    up = near.filter((F.col("oy0") < F.col("y0")) & (F.col("y1") - F.col("oy0") <= (1 + reach) * high)).withColumn("d", F.col("y1") - F.col("oy0"))
    down = near.filter((F.col("oy0") > F.col("y0")) & (F.col("oy0") - F.col("y1") <= reach * high)).withColumn("d", F.col("oy0") - F.col("y1"))

    def nearest(df: DataFrame, name: str) -> DataFrame:
        best = df.groupBy(*KEY).agg(F.min(F.struct("d", "other", "part")).alias("b"), F.min("y0").alias("fy"))
        once = Window.partitionBy(*PAGE, "b.other").orderBy("fy", "idx")
        return best.withColumn("_k", F.row_number().over(once)).filter("_k = 1").select(*KEY, F.col("b.other").alias(name), F.col("b.part").alias(f"{name}_text"))

    j = f.join(nearest(up, "above"), KEY).join(nearest(down, "below"), KEY).filter("above <> below")
    whole = F.concat_ws(" ", F.regexp_extract("text", r"^(.*?=)", 1), F.col("above_text"), F.lit("/"), F.col("below_text"), T.trimmed(F.regexp_replace("text", r"^.*?=", "")))
    return j.select(*KEY, "above", "below", T.trimmed(F.regexp_replace(whole, r"\s+", " ")).alias("text"))


def orphans(elements: DataFrame, longest: int = 16, reach: float = 4.0) -> DataFrame:
    """(doc_id, page, idx, host): short pieces without relation that stand tightly above a formula, to be folded into the nearest."""
    f = boxes(elements).filter("kind = 'formula'").select(*PAGE, F.col("idx").alias("host"), F.col("x0").alias("hx0"), F.col("x1").alias("hx1"), F.col("y0").alias("hy0"))
    s = boxes(elements).filter(F.col("kind").isin("text", "formula") & F.length("text").between(1, longest) & ~F.col("text").rlike("[=≥≤≠→←∑∏∫∂]")).select(*KEY, "x0", "x1", "y0", "y1")
    near = s.join(f, PAGE).filter((F.col("idx") != F.col("host")) & (F.least("x1", "hx1") > F.greatest("x0", "hx0")) & (F.abs(F.col("hy0") - F.col("y1")) <= reach) & (F.col("y0") < F.col("hy0")))
    return near.groupBy(*KEY).agg(F.min(F.struct(F.abs(F.col("hy0") - F.col("y1")).alias("d"), "host")).alias("b")).select(*KEY, "b.host")
