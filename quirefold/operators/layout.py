"""Geometry of pages: columns, coverage, overlaps and the vertical push-down. Every operator works per (doc_id, page), so
that no document, however long, becomes one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T

PAGE = ["doc_id", "page"]
KEY = [*PAGE, "idx"]
GAP = 3.0


def page_sizes(pages: DataFrame) -> DataFrame:
    """(doc_id, page, width, height), one row per page, the largest of repeated ones."""
    return pages.groupBy(*PAGE).agg(F.max("width").alias("width"), F.max("height").alias("height"))


def boxes(elements: DataFrame) -> DataFrame:
    """elements with x0, y0, x1, y1 instead of bbox; those without bbox are left out."""
    return elements.filter(F.col("bbox").isNotNull()).select("*", *[F.col(f"bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]).drop("bbox")


def is_blank() -> Column:
    """Text or formula emptied by a repair: it takes no room."""
    empty = F.coalesce(T.trimmed("text"), F.lit("")) == ""
    said = F.coalesce(F.exists("sentences", lambda s: F.coalesce(T.trimmed(s), F.lit("")) != ""), F.lit(False))
    return F.col("kind").isin("text", "formula") & empty & ~said


def gutters(elements: DataFrame, pages: DataFrame, divider: float = 0.5) -> DataFrame:
    """(doc_id, page, gutter) of pages with two columns: text right of the divider that runs down 60 % of the page, or
    stands beside the left text for 75 % of its height. Pages of unknown size have none."""
    sized = boxes(elements).join(page_sizes(pages), PAGE).filter((F.col("width") > 0) & (F.col("height") > 0))
    body = sized.filter((F.col("kind") == "text") & ~is_blank())
    right = F.col("x0") > F.col("width") * divider
    of = lambda f, c, on: f(F.when(on, F.col(c)))
    sides = body.groupBy(*PAGE).agg(
        F.max("height").alias("height"), F.count_if(right).alias("n_right"), F.count_if(~right).alias("n_left"), of(F.min, "x0", right).alias("gutter"),
        of(F.min, "y0", right).alias("top"), of(F.max, "y1", right).alias("bottom"), of(F.min, "y0", ~right).alias("l_top"), of(F.max, "y1", ~right).alias("l_bottom"),
    )
    span = F.col("bottom") - F.col("top")
    beside = F.least("bottom", "l_bottom") - F.greatest("top", "l_top")
    two = (span >= F.col("height") * 0.6) | ((F.col("n_left") >= 2) & (span > 0) & (beside >= span * 0.75))
    return sides.filter((F.col("n_right") >= 2) & two).select(*PAGE, "gutter")


def columns(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, idx, gutter, side, column_right): the column of each element and the right edge that it may use."""
    e = boxes(elements).join(page_sizes(pages), PAGE, "left").join(gutters(elements, pages), PAGE, "left")
    side = F.when(F.col("gutter").isNull() | (F.col("kind") != "text"), "full").when(F.col("x1") <= F.col("gutter"), "left").when(F.col("x0") >= F.col("gutter"), "right").otherwise("full")
    margin = F.col("width") - F.when(F.col("width") > 500, 72.0).otherwise(28.0)
    capped = F.when((F.col("x0") < F.col("gutter")) & (F.col("gutter") < margin), F.col("gutter") - 8.0).otherwise(margin)
    edge = F.when(F.coalesce(F.col("width"), F.lit(0.0)) <= 0, F.col("x0") + 200.0).when(capped <= F.col("x0") + 20, F.col("width") - 24.0).otherwise(capped)
    return e.select(*KEY, "gutter", side.alias("side"), edge.alias("column_right"))


def islands(spans: DataFrame, keys: list[str], low: str = "y0", high: str = "y1") -> DataFrame:
    """Union of intervals per key: (keys, low, high) of maximal runs that touch."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(low) > before + 1e-6), 1).otherwise(0)
    return spans.select(*keys, low, high).withColumn("_new", new).withColumn("_island", F.sum("_new").over(w)).groupBy(*keys, "_island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_island")


def text_islands(elements: DataFrame) -> DataFrame:
    """Vertical runs of each page that text or formulas cover."""
    said = boxes(elements).filter(F.col("kind").isin("text", "formula") & (F.coalesce(T.trimmed("text"), F.lit("")) != ""))
    return islands(said, PAGE)


def coverage(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, covered): share of each page's height that text covers."""
    cut = text_islands(elements).join(page_sizes(pages), PAGE).filter("height > 0")
    part = F.greatest(F.lit(0.0), F.least("y1", "height") - F.greatest(F.col("y0"), F.lit(0.0)))
    return cut.groupBy(*PAGE).agg((F.sum(part) / F.max("height")).alias("covered"))


def uncovered_bands(elements: DataFrame, pages: DataFrame, least: float = 24.0) -> DataFrame:
    """(doc_id, page, band_top, band_bottom): bands of at least `least` points without text, of pages with text."""
    runs = text_islands(elements).join(page_sizes(pages), PAGE).filter("height > 0")
    w = Window.partitionBy(*PAGE).orderBy("y0")
    ahead = runs.select(*PAGE, F.greatest(F.lit(0.0), F.coalesce(F.lag("y1").over(w), F.lit(0.0))).alias("band_top"), F.col("y0").alias("band_bottom"))
    last = runs.groupBy(*PAGE).agg(F.greatest(F.lit(0.0), F.max("y1")).alias("band_top"), F.max("height").alias("band_bottom"))
    return ahead.unionByName(last).filter(F.col("band_bottom") - F.col("band_top") >= least)


def scan_marks(elements: DataFrame, pages: DataFrame, mode: str = "auto", cover: float = 0.7) -> DataFrame:
    """(doc_id, page, idx, skipped) of page-sized images: skipped where the text layer covers them. mode keep: none, drop: all."""
    images = boxes(elements).filter("kind = 'image'").join(page_sizes(pages), PAGE)
    big = images.filter((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= 0.8 * F.greatest(F.col("width") * F.col("height"), F.lit(1e-6)))
    if mode != "auto":
        return big.select(*KEY, F.lit(mode == "drop").alias("skipped"))
    runs = text_islands(elements).withColumnsRenamed({"y0": "a", "y1": "b"})
    cut = big.join(runs, PAGE, "left")
    part = F.greatest(F.lit(0.0), F.least("b", "y1") - F.greatest("a", "y0"))
    span = F.greatest(F.col("y1") - F.col("y0"), F.lit(1e-6))
    return cut.groupBy(*KEY).agg((F.coalesce(F.sum(part / span), F.lit(0.0)) >= cover).alias("skipped"))


def estimated_heights(elements: DataFrame, translations: DataFrame) -> DataFrame:
    """(doc_id, page, idx, lines, est_height) of text elements with their translation beneath each sentence."""
    e = boxes(elements).filter("kind = 'text'").join(translations.select(*KEY, "segs"), KEY, "left")
    size, width = F.coalesce(F.when(F.col("size") != 0, F.col("size")), F.lit(11.0)), F.greatest(F.col("x1") - F.col("x0"), F.lit(4.0))
    units = F.when(F.size("sentences") > 0, F.col("sentences")).otherwise(F.array(F.coalesce("text", F.lit(""))))
    pairs = F.transform(units, lambda s, i: F.struct(F.coalesce(s, F.lit("")).alias("s"), F.coalesce(F.try_element_at("segs", i + 1), F.lit("")).alias("z")))
    e = e.select(*KEY, size.alias("size"), width.alias("w"), F.posexplode(pairs).alias("i", "p"))
    own = T.measure_lines(F.col("p.s"), F.col("size"), F.col("w"))
    zh = F.when(F.col("p.z") != "", T.measure_lines(F.col("p.z"), F.col("size") * 0.94, F.col("w") - 16)).otherwise(0)
    high = own * F.col("size") * 1.18 + F.when(zh > 0, zh * F.col("size") * 0.94 * 1.62 + 4.5).otherwise(0.0)
    return e.groupBy(*KEY).agg(F.sum(own + zh).alias("lines"), (F.sum(high) * 1.02 + 1.0).alias("est_height"))


def widened(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """elements with text boxes widened toward the right edge of their column, where there is room: those of size 13 or more,
    and those whose text needs more than its width. To be taken before heights and sides."""
    edges = columns(elements, pages).select(*KEY, "column_right").dropDuplicates(KEY)
    e = elements.join(edges, KEY, "left")
    x0, size = F.col("bbox.x0"), F.coalesce(F.when(F.col("size") != 0, F.col("size")), F.lit(11.0))
    natural, room = F.greatest(F.col("bbox.x1") - x0, F.lit(4.0)), F.col("column_right") - x0
    need = F.coalesce(T.text_advance(F.coalesce("text", F.lit("")), size), F.lit(0.0))
    wide = (F.col("kind") == "text") & (room > natural) & ((need > natural * 1.02) | (size >= 13.0))
    x1 = F.when(wide, x0 + F.least(room, F.greatest(natural, need * 1.02))).otherwise(F.col("bbox.x1"))
    return e.withColumn("bbox", F.when(F.col("bbox").isNotNull(), F.col("bbox").withField("x1", x1))).select(*elements.columns)


def relayout(elements: DataFrame, pages: DataFrame, translations: DataFrame) -> DataFrame:
    """(doc_id, page, idx, side, top, bottom): elements pushed down so that translations fit, each column on its own cursor
    and full-width elements across both. Blank elements and skipped scans take no room. One fold per page. Boxes are taken
    as they are; `widened` gives those of the reference."""
    marks = scan_marks(elements, pages).filter("skipped").select(*KEY, F.lit(True).alias("skipped"))
    e = boxes(elements).withColumn("blank", is_blank()).select(*KEY, "kind", "x0", "y0", "x1", "y1", "size", "blank")
    e = e.join(columns(elements, pages).select(*KEY, "side"), KEY).join(estimated_heights(elements, translations), KEY, "left").join(marks, KEY, "left")
    size = F.coalesce(F.when(F.col("size") != 0, F.col("size")), F.lit(11.0))
    own = F.col("y1") - F.col("y0")
    high = F.when(F.col("kind") == "text", F.greatest(F.coalesce("est_height", F.lit(0.0)), own, size)).when(F.col("kind") == "formula", F.greatest(own, size * 1.2)).otherwise(F.greatest(own, F.lit(4.0)))
    gone = F.coalesce("skipped", F.lit(False)) | F.col("blank")
    row = F.struct(F.bround("y0", 1).alias("r"), "x0", "idx", "y0", "side", high.alias("h"), gone.alias("gone"))
    rows = e.groupBy(*PAGE).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    low = F.lit(-1e9)
    placed = "array<struct<idx:int,side:string,top:double,bottom:double>>"
    start = F.struct(low.alias("l"), low.alias("r"), low.alias("f"), F.array().cast(placed).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        floor = F.when(x.side == "left", acc.l).when(x.side == "right", acc.r).otherwise(F.greatest(acc.l, acc.r, acc.f))
        top = F.when(x.gone, 0.0).otherwise(F.greatest(x.y0, floor + GAP))
        end = F.when(x.gone, 0.0).otherwise(top + x.h)
        keep = lambda mine, old: F.when(~x.gone & ((x.side == mine) | (x.side == "full")), end).otherwise(old)
        done = F.struct(x.idx.alias("idx"), x.side.alias("side"), top.alias("top"), end.alias("bottom"))
        return F.struct(keep("left", acc.l).alias("l"), keep("right", acc.r).alias("r"), keep("full", acc.f).alias("f"), F.concat(acc.out, F.array(done)).alias("out"))

    folded = rows.select(*PAGE, F.explode(F.aggregate("rows", start, step, lambda a: a.out)).alias("p"))
    return folded.select(*PAGE, "p.idx", "p.side", "p.top", "p.bottom")


def overlapping(elements: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(doc_id, page, idx_a, idx_b): text and formula boxes of a page that overlap by more than the tolerance both ways."""
    b = boxes(elements).filter("kind <> 'image'").select(*PAGE, *[F.col(c).alias(f"{c}_a") for c in ("idx", "x0", "y0", "x1", "y1")])
    c = b.withColumnsRenamed({f"{k}_a": f"{k}_b" for k in ("idx", "x0", "y0", "x1", "y1")})
    meet = lambda lo, hi: F.least(f"{hi}_a", f"{hi}_b") - F.greatest(f"{lo}_a", f"{lo}_b") > tolerance
    return b.join(c, PAGE).filter((F.col("idx_a") < F.col("idx_b")) & meet("x0", "x1") & meet("y0", "y1")).select(*PAGE, "idx_a", "idx_b")


def column_pairing(elements: DataFrame, pages: DataFrame, least: float = 0.6) -> DataFrame:
    """(doc_id, page, ratio, collapsed): share of the shorter column that stands beside the other; pages with four boxes or more."""
    c = columns(elements, pages).filter("side <> 'full'").select(*KEY, "side")
    tall = boxes(elements).filter("y1 - y0 > 10").select(*KEY, "y0", "y1").join(c, KEY)
    enough = tall.groupBy(*PAGE).agg(F.count("*").alias("n")).filter("n >= 4").select(*PAGE)
    runs = islands(tall.join(enough, PAGE, "left_semi"), [*PAGE, "side"])
    total = runs.groupBy(*PAGE, "side").agg(F.sum(F.col("y1") - F.col("y0")).alias("t")).groupBy(*PAGE).agg(F.min("t").alias("shorter"), F.count("*").alias("sides")).filter("sides = 2")
    left = runs.filter("side = 'left'").select(*PAGE, F.col("y0").alias("a0"), F.col("y1").alias("a1"))
    both = left.join(runs.filter("side = 'right'").select(*PAGE, "y0", "y1"), PAGE).groupBy(*PAGE).agg(F.sum(F.greatest(F.lit(0.0), F.least("a1", "y1") - F.greatest("a0", "y0"))).alias("shared"))
    out = total.join(both, PAGE).filter("shorter > 0").select(*PAGE, F.round(F.col("shared") / F.col("shorter"), 4).alias("ratio"))
    return out.withColumn("collapsed", F.col("ratio") < least)


def coincident(elements: DataFrame) -> DataFrame:
    """(doc_id, page, x, y, n): spots where several elements with content begin."""
    said = boxes(elements).filter(F.col("kind").isin("text", "formula") & ~is_blank())
    return said.groupBy(*PAGE, F.bround("x0").alias("x"), F.bround("y0").alias("y")).agg(F.count("*").alias("n")).filter("n > 1")


def contained(elements: DataFrame, share: float = 0.5, slack: float = 1.0) -> DataFrame:
    """(doc_id, page, idx, host): formulas inside another text or formula box of more than twice their area."""
    b = boxes(elements).filter(F.col("kind").isin("text", "formula"))
    inner = b.filter("kind = 'formula'").select(*KEY, "x0", "y0", "x1", "y1")
    host = b.select(*PAGE, F.col("idx").alias("host"), *[F.col(c).alias(f"h{c}") for c in ("x0", "y0", "x1", "y1")])
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    inside = (F.col("x0") >= F.col("hx0") - slack) & (F.col("y0") >= F.col("hy0") - slack) & (F.col("x1") <= F.col("hx1") + slack) & (F.col("y1") <= F.col("hy1") + slack)
    pairs = inner.join(host, PAGE).filter((F.col("idx") != F.col("host")) & inside & (area("") < share * area("h")))
    return pairs.groupBy(*KEY).agg(F.min("host").alias("host"))


def covered_by_image(elements: DataFrame, pages: DataFrame, share: float = 0.6) -> DataFrame:
    """(doc_id, page, idx, image_idx, dropped): text that the first image over it covers for 60 %; dropped unless that image is page-sized."""
    b = boxes(elements).join(page_sizes(pages), PAGE)
    image = b.filter("kind = 'image'").select(*PAGE, F.col("idx").alias("image_idx"), *[F.col(c).alias(f"i{c}") for c in ("x0", "y0", "x1", "y1")], (F.col("width") * F.col("height")).alias("whole"))
    over = F.greatest(F.lit(0.0), F.least("x1", "ix1") - F.greatest("x0", "ix0")) * F.greatest(F.lit(0.0), F.least("y1", "iy1") - F.greatest("y0", "iy0"))
    own = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    hits = b.filter("kind <> 'image'").join(image, PAGE).filter((own > 0) & (over >= share * own))
    big = (F.col("ix1") - F.col("ix0")) * (F.col("iy1") - F.col("iy0")) >= 0.8 * F.col("whole")
    first = hits.groupBy(*KEY).agg(F.min(F.struct("image_idx", big.alias("big"))).alias("first"))
    return first.select(*KEY, "first.image_idx", (~F.col("first.big")).alias("dropped"))


def is_page_number(top: float = 0.12, bottom: float = 0.9, widest: float = 0.12) -> Column:
    """Digits only, narrow, at the page's head or foot; columns kind, text, x0..y1, width, height."""
    edge = (F.col("y1") < F.col("height") * top) | (F.col("y0") > F.col("height") * bottom)
    return F.coalesce(F.col("kind").isin("text", "formula") & T.trimmed("text").rlike(r"^\d{1,4}\z") & (F.col("x1") - F.col("x0") <= F.col("width") * widest) & edge, F.lit(False))


def word_boxes(elements: DataFrame) -> DataFrame:
    """(doc_id, page, idx, pos, word, x0, y0, x1, y1): words of each line with boxes in proportion to their letters."""
    e = boxes(elements).filter("kind = 'text' and text is not null")
    ls = e.select(*KEY, "x0", "y0", "x1", "y1", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("li", "line"))
    step = (F.col("y1") - F.col("y0")) / F.col("n")
    tokens = F.filter(F.split("line", " ", -1), lambda w: w != "")
    ws = ls.select(*KEY, "x0", "x1", "line", "li", (F.col("y0") + F.col("li") * step).alias("top"), (F.col("y0") + (F.col("li") + 1) * step).alias("low"), tokens.alias("ws"))
    ws = ws.filter(F.size("ws") > 0).withColumn("chars", F.length(F.array_join("ws", " ")))
    before = lambda i: F.length(F.array_join(F.slice("ws", 1, i), " ")) + F.when(i > 0, 1).otherwise(0)
    spots = F.transform("ws", lambda w, i: F.struct(i.alias("i"), w.alias("w"), before(i).alias("at")))
    x = ws.select(*KEY, "li", "x0", "x1", "top", "low", "chars", F.explode(spots).alias("s"))
    scale = (F.col("x1") - F.col("x0")) / F.col("chars")
    return x.select(*KEY, "li", F.col("s.i").alias("pos"), F.col("s.w").alias("word"), (F.col("x0") + F.col("s.at") * scale).alias("wx0"), F.col("top").alias("wy0"), (F.col("x0") + (F.col("s.at") + F.length("s.w")) * scale).alias("wx1"), F.col("low").alias("wy1"))


def line_gutters(words: DataFrame, pages: DataFrame, least: float = 14.0) -> DataFrame:
    """(doc_id, page, gutter): the commonest place of wide gaps between neighbouring words of a line, if a third agrees."""
    line = Window.partitionBy(*PAGE, "line").orderBy("wx0", "idx", "li", "pos")
    w = words.withColumn("line", F.bround(F.col("wy0") / 3.0)).withColumn("next", F.lead("wx0").over(line))
    gaps = w.filter(F.col("next") - F.col("wx1") >= least).select(*PAGE, ((F.col("next") + F.col("wx1")) / 2).alias("c"))
    gaps = gaps.withColumn("bucket", F.bround(F.col("c") / 8) * 8)
    votes = gaps.groupBy(*PAGE, "bucket").agg(F.count("*").alias("n"), F.avg("c").alias("mean"))
    total = votes.groupBy(*PAGE).agg(F.sum("n").alias("all"), F.max_by(F.struct("n", "mean"), F.struct("n", -F.col("bucket"))).alias("best"))
    good = total.filter((F.col("all") >= 4) & (F.col("best.n") >= 0.35 * F.col("all"))).join(page_sizes(pages), PAGE)
    return good.filter(F.col("best.mean").between(0.3 * F.col("width"), 0.7 * F.col("width"))).select(*PAGE, F.round("best.mean", 4).alias("gutter"))


def reading_order(words: DataFrame, gutter: DataFrame) -> DataFrame:
    """(doc_id, page, fragment, side, line, text): words regrouped into line fragments, left column first."""
    w = words.join(gutter, PAGE, "left").withColumn("line", F.bround(F.col("wy0") / 3.0).cast("int"))
    g = F.col("gutter")
    side = F.when(g.isNull() | (F.col("wx1") <= g + 2), 0).when(F.col("wx0") >= g - 2, 1).when(g - F.col("wx0") > F.col("wx1") - g, 0).otherwise(1)
    frag = w.withColumn("side", side).groupBy(*PAGE, "side", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("wx0", "idx", "li", "pos", "word"))), lambda s: s.word), " ").alias("text"))
    return frag.withColumn("fragment", F.row_number().over(Window.partitionBy(*PAGE).orderBy("side", "line")) - 1)
