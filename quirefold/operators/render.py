"""Pages as HTML: sentences with clickable words and their translations beneath."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import align, layout, rules
from quirefold.operators.layout import KEY, PAGE, boxes


def escaped(t: str | Column) -> Column:
    x = F.col(t) if isinstance(t, str) else t
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def clickable(t: Column, sent_id: Column) -> Column:
    """Lookup words in <w> tags with their lower-cased form and sentence, all else escaped."""
    words = T.lookup_tokens(t)
    marked = F.regexp_replace(t, T.WORD, "\u0001")
    rest = F.split(marked, "\u0001", -1)
    tag = lambda w: F.when(T.is_lookup_word(w), F.concat(F.lit('<w data-w="'), escaped(F.lower(w)), F.lit('" data-s="'), sent_id, F.lit('">'), escaped(w), F.lit("</w>"))).otherwise(escaped(w))
    parts = F.transform(rest, lambda r, i: F.concat(escaped(r), F.coalesce(tag(F.try_element_at(words, i + 1)), F.lit(""))))
    return F.array_join(parts, "")


def page_html(elements: DataFrame, translations: DataFrame) -> DataFrame:
    """(doc_id, page, html): text elements of each page in reading order."""
    e = boxes(elements).filter("kind = 'text' and size(sentences) > 0").join(align.newest(translations).select(*KEY, "segs"), KEY, "left")
    key = F.concat(F.col("page").cast("string"), F.lit("#"), F.col("idx").cast("string"))

    def sentence(s: Column, i: Column) -> Column:
        z = F.coalesce(F.try_element_at("segs", i + 1), F.lit(""))
        zh = F.when(T.trimmed(z) != "", F.concat(F.lit('<p class="zh">'), escaped(z), F.lit("</p>"))).otherwise("")
        return F.concat(F.lit('<p class="en">'), clickable(F.coalesce(s, F.lit("")), F.concat(key, F.lit(":"), i.cast("string"))), F.lit("</p>"), zh)

    body = F.concat(F.lit('<div id="'), key, F.lit('">'), F.array_join(F.transform("sentences", sentence), ""), F.lit("</div>"))
    row = F.struct(F.bround("y0", 1).alias("r"), "x0", "idx", body.alias("html"))
    return e.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r.html), "").alias("html"))


def _px(**props: Column) -> Column:
    return F.concat(*[x for k, v in props.items() for x in (F.lit(f"{k.replace('_', '-')}:"), v.cast("string"), F.lit("px;"))])


def laid_pages(elements: DataFrame, pages: DataFrame, translations: DataFrame, hotspots: DataFrame | None = None, latex: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, html): sections with every element at its place after the push-down, as high as their lowest element needs.

    Text has its sentences, clickable words and translations beneath; texts of up to 24 characters are marked short, bare
    numbers of up to three digits get no translation. Formulas carry their LaTeX source (latex: doc_id, page, idx, latex),
    images their bytes and the words found in them (hotspots: doc_id, page, idx, nat_w, nat_h, words of w, x, y, w_px,
    h_px). Blank elements and skipped scans show nothing; flow pages keep their order without places."""
    wide = layout.widened(elements, pages)
    placed = layout.relayout(wide, pages, align.newest(translations)).select(*KEY, "top", "bottom")
    size_of = pages.groupBy(*PAGE).agg(F.max("width").alias("width"), F.max("height").alias("height"), F.max(F.coalesce("flow", F.lit(False))).alias("flow"))
    marks = layout.scan_marks(elements, pages).filter("skipped").select(*KEY, F.lit(True).alias("gone"))
    e = boxes(wide.withColumn("blank", layout.is_blank())).join(placed, KEY).join(size_of, PAGE, "left").join(marks, KEY, "left").join(align.newest(translations).select(*KEY, "segs"), KEY, "left")
    for extra, name in ((hotspots, "words"), (latex, "latex")):
        e = e.join(extra, KEY, "left") if extra is not None else e.withColumn(name, F.lit(None).cast("string"))
    flow = F.coalesce("flow", F.lit(False))
    top, bottom = F.when(flow, F.col("y0")).otherwise(F.col("top")), F.when(flow, F.col("y1")).otherwise(F.col("bottom"))
    size, wide_, high = F.coalesce(F.when(F.col("size") != 0, F.col("size")), F.lit(11.0)), F.greatest(F.col("x1") - F.col("x0"), F.lit(4.0)), F.greatest(bottom - top, F.lit(4.0))
    key = F.concat(F.col("page").cast("string"), F.lit("#"), F.col("idx").cast("string"))
    plain = F.coalesce(T.trimmed("text"), F.lit(""))
    lead = F.when(F.length(plain) <= 24, size * 1.5).otherwise(size * 1.18)
    units = F.when(F.size("sentences") > 0, F.col("sentences")).otherwise(F.array(F.coalesce("text", F.lit(""))))
    number = plain.rlike(r"^\d{1,3}\z")

    def sentence(s: Column, i: Column) -> Column:
        sid = F.concat(key, F.lit(":"), i.cast("string"))
        z = F.coalesce(F.try_element_at("segs", i + 1), F.lit(""))
        zh = F.when((z != "") & ~number, F.concat(F.lit('<span class="zh" data-for="'), sid, F.lit('">'), escaped(z), F.lit("</span>"))).otherwise("")
        return F.concat(F.lit('<span class="sent" data-s="'), sid, F.lit('">'), clickable(F.coalesce(s, F.lit("")), sid), F.lit("</span>"), zh)

    at = _px(left=F.col("x0"), top=top, width=wide_, height=high)
    styled = F.concat(F.lit("font-family:"), rules.font_stack("font"), F.when(F.col("style.italic"), ";font-style:italic").otherwise(""), F.when(F.col("style.bold"), ";font-weight:600").otherwise(""))
    text = F.concat(F.lit('<div class="el txt'), F.when(F.length(plain) <= 24, " short").otherwise(""), F.lit('" style="'), at, _px(font_size=size, line_height=lead), styled, F.lit('" data-id="'), key, F.lit('">'), F.array_join(F.transform(units, sentence), ""), F.lit("</div>"))
    formula = F.concat(F.lit('<div class="el formula" style="'), at, _px(font_size=size), F.lit('" data-id="'), key, F.lit('" data-latex="'), escaped(F.coalesce("latex", F.lit(""))), F.lit('"><span class="fx">'), escaped(F.coalesce("text", F.lit(""))), F.lit("</span></div>"))
    hot = F.lit("")
    if hotspots is not None:
        pct = lambda x, n: F.format_string("%.3f", 100.0 * x / F.col(n))
        spot = lambda w: F.concat(F.lit('<w class="hot" style="left:'), pct(w.x, "nat_w"), F.lit("%;top:"), pct(w.y, "nat_h"), F.lit("%;width:"), F.format_string("%.3f", F.greatest(100.0 * w.w_px / F.col("nat_w"), F.lit(0.6))), F.lit("%;height:"), F.format_string("%.3f", F.greatest(100.0 * w.h_px / F.col("nat_h"), F.lit(0.6))), F.lit('%" data-w="'), escaped(w.w), F.lit('"></w>'))
        hot = F.when((F.col("nat_w") > 0) & (F.col("nat_h") > 0) & (F.size("words") > 0), F.concat(F.lit('<div class="hotlayer">'), F.array_join(F.transform("words", spot), ""), F.lit("</div>"))).otherwise("")
    bytes_ = F.base64("image") if "image" in elements.columns else F.lit("")
    ext = F.coalesce("image_ext", F.lit("png")) if "image_ext" in elements.columns else F.lit("png")
    image = F.concat(F.lit('<div class="el imgbox" style="'), at, F.lit('"><img src="data:image/'), ext, F.lit(";base64,"), F.coalesce(bytes_, F.lit("")), F.lit('" alt="">'), hot, F.lit("</div>"))
    gone = F.coalesce("gone", F.lit(False)) | F.col("blank")
    body = F.when(gone, "").when(F.col("kind") == "text", text).when(F.col("kind") == "formula", formula).when(F.col("kind") == "image", image).otherwise("")
    row = F.struct(F.bround("y0", 1).alias("r"), "x0", "idx", body.alias("html"))
    per = e.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r.html), "").alias("body"), F.max(F.when(~F.coalesce("gone", F.lit(False)), bottom)).alias("used"), F.max("width").alias("w"), F.max("height").alias("h"), F.max(flow).alias("flow"))
    high = F.round(F.greatest(F.coalesce("h", F.lit(842.0)), F.coalesce("used", "h", F.lit(842.0)) + 24.0), 1)
    number_ = F.col("page").cast("string")
    section = F.when(F.col("flow"), F.concat(F.lit('<section class="page flow" data-page="'), number_, F.lit('"><div class="flowbody">'), "body", F.lit("</div></section>"))).otherwise(
        F.concat(F.lit('<section class="page" data-page="'), number_, F.lit('" style="'), _px(width=F.coalesce("w", F.lit(595.0)), height=high), F.lit('">'), "body", F.lit("</section>")))
    return per.select(*PAGE, section.alias("html"))


def document_html(pages: DataFrame, title: str = "") -> DataFrame:
    """(doc_id, html): self-contained documents, pages in order."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "html"))), lambda p: F.concat(F.lit('<section data-page="'), p.page.cast("string"), F.lit('">'), p.html, F.lit("</section>"))), "")
    head = f"<!doctype html><meta charset='utf-8'><title>{title}</title><body>"
    return pages.groupBy("doc_id").agg(F.concat(F.lit(head), whole, F.lit("</body>")).alias("html"))
