"""Repairs and overrides that a user's tables state: word rules, exact splices, formula overrides, dropped pages."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.operators.heads import stub_pages
from quirefold.session import small

KEY = ["doc_id", "page", "idx"]


class Rule(NamedTuple):
    """bad becomes good. Whole words unless `exact`; ignore_case also takes other spellings, an all-capitals one becoming
    capitals if keep_upper. doc_id and page narrow the scope."""

    bad: str
    good: str
    ignore_case: bool = False
    keep_upper: bool = False
    exact: bool = False
    doc_id: int | None = None
    page: int | None = None


def _literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def apply_rules(t: Column, rules: Sequence[Rule], doc_id: Column | None = None, page: Column | None = None) -> Column:
    """Rules one after another, later ones seeing what earlier ones made, in one expression without shuffle. The number of
    rules is that of a hand-made table."""
    x = t
    for r in rules:
        edge = (lambda p: p) if r.exact else (lambda p: rf"(?<![\p{{L}}\p{{N}}_]){p}(?![\p{{L}}\p{{N}}_])")
        bad = re.escape(r.bad)
        y = x
        if r.keep_upper and not r.good.isupper():
            y = F.regexp_replace(y, edge(re.escape(r.bad.upper())), _literal(r.good.upper()))
        y = F.regexp_replace(y, ("(?i)" if r.ignore_case else "") + edge(bad), _literal(r.good)) if not (r.keep_upper and r.bad.upper() == r.good.upper()) else y
        scope = [c == v for c, v in ((doc_id, r.doc_id), (page, r.page)) if c is not None and v is not None]
        for s in scope:
            y = F.when(s, y).otherwise(x)
        x = y
    return x


def repair_elements(elements: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rules on text and on every sentence alike, so that neither grows stale; rows and ids stay."""
    own = lambda c: apply_rules(c, rules, F.col("doc_id"), F.col("page"))
    return elements.withColumn("text", own(F.col("text"))).withColumn("sentences", F.transform("sentences", own))


def _plain(c: str) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def override_formulas(elements: DataFrame, fixes: DataFrame) -> DataFrame:
    """(doc_id, page, idx, text, new_text): formulas with an override for their text, blanks aside; an empty new_text deletes. Of
    repeated overrides the first by new_text holds."""
    f = fixes.filter("src_text is not null").groupBy(_plain("src_text").alias("k")).agg(F.min(F.coalesce("new_text", F.lit(""))).alias("new_text"))
    return elements.filter("kind = 'formula' and text is not null").select(*KEY, "text", _plain("text").alias("k")).join(small(f), "k").drop("k")


def stale_overrides(elements: DataFrame, fixes: DataFrame) -> DataFrame:
    """Overrides whose source text no formula has."""
    known = elements.filter("kind = 'formula' and text is not null").select(_plain("text").alias("k")).distinct()
    return fixes.filter("src_text is not null").withColumn("k", _plain("src_text")).join(known, "k", "left_anti").drop("k")


def without_stubs(elements: DataFrame, marks: tuple[str, ...] = ()) -> DataFrame:
    """elements without stub pages, pages numbered anew from 1 without gaps; new_page beside page."""
    kept = elements.join(stub_pages(elements, marks), ["doc_id", "page"], "left_anti")
    numbers = kept.select("doc_id", "page").distinct().withColumn("new_page", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))
    return kept.join(numbers, ["doc_id", "page"])


# Font stacks of the reader by marks in a font's name.
SERIF_MARKS, MONO_MARKS = ("times", "serif", "tiro", "nimbusrom", "minion", "georgia", "cmr"), ("cour", "mono", "consol")
SERIF, MONO, SANS = "serif", "monospace", "sans-serif"


def font_stack(font: str | Column) -> Column:
    """Generic family for a font's name."""
    name = F.lower(F.coalesce(F.col(font) if isinstance(font, str) else font, F.lit("")))
    return F.when(name.rlike("|".join(SERIF_MARKS)), SERIF).when(name.rlike("|".join(MONO_MARKS)), MONO).otherwise(SANS)


def style_of(flags: Column) -> Column:
    """italic, bold and serifed of a font's flag bits 2, 16 and 4."""
    on = lambda bit, name: (flags.bitwiseAND(bit) != 0).alias(name)
    return F.struct(on(2, "italic"), on(16, "bold"), on(4, "serifed"))


def png_size(image: Column) -> Column:
    """(width, height) of a PNG by its header, null for other bytes."""
    number = lambda at: F.conv(F.hex(F.substring(image, at, 4)), 16, 10).cast("int")
    is_png = F.hex(F.substring(image, 1, 8)) == "89504E470D0A1A0A"
    return F.when(is_png, F.struct(number(17).alias("width"), number(21).alias("height")))


def hotspots(words: DataFrame, least: float = 0.6) -> DataFrame:
    """Word boxes in image pixels (nat_w, nat_h, x, y, w_px, h_px) as percent of the image: left, top, wide, high; boxes at
    least 0.6 wide and high, images of unknown size left out."""
    pct = lambda a, b: F.round(100.0 * F.col(a) / F.col(b), 3)
    sized = words.filter((F.col("nat_w") > 0) & (F.col("nat_h") > 0))
    return sized.select("*", pct("x", "nat_w").alias("left"), pct("y", "nat_h").alias("top"), F.greatest(F.lit(least), pct("w_px", "nat_w")).alias("wide"), F.greatest(F.lit(least), pct("h_px", "nat_h")).alias("high"))
