"""The core queries, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import align, audit, folds, heads, layout, lexicon, render, rewrites, rules
from quirefold.plans.core_sql import SQL
from quirefold.sources.tables import table
from quirefold.streaming import deliveries

KEY = ["doc_id", "page", "idx"]
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def elements(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Elements delivered once; only the named columns are read."""
    return table(spark, d, "elements").select(*KEY, *cols).dropDuplicates(KEY)


def geometry(spark: SparkSession, d: str) -> DataFrame:
    return elements(spark, d, "kind", "bbox", "text", "size", "sentences")


def columned(spark: SparkSession, d: str) -> DataFrame:
    """geometry with every other element moved to a right column, as the test data has pages of one column only."""
    e = geometry(spark, d)
    x0 = F.when(F.col("idx") % 2 == 1, F.lit(261.0) + F.col("bbox.x0") % 7).otherwise(F.col("bbox.x0"))
    x1 = F.when(F.col("idx") % 2 == 1, F.lit(461.0) + F.col("bbox.x0") % 7).otherwise(F.least(F.col("bbox.x1"), F.lit(240.0)))
    moved = F.struct(x0.alias("x0"), F.col("bbox.y0").alias("y0"), x1.alias("x1"), F.col("bbox.y1").alias("y1"))
    return e.withColumn("bbox", F.when(F.col("bbox").isNotNull() & (F.col("kind") == "text"), moved).otherwise(F.col("bbox")))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages_geo")


def translations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translations")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return elements(spark, d, "kind", "text").filter("kind = 'text' and text is not null").drop("kind")


# --- sentences and tokens ---


def _sentences(spark: SparkSession, d: str, split: Callable) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(split("text")).alias("sent", "sentence"))


@query
def sentences_split(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d, T.split_sentences)


@query
def sentences_resplit(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d, T.resplit_sentences)


@query
def sentences_naive(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d, T.naive_sentences)


@query
def chinese_split(spark: SparkSession, d: str) -> DataFrame:
    t = align.newest(translations(spark, d)).select(*KEY, F.posexplode("segs").alias("seg", "s")).filter("s is not null")
    return t.select(*KEY, "seg", F.posexplode(T.split_chinese("s")).alias("piece", "sentence"))


@query
def tokens_lookup(spark: SparkSession, d: str) -> DataFrame:
    w = T.lookup_tokens("text")
    return _texts(spark, d).select(*KEY, F.size(w).alias("words"), F.size(F.filter(w, T.is_lookup_word)).alias("lookups"))


@query
def vocabulary_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.vocabulary(elements(spark, d, "kind", "text", "sentences"))


@query
def surface_acronyms(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.acronyms(elements(spark, d, "kind", "text", "sentences"))


# --- dictionary ---


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dictionary")


@query
def lemma_candidates(spark: SparkSession, d: str) -> DataFrame:
    w = _dictionary(spark, d).select(F.lower(T.trimmed("word")).alias("word")).filter("word <> ''").distinct()
    return w.select("word", F.posexplode(T.lemma_candidates("word")).alias("candidate", "form"))


@query
def dictionary_resolve(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.resolve(lexicon.vocabulary(elements(spark, d, "kind", "text", "sentences")), _dictionary(spark, d))


@query
def dictionary_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.unresolved(lexicon.vocabulary(elements(spark, d, "kind", "text", "sentences")), _dictionary(spark, d))


@query
def dictionary_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: sentences to words, base forms, dictionary, coverage by source."""
    vocab = lexicon.vocabulary(elements(spark, d, "kind", "text", "sentences"))
    source = table(spark, d, "docs").select("doc_id", F.coalesce("source", F.lit("-")).alias("source")).dropDuplicates(["doc_id"])
    return lexicon.coverage(vocab.join(source, "doc_id"), _dictionary(spark, d), "source")


@query
def dictionary_entries(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.entries(_dictionary(spark, d)).select("word", "tier", "m")


@query
def gloss_clean(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(" ", "t", "m")
    tag, rest = T.clean_gloss(line)
    return _dictionary(spark, d).filter("m is not null").select(T.trimmed(line).alias("line"), tag.alias("tag"), rest.alias("gloss")).distinct()


@query
def pos_format(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.regexp_replace("t", r"\.", ":46/"), F.lit("v:54/n:9"))
    return _dictionary(spark, d).filter("t is not null").select("t", T.format_pos(raw).alias("pos")).distinct()


@query
def first_lines(spark: SparkSession, d: str) -> DataFrame:
    return _dictionary(spark, d).filter("m is not null").select("m", T.first_lines(F.concat("m", F.lit("; a \\n b；"), F.col("m"))).alias("lines")).distinct()


# --- repairs ---


@query
def ligature_expand(spark: SparkSession, d: str) -> DataFrame:
    x = T.expand_ligatures("text")
    return _texts(spark, d).filter(x != F.col("text")).select(*KEY, x.alias("expanded"))


#: A user's tables: slips of one scan, and words that lost a drop capital.
WORD_FIXES = (("jinance", "finance"), ("jirm", "firm"), ("jirst", "first"), ("Keyndsian", "Keynesian"))
DROP_CAPS = {"HE": "THE", "HIS": "THIS", "HESE": "THESE"}


@query
def word_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Fixed repairs in order, on texts with the damage they mend written in."""
    hurt = F.concat(F.replace("text", F.lit("finance"), F.lit("jinance")), F.lit(" HE BANK, macmacroeconomics"))
    return _texts(spark, d).select(*KEY, T.fix_double_stem(T.fix_words(T.fix_drop_caps(hurt, DROP_CAPS), WORD_FIXES)).alias("repaired"))


@query
def header_strip(spark: SparkSession, d: str) -> DataFrame:
    x = heads.strip_heads("text")
    return _texts(spark, d).filter(x != T.trimmed("text")).select(*KEY, x.alias("stripped"), heads.has_substance(x).alias("substance"))


@query
def volume_head_strip(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d).withColumn("headed", F.concat(F.lit("Vol. XXVIII (December 1990) "), "text"))
    return t.select(*KEY, T.strip_volume_head("headed", "December", "1990").alias("stripped"))


#: Rules in the manner of a user's table: fused and broken words, one exact splice.
RULES = (
    rules.Rule("harvest", "harvest yield", True, True), rules.Rule("the yield", "that yield"), rules.Rule("Table", "TABLE"), rules.Rule("well-known", "known", True), rules.Rule(" ,", ",", exact=True),
)


@query
def rule_repairs(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d)
    return t.select(*KEY, rules.apply_rules(F.col("text"), RULES).alias("repaired"))


@query
def font_stacks(spark: SparkSession, d: str) -> DataFrame:
    return elements(spark, d, "font").groupBy("font", rules.font_stack("font").alias("family")).agg(F.count("*").alias("n"))


# --- formulas ---


def _overrides(spark: SparkSession, d: str) -> DataFrame:
    """Overrides for the texts of the formulas of even pages, and one that no formula has."""
    f = elements(spark, d, "kind", "text").filter("kind = 'formula' and page % 2 = 0").select(F.concat(F.lit(" "), "text").alias("src_text"), F.replace("text", F.lit(" "), F.lit("")).alias("new_text")).distinct()
    return f.unionByName(spark.createDataFrame([("no = such", "x")], "src_text string, new_text string"))


@query
def formula_overrides(spark: SparkSession, d: str) -> DataFrame:
    return rules.override_formulas(elements(spark, d, "kind", "text"), _overrides(spark, d))


@query
def stale_overrides(spark: SparkSession, d: str) -> DataFrame:
    return rules.stale_overrides(elements(spark, d, "kind", "text"), _overrides(spark, d))



@query
def formula_class(spark: SparkSession, d: str) -> DataFrame:
    e = elements(spark, d, "kind", "text", "font").filter("kind in ('text', 'formula') and text is not null")
    return e.select(*KEY, "kind", T.math_points("text").alias("points"), T.is_formula("text", "font", F.lit(1)).alias("formula"))


@query
def math_line_class(spark: SparkSession, d: str) -> DataFrame:
    e = elements(spark, d, "kind", "text", "font").filter("kind in ('text', 'formula') and text is not null")
    return e.select(*KEY, "kind", T.is_math_line("text", "font").alias("math"))


# --- heads, stubs, folios ---


@query
def header_probe(spark: SparkSession, d: str) -> DataFrame:
    return heads.probe(elements(spark, d, "kind", "sentences"), align.newest(translations(spark, d)))


@query
def repeated_header(spark: SparkSession, d: str) -> DataFrame:
    return audit.repeated_header(elements(spark, d, "kind", "text", "sentences"))


@query
def zh_piece_learn(spark: SparkSession, d: str) -> DataFrame:
    """On heads written in: the first sentence of every third element begins with a volume line, its first segment with the
    translated one and a page number."""
    e, t = elements(spark, d, "kind", "sentences"), align.newest(translations(spark, d))
    third = (F.col("idx") + F.col("page")) % 3 == 0
    ahead = lambda c, x: F.when(third & (F.size(c) > 0), F.concat(F.array(F.concat(x, F.element_at(c, 1))), F.slice(c, 2, F.size(c)))).otherwise(F.col(c))
    headed = e.withColumn("sentences", ahead("sentences", F.lit("1655 Vol. XX (")))
    zh = t.withColumn("segs", ahead("segs", F.concat(F.lit("期刊第"), F.col("page") % 3, F.lit("卷 165"), (F.col("idx") % 10).cast("string"), F.lit(" "))))
    return heads.learn_pieces(headed, zh)


@query
def zh_piece_learn_plain(spark: SparkSession, d: str) -> DataFrame:
    """On the tables as they are, with the words that begin running heads in them."""
    return heads.learn_pieces(elements(spark, d, "kind", "sentences"), align.newest(translations(spark, d)), ("Proceedings of the", "Notes on the", "A History of"))


#: A user's marks of pages that only cite: one anywhere, one that must be the whole page.
STUB_MARKS = (r"(?i)linked citations", r"(?i)^\s*www\.example\.org\s*\z")


@query
def stub_pages(spark: SparkSession, d: str) -> DataFrame:
    """On texts in which `table` is four links, as on a page of links; pages of nothing but `Index` are stubs too."""
    e = elements(spark, d, "kind", "text").withColumn("text", F.regexp_replace("text", "(?i)table", "https://a.b https://c.d https://e.f https://g.h"))
    return heads.stub_pages(e, STUB_MARKS)


@query
def stub_pages_plain(spark: SparkSession, d: str) -> DataFrame:
    """Stub pages of the table as it is."""
    return heads.stub_pages(elements(spark, d, "kind", "text"), STUB_MARKS)


@query
def page_renumber(spark: SparkSession, d: str) -> DataFrame:
    """Stub pages of stub_pages dropped, the others numbered anew."""
    e = elements(spark, d, "kind", "text").withColumn("text", F.regexp_replace("text", "(?i)table", "https://a.b https://c.d https://e.f https://g.h"))
    return rules.without_stubs(e).select("doc_id", "page", "new_page").distinct()


@query
def folio_strip(spark: SparkSession, d: str) -> DataFrame:
    e = layout.boxes(geometry(spark, d)).join(layout.page_sizes(pages(spark, d)), layout.PAGE)
    return e.filter(layout.is_page_number()).select(*KEY, T.trimmed("text").alias("folio"))


# --- geometry ---


@query
def layout_gutter(spark: SparkSession, d: str) -> DataFrame:
    return layout.gutters(columned(spark, d), pages(spark, d))


@query
def column_assign(spark: SparkSession, d: str) -> DataFrame:
    return layout.columns(columned(spark, d), pages(spark, d)).select(*KEY, "side")


@query
def column_right_edge(spark: SparkSession, d: str) -> DataFrame:
    return layout.columns(columned(spark, d), pages(spark, d)).select(*KEY, F.round("column_right", 2).alias("column_right"))


@query
def vertical_coverage(spark: SparkSession, d: str) -> DataFrame:
    return layout.coverage(geometry(spark, d), pages(spark, d)).select("doc_id", "page", F.round("covered", 4).alias("covered"))


@query
def uncovered_bands(spark: SparkSession, d: str) -> DataFrame:
    return layout.uncovered_bands(geometry(spark, d), pages(spark, d))


@query
def scan_image_marks(spark: SparkSession, d: str) -> DataFrame:
    return layout.scan_marks(geometry(spark, d), pages(spark, d))


@query
def covered_spans(spark: SparkSession, d: str) -> DataFrame:
    return layout.covered_by_image(geometry(spark, d), pages(spark, d))


@query
def line_estimate(spark: SparkSession, d: str) -> DataFrame:
    e = layout.boxes(geometry(spark, d)).filter("kind = 'text' and text is not null")
    size = F.coalesce("size", F.lit(11.0))
    return e.select(*KEY, F.round(T.text_advance("text", size), 2).alias("advance"), T.measure_lines("text", size, F.col("x1") - F.col("x0")).alias("lines"))


@query
def height_estimate(spark: SparkSession, d: str) -> DataFrame:
    h = layout.estimated_heights(geometry(spark, d), align.newest(translations(spark, d)))
    return h.select(*KEY, "lines", F.round("est_height", 2).alias("est_height"))


@query
def pushdown_layout(spark: SparkSession, d: str) -> DataFrame:
    e, p = columned(spark, d), pages(spark, d)
    r = layout.relayout(layout.widened(e, p), p, align.newest(translations(spark, d)))
    return r.select(*KEY, "side", F.round("top", 2).alias("top"), F.round("bottom", 2).alias("bottom"))


@query
def box_overlap(spark: SparkSession, d: str) -> DataFrame:
    return layout.overlapping(geometry(spark, d))


@query
def column_pairing(spark: SparkSession, d: str) -> DataFrame:
    return layout.column_pairing(columned(spark, d), pages(spark, d))


@query
def coincident_slots(spark: SparkSession, d: str) -> DataFrame:
    return layout.coincident(geometry(spark, d))


@query
def containment_dups(spark: SparkSession, d: str) -> DataFrame:
    return layout.contained(geometry(spark, d))


@query
def line_gutter_mode(spark: SparkSession, d: str) -> DataFrame:
    return layout.line_gutters(layout.word_boxes(columned(spark, d)), pages(spark, d))


@query
def column_major_order(spark: SparkSession, d: str) -> DataFrame:
    words = layout.word_boxes(columned(spark, d))
    return layout.reading_order(words, layout.line_gutters(words, pages(spark, d)))


@query
def word_boxes(spark: SparkSession, d: str) -> DataFrame:
    return layout.word_boxes(geometry(spark, d)).groupBy(*KEY).agg(F.count("*").alias("n"), F.round(F.max("wx1"), 2).alias("right"), F.round(F.avg("wx0"), 2).alias("mean_left"))


# --- folds ---


@query
def text_run_merge(spark: SparkSession, d: str) -> DataFrame:
    return folds.text_runs(geometry(spark, d))


@query
def paragraph_reflow(spark: SparkSession, d: str) -> DataFrame:
    return folds.paragraphs(geometry(spark, d))


@query
def line_reflow(spark: SparkSession, d: str) -> DataFrame:
    return folds.line_blocks(geometry(spark, d))


@query
def baseline_merge(spark: SparkSession, d: str) -> DataFrame:
    return folds.baseline_lines(geometry(spark, d))


@query
def fraction_fold(spark: SparkSession, d: str) -> DataFrame:
    return folds.fractions(geometry(spark, d))


@query
def orphan_absorb(spark: SparkSession, d: str) -> DataFrame:
    return folds.orphans(geometry(spark, d))


# --- translations ---


@query
def translation_newest(spark: SparkSession, d: str) -> DataFrame:
    return align.newest(translations(spark, d)).select(*KEY, F.coalesce(F.array_join("segs", "|", "~"), F.lit("-")).alias("segs"))


@query
def align_segments(spark: SparkSession, d: str) -> DataFrame:
    a = align.align_segments(elements(spark, d, "kind", "text", "sentences"), translations(spark, d))
    return a.select(*KEY, "want", F.array_join("aligned", "|").alias("segs"), "note")


@query
def zh_reconcile(spark: SparkSession, d: str) -> DataFrame:
    a = align.reconcile(elements(spark, d, "kind", "text", "sentences"), translations(spark, d))
    return a.select(*KEY, "want", "n_segs", F.array_join("fixed", "|").alias("segs"), "blanks")


@query
def translation_audit(spark: SparkSession, d: str) -> DataFrame:
    return align.translation_audit(elements(spark, d, "kind", "text", "sentences"), translations(spark, d))


@query
def bibliography_unify(spark: SparkSession, d: str) -> DataFrame:
    return align.unify_references(geometry(spark, d), pages(spark, d))


@query
def continuation_stitch(spark: SparkSession, d: str) -> DataFrame:
    return align.stitch(elements(spark, d, "kind", "sentences"))


@query
def content_realign(spark: SparkSession, d: str) -> DataFrame:
    """Old and new numbering: the new one counts text elements only."""
    old = elements(spark, d, "kind", "text")
    from pyspark.sql import Window

    new = old.filter("kind = 'text'").withColumn("idx", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("idx")) - 1)
    return align.realign(old, new)


# --- gates and statistics ---


@query
def audit_findings(spark: SparkSession, d: str) -> DataFrame:
    e = elements(spark, d, "kind", "bbox", "text", "size", "sentences", "skip")
    return audit.findings(e, pages(spark, d), translations(spark, d))


@query
def severity_summary(spark: SparkSession, d: str) -> DataFrame:
    return audit.severities(audit_findings(spark, d))


@query
def stage_stats(spark: SparkSession, d: str) -> DataFrame:
    e = elements(spark, d, "kind", "sentences", "font")
    said = F.when(F.col("kind") == "text", F.greatest(F.coalesce(F.size("sentences"), F.lit(0)), F.lit(0))).otherwise(0)
    return e.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "text").alias("texts"), F.count_if(F.col("kind") == "formula").alias("formulas"), F.count_if(F.col("kind") == "image").alias("images"),
        F.sum(said).alias("sentences"), F.array_join(F.array_sort(F.collect_set("font")), ",").alias("fonts"),
    )


@query
def page_render(spark: SparkSession, d: str) -> DataFrame:
    return render.page_html(geometry(spark, d), translations(spark, d))


@query
def page_layout_render(spark: SparkSession, d: str) -> DataFrame:
    e = elements(spark, d, "kind", "bbox", "text", "size", "sentences", "font", "style")
    return render.laid_pages(e, pages(spark, d), translations(spark, d)).select("doc_id", "page", F.length("html").alias("characters"), F.xxhash64("html").alias("hash"))


# --- rewrites ---


@query
def heads_stripped(spark: SparkSession, d: str) -> DataFrame:
    """On heads written in: the first sentence of every third element, and its first segment, begin with a volume line and a page number."""
    third = (F.col("idx") + F.col("page")) % 3 == 0
    ahead = lambda c, x: F.when(third & (F.size(c) > 0), F.concat(F.array(F.concat(F.lit(x), F.coalesce(F.element_at(c, 1), F.lit("")))), F.slice(c, 2, F.size(c)))).otherwise(F.col(c))
    e = elements(spark, d, "kind", "sentences").withColumn("sentences", ahead("sentences", "1655 Vol. XX (May 1990) "))
    t = translations(spark, d).withColumn("segs", ahead("segs", "1655 《期刊》（1990年5月），"))
    r = rewrites.strip_both(e, t)
    return r.select(*KEY, F.array_join("sentences", "|").alias("sentences"), F.array_join("segs", "|").alias("segs"), "dropped", "dropped_segs")


@query
def folios_blanked(spark: SparkSession, d: str) -> DataFrame:
    """Elements and translations that are left after page numbers were emptied, counted by page."""
    e, t = rewrites.blank_folios(geometry(spark, d), pages(spark, d), align.newest(translations(spark, d)))
    said = e.filter("text <> ''").groupBy(*layout.PAGE).agg(F.count("*").alias("texts"))
    return said.join(t.groupBy(*layout.PAGE).agg(F.count("*").alias("translated")), layout.PAGE, "full_outer").select(*layout.PAGE, "texts", "translated")


@query
def references_unified(spark: SparkSession, d: str) -> DataFrame:
    """On the last page of each document."""
    p = pages(spark, d)
    last = p.groupBy("doc_id").agg(F.max("page").alias("page"))
    return rewrites.unified_references(geometry(spark, d), p, last).select(*KEY, "text")


@query
def references_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth text element is taken for a continuation of the one before."""
    e = elements(spark, d, "kind", "text")
    r = rewrites.rejoined(e, translations(spark, d), e.filter("kind = 'text' and idx % 5 = 4"))
    return r.select(*KEY, "text", F.array_join("segs", "|").alias("segs"))


@query
def tails_moved(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that continuation_stitch finds, moved to their hosts."""
    e = elements(spark, d, "kind", "sentences")
    s = align.stitch(e).select(*KEY, F.col("page").alias("tail_page"), F.col("next_idx").alias("tail_idx"), T.trimmed("tail").alias("expected"))
    s = s.filter("idx % 2 = 0").join(s.filter("idx % 2 = 0").select("doc_id", F.col("tail_page").alias("page"), F.col("tail_idx").alias("idx")), KEY, "left_anti")
    changed, _ = rewrites.moved_tails(e, translations(spark, d), s)
    return changed.select(*KEY, "text", F.array_join("segs", "|").alias("segs"))


@query
def self_checks(spark: SparkSession, d: str) -> DataFrame:
    e = elements(spark, d, "kind", "bbox", "text", "size", "sentences")
    return rewrites.self_checks(e, pages(spark, d), translations(spark, d))


@query
def delivery_volumes(spark: SparkSession, d: str) -> DataFrame:
    """The streaming operator over the table as a batch: volumes by day and kind of the elements that arrived."""
    return deliveries.volumes(table(spark, d, "elements").select(*KEY, "kind", "text", "ingested_at"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in _QUERIES}
