"""Problem 1: lines repeated across the documents of one source.

The lines of a source, document after document, form one sequence of line identifiers; lines without letters don't count. A
suffix array of that sequence is built by prefix doubling with discarding: in round k every suffix has a rank under its
first 2^k lines, equal ranks being the suffix array's common-prefix intervals of that depth; ranks of two neighbouring
halves give the ranks of the next round. An interval that spans too few documents can't hold a deeper one that spans
enough, so its suffixes are discarded before the next round. After the last round each suffix is carried on, halves that
shrink, to the longest prefix whose interval spans enough documents: that is a repeated block, and its lines are deleted.

Work: the first round is two hash aggregations over all lines, with partial sums before each shuffle, keyed by (source,
line, document), so that neither a large source, document nor line makes a large task. All later rounds see only suffixes
that start with a frequent line. Ranks are sorted per source among the surviving intervals; their number is at most the
mean number of lines of a document divided by the share, whatever the size of the corpus. Lines are numbered through their
document by sums over elements, pages and groups of pages, so that no window holds a whole document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.session import join_hot, materialize, small

MIN_SHARE, MIN_DOCS, MIN_LETTERS = 0.35, 3, 30
KEY = ["doc_id", "page", "idx"]
#: Pages of a document that one window numbers.
PAGES = 1_024


def lines(elements: DataFrame) -> DataFrame:
    """(doc_id, page, idx, line_no, nth, of, letters, n_letters): text cut at newlines, letters being the case-folded letters only;
    nth numbers the `of` lines of the element that have letters, from 0.

    Null texts give no line, nor do lines without letters; repeated deliveries give repeated rows."""
    every = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line_no"), F.regexp_replace(F.lower(x), r"[^\p{L}]+", "").alias("letters")))
    said = elements.filter(F.col("text").isNotNull()).select(*KEY, F.filter(every, lambda s: s.letters != "").alias("ls"))
    cut = said.select(*KEY, F.size("ls").alias("of"), F.posexplode("ls").alias("nth", "l"))
    return cut.select(*KEY, "l.line_no", "nth", "of", "l.letters", F.length("l.letters").alias("n_letters"))


def doc_sources(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source) without null sources, and (source, n_docs)."""
    named = docs.filter(F.col("source").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "source").distinct()
    return named, named.groupBy("source").agg(F.count("*").alias("n_docs"))


def _first_places(sizes: DataFrame) -> DataFrame:
    """(doc_id, page, idx, first): the number of the first line of each element in its document; sizes has (doc_id, page, idx, of)."""
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    e = sizes.withColumnRenamed("of", "n").withColumn("here", before(Window.partitionBy("doc_id", "page").orderBy("idx")))
    p = sizes.groupBy("doc_id", "page").agg(F.sum("of").alias("n")).withColumn("group", F.floor(F.col("page") / PAGES))
    p = p.withColumn("in_group", before(Window.partitionBy("doc_id", "group").orderBy("page")))
    g = p.groupBy("doc_id", "group").agg(F.sum("n").alias("n")).withColumn("in_doc", before(Window.partitionBy("doc_id").orderBy("group")))
    starts = p.drop("n").join(g.drop("n"), ["doc_id", "group"]).select("doc_id", "page", (F.col("in_group") + F.col("in_doc")).alias("start"))
    return e.join(starts, ["doc_id", "page"]).select(*KEY, (F.col("here") + F.col("start")).alias("first"))


def _spread(pairs: DataFrame, need: DataFrame) -> DataFrame:
    """(source, head, then, docs) of intervals that span enough documents: distinct (source, ranks, doc) first, so that both steps combine before they shuffle."""
    once = pairs.select("source", "head", "then", "doc_id").distinct()
    return once.groupBy("source", "head", "then").agg(F.count("*").alias("docs")).join(small(need), "source").filter(F.col("docs") >= F.col("need")).drop("need")


def _ranked(kept: DataFrame, by: list[str]) -> DataFrame:
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(*by)))


_STATE = ["source", "doc_id", "pos", "rank"]


def repeated_blocks(elements: DataFrame, docs: DataFrame, min_share: float = MIN_SHARE, min_docs: int = MIN_DOCS, min_letters: int = MIN_LETTERS) -> tuple[DataFrame, DataFrame]:
    """(occurrences, blocks).

    blocks(source, doc_id, pos, depth, rank): for each place of a source's sequence from which a block runs that spans at least
    `min_docs` documents and a share `min_share` of those that docs lists for the source, its longest such block; depth is
    the number of its lines, rank tells blocks of one depth apart.
    occurrences(source, doc_id, page, idx, line_no, pos, letters, n_letters): the lines inside blocks that have at least
    `min_letters` letters.
    A block counts once per document however often it stands there. Documents without a source, or not in docs, are left
    out, and so are rows without a whole key. Empty tables give empty results."""
    by_doc, sizes = doc_sources(docs)
    need = materialize(sizes.select("source", F.greatest(F.lit(min_docs).cast("double"), F.ceil(F.col("n_docs") * F.lit(min_share) - 1e-9).cast("double")).alias("need")), "p1-need")
    all_lines = lines(elements.dropna(subset=KEY)).withColumn("sym", F.xxhash64("letters"))
    # round 1: the rank of a suffix is that of its first line; the source follows from the document and is joined after the first combine
    once = all_lines.groupBy("doc_id", "sym").agg(F.count("*").alias("n"))
    first = join_hot(once, by_doc, ["doc_id"], salt_from=["sym"]).groupBy("source", "sym").agg(F.count("*").alias("docs"))
    frequent = materialize(_ranked(first.join(small(need), "source").filter(F.col("docs") >= F.col("need")).select("source", "sym"), ["sym"]), "p1-symbols")
    held = all_lines.join(small(frequent.select("sym").distinct()), "sym", "left_semi")
    held = materialize(join_hot(join_hot(held, by_doc, ["doc_id"], salt_from=["page", "idx"]), frequent, ["source", "sym"], salt_from=[*KEY]).dropDuplicates([*KEY, "line_no"]), "p1-lines")
    counted = elements.dropna(subset=["text", *KEY]).select(*KEY, F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"\p{L}"))).alias("of")).dropDuplicates(KEY)
    places = _first_places(counted).join(small(held), KEY).withColumn("pos", F.col("first") + F.col("nth"))
    suffixes = materialize(places.select(*_STATE, "page", "idx", "line_no", "letters", "n_letters"), "p1-suffixes")
    rounds = [suffixes.select(*_STATE)]
    while True:
        kept, state = _doubled(rounds[-1], rounds[-1], F.lit(1 << (len(rounds) - 1)), need)
        if kept.isEmpty():
            break
        rounds.append(materialize(state, "p1-ranks"))
    # carried on from the deepest round to the longest prefix: halves that shrink
    blocks = rounds[-1].withColumn("depth", F.lit(1 << (len(rounds) - 1)))
    for k in range(len(rounds) - 2, -1, -1):
        blocks = blocks.unionByName(rounds[k].join(blocks.select("source", "doc_id", "pos"), ["source", "doc_id", "pos"], "left_anti").withColumn("depth", F.lit(1 << k)))
        blocks = materialize(_lengthened(blocks, rounds, k, need), "p1-blocks")
    covered = blocks.select("source", "doc_id", F.explode(F.sequence("pos", F.col("pos") + F.col("depth") - 1)).alias("pos")).distinct()
    inside = suffixes.drop("rank").join(covered, ["source", "doc_id", "pos"], "left_semi").filter(F.col("n_letters") >= min_letters)
    return inside, blocks


def _doubled(heads: DataFrame, tails: DataFrame, step: F.Column, need: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(intervals, suffixes): suffixes of `heads` that go on, `step` lines ahead, with one of `tails`, ranked by both; only
    those whose interval spans enough documents."""
    ahead = heads.withColumnRenamed("rank", "head").withColumn("at", F.col("pos") + step)
    pairs = ahead.join(tails.select("source", "doc_id", F.col("pos").alias("at"), F.col("rank").alias("then")), ["source", "doc_id", "at"]).drop("at")
    kept = materialize(_ranked(_spread(pairs, need), ["head", "then"]), "p1-intervals")
    return kept, join_hot(pairs, kept.drop("docs"), ["source", "head", "then"], salt_from=["doc_id", "pos"]).drop("head", "then")


def _lengthened(blocks: DataFrame, rounds: list[DataFrame], k: int, need: DataFrame) -> DataFrame:
    """blocks, those made longer by 2^k lines whose longer prefix still spans enough documents. Depth belongs to the rank."""
    deep = blocks.withColumn("rank", F.struct("depth", "rank"))
    ahead = deep.withColumnRenamed("rank", "head").withColumn("at", F.col("pos") + F.col("depth"))
    pairs = ahead.join(rounds[k].select("source", "doc_id", F.col("pos").alias("at"), F.col("rank").alias("then")), ["source", "doc_id", "at"]).drop("at")
    kept = materialize(_ranked(_spread(pairs, need), ["head", "then"]), "p1-intervals")
    longer = join_hot(pairs, kept.drop("docs"), ["source", "head", "then"], salt_from=["doc_id", "pos"]).select("source", "doc_id", "pos", "rank", (F.col("depth") + (1 << k)).alias("depth"))
    rest = blocks.join(longer.select("source", "doc_id", "pos"), ["source", "doc_id", "pos"], "left_anti")
    return longer.unionByName(rest.select(*longer.columns))


def block_counts(blocks: DataFrame) -> DataFrame:
    """(source, depth, blocks, places, docs): how many longest blocks of each length a source has, at how many places, in how
    many documents."""
    by = blocks.groupBy("source", "depth", "rank", "doc_id").agg(F.count("*").alias("n"))
    counts = by.groupBy("source", "depth", "rank").agg(F.sum("n").alias("n")).groupBy("source", "depth").agg(F.count("*").alias("blocks"), F.sum("n").alias("places"))
    docs = by.select("source", "depth", "doc_id").distinct().groupBy("source", "depth").agg(F.count("*").alias("docs"))
    return counts.join(docs, ["source", "depth"])


def without_repeats(elements: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Every element with its repeated lines taken out of text (null stays null). Other columns pass unchanged; rows stay
    even if no text is left, so that ids remain stable."""
    gone = occurrences.groupBy("doc_id", "page", "idx").agg(F.collect_set("line_no").alias("_gone"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("_gone", i), F.lit(False))), "\n")
    return elements.join(gone, ["doc_id", "page", "idx"], "left").withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)).drop("_gone")
