"""Problem 2: sentence alignment in documents that translate each other.

Concepts are pairs of passages, one in each document of a paired-document row, that anchor each other. A term's vector has
the concepts it occurs in; the similarity of two terms of different languages is the cosine of their vectors. A sentence is
represented by the similarities of its terms: one of the first document has a vector over the terms of the other language,
one of the second over its own terms, and the likeness of two sentences is the cosine of these sparse vectors, a join and a
sum in SQL. Round 0 knows no concept: names, numbers and words that both languages write alike anchor the first passages.
Each round makes the mutual best pairs the concepts of the next. At the end mutual best spans are selected: a sentence also
takes further counterparts while the window of all of them together is nearer to it than the window without.

Blocks of at most BLOCK sentences of the first document, with the second document's sentences, are the unit of work: joins and
sums of a round keep the partitioning by block, so that only the terms are shuffled, and a long pair is many blocks. Pairs
of terms that can't reach the least cosine, by their numbers of concepts, are left out before the shuffle; no others are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.session import discard, is_small, join_hot, materialize, settings

#: Least cosine of the concept vectors of translations.
LEAST_COSINE = 0.12
#: Least cosine of sentences that anchor concepts, in round 0 and later; of an accepted pair; of a further counterpart of a merged sentence.
FIRST_SIM, ANCHOR_SIM, LEAST_SIM, GUEST_SIM = 0.05, 0.2, 0.27, 0.15
#: Rounds of concepts; times by which an anchor must be better than the next; share of its cosine that a window must keep when it grows.
ROUNDS, CLEAR, GAIN = 3, 1.1, 0.99
#: Sentences of the first document in a block.
BLOCK = 2_000
PLACE = ["pair", "block"]


def sentences(elements: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, doc_a, doc_b, side, lang, direction, page, idx, sent, sid, pos, blocks_a, blocks_b, text): sentences of both documents
    of each pair; sid numbers the sentences of a document, pos is the relative place, blocks_a and blocks_b count the parts of
    BLOCK sentences of its documents. Keys are numbers, as they are shuffled often. Null and blank sentences keep their number but give no row, elements without page none."""
    p = pairs.dropna(subset=["doc_a", "doc_b"]).dropDuplicates(["doc_a", "doc_b"]).select("doc_a", "doc_b", *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang_a", "lang_b")])
    p = materialize(p.withColumn("pair", F.monotonically_increasing_id()), "p2-pairs")
    # pairs of languages are few, whatever the size of the collection
    ways = materialize(p.select("lang_a", "lang_b").distinct().coalesce(1).withColumn("direction", F.monotonically_increasing_id().cast("int")), "p2-directions")
    p = p.join(F.broadcast(ways), ["lang_a", "lang_b"])
    side = lambda s: p.select("pair", "doc_a", "doc_b", "direction", F.lit(s).alias("side"), F.col(f"lang_{s}").alias("lang"), F.col(f"doc_{s}").alias("doc_id"))
    both = side("a").unionByName(side("b"))
    rows = elements.filter((F.size("sentences") > 0) & F.col("page").isNotNull()).select("doc_id", "page", "idx", "sentences")
    mine = join_hot(rows, both, ["doc_id"], salt_from=["page", "idx"]).dropDuplicates(["pair", "side", "page", "idx"]).drop("doc_id")
    out = mine.select(*[c for c in mine.columns if c != "sentences"], F.posexplode("sentences").alias("sent", "text")).filter(F.trim("text") != "")
    # numbers run over pages first, so that a long document is no single window
    side_order = Window.partitionBy("pair", "side")
    before = F.sum("n").over(side_order.orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    offsets = out.groupBy("pair", "side", "page").agg(F.count("*").alias("n")).withColumns({"before": F.coalesce(before, F.lit(0)), "all": F.sum("n").over(side_order)}).drop("n")
    count = lambda s: F.coalesce(F.ceil(F.max(F.when(F.col("side") == s, F.col("all"))) / BLOCK).cast("int"), F.lit(1)).alias(f"blocks_{s}")
    offsets = materialize(offsets.join(offsets.groupBy("pair").agg(count("a"), count("b")), "pair"), "p2-offsets")
    on_page = out.withColumn("nth", F.row_number().over(Window.partitionBy("pair", "side", "page").orderBy("idx", "sent")))
    numbered = on_page.join(offsets, ["pair", "side", "page"]).withColumn("sid", (F.col("before") + F.col("nth")).cast("int"))
    return numbered.withColumn("pos", (F.col("sid") / F.col("all")).cast("float")).drop("before", "all", "nth")


def terms(sents: DataFrame) -> DataFrame:
    """Distinct terms of each sentence: words and numbers, and pairs of neighbouring signs of scripts without spaces."""
    low = F.lower("text")
    words = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]][\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]]*"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]+"), F.lit(0))
    grams = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))
    return sents.withColumn("term", F.explode(F.array_distinct(F.concat(words, grams)))).drop("text")


def _weighted(t: DataFrame, sents: DataFrame) -> DataFrame:
    """Terms by number, with weight idf over the sentences of their language."""
    n = sents.groupBy("lang").agg(F.count("*").alias("n"))
    df = t.groupBy("term", "lang").agg(F.count("*").alias("df")).join(F.broadcast(n), "lang")  # a row for each language
    listed = df.groupBy("term").agg(F.collect_list(F.struct("lang", F.log((F.col("n") + 1) / F.col("df")).cast("float").alias("w"))).alias("by"))
    vocabulary = materialize(listed.select("term", F.monotonically_increasing_id().alias("id"), "by"), "p2-vocabulary").select("term", "id", F.explode("by").alias("x"))
    weights = vocabulary.select("term", "id", "x.lang", "x.w")
    return join_hot(t, weights, ["lang", "term"], salt_from=["pair", "sid"]).drop("term", "lang").withColumnRenamed("id", "term")


def _blocks(w: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms of sentences by block; a block is a part of a with a part of b, so that each part stands in one block unless its
    pair is long."""
    part = F.floor((F.col("sid") - 1) / BLOCK).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cols = ["sid", "term", "w", "pos", "direction"]
    a = w.filter("side = 'a'").select("pair", "blocks_b", part.alias("i"), upto("blocks_b").alias("j"), *cols)
    b = w.filter("side = 'b'").select("pair", "blocks_b", upto("blocks_a").alias("i"), part.alias("j"), *cols)
    block = (F.col("i").cast("long") * F.col("blocks_b") + F.col("j")).alias("block")
    return a.select("pair", block, *cols), b.select("pair", block, *cols)


def _by_block(t: DataFrame) -> DataFrame:
    """t partitioned by block; terms are few bytes for the rows they give, so that tasks are small."""
    return t.repartition(4 * int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PLACE)


def _normed(v: DataFrame) -> DataFrame:
    return v.withColumn("norm", F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(*PLACE, "sid"))))


def _vectors(a: DataFrame, b: DataFrame, lexicon: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(pair, block, sid, term, pos, v, norm) of both sides, partitioned by block: sentences of a over the terms of the other
    language, a term written alike counting whole, and those of b over their own. The lexicon, one row for each term, is
    broadcast if it is small when counted; a larger one is joined before its lists are unfolded."""
    if lexicon is None:
        told = _by_block(a).withColumn("to", F.array().cast(_TO))
    elif _held(lexicon):
        told = _by_block(a).join(F.broadcast(lexicon), ["direction", "term"], "left")
    else:
        told = _by_block(join_hot(a, lexicon, ["direction", "term"], "left", salt_from=["pair", "sid"]))
    own = F.array(F.struct(F.col("term").alias("as_term"), F.lit(1.0).alias("alike")))
    far = told.select(*PLACE, "sid", "pos", "w", F.explode(F.concat(own, F.coalesce("to", F.array().cast(_TO)))).alias("x"))
    value = F.sum(F.col("w") * F.col("x.alike") * F.col("x.alike"))
    left = far.groupBy(*PLACE, "sid", F.col("x.as_term").alias("term")).agg(F.first("pos").alias("pos"), value.alias("v"))
    right = _by_block(b).select(*PLACE, "sid", "term", "pos", F.col("w").cast("double").alias("v"))
    return _normed(left), _normed(right)


_TO = "array<struct<as_term:bigint,alike:double>>"
#: Bytes of a lexicon that is broadcast at most.
LEXICON_BYTES = 32 << 20


def _held(lexicon: DataFrame) -> bool:
    n, k = lexicon.agg(F.count("*"), F.sum(F.size("to"))).first()
    return 64 * n + 24 * (k or 0) <= LEXICON_BYTES


def _cells(x: DataFrame, y: DataFrame) -> DataFrame:
    """(pair, block, sid_a, sid_b, dot, norm_a, norm_b, sim, far): all sentence pairs of a block that share a term, with the cosine."""
    side = lambda df, s: df.select(*PLACE, "term", *[F.col(c).alias(f"{c}_{s}") for c in ("sid", "pos", "v", "norm")])
    hits = side(x, "a").join(side(y, "b").hint("shuffle_hash"), [*PLACE, "term"])  # what is held is a part of a document
    sums = hits.groupBy(*PLACE, "sid_a", "sid_b").agg(F.sum(F.col("v_a") * F.col("v_b")).alias("dot"), *[F.first(c).alias(c) for c in ("norm_a", "norm_b", "pos_a", "pos_b")])
    sim = F.col("dot") / F.greatest(F.col("norm_a") * F.col("norm_b"), F.lit(1e-12))
    return sums.select(*PLACE, "sid_a", "sid_b", "dot", "norm_a", "norm_b", sim.alias("sim"), F.abs(F.col("pos_a") - F.col("pos_b")).alias("far"))


def _ranked(cells: DataFrame, least: float = 2.0) -> DataFrame:
    """Ranks of each pair among those of its a and of its b, with the rate of the next one; nearer places win ties and outweigh
    small differences. Returned are the pairs that are among the first two of their a or b, and those with a cosine of
    `least`. Ranks within a block come first, so that only these pairs are shuffled to be ranked over all blocks."""
    s = cells.withColumn("rate", F.col("sim") - 0.1 * F.col("far"))
    by = lambda keys, other: Window.partitionBy(*keys).orderBy(F.col("rate").desc(), "far", other)
    s = s.withColumns({"j": F.row_number().over(by([*PLACE, "sid_a"], "sid_b"))}).withColumn("k", F.row_number().over(by([*PLACE, "sid_b"], "sid_a")))
    s = s.filter((F.col("j") <= 2) | (F.col("k") <= 2) | (F.col("sim") >= least)).drop("j", "k")
    for one, other in (("a", "b"), ("b", "a")):
        w = by(["pair", f"sid_{one}"], f"sid_{other}")
        s = s.withColumns({f"rank_{one}": F.row_number().over(w), f"next_{one}": F.coalesce(F.lead("rate").over(w), F.lit(0.0))})
    return s


def _listed(t: DataFrame) -> DataFrame:
    """(pair, block, sid, direction, terms): the terms of each sentence of a side in one row."""
    return t.groupBy(*PLACE, "sid", "direction").agg(F.collect_list("term").alias("terms"))


def _lexicon(concepts: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(direction, term, to): for each term all its translations (as_term, alike), alike being the cosine of the concept vectors,
    relative to the term's best; a and b are the sentences of both sides as _listed gives them. Terms of one concept only
    have no vector to speak of; what their numbers of concepts rule out is left out before it is shuffled, if these numbers
    are few enough to be broadcast."""
    side = lambda t, s: t.select(*PLACE, F.col("sid").alias(f"sid_{s}"), *(["direction"] if s == "a" else []), F.col("terms").alias(f"t{s}"))
    both = concepts.join(side(a, "a"), [*PLACE, "sid_a"]).join(side(b, "b"), [*PLACE, "sid_b"])
    both = materialize(both.select("direction", "ta", "tb"), "p2-vectors")  # one row per concept
    often = {s: materialize(both.select("direction", F.explode(f"t{s}").alias(f"t{s}")).groupBy("direction", f"t{s}").agg(F.count("*").cast("int").alias(f"n{s}")).filter(f"n{s} >= 2"), "p2-often") for s in "ab"}
    few = is_small(often["a"]) and is_small(often["b"])
    with_n = lambda df, s: df.join(F.broadcast(often[s]) if few else often[s], ["direction", f"t{s}"])
    cosine = lambda n: (n - 0.7) / F.sqrt(F.col("na").cast("double") * F.col("nb"))
    met = both.select("direction", F.explode("ta").alias("ta"), "tb")
    met = (with_n(met, "a") if few else met).select("direction", "ta", *(["na"] if few else []), F.explode("tb").alias("tb")).filter("ta <> tb")
    if few:
        met = with_n(met, "b").filter(cosine(F.least("na", "nb")) >= LEAST_COSINE)
    together = met.groupBy("direction", "ta", "tb").agg(F.count("*").alias("n")).filter("n >= 2")
    scored = with_n(with_n(together, "a"), "b").withColumn("alike", cosine(F.col("n"))).filter(F.col("alike") >= LEAST_COSINE)
    to = F.collect_list(F.struct(F.col("tb").alias("as_term"), "alike")).alias("to")
    found = scored.groupBy("direction", F.col("ta").alias("term")).agg(F.max("alike").alias("top"), to)
    relative = F.transform("to", lambda x: F.struct(x.as_term.alias("as_term"), F.least(F.lit(1.0), x.alike / F.greatest("top", F.lit(0.5))).alias("alike")))
    return found.select("direction", "term", relative.alias("to"))


def aligned_sentences(elements: DataFrame, pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_a, page_a, idx_a, sent_a, doc_b, page_b, idx_b, sent_b, sim): pairs of sentences that render each other.

    A pair is given if each is the other's best, or if one is the best of the other, which has no partner of its own, and
    brings the window of the other's counterparts nearer (a merged sentence). A sentence without counterpart gives none.
    Pairs of documents that have no sentences give none; repeated rows of either table count once; equal sentences are told
    apart by their places."""
    s = materialize(sentences(elements, pairs), "p2-sentences")
    w = materialize(_weighted(terms(s.select("pair", "side", "lang", "direction", "sid", "pos", "blocks_a", "blocks_b", "text")), s), "p2-terms")
    a, b = _blocks(w)
    # both sides of a join that are partitioned by block already stay as they are
    with settings(s.sparkSession, spark_sql_requireAllClusterKeysForCoPartition="false"):
        lexicon = _learned(a, b, rounds)
        cells = materialize(_ranked(_cells(*_vectors(a, b, lexicon)), GUEST_SIM), "p2-cells")
    best = cells.filter((F.col("rank_a") == 1) & (F.col("rank_b") == 1) & (F.col("sim") >= LEAST_SIM))
    spans = _spans(cells, best, lambda asked: _vectors(*(t.join(asked.filter(F.col("side") == s).drop("side"), [*PLACE, "sid"], "left_semi") for t, s in ((a, "a"), (b, "b"))), lexicon))
    return _with_places(best.select("pair", "sid_a", "sid_b", "sim").unionByName(spans).dropDuplicates(["pair", "sid_a", "sid_b"]), s)


def _learned(a: DataFrame, b: DataFrame, rounds: int) -> DataFrame | None:
    """The lexicon after some rounds, each from the mutual best pairs that the one before gives."""
    lexicon = None
    of_a, of_b = materialize(_listed(a), "p2-listed"), materialize(_listed(b), "p2-listed")
    for r in range(rounds):
        ranked = _ranked(_cells(*_vectors(a, b, lexicon)))
        clear = (F.col("rate") > CLEAR * F.col("next_a")) & (F.col("rate") > CLEAR * F.col("next_b"))
        mutual = ranked.filter((F.col("rank_a") == 1) & (F.col("rank_b") == 1) & clear & (F.col("sim") >= (ANCHOR_SIM if r else FIRST_SIM)))
        concepts = materialize(mutual.select(*PLACE, "sid_a", "sid_b"), "p2-concepts")
        last, lexicon = lexicon, materialize(_lexicon(concepts, of_a, of_b), "p2-lexicon")
        discard(concepts, *([last] if last is not None else []))
    return lexicon


def _spans(cells: DataFrame, best: DataFrame, vectors_of: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(pair, sid_a, sid_b, sim): further counterparts of merged sentences, the hosts. A sentence without partner, a guest, joins the
    window whose cosine to its host grows most by it; of several the best goes first, and the others are tried again with
    the larger window. A window has each term once, as the merged sentence would. Both sides can be hosts; vectors_of gives
    the vectors of both sides of sentences (pair, block, side, sid)."""
    def of(df: DataFrame, one: str, many: str) -> DataFrame:
        return df.select(*PLACE, F.lit(one).alias("side"), F.col(f"sid_{one}").alias("host"), F.col(f"sid_{many}").alias("guest"), "dot", F.col(f"norm_{many}").alias("norm"), "sim")

    def free(one: str, many: str) -> DataFrame:
        lonely = cells.filter(F.col("sim") >= GUEST_SIM).join(best.select("pair", f"sid_{many}"), ["pair", f"sid_{many}"], "left_anti")
        return of(lonely.join(best.select("pair", f"sid_{one}"), ["pair", f"sid_{one}"], "left_semi"), one, many)

    key = ["pair", "side", "host"]
    sides = (("a", "b"), ("b", "a"))
    left = materialize(free(*sides[0]).unionByName(free(*sides[1])), "p2-guests")
    members = materialize(of(best, *sides[0]).unionByName(of(best, *sides[1])).join(left.select(*key).distinct(), key, "left_semi"), "p2-hosts")
    other = F.when(F.col("side") == "a", "b").otherwise("a")
    rows = left.select(*PLACE, "side", "host", "guest").unionByName(members.select(*PLACE, "side", "host", "guest"))
    asked = rows.select(*PLACE, "side", F.col("host").alias("sid")).unionByName(rows.select(*PLACE, other.alias("side"), F.col("guest").alias("sid"))).distinct()
    x, y = vectors_of(materialize(asked, "p2-asked"))
    every = x.withColumn("side", F.lit("a")).unionByName(y.withColumn("side", F.lit("b"))).select("pair", "side", "sid", "term", "v")
    every = materialize(every.dropDuplicates(["pair", "side", "sid", "term"]), "p2-windows")  # a sentence of a long pair stands in several blocks
    vectors = every.select("pair", other.alias("side"), F.col("sid").alias("guest"), "term", "v")
    own = every.select("pair", "side", F.col("sid").alias("host"), "term", F.col("v").alias("x"))
    guest = ["pair", "side", "guest"]
    state = members.select(*key, F.col("dot").alias("had"), (F.col("norm") * F.col("norm")).alias("square"))
    window = members.select(*key, "guest").join(vectors, guest).select(*key, "term", F.col("v").alias("u"))
    found = best.filter("false").select("pair", "sid_a", "sid_b", "sim")
    while True:
        met = left.select(*key, "guest").join(vectors, guest).join(window, [*key, "term"], "left").join(own, [*key, "term"], "left").fillna(0.0, ["u", "x"])
        more = F.greatest(F.col("v") - F.col("u"), F.lit(0.0))
        grown = met.groupBy(*key, "guest").agg(F.sum(more * F.col("x")).alias("more"), F.sum(more * (more + 2 * F.col("u"))).alias("wider"))
        tried = left.join(state, key).join(grown, [*key, "guest"])
        near = lambda dot, square: F.col(dot) / F.sqrt(square)
        tried = tried.withColumns({"had_new": F.col("had") + F.col("more"), "square_new": F.col("square") + F.col("wider")}).withColumn("gain", near("had_new", "square_new") / near("had", "square"))
        mine, ours = Window.partitionBy(*guest).orderBy(F.col("gain").desc(), "host"), Window.partitionBy(*key).orderBy("nth", F.col("gain").desc(), "guest")
        tried = tried.filter(F.col("gain") > GAIN).withColumn("nth", F.row_number().over(mine)).withColumn("k", F.row_number().over(ours))
        tried = materialize(tried, "p2-gains")
        taken = tried.filter("nth = 1 and k = 1")
        pick = lambda s: F.when(F.col("side") == s, F.col("host")).otherwise(F.col("guest")).alias(f"sid_{s}")
        found = found.unionByName(taken.select("pair", pick("a"), pick("b"), "sim"))
        left = materialize(tried.select(*left.columns).join(taken.select(*guest), guest, "left_anti").join(taken.select(*key), key, "left_semi"), "p2-guests")
        if left.isEmpty():
            return found
        state = taken.select(*key, F.col("had_new").alias("had"), F.col("square_new").alias("square"))
        added = taken.select(*key, "guest").join(vectors, guest).select(*key, "term", F.col("v").alias("u"))
        window = materialize(window.join(taken.select(*key), key, "left_semi").unionByName(added).groupBy(*key, "term").agg(F.max("u").alias("u")), "p2-windows")


def _with_places(found: DataFrame, s: DataFrame) -> DataFrame:
    place = lambda side: s.filter(F.col("side") == side).select("pair", F.col("sid").alias(f"sid_{side}"), *([F.col("doc_a"), F.col("doc_b")] if side == "a" else []), *[F.col(c).alias(f"{c}_{side}") for c in ("page", "idx", "sent")])
    return found.join(place("a"), ["pair", "sid_a"]).join(place("b"), ["pair", "sid_b"]).select("doc_a", "page_a", "idx_a", "sent_a", "doc_b", "page_b", "idx_b", "sent_b", F.round("sim", 4).alias("sim"))
