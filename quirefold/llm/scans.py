"""Problem 6: noise in text from scanned pages.

A frequency lexicon is counted over the whole collection, apart for scanned and other documents. A symmetric-delete index
over it proposes corrections: words that become equal after at most two deletions on either side meet in a join. A weighted
edit distance, in which signs that scanners confuse cost little and all else costs 1, keeps those that misreading explains;
a word is taken for misread if a far more frequent word is that near and the word is hardly seen in documents that were
not scanned. If several words explain it, the neighbours in the line decide by bigram counts.

Running heads are lines at a page's head or foot, and first or last lines of its text that say the same, misreadings
allowed. Words cut at a line's end are rejoined unless the lexicon knows them with the hyphen.

Two passes over the text: one counts, one emits only heads, feet, cut words and words that aren't known to be good. What a
task holds is bounded, the KNOWN most frequent good words; whether other words are good, whether a hyphen belongs to its
word, and what stands between neighbours is decided by joins with the lexicon and the bigrams, for all of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.session import join_hot, materialize, most_frequent, small

KEY = ["doc_id", "page", "idx"]
PAGE_SIZED, HEAD, FOOT = 0.8, 0.1, 0.9
#: Pages within which a running head comes again.
REACH = 8
#: Words known to be good that a task holds, and words whose bigrams are asked for; beyond that they are joined.
KNOWN = 100_000
#: Least count of a word that corrects others; times it must be as frequent; largest weighted distance.
LEAST_COUNT, RATIO, LARGEST = 5, 8, 0.65
#: Largest share of a misread word's occurrences, by rate, outside scanned documents.
CLEAN_RATE = 0.1

# Signs and pairs of signs that scanners take for each other.
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("2", "z"), ("4", "a"), ("rn", "m"), ("nn", "m"), ("in", "m"), ("ri", "n"), ("ii", "u"), ("li", "h"), ("cl", "d"), ("vv", "w"),
    ("c", "e"), ("l", "i"), ("f", "t"), ("h", "b"), ("u", "v"), ("q", "g"), ("o", "e"), ("c", "o"), ("j", "i"), ("1", "t"), ("lc", "k"), ("tl", "d"), ("ll", "u"), ("hn", "lin"), ("fi", "h"), ("é", "e"), ("è", "e"),
]
# The letter that a digit most often stands for.
DIGITS = {"0": "o", "1": "l", "5": "s", "6": "b", "8": "b", "9": "g"}
CONFUSED = {(a, b) for x, y in CONFUSIONS for a, b in ((x, y), (y, x))}
CONFUSION_COST = 0.3

_WORD = re.compile(r"[^\W_]+")
_COMPOUND = re.compile(r"[^\W\d_]+-[^\W\d_]+")
_HYPHEN = "[-\u00ad\u2010\u2011]"
_CUT = re.compile(rf"([^\W\d_]+){_HYPHEN}[ \t]*\n[ \t]*([^\W\d_]+)")
_CUT_END = re.compile(rf"([^\W\d_]+){_HYPHEN}\s*$")
_HYPHENS = re.compile(_HYPHEN)
_JOIN = re.compile(rf"(?<=\w){_HYPHEN}[ \t]*\n[ \t]*(?=\w)")
_DECORATION = r"[\s|*•·.,:;_~=\-–—§\[\](){}<>]*"
_NUMBER = r"(?:[0-9OoQDIl|!SsBbZzgq]{1,4}(?: [0-9OoIl|SsBZ]{1,3}){0,2}|[ivxlcdmIVXLCDM1]{1,9})"
PAGE_NUMBER = re.compile(rf"^{_DECORATION}(?:(?:[Pp][aAo4e][gGq9][eEco]|[Pp][gp]?|[Ss](?:eite)?|[Pp][aá]g(?:ina)?)\.?\s*)?{_NUMBER}(?:\s*(?:[oO0c][fFt]|/|von|de|sur)\s*{_NUMBER})?{_DECORATION}$")
#: A page number beside a running head, two blanks apart.
_BESIDE = re.compile(rf"^\s*{_NUMBER}\s{{2,}}|\s{{2,}}{_NUMBER}\s*$")


def weighted_distance(a: str, b: str, limit: float = 2.0) -> float:
    """Edit distance in which confused signs and pairs of signs cost CONFUSION_COST and all other edits 1."""
    n, m = len(a), len(b)
    if abs(n - m) > 4:
        return limit + 1
    d = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == j == 0:
                continue
            best = 99.0
            if i and j:
                best = d[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else 1)
            if i:
                best = min(best, d[i - 1][j] + 1)
            if j:
                best = min(best, d[i][j - 1] + 1)
            for x in (1, 2):
                for y in (1, 2, 3):
                    if i >= x and j >= y and (a[i - x : i], b[j - y : j]) in CONFUSED:
                        best = min(best, d[i - x][j - y] + CONFUSION_COST)
            d[i][j] = best
    return d[n][m]


def deletes(word: str) -> set[str]:
    """The word with up to two signs deleted, one if it is short."""
    out = {word}
    for k in (1, 2) if len(word) > 3 else (1,):
        out.update("".join(c for i, c in enumerate(word) if i not in at) for at in combinations(range(len(word)), k))
    return out


def scanned_documents(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, doc_height): documents with an image element of page size. Pages of unknown size take their document's largest."""
    geo = pages.filter("width > 0 and height > 0").groupBy("doc_id", "page").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    of_doc = geo.groupBy("doc_id").agg(F.max("width").alias("doc_width"), F.max("height").alias("doc_height"))
    images = elements.filter("kind = 'image'").select("doc_id", "page", ((F.col("bbox.x1") - F.col("bbox.x0")) * (F.col("bbox.y1") - F.col("bbox.y0"))).alias("area")).filter("area > 0")
    sized = images.join(geo, ["doc_id", "page"], "left").join(of_doc, "doc_id", "left")
    whole = F.coalesce(F.col("width") * F.col("height"), F.col("doc_width") * F.col("doc_height"))
    return sized.filter(F.col("area") >= F.lit(PAGE_SIZED) * whole).groupBy("doc_id").agg(F.max("doc_height").alias("doc_height"))


def _joined(text: str) -> str:
    return _JOIN.sub("", text)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, scan = b.column("text").to_pylist(), b.column("scanned").to_pylist()
        out: dict[str, list[int]] = {}
        for flag in (0, 1):
            whole = "\n\n".join(_joined(t) for t, s in zip(texts, scan) if bool(s) == bool(flag)).lower()
            counts = Counter(_WORD.findall(whole))
            counts.update(_COMPOUND.findall(whole))
            for w, n in counts.items():
                if not w.isdigit():
                    out.setdefault(w, [0, 0])[flag] = n
        yield pa.RecordBatch.from_pydict({"word": list(out), "clean": [v[0] for v in out.values()], "scan": [v[1] for v in out.values()]}, schema=pa.schema([("word", pa.string()), ("clean", pa.int64()), ("scan", pa.int64())]))


def lexicon(texts: DataFrame) -> DataFrame:
    """(word, clean, scan): counts of all words and hyphenated words, in documents that are not scanned and that are."""
    return texts.select("text", "scanned").mapInArrow(_count_words, "word string, clean bigint, scan bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("scan").alias("scan"))


def _emit_deletes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(k, w, n) for w, n in zip(f.word, f.n) for k in deletes(w)]
        yield pd.DataFrame(rows, columns=["key", "word", "n"])


def _weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        f["cost"] = [weighted_distance(a, b) for a, b in zip(f.bad, f.good)]
        yield f[f.cost <= LARGEST]


def corrections(words: DataFrame) -> DataFrame:
    """(bad, good, n_bad, n_good, cost): words that are misreadings of far more frequent ones.

    Words of digits with letters need a word RATIO / 2 times as frequent, words of letters RATIO times, or four times
    that if two confusions are needed or the word has at most four letters. A word has 2 to 40 signs; longer runs are none. A single digit among four letters or more needs
    none. Words that stand in documents that were not
    scanned at nearly the rate of the scanned ones, and Roman numerals, are no misreadings."""
    sums = words.groupBy().agg(F.sum("clean").alias("a"), F.sum("scan").alias("b")).first()
    odds = (sums[0] or 1) / (sums[1] or 1)
    plain = words.filter(F.col("word").rlike(r"^[\p{L}\p{N}]{2,40}$")).withColumn("n", F.col("clean") + F.col("scan"))
    index = plain.filter((F.col("n") >= LEAST_COUNT) & F.col("word").rlike(r"^\p{L}+$") & ~F.col("word").rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"))
    asked = plain.filter(~F.col("word").rlike("^[ivxlcdm]+$") & (F.col("scan") > 0) & (F.col("clean") <= F.lit(CLEAN_RATE * odds) * F.col("scan")) & ~F.col("word").rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"))
    schema = "key string, word string, n bigint"
    good = index.select("word", "n").mapInPandas(_emit_deletes, schema).select("key", F.col("word").alias("good"), F.col("n").alias("n_good"))
    bad = asked.select("word", "n").mapInPandas(_emit_deletes, schema).select("key", F.col("word").alias("bad"), F.col("n").alias("n_bad"))
    near = bad.join(good, "key").filter((F.col("n_good") >= F.lit(RATIO / 2) * F.col("n_bad")) & (F.col("bad") != F.col("good"))).select("bad", "good", "n_bad", "n_good").distinct()
    weighed = near.mapInPandas(_weigh, "bad string, good string, n_bad bigint, n_good bigint, cost double")
    factor = F.when(F.col("bad").rlike(r"\d"), RATIO / 2).when((F.col("cost") > CONFUSION_COST + 0.01) | (F.length("bad") <= 4), 4 * RATIO).otherwise(RATIO)
    found = weighed.filter(F.col("n_good") >= factor * F.col("n_bad"))
    # a digit among letters is misread even where the lexicon doesn't know the word: its usual letter takes the place
    mixed = F.col("word").rlike(r"^(?=\p{L}*\d\p{L}*\d?\p{L}*$)(?=(.*\p{L}){4})") & ~F.col("word").rlike(r"\d\d")
    rest = asked.filter(mixed).select(F.col("word").alias("bad"), F.col("n").alias("n_bad")).join(found.select("bad").distinct(), "bad", "left_anti")
    guess = F.translate("bad", "".join(DIGITS), "".join(DIGITS.values()))
    guessed = rest.filter(~guess.rlike(r"\d")).select("bad", guess.alias("good"), "n_bad", F.lit(0).cast("bigint").alias("n_good"), F.lit(CONFUSION_COST).alias("cost"))
    return found.unionByName(guessed)


SCHEMA = "doc_id bigint, page int, idx int, what string, word string, other string, place double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("idx", pa.int32()), ("what", pa.string()), ("word", pa.string()), ("other", pa.string()), ("place", pa.float64())])


def _traces(known: set):
    """Per element: `line`, a line that may be a running head (place: relative y, other: whole, first or last); `hyphen`, a word
    with a hyphen at a line's end (word, other: its parts); `open`, one at the end; `first`, the first word; `odd`, a word
    not known to be good (other: its neighbours)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            cols = [b.column(c).to_pylist() for c in ("doc_id", "page", "idx", "text", "y0", "y1", "h")]
            for d, p, i, text, y0, y1, h in zip(*cols):
                h = h or 792.0
                top, bottom = (y0 if y0 is not None else h / 2) / h, (y1 if y1 is not None else h / 2) / h
                lines = [x for x in text.split("\n") if x.strip()]
                if not lines:
                    continue
                alone = len(lines) == 1
                if alone and (bottom < 2 * HEAD or top > 1 - 2 * (1 - FOOT)):
                    rows.append((d, p, i, "line", lines[0], "whole", bottom if bottom < 0.5 else top))
                    if PAGE_NUMBER.match(lines[0]):
                        continue
                elif not alone:
                    if top < 0.3:
                        rows.append((d, p, i, "line", lines[0], "first", top))
                    if bottom > 0.7:
                        rows.append((d, p, i, "line", lines[-1], "last", bottom))
                if _HYPHENS.search(text):
                    rows += [(d, p, i, "hyphen", a, b, None) for a, b in {(m[1].lower(), m[2].lower()) for m in _CUT.finditer(text)}]
                    m = _CUT_END.search(text)
                    if m:
                        rows.append((d, p, i, "open", m.group(1).lower(), None, None))
                body = _joined(text)
                if _HYPHENS.match(body.rstrip()[-1:]):
                    body = _CUT_END.sub("", body)
                low = _WORD.findall(body.lower())
                torn = bool(low) and text.lstrip()[:1].islower()  # may be the rest of a word cut in the element before
                if low:
                    rows.append((d, p, i, "first", low[0], "short" if alone and len(text) < 12 else None, top))
                for k, w in enumerate(low):
                    if w not in known and not w.isdigit() and len(w) > 1:
                        rows.append((d, p, i, "odd", w, f"{low[k - 1] if k else '^' if torn else ''} {low[k + 1] if k + 1 < len(low) else ''}", None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows) if rows else [[]] * 7, _ARROW)], schema=_ARROW)

    return run


def _letters(col: str) -> F.Column:
    return F.lower(F.regexp_replace(F.regexp_replace(col, _BESIDE.pattern, " "), r"[^\p{L}\p{N}]+", ""))


def headers(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Elements that are, or whose first or last line is, a running head or foot; and page numbers: (key, noise, where),
    where being whole, first or last.

    A line alone at the head or foot that is no page number is a head. A first or last line of a longer element is one if
    it stands first or last on its page and says what a head of the same document says, or what the first or last line of
    another page within REACH pages says; a tenth of its letters may be misread. A line alone away from head and foot, as the title of the first page, is none."""
    geo = pages.filter("height > 0").groupBy("doc_id", "page").agg(F.max("height").alias("height"))
    lines = lines.join(geo, ["doc_id", "page"], "left").withColumn("at", F.col("place") * F.coalesce(F.col("h") / F.col("height"), F.lit(1.0)))
    alone = lines.filter("other = 'whole'").filter((F.col("at") < HEAD) | (F.col("at") > FOOT))
    number = F.col("word").rlike(PAGE_NUMBER.pattern)
    nums = alone.filter(number).select(*KEY, F.lit("pagenum").alias("noise"), F.lit("whole").alias("where"))
    heads = alone.filter(~number & (F.length(_letters("word")) >= 3)).withColumn("letters", _letters("word"))
    inner = lines.filter("other <> 'whole'")
    edge = inner.groupBy("doc_id", "page").agg(F.min(F.when(F.col("other") == "first", F.col("place"))).alias("top"), F.max(F.when(F.col("other") == "last", F.col("place"))).alias("bottom"))
    inner = inner.join(edge, ["doc_id", "page"]).filter(F.col("place") == F.when(F.col("other") == "first", F.col("top")).otherwise(F.col("bottom")))
    inner = materialize(inner.withColumn("letters", _letters("word")).filter(F.length("letters") >= 6).select(*KEY, "word", "letters", "other"), "p6-inner")
    numbered = inner.filter(F.col("word").rlike(_BESIDE.pattern) & (F.length("letters") <= 60)).select(*KEY, "other")
    # twice within REACH pages: windows of twice that length, overlapping by half
    near_pages = F.explode(F.array(F.concat(F.lit("a"), F.floor(F.col("page") / (2 * REACH))), F.concat(F.lit("b"), F.floor((F.col("page") + REACH) / (2 * REACH)))))
    spread = heads.select("doc_id", "page", "letters").unionByName(inner.select("doc_id", "page", "letters")).distinct().withColumn("window", near_pages)
    sure = spread.groupBy("doc_id", "letters", "window").agg(F.count("*").alias("pages"))
    running = heads.select("doc_id", "letters").unionByName(sure.filter("pages >= 2").select("doc_id", "letters")).distinct()
    running = materialize(running.filter(F.length("letters") >= 6), "p6-running")
    same = inner.join(running, ["doc_id", "letters"], "left_semi").select(*KEY, "other")
    # misread heads share the first or the last letters with one that was read right
    ends = lambda df: df.withColumn("end", F.explode(F.array(F.concat(F.lit("<"), F.substring("letters", 1, 6)), F.concat(F.expr("right(letters, 6)"), F.lit(">")))))
    rest = inner.join(running, ["doc_id", "letters"], "left_anti")
    near = ends(rest.select(*KEY, "other", "letters")).join(ends(running).withColumnRenamed("letters", "known"), ["doc_id", "end"])
    near = near.filter(F.levenshtein("letters", "known") <= F.greatest(F.lit(2), F.floor(F.length("known") * 0.12))).select(*KEY, "other")
    inside = numbered.unionByName(same).unionByName(near).select(*KEY, F.lit("header").alias("noise"), F.col("other").alias("where"))
    return nums.unionByName(heads.select(*KEY, F.lit("header").alias("noise"), F.lit("whole").alias("where"))).unionByName(inside).distinct()


def _hyphens(traces: DataFrame, good: DataFrame) -> DataFrame:
    """(key, word, cut): words with a hyphen at a line's end, and whether it cuts them: the lexicon doesn't know the word with
    the hyphen, or knows it without as well at least."""
    asked = traces.filter("what = 'hyphen'").select(*KEY, F.concat("word", F.lit("-"), "other").alias("word"), F.concat("word", "other").alias("whole"))
    words = asked.select(F.explode(F.array("word", "whole")).alias("word")).distinct()
    known = materialize(words.join(good.filter("n >= 2").select("word", "n"), "word"), "p6-hyphenated")
    own = join_hot(asked, known.withColumnRenamed("n", "own"), ["word"], "left", salt_from=KEY)
    both = join_hot(own, known.withColumnsRenamed({"word": "whole", "n": "joined"}), ["whole"], "left", salt_from=KEY)
    return both.select(*KEY, "word", (F.col("own").isNull() | (F.col("own") <= F.coalesce("joined", F.lit(0)))).alias("cut"))


def _open_cuts(traces: DataFrame, known_pairs: DataFrame) -> DataFrame:
    """Words open at an element's end whose hyphen is not their own: the next element of the text begins with their rest."""
    opened = traces.filter("what = 'open'").select(*KEY, "word")
    firsts = traces.filter("what = 'first' and place > 0").select("doc_id", "page", F.col("idx").alias("next_idx"), F.col("word").alias("rest"))
    here = opened.join(firsts, ["doc_id", "page"]).filter("next_idx > idx").groupBy(*KEY, "word").agg(F.min_by("rest", "next_idx").alias("rest"))
    left = opened.join(here, KEY, "left_anti")
    after = left.join(firsts.withColumn("page", F.col("page") - 1), ["doc_id", "page"]).groupBy(*KEY, "word").agg(F.min_by("rest", "next_idx").alias("rest"))
    own = here.unionByName(after).withColumn("word", F.concat("word", F.lit("-"), "rest")).join(known_pairs, "word", "left_semi")
    return opened.join(own, KEY, "left_anti").select(*KEY)


def after_cuts(traces: DataFrame) -> DataFrame:
    """Elements before which a word was cut: the text element before them, on the page or at the end of the page before, ends with a hyphen."""
    ends = traces.filter("what = 'open'").select(*KEY).distinct().withColumn("cut", F.lit(1))
    bodies = traces.filter("what = 'first' and other is null").select(*KEY).join(ends, KEY, "left")
    order = Window.partitionBy("doc_id", "page").orderBy("idx")
    placed = bodies.withColumn("before", F.lag(F.coalesce("cut", F.lit(0))).over(order))
    last = bodies.groupBy("doc_id", (F.col("page") + 1).alias("page")).agg(F.max_by(F.coalesce("cut", F.lit(0)), "idx").alias("page_before"))
    return placed.join(last, ["doc_id", "page"], "left").filter(F.coalesce("before", "page_before") == 1).select(*KEY)


def scan_traces(elements: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(traces, lexicon, corrections, good words with counts), tables written to the shared folder; see scan_noise."""
    scanned = materialize(scanned_documents(elements, pages), "p6-scanned")
    texts = elements.filter("kind = 'text' and text is not null").select(*KEY, "text", F.col("bbox.y0").alias("y0"), F.col("bbox.y1").alias("y1"))
    flagged = join_hot(texts, scanned.withColumn("scanned", F.lit(1)), ["doc_id"], "left", salt_from=["page", "idx"])
    words = materialize(lexicon(flagged), "p6-lexicon")
    fixes = materialize(corrections(words), "p6-corrections")
    good = materialize(words.join(fixes.select(F.col("bad").alias("word")).distinct(), "word", "left_anti").select("word", (F.col("clean") + F.col("scan")).alias("n")), "p6-good")
    known = {r[0] for r in most_frequent(good.filter("n >= 2 and not word like '%-%'"), "n", KNOWN).select("word").collect()}
    rows = flagged.filter("scanned = 1").select(*KEY, "text", "y0", "y1", F.col("doc_height").alias("h"))
    traces = rows.mapInArrow(_traces(known), SCHEMA)
    traces = join_hot(traces, scanned.select("doc_id", F.col("doc_height").alias("h")), ["doc_id"], "left", salt_from=["page", "idx"])
    return materialize(traces, "p6-traces"), words, fixes, good


def _count_bigrams(near: set | None):
    """Bigrams of a batch with a word of `near`, or all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: Counter = Counter()
            for t in f.text:
                ws = _WORD.findall(_joined(t).lower())
                out.update((a, b) for a, b in zip(ws, ws[1:]) if near is None or a in near or b in near)
            yield pd.DataFrame([(a, b, n) for (a, b), n in out.items()], columns=["left", "right", "n"])

    return run


def chosen_corrections(traces: DataFrame, fixes: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, bad, good): the correction of each misread word in each element. Of several the one that stands best between
    its neighbours by bigram counts, with the smaller distance, the larger count. Of at most KNOWN words in question the
    bigrams are counted apart; of more, those of all words are."""
    odd = _odd_words(traces, fixes.select("bad", "good", "n_good", "cost"), "inner")
    side = lambda i: F.split("other", " ").getItem(i)
    odd = odd.withColumns({"left": side(0), "right": side(1)})
    twice = fixes.groupBy("bad").agg(F.count("*").alias("n")).filter("n > 1")
    asked = [r[0] for r in fixes.join(twice.select("bad"), "bad", "left_semi").select("good").distinct().limit(KNOWN + 1).collect()]  # to decide between the two ways only
    near = set(asked) if len(asked) <= KNOWN else None
    pairs = texts.select("text").mapInPandas(_count_bigrams(near), "left string, right string, n bigint").groupBy("left", "right").agg(F.sum("n").alias("n")) if asked else None
    if pairs is None:
        scored = odd.withColumn("fit", F.lit(0.0))
    else:
        pairs = materialize(pairs, "p6-bigrams")
        before = pairs.select("left", F.col("right").alias("good"), F.col("n").alias("n1"))
        after = pairs.select(F.col("left").alias("good"), "right", F.col("n").alias("n2"))
        seen = join_hot(join_hot(odd, before, ["left", "good"], "left", salt_from=KEY), after, ["good", "right"], "left", salt_from=KEY)
        scored = seen.withColumn("fit", F.log(1 + F.coalesce("n1", F.lit(0))) + F.log(1 + F.coalesce("n2", F.lit(0))))
    best = F.struct((F.col("fit") + 0.5 * F.log(1 + F.col("n_good")) - 6 * F.col("cost")).alias("score"), "good")
    return scored.groupBy(*KEY, "bad").agg(F.max(best).alias("b")).select(*KEY, "bad", "b.good")


def mended(text: str, where: set[str], fixes: dict[str, str], own: set[str]) -> str:
    """A text without its heads and page number, cut words rejoined but those of `own`, misread words corrected in their case, lines joined."""
    if "whole" in where:
        return ""
    lines = [x for x in text.split("\n")]
    said = [i for i, x in enumerate(lines) if x.strip()]
    drop = {said[0]} if "first" in where and said else set()
    drop |= {said[-1]} if "last" in where and said else set()
    out = "\n".join(x for i, x in enumerate(lines) if i not in drop)
    keep = lambda m: f"{m[1]}-{m[2]}" if f"{m[1]}-{m[2]}".lower() in own else m[1] + m[2]
    out = _CUT.sub(keep, out)

    def fix(m: re.Match) -> str:
        good = fixes.get(m[0].lower())
        if good is None:
            return m[0]
        letters = [c for c in m[0] if c.isalpha()]
        return good.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else good.capitalize() if letters and m[0][0].isupper() else good

    return re.sub(r"[ \t]*\n[ \t]*", " ", _WORD.sub(fix, out)).strip()


def _mend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    some = lambda x: x if x is not None else ()
    for f in frames:
        texts = [mended(t, set(some(w)), {x["bad"]: x["good"] for x in some(c)}, set(some(o))) for t, w, c, o in zip(f.text, f["where"], f.fixes, f.own)]
        yield f[[*KEY, "y0", "x0"]].assign(repaired=texts)


def repaired_paragraphs(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, idx, text, elements): paragraphs of scanned documents, repaired. An element that doesn't end a
    sentence goes on with the next text element of its page, a word cut between them is made whole; idx is that of the
    first element. Page numbers and running heads are left out. Elements without text, and other documents, give no row."""
    traces, words, fixes, good = scan_traces(elements, pages)
    where = headers(traces.filter("what = 'line'"), pages).groupBy(*KEY).agg(F.collect_set("where").alias("where"))
    texts = elements.filter("kind = 'text' and text is not null")
    chosen = chosen_corrections(traces, fixes, texts).groupBy(*KEY).agg(F.collect_list(F.struct("bad", "good")).alias("fixes"))
    scanned = traces.select("doc_id").distinct()
    rows = join_hot(texts.select(*KEY, "text", F.col("bbox.y0").alias("y0"), F.col("bbox.x0").alias("x0")), scanned, ["doc_id"], "left_semi", salt_from=["page", "idx"]).dropDuplicates(KEY)
    own = _hyphens(traces, good).filter("not cut").groupBy(*KEY).agg(F.collect_set("word").alias("own"))
    rows = rows.join(where, KEY, "left").join(chosen, KEY, "left").join(own, KEY, "left")
    done = rows.mapInPandas(_mend, "doc_id bigint, page int, idx int, y0 double, x0 double, repaired string").filter("repaired <> ''")
    order = Window.partitionBy("doc_id", "page").orderBy("idx")
    before = F.lag("repaired").over(order)
    ended = before.isNull() | before.rlike("[.!?…。！？][\"'”’»)\\]]*\\s*$")
    numbered = done.withColumn("para", F.sum(F.when(ended, 1).otherwise(0)).over(order))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "repaired"))), lambda x: x.repaired), "\u0001")
    glued = F.regexp_replace(F.regexp_replace(whole, "(?<=\\p{L})[-\u00ad\u2010\u2011]\u0001(?=\\p{Ll})", ""), "\u0001", " ")
    return numbered.groupBy("doc_id", "page", "para").agg(F.min("idx").alias("idx"), glued.alias("text"), F.count("*").alias("elements")).drop("para")


def _odd_words(traces: DataFrame, fixes: DataFrame, how: str) -> DataFrame:
    odd = traces.filter("what = 'odd'").select(*KEY, F.col("word").alias("bad"), "other")
    torn = odd.filter(F.col("other").startswith("^")).join(after_cuts(traces), KEY, "left_anti")
    odd = odd.filter(~F.col("other").startswith("^")).unionByName(torn.withColumn("other", F.substring("other", 2, 1_000)))
    return join_hot(odd, fixes if how == "inner" else fixes.select("bad").distinct(), ["bad"], how, salt_from=KEY)


def scan_noise(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, idx, noise): kinds of scanning noise in each text element of documents that have a page-sized image:
    `header`, `pagenum`, `hyphen`, `misread`, once each.

    Null and blank texts have none; elements without bbox are never heads; repeated deliveries count once; documents
    without page sizes are judged by their other pages, or are not taken for scanned."""
    traces, words, fixes, good = scan_traces(elements, pages)
    heads = materialize(headers(traces.filter("what = 'line'"), pages), "p6-heads")
    pairs = words.filter("word like '%-%' and clean + scan >= 2").select("word")
    cut = _hyphens(traces, good).filter("cut").select(*KEY).unionByName(_open_cuts(traces, pairs)).select(*KEY, F.lit("hyphen").alias("noise"))
    numbers = heads.filter("noise = 'pagenum'").select(*KEY)
    bad = _odd_words(traces, fixes, "left_semi").select(*KEY).distinct().join(numbers, KEY, "left_anti").select(*KEY, F.lit("misread").alias("noise"))
    return heads.drop("where").unionByName(cut).unionByName(bad).distinct()
