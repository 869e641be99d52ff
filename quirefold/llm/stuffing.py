"""Problem 9: keyword-stuffed pages and link lists.

A text is cut into units: lines, the entries of a line that is a list, and sentences. Each unit is reduced to a shape of
its number of words, capitals, separators, links, figures and ending. Shapes are grouped per document with the characters
they cover; a page of whose text more than half lies in a few non-sentence shapes is flagged. Two facts of the document go into a
shape beside the unit's own looks: whether the unit stands there more than once, and whether a term that is stuffed into
the document (repeated inside sentences, and dense) stands in it, for keyword spam that is written as sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.sources.tables import rows_once

#: Share of a text's characters beyond which it is flagged.
SHARE = 0.5
#: Number of its largest non-sentence shapes that must cover that share.
FEW = 6
#: A stuffed term stands this often in a text, makes up this share of its words, and stands twice in one sentence.
TERM_COUNT, TERM_SHARE, SHORT_WORD = 4, 0.14, 4
#: Entries without any mark of links, products or repetition make a page only from this number on; fewer may be a sentence cut off.
ENTRIES = 3

_LINK = re.compile(r"(?:https?://|ftp://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.(?:com|org|net|info|biz|html?|php)\b\S*", re.I)
_TAG = re.compile(r"(?<!\w)#[^\W_][\w-]*")
_PRICE = re.compile(r"(?<![\d.,])\d{1,6}[.,]\d{2}(?!\d)|[$€£¥]\s?\d|\d\s?[$€£¥]")
_CODE = re.compile(r"\b(?:SKU|Art|Ref|Nr|No|Item|EAN|ISBN)\b\.?:?\s*[\w-]*\d|\b\d{3,}-[A-Z0-9]{1,4}\b|\b[A-Z]{1,4}-?\d{3,}\b")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_CJK_RUN = re.compile(f"{_CJK.pattern}+")
_MARKED = re.compile(f"{_LINK.pattern}|{_TAG.pattern}", re.I)
#: What a text must hold to have a price or a code anywhere.
_MAYBE_PRICE = re.compile(r"\d[.,]\d\d|[$€£¥]")
_MAYBE_CODE = re.compile(r"\d-[A-Z0-9]|[A-Z]-?\d|\b(?:SKU|Art|Ref|Nr|No|Item|EAN|ISBN)\b")
# Signs that end a sentence, closers that may follow them, and separators of lists.
_ENDS, _CLOSERS = ".!?…。！？।؟۔", "\"'”’»›“)]」』》）"
_LIST_SIGNS = ("|¦", ">›→/", "·•∙●", ";", ",，、")
_SENTENCE = re.compile(r"(?<=[!?…。！？।؟۔])(?=\S)|(?<=[。！？][”」』》）])(?=\S)|(?<=[.!?…।؟۔])\s+|(?<=[.!?…][\"'”’»“)\]])\s+")
_WRAP_END = re.compile(r"[.!?…。！？।؟۔][\"'”’»›“)\]」』》）]*(?:\s|$)|[。！？]")
_LIST = [re.compile(p) for p in (r"\s+[|¦]\s+|\s*\|\s*", r"\s+[>›→/]\s+", r"\s*[·•∙●]\s*", r"\s*;\s+", r"\s*[,，、]\s*")]
_BULLET = re.compile(r"^\s*(?:[-–—•*·]|\(?\d{1,3}[.)])\s+")


class _Marks:
    """What a text can hold at all, so that its units aren't searched for the rest."""

    def __init__(self, text: str) -> None:
        low = text.lower()
        self.link = "://" in low or any(x in low for x in (".com", ".org", ".net", ".info", ".biz", ".htm", ".php", "www."))
        self.tag, self.cjk = "#" in text, not text.isascii() and _CJK.search(text) is not None
        self.price = _MAYBE_PRICE.search(text) is not None
        self.code = _MAYBE_CODE.search(text) is not None

    def links(self, t: str) -> list[str]:
        return _LINK.findall(t) if self.link else []

    def tags(self, t: str) -> list[str]:
        return _TAG.findall(t) if self.tag else []

    def spoken(self, t: str) -> str:
        """t without links."""
        return _LINK.sub(" ", t) if self.link else t

    def spaced(self, t: str) -> str:
        """t without signs of scripts without spaces."""
        return _CJK.sub(" ", t) if self.cjk else t

    def n_words(self, t: str) -> int:
        """Words; two signs of a script without spaces count as one."""
        if not self.cjk:
            return len(_WORD.findall(t))
        cjk = len(_CJK.findall(t))
        return len(_WORD.findall(_CJK.sub(" ", t))) + (cjk + 1) // 2


def ended(t: str) -> bool:
    """Whether t ends with an end mark, perhaps closed."""
    last = t.rstrip().rstrip(_CLOSERS)[-1:]
    return last != "" and last in _ENDS


def units(text: str, marks: _Marks | None = None) -> list[tuple[str, str]]:
    """(unit, how): how is L for a line, E for an entry of a list, S for a sentence of a line that holds several."""
    m, out = marks or _Marks(text), []
    for line in _unwrapped(text, m):
        body = _BULLET.sub("", line)
        parts = None
        for signs, cut in zip(_LIST_SIGNS, _LIST):
            if not any(c in body for c in signs):
                continue
            pieces = [p for p in cut.split(body) if p.strip()]
            if len(pieces) < 3:
                continue
            short = sum(m.n_words(_LINK.sub("u", p) if m.link else p) <= 8 for p in pieces)
            if short >= 0.8 * len(pieces) and not sum(ended(p) and m.n_words(p) > 3 for p in pieces) > len(pieces) / 3:
                if cut is not _LIST[-1] or sum(map(m.n_words, pieces)) / len(pieces) <= 3.5 and (m.links(body) or m.tags(body) or len(pieces) >= 5 and not ended(body)):
                    parts = [(p.strip(), "E") for p in pieces]
                break
        if parts is None:
            pieces = [p.strip() for p in _SENTENCE.split(body) if p and p.strip()]
            parts = [(p, "L" if len(pieces) == 1 else "S") for p in pieces]
        for p, how in parts:
            out += _apart(p, how, m)
    return out


def _unwrapped(text: str, m: _Marks) -> list[str]:
    """Lines, those of a hard-wrapped paragraph joined: lines without an end mark go with the next ones up to a line that
    has one, unless a line among them has marks of a list, or comes again."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    if len(lines) == 1:
        return lines
    often, out, held = Counter(lines), [], []
    for line in lines:
        listed = often[line] > 1 or _BULLET.match(line) or m.tags(line) or m.links(line) or m.price and _PRICE.search(line) or m.code and _CODE.search(line) or any(c in line for c in "|>»«")
        if listed:
            out, held = out + held + [line], []
        elif _WRAP_END.search(line):
            out, held = [*out, " ".join([*held, line])], []
            tail = _SENTENCE.split(line)[-1] or ""
            if not ended(tail) and len(lines) > 1:
                held = [out.pop()]
        else:
            held.append(line)
    return out + held


def _apart(piece: str, how: str, m: _Marks) -> list[tuple[str, str]]:
    """A sentence before or after a run of links and tags is a unit of its own."""
    if not (m.link or m.tag):
        return [(piece, how)]
    marks = [x.span() for x in _MARKED.finditer(piece)]
    if len(marks) < 3:
        return [(piece, how)]
    head = piece[: marks[0][0]].strip()
    return ([(head, how)] if head else []) + [(piece[marks[0][0] :], "E")]


def _terms(unit: str, words: list[str], m: _Marks) -> list[str]:
    """Words of four letters or more, and runs of three signs in a script without spaces."""
    out = [w.lower() for w in words if len(w) >= SHORT_WORD]
    for run in _CJK_RUN.findall(unit) if m.cjk else ():
        out += [run[i : i + 3] for i in range(len(run) - 2)]
    return out


def shape(unit: str, how: str, repeated: bool, stuffed: bool, m: _Marks, words: list[str]) -> str:
    """The unit's shape: how it was cut, words, capitals, links, tags, price, code, separators, ending, repetition. words are
    those outside scripts without spaces."""
    n = m.n_words(m.spoken(unit))
    bucket = "0" if not n else "1" if n == 1 else "2-4" if n <= 4 else "5-8" if n <= 8 else "9+"
    ws = [w for w in words if w[0].isalpha()]
    caps = sum(w[0].isupper() for w in ws)
    cap = "A" if ws and caps == len(ws) and all(w.isupper() for w in ws) else "T" if ws and caps == len(ws) else "i" if ws and ws[0][0].isupper() or m.cjk and _CJK.search(unit) else "x"
    links, tags = m.links(unit), m.tags(unit)
    share = sum(map(len, links)) / max(1, len(unit))
    flags = "".join(
        c
        for c, on in (
            ("u", share > 0), ("U", share > 0.5 or len(links) + len(tags) >= 3), ("#", len(tags) * 2 >= n > 0), ("p", m.price and _PRICE.search(unit)), ("c", m.code and _CODE.search(unit)),
            ("s", any(c in unit for c in "|>»«·•")), (".", ended(unit)), ("r", repeated), ("k", stuffed),
        )
        if on
    )
    return f"{how} {bucket} {cap} {flags}"


def is_prose_shape(s: str) -> bool:
    """Sentence shapes: at least three words (two before an end mark), ended like a sentence or long, without the marks of entries, links, products, repetition and stuffing."""
    how, n, cap, flags = (s.split(" ") + [""])[:4]
    if any(c in flags for c in "U#rk") or n in ("0", "1"):
        return False
    if "p" in flags and "c" in flags or (how == "E" and "." not in flags):
        return False
    if "." in flags:
        return n != "2-4" or cap != "T"
    if how == "S" and n == "5-8" and cap == "i" and not set(flags) & set("upcs"):
        return True  # a sentence cut off
    return n == "9+" and cap == "i" and "p" not in flags and "c" not in flags and how != "E"


def is_marked_shape(s: str) -> bool:
    """Shapes with links, tags, products or repetition."""
    flags = s.rpartition(" ")[2]
    return any(c in flags for c in "U#rk") or "p" in flags and "c" in flags


def shapes(text: str | None) -> dict[str, tuple[int, int]]:
    """(characters, units) of text by shape."""
    m = _Marks(text or "")
    us = units(text or "", m)
    if not us:
        return {}
    seen = Counter(u.lower() for u, _ in us)
    words = [_WORD.findall(m.spaced(u)) for u, _ in us]
    in_unit = [Counter(_terms(u, ws, m)) for (u, _), ws in zip(us, words)]
    total: Counter = Counter()
    for c in in_unit:
        total.update(c)
    n_all = max(1, sum(m.n_words(u) for u, _ in us))
    doubled = {t for c in in_unit for t, k in c.items() if k >= 2}
    stuffed = {t for t in doubled if total[t] >= TERM_COUNT and total[t] >= TERM_SHARE * n_all}
    out: dict[str, tuple[int, int]] = {}
    for (u, how), c, ws in zip(us, in_unit, words):
        all_ws = _WORD.findall(u) if m.cjk else ws
        poor = len(all_ws) >= 8 and len({w.lower() for w in all_ws}) <= 0.5 * len(all_ws) and not ended(u)
        s = shape(u, how, seen[u.lower()] >= 3, poor or not stuffed.isdisjoint(c), m, ws)
        chars, k = out.get(s, (0, 0))
        out[s] = (chars + len(u), k + 1)
    return out


def _by_shape(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(d, s, n, k, is_prose_shape(s), is_marked_shape(s)) for d, t in zip(f.doc_id, f.text) for s, (n, k) in shapes(t).items()]
        yield pd.DataFrame(rows, columns=["doc_id", "shape", "chars", "units", "prose", "marked"])


def document_shapes(documents: DataFrame) -> DataFrame:
    """(doc_id, shape, chars, units, prose, marked): characters and units of each document by shape. Null, empty and blank texts, and rows without id, give no row;
    texts that come again under another id are judged again; a repeated row counts once."""
    docs = rows_once(documents.filter(F.col("text").isNotNull()).select("doc_id", "text"), ["doc_id"])
    return docs.mapInPandas(_by_shape, "doc_id bigint, shape string, chars bigint, units bigint, prose boolean, marked boolean")


def stuffed_pages(documents: DataFrame, share: float = SHARE, few: int = FEW) -> DataFrame:
    """(doc_id, chars, stuffed_chars, top_shape): documents of whose unit characters more than `share` lie in non-sentence
    shapes, and that in `few` of them; the non-sentence shape that covers most.
    A text of less than ENTRIES units without marks is not judged by its shape alone."""
    other = F.when(F.col("prose"), 0).otherwise(F.col("chars"))
    by = document_shapes(documents).groupBy("doc_id").agg(
        F.sum("chars").alias("chars"),
        F.sum(other).alias("stuffed_chars"),
        F.slice(F.sort_array(F.collect_list(other), False), 1, few).alias("largest"),
        F.sum(F.when(F.col("prose"), 0).otherwise(F.col("units"))).alias("entries"),
        F.max("marked").alias("marked"),
        F.max_by("shape", F.when(F.col("prose"), -1).otherwise(F.col("chars"))).alias("top_shape"),
    )
    dominated = F.aggregate("largest", F.lit(0).cast("bigint"), lambda a, x: a + x) > F.lit(share) * F.col("chars")
    short = (F.col("entries") < ENTRIES) & ~F.col("marked")
    return by.filter(dominated & ~short).drop("entries", "marked", "largest")
