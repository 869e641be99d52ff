"""Problem 3: sentence boundaries across languages and scripts.

A hidden-event n-gram model: between tokens stands a boundary event or none. Left n-grams (the token before a gap with its
punctuation, alone and with the token before it) end sentences or don't; right tokens begin them or follow inside. Where a
token is unseen its shape serves. Events inside quotations and brackets are ruled out, blank lines are certain. The gaps of
a text form a chain of two states, in which the left bigram of a gap depends on the event of the gap just before it;
forward-backward posteriors decide.

Training needs no labels for a language or script: the end of a text that is to be cut is the end of a sentence and its
begin a beginning, so an n-gram that ends sentences is found at ends of texts at the rate of sure terminators. From there
expectation-maximisation with the posteriors refines all counts, over all texts. Elements that have sentences add labelled
gaps, all of them, counted once; only n-grams of the texts to be cut are kept.
"""

from __future__ import annotations

import marshal
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.session import frequent, join_hot, least_frequent, materialize, small
from quirefold.sources.tables import rows_once

KEY = ["doc_id", "page", "idx"]
#: N-grams that tasks hold, the most frequent, while the rest is joined; rounds of EM.
NGRAMS, ROUNDS = 200_000, 4

# Signs that can end a sentence, closers, and pairs of quotation marks and brackets.
ENDERS = ".!?…。！？．｡।॥؟۔։።။។"
CLOSERS = "'”’»›)]}」』》〉）】］"
#: Marks that open in one language and close in another; they are closers where a pair says so.
EITHER = "“\""
PAIRS = {"«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "（": "）", "【": "】", "［": "］", "(": ")", "[": "]", "“": "”"}
# Prior probability that a gap of a kind is a boundary, before anything is learned.
PRIOR = {".": 0.8, "!": 0.95, "?": 0.95, "…": 0.5, "w": 0.97, " ": 0.3, "n": 0.003}
_WIDE = "。！？．｡।॥؟۔։።။។"

_GAP = re.compile(
    rf"(?P<hard>[ \t\r]*\n\s*\n\s*)|(?P<end>[{re.escape(ENDERS)}]+(?:[   ]?[»›]|[{re.escape(CLOSERS)}])*[{re.escape(ENDERS)}]*)(?P<sp>\s*)|(?P<th>(?<=[฀-໿ក-៿က-႟0-9”\"»）)])[ \t\n​]+(?=[฀-໿ក-៿က-႟0-9“\"«（(]))|(?P<nl>[ \t\r]*\n[ \t\r]*)"
)
_TAIL = re.compile(rf"[{re.escape(ENDERS)}]+[{re.escape(CLOSERS)}   ]*$")
_BLANK_LINE = re.compile(r"\n\s*\n")
_AFTER = re.compile(rf"(?P<signs>[{re.escape(ENDERS + CLOSERS)}]*)\s*")
_NOSPACE = re.compile(r"[฀-໿ក-៿က-႟]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_UNSPACED = re.compile(r"[฀-໿ក-៿က-႟぀-ヿ㐀-鿿豈-﫿]")
_DIGITS = re.compile(r"\d+(?:[.,:]\d+)*")


def _spans(text: str) -> list[tuple[int, int]]:
    """Places of matched quotations and brackets; a blank line ends an open one."""
    stack: list[tuple[str, int]] = []
    out = []
    for m in re.finditer(r"[«»‹›「」『』《》〈〉（）【】［］()\[\]“”„\"]|\n\s*\n", text):
        c, at = m.group(), m.start()
        if c[0] == "\n":
            stack.clear()
        elif c == '"':
            if any(x == '"' for x, _ in stack):
                while stack:
                    x, a = stack.pop()
                    if x == '"':
                        out.append((a, at))
                        break
            else:
                stack.append(('"', at))
        elif c == "“" and any(x == "”„" for x, _ in stack):
            while stack:
                x, a = stack.pop()
                if x == "”„":
                    out.append((a, at))
                    break
        elif c == "„":
            stack.append(("”„", at))
        elif c in PAIRS:
            stack.append((PAIRS[c], at))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if c in stack[k][0]:
                    out.append((stack[k][1], at))
                    del stack[k:]
                    break
    return out


def _chunk(text: str, end: int) -> tuple[str, int]:
    """The token that ends at `end`, and where it begins: up to a blank, or the last signs of a script without spaces."""
    e = end
    while e > 0 and text[e - 1].isspace():
        e -= 1
    near = text[max(0, e - 40) : e]
    if near and not _UNSPACED.search(near):
        token = near.rsplit(None, 1)[-1]
        return token, e - len(token)
    b, signs = e, 0
    limit = None
    while b > 0 and not text[b - 1].isspace() and e - b < 40:
        c = text[b - 1]
        if limit is None and c.isalpha():
            limit = 2 if _CJK.match(c) else 6 if _NOSPACE.match(c) else 99
        if limit is not None and ((signs := signs + 1) > limit or limit == 99 and _CJK.match(c)):
            break
        b -= 1
    return text[b:e], b


@lru_cache(maxsize=1 << 16)
def _norm(token: str) -> str:
    t = _DIGITS.sub("0", token.strip("«‹「『《〈（【［([“„\"¿¡")).lower()
    return "I." if len(token) == 2 and token[0].isupper() and token[1] == "." else t


@lru_cache(maxsize=1 << 16)
def _left_shape(token: str, kind: str, gap: str) -> str:
    core = token.rstrip(ENDERS + CLOSERS + EITHER + "   ").lstrip("«‹「『《〈（【［([“„\"¿¡")
    tail = "q" if token[-1:] in CLOSERS + EITHER else ""
    if not core:
        s = "-"
    elif core[-1].isdigit():
        s = "0"
    elif len(core) == 1:
        s = "I" if core.isupper() else "x"
    elif "." in core:
        s = "x.x"
    else:
        s = ("X" if core[0].isupper() else "x") + ("s" if len(core) <= 3 else "")
    return f"{kind}{tail}{gap} {s}"


def _right(text: str, at: int) -> tuple[str, str]:
    """(token, shape) that follow a gap."""
    e = at
    while e < len(text) and not text[e].isspace() and e - at < 30:
        e += 1
    token = text[at:e]
    if not token:
        return "", ""
    c = token[0]
    if _CJK.search(token[:2]):
        token = token[:2]
    elif _NOSPACE.search(token[:2]):
        token = token[:5]
    elif (other := _CJK.search(token)) is not None:
        token = token[: other.start()]
    shape = "0" if c.isdigit() else "U" if c.isupper() else "l" if c.islower() else "a" if c.isalpha() else "q" if c in PAIRS or c in "„\"¿¡—–-" else "."
    if shape == "q" and len(token) > 1:
        shape += "U" if token[1].isupper() else "l" if token[1].islower() else "a"
    return _DIGITS.sub("0", token).rstrip(ENDERS + CLOSERS + EITHER + ",;:，、；：").lower(), shape


def _caseless(text: str, at: int, kind: str) -> bool:
    """Whether a sign of a script without case stands before the end mark at `at`, closers between them aside, and numbers
    unless the mark is a point, which may be theirs. No blank follows a sentence in such scripts, and no capital tells."""
    while at > 0 and (text[at - 1] in CLOSERS + EITHER or text[at - 1].isdigit() and kind != "." or unicodedata.category(text[at - 1])[0] == "M"):
        at -= 1
    return at > 0 and unicodedata.category(text[at - 1]) == "Lo"


def gaps(text: str, right: bool = True) -> list[tuple]:
    """Gaps where a boundary is possible: (end of the unit, certainty: 1 hard, 0 open, -1 ruled out, whether the gap before
    is just one token away, left bigram, left bigram if a sentence begins after the gap before, left unigram, left shape,
    right token, right shape, kind). The last one is the end of the text. Without `right`, right tokens and shapes are empty."""
    spans, out, last = _spans(text), [], -1
    closing = {b for _, b in spans if text[b] in EITHER}
    stop, lead = len(text.rstrip()), len(text) - len(text.lstrip())
    if not stop:
        return []
    inside = [0] * (len(text) + 2) if spans else []  # how many quotations or brackets hold a unit's end there
    for a, b in spans:
        if b >= a + 2:
            inside[a + 2] += 1
            inside[b + 1] -= 1
    inside = list(accumulate(inside))

    def add(end: int, at: int, kind: str, gap: str, sure: int) -> None:
        nonlocal last
        token, b = _chunk(text, end)
        left = _norm(token) + ("_" if kind == " " else "\n" if kind == "n" and not sure else "")  # a line break tells apart
        before = _norm(_chunk(text, b)[0]) if b else "<s>"
        adjacent = last >= 0 and not text[last:b].strip()
        r, rs = _right(text, at) if right and at < stop else ("", "")
        out.append((end, sure, adjacent, f"{before} {left}", f"<s> {left}", left, _left_shape(token, kind, gap), r, rs, kind))
        last = end

    for m in _GAP.finditer(text):
        end, at = m.start(), m.end()
        closed = 0
        if m.group("end") is not None:
            end = m.end("end")
            while end + closed in closing and not m.group("sp"):
                closed += 1
            if closed:  # marks that close here, then a further end mark and blanks
                more = _AFTER.match(text, end + closed)
                end, at = more.end("signs"), more.end()
            space = text[end:at]
            signs = m.group("end").rstrip(CLOSERS + "   ")
            kind = "w" if signs[-1:] in _WIDE else "…" if "…" in signs or signs.endswith("..") else signs[-1:] or "."
            kind = kind if kind in PRIOR else "."
            wide = kind == "w" or bool(_CJK.match(text[at : at + 1])) and kind != "."
            if at == end and at < stop and not wide:
                before, after = text[m.start() - 2 : m.start()], text[at]
                if not (after.isupper() and before.isalpha() and before.islower() or after.isupper() and kind in "!?" or _caseless(text, m.start(), kind)):
                    continue
            gap = "0" if at == end else "n" if "\n" in space else "s"
            sure = 1 if "\n" in space and _BLANK_LINE.search(space) else 0
        elif m.group("hard") is not None:
            kind, gap, sure = "n", "h", 1
        elif m.group("th") is not None:
            kind, gap, sure = " ", "s", 0
        else:
            kind, gap, sure = "n", "n", 0
        if at >= stop or end <= lead:
            continue
        if sure == 0 and inside and inside[end] > 0:
            sure = -1
        while text[end - 1].isspace():
            end -= 1
        if out and out[-1][0] == end:
            continue
        add(end, at, kind, gap, sure)
    tail = _TAIL.search(text, 0, stop)
    signs = tail.group().rstrip(CLOSERS + "   ") if tail else ""
    kind = ("w" if signs[-1] in _WIDE else "…" if "…" in signs or signs.endswith("..") else signs[-1]) if signs else " " if _NOSPACE.search(text[max(0, stop - 3) : stop]) else "n"
    add(stop, len(text), kind if kind in PRIOR else ".", "s", 1)
    return out


def labels(text: str, sentences: list[str], found: list[tuple]) -> list[int | None]:
    """Whether each gap ends a sentence by the given cut, blanks aside; None where text and sentences differ."""
    ends, n = set(), 0
    for s in sentences:
        n += len("".join((s or "").split()))
        ends.add(n)
    if "".join(text.split()) != "".join("".join((s or "").split()) for s in sentences):
        return [None] * len(found)
    out, at, n = [], 0, 0
    for g in found:
        n += len("".join(text[at : g[0]].split()))
        at = g[0]
        out.append(int(n in ends))
    return out


# --- model -------------------------------------------------------------------------------------------------------------

SMOOTH = 3.0


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


class Model:
    """Event n-grams with counts (b, n): expected boundaries and gaps. Levels: B left bigram, U left unigram, C left shape;
    R right token, T its shape, N all, each by kind of gap; S pair of shapes, K left shape, for the same gaps as R.

    `ends` are counts (e, w, k): for B and U how often the n-gram ends a text, and how often it stands before a gap or end,
    weighted by one over the text's sentences (w) and plainly (k); for R how often the token begins a text, and stands after
    a gap. Any sentence end of a text is its last with probability of that weight, so e / (rate * w) estimates the share of
    places at which an n-gram ends a sentence, however long the texts are. The number of sentences is that of the round
    before, in round 0 the number of gaps, for which `rate` makes up. These estimates stay beside the posteriors."""

    def __init__(self, ends: dict, rate: float, counts: dict | None = None) -> None:
        self.ends, self.rate, self.c = ends, rate, counts or {}
        self.odds: dict[str, float] = {}

    def hold(self, rare) -> None:
        """Takes in the counts of a text's n-grams that the model doesn't hold: rows of (level, name, b, n, k)."""
        for level, name, b, n, k in rare:
            if level == "O":
                self.odds[name] = b
            elif level[0] == "E":
                self.ends[level, name] = (b, n, k)
            else:
                self.c[level, name] = (b, n)

    def drop(self, rare) -> None:
        for level, name, *_ in rare:
            if level == "O":
                del self.odds[name]
            else:
                del (self.ends if level[0] == "E" else self.c)[level, name]

    def missing(self, found: list[tuple]) -> set[tuple[str, str]]:
        """(level, name) of the n-grams of open gaps that the model doesn't hold."""
        out = set()
        for _, sure, adjacent, bigram, at_start, unigram, _, token, rshape, kind in found:
            if sure == 0:
                out |= {("EU", unigram), ("EB", bigram), ("ER", f"{rshape} {token}"), ("EW", f"{rshape} {token}")}
                if adjacent:
                    out.add(("EB", at_start))
                if self.c:
                    out |= {("U", unigram), ("B", bigram), ("I", bigram), ("R", f"{kind} {rshape} {token}")}
                    if adjacent:
                        out.add(("B", at_start))
        return {("O" if x[0] == "I" else x[0], x[1]) for x in out if x not in self.ends and x not in self.c}

    def ending(self, level: str, name: str) -> tuple[float, float]:
        """(share of places that end a sentence, number of places) by the ends of texts."""
        e, w, k = self.ends.get((f"E{level}", name), (0.0, 0.0, 0.0))
        return (min(1.0, e / (self.rate * w)) if w else 0.0), k

    def beginning(self, name: str) -> tuple[float, float]:
        """(share of gaps after which the token begins a sentence, number of gaps) by the begins of texts."""
        e, w, k = self.ends.get(("ER", name), (0.0, 0.0, 0.0))
        own = self.ends.get(("EW", name), (0.0, 0.0, 0.0))[0]
        return (min(1.0, max(0.0, (e / self.rate - own) / w)) if w else 0.0), k

    def left(self, bigram: str, unigram: str, shape: str, kind: str) -> float:
        """Probability that the left context ends a sentence, each order backed by the next lower one."""
        p = PRIOR[kind]
        for level, name in (("C", shape), ("U", unigram), ("B", bigram)):
            b, n = self.c.get((level, name), (0.0, 0.0))
            weight = SMOOTH
            if level != "C":
                share, k = self.ending(level, name)
                b, n = b + share * k, n + k
                weight = SMOOTH * (2 if self.c else 4) * (3 if kind in "w?" else 1)  # signs that hardly ever stand inside
            p = (b + weight * p) / (n + weight)
        return min(max(p, 1e-4), 1 - 1e-4)

    def right(self, token: str, shape: str, left_shape: str, kind: str) -> float:
        """Factor by which the right token changes the odds of a boundary."""
        most = {"w": 0.7, "?": 0.7, "!": 3.0, "n": 2.0}.get(kind, 5.0)
        share, k = self.beginning(f"{shape} {token}")
        k = 0.0 if kind == "n" else k  # how sentences begin elsewhere says little about bare line breaks
        began = share * k
        if not self.c:
            base = {"l": 0.05, "ql": 0.3, ".": 0.2}.get(shape, 0.6)
            tok = (began + 4 * SMOOTH * base) / (k + 4 * SMOOTH)
            return math.exp(max(-most, min(most, _logit(tok) - _logit(0.6))))
        at = lambda level, name: self.c.get((level, name), (0.0, 0.0))
        tb, tn = at("T", f"{kind} {shape}")
        kb, kn = at("K", left_shape)
        sb, sn = at("S", f"{left_shape} {shape}")
        rb, rn = at("R", f"{kind} {shape} {token}")
        nb, nn = at("N", kind)
        p_k, p_n, p_t = (kb + 1) / (kn + 2), (nb + 1) / (nn + 2), (tb + 1) / (tn + 2)
        p_s = (sb + SMOOTH * p_k) / (sn + SMOOTH)
        p_r = (rb + 0.5 * began + SMOOTH * p_t) / (rn + 0.5 * k + SMOOTH)
        seen = rn / (rn + 4 * SMOOTH) if shape != "0" else 0.0  # the token if it is frequent, else its shape; all numbers are one token
        x = seen * (_logit(p_r) - _logit(p_n)) + (1 - seen) * (_logit(p_s) - _logit(p_k))
        return math.exp(max(-most, min(most, x)))

    def posteriors(self, found: list[tuple]) -> list[float]:
        """Forward-backward over the chain of gaps; state 1 is a boundary."""
        n = len(found)
        like = []
        for end, sure, adjacent, bigram, at_start, unigram, shape, token, rshape, kind in found:
            if sure == 1:
                like.append(((0.0, 1.0), (0.0, 1.0)))
                continue
            if sure == -1:
                like.append(((1.0, 0.0), (1.0, 0.0)))
                continue
            ratio = self.right(token, rshape, shape, kind) * self.odds.get(bigram, 1.0)
            row = []
            for state in (0, 1):
                p = self.left(at_start if state and adjacent else bigram, unigram, shape, kind)
                odds = p / (1 - p) * ratio
                row.append((1 / (1 + odds), odds / (1 + odds)))
            like.append((row[0], row[1]))
        forward, backward = [], [(1.0, 1.0)] * n
        f = (0.0, 1.0)
        for row in like:
            f = (f[0] * row[0][0] + f[1] * row[1][0], f[0] * row[0][1] + f[1] * row[1][1])
            s = f[0] + f[1] or 1.0
            f = (f[0] / s, f[1] / s)
            forward.append(f)
        for i in range(n - 2, -1, -1):
            nxt, (b0, b1) = like[i + 1], backward[i + 1]
            x = (nxt[0][0] * b0 + nxt[0][1] * b1, nxt[1][0] * b0 + nxt[1][1] * b1)
            s = x[0] + x[1] or 1.0
            backward[i] = (x[0] / s, x[1] / s)
        out = []
        for (f0, f1), (b0, b1) in zip(forward, backward):
            out.append(f1 * b1 / ((f0 * b0 + f1 * b1) or 1.0))
        return out


def _count(out: dict, level: str, name: str, b: float, n: float = 1.0) -> None:
    x = out.get((level, name), (0.0, 0.0))
    out[level, name] = (x[0] + b, x[1] + n)


def _place(out: dict, level: str, name: str, e: float, w: float, k: float = 1.0) -> None:
    x = out.get((level, name), (0.0, 0.0, 0.0))
    out[level, name] = (x[0] + e, x[1] + w, x[2] + k)


def _places(out: dict, begin: str, found: list[tuple], w: float) -> None:
    """Ends and begins of a text, and the places where its n-grams stand; w is one over its sentences."""
    for g in found:
        if g[1] >= 0:
            _place(out, "EB", g[3], float(g[1]), w)
            _place(out, "EU", g[5], float(g[1]), w)
        if g[1] == 0 and g[9] != "n":
            _place(out, "ER", f"{g[8]} {g[7]}", 0.0, w)
    _place(out, "ER", begin, 1.0, 0.0, 0.0)
    _place(out, "EW", begin, w, 0.0)


def _left_counts(out: dict, g: tuple, p: float) -> None:
    for level, name in (("B", g[3]), ("U", g[5]), ("C", g[6])):
        _count(out, level, name, p)


def _right_counts(out: dict, g: tuple, p: float) -> None:
    shape, token, rshape, kind = g[6:10]
    for level, name in (("R", f"{kind} {rshape} {token}"), ("T", f"{kind} {rshape}"), ("S", f"{shape} {rshape}"), ("K", shape), ("N", kind), ("I", g[3])):
        _count(out, level, name, p)


def _table(out: dict) -> pd.DataFrame:
    return pd.DataFrame([(k[0], k[1], v[0], v[1], v[2] if len(v) > 2 else 0.0) for k, v in out.items()], columns=["level", "name", "b", "n", "k"])


def _found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The gaps of each text, packed, and the token that begins it with its shape."""
    for f in frames:
        begins = [_right(t, len(t) - len(t.lstrip())) for t in f.text]
        yield f[KEY].assign(gaps=[marshal.dumps(gaps(t)) for t in f.text], begin=[f"{rshape} {token}" for token, rshape in begins])


def _with_gaps(cut: DataFrame) -> DataFrame:
    """Texts to be cut, to (doc_id, page, idx, gaps, begin), written once for all rounds."""
    return materialize(_spread(cut).mapInPandas(_found, "doc_id bigint, page int, idx int, gaps binary, begin string"), "p3-gaps")


def _expect(model: Model | None):
    """Counts of a batch of texts to be cut: without a model those of round 0, else expected ones."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: dict = {}
            for packed, begin, rare in zip(f.gaps, f.begin, _rare(f)):
                found = marshal.loads(packed)
                if not found:
                    continue
                post = _posteriors(model, found, rare) if model else None
                _places(out, begin, found, 1 / max(1.0, sum(post) if model else sum(g[1] == 1 or g[1] == 0 and g[9] != "n" for g in found)))
                for g, p in zip(found, post or ()):
                    if g[1] >= 0:
                        _left_counts(out, g, p)
                    if g[1] == 0:
                        _right_counts(out, g, p)
            yield _table(out)

    return run


def _taught(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a batch of elements that have sentences. They teach left contexts only, since all their gaps were found by
    other means."""
    for f in frames:
        out: dict = {}
        for text, sentences in zip(f.text, f.sentences):
            found = gaps(text, right=False)
            for g, y in zip(found[:-1], labels(text, list(sentences), found)):
                if y is not None and g[1] == 0:
                    _left_counts(out, g, float(y))
        yield _table(out)


def _left_names(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The left contexts that a model of these texts is asked for."""
    for f in frames:
        out = set()
        for packed in f.gaps:
            for g in marshal.loads(packed):
                out |= {("B", g[3]), ("B", g[4]), ("U", g[5]), ("C", g[6])}
        yield pd.DataFrame(sorted(out), columns=["level", "name"])


_GRAM = "level string, name string, b double, n double, k double"


def _rare(f: pd.DataFrame) -> list[list[tuple]]:
    """The n-grams joined to each row, if any were."""
    if "rare" not in f:
        return [[]] * len(f)
    return [[] if x is None else [(g["level"], g["name"], g["b"], g["n"], g["k"]) for g in x] for x in f.rare]


def _posteriors(model: Model, found: list[tuple], rare: list[tuple]) -> list[float]:
    model.hold(rare)
    try:
        return model.posteriors(found)
    finally:
        model.drop(rare)


def _missing(model: Model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, p, i, *x) for d, p, i, packed in zip(f.doc_id, f.page, f.idx, f.gaps) for x in sorted(model.missing(marshal.loads(packed)))]
            yield pd.DataFrame(rows, columns=[*KEY, "level", "name"])

    return run


def _with_rare(cut: DataFrame, model: Model | None, rest: DataFrame | None) -> DataFrame:
    """Texts to be cut with `rare`, the counts of their n-grams that the model doesn't hold, if there are any."""
    if rest is None:
        return cut
    asked = _spread(cut.select(*KEY, "gaps")).mapInPandas(_missing(model), "doc_id bigint, page int, idx int, level string, name string")
    known = join_hot(asked, rest.select("level", "name", "b", "n", "k"), ["level", "name"], salt_from=KEY)
    listed = known.groupBy(*KEY).agg(F.collect_list(F.struct("level", "name", "b", "n", "k")).alias("rare"))
    return cut.join(listed, KEY, "left")


def _counts(cut: DataFrame, taught: DataFrame | None, model: Model | None, rest: DataFrame | None) -> tuple[dict, dict, DataFrame | None, float]:
    """(ends, counts, further n-grams, rate) of a round: ends and counts of shapes and the most frequent n-grams, and a table of
    all the others, if there are others. The rate is that of all n-grams. `taught` are the counts of labelled gaps, if they count."""
    rows = _with_rare(cut, model, rest)
    t = _spread(rows.select("gaps", "begin", *(["rare"] if rest is not None else []))).mapInPandas(_expect(model), _GRAM)
    t = t if taught is None else t.unionByName(taught)
    sums = [F.round(F.sum(c), 6).alias(c) for c in ("b", "n", "k")]  # rounded, as the order of sums differs
    total = materialize(t.groupBy("level", "name").agg(*sums).withColumn("often", F.greatest("n", "k")), "p3-counts")
    grams = F.col("level").isin("B", "I", "R", "U", "EB", "EU", "ER", "EW")
    least, whole = least_frequent(total.filter(grams), "often", NGRAMS)
    held = ~grams | frequent("often", least)
    found = total.filter(held).collect()  # shapes are a few hundred
    ends = {(r.level, r.name): (r.b, r.n, r.k) for r in found if r.level[0] == "E"}
    counts = {(r.level, r.name): (r.b, r.n) for r in found if r.level[0] != "E"}
    if whole:
        return ends, counts, None, _rate(ends)
    rate = _rate_of_table(total)
    others = total.filter(~held)
    return ends, counts, materialize(others.filter("level <> 'I'").drop("often").unionByName(_rare_odds(others, total, rest, rate)), "p3-rare"), rate


def _rare_odds(others: DataFrame, total: DataFrame, rest: DataFrame | None, rate: float) -> DataFrame:
    """Rows of level O: the odds of n-grams that are no longer held, by the rule that train has for those that are."""
    inside = others.filter("level = 'I' and n >= 30").select("name", "b", "n")
    ending = total.filter("level = 'EB'").select("name", F.col("b").alias("e"), F.col("n").alias("w"))
    old = others.filter("false").select("name", F.lit(1.0).alias("odds")) if rest is None else rest.filter("level = 'O'").select("name", F.col("b").alias("odds"))
    all_ = inside.join(ending, "name", "left").join(old, "name", "left")
    share = F.when(F.col("w") > 0, F.least(F.lit(1.0), F.col("e") / (F.lit(rate) * F.col("w")))).otherwise(0.0)
    seen = 4 * F.col("b") / F.col("n")
    factor = F.greatest(F.lit(1.0), (F.col("n") * share + seen) / (F.col("b") + seen + 1e-9))
    odds = F.least(F.lit(16.0), F.coalesce("odds", F.lit(1.0)) * factor)
    return all_.select(F.lit("O").alias("level"), "name", odds.alias("b"), F.lit(0.0).alias("n"), F.lit(0.0).alias("k"))


def _spread(rows: DataFrame) -> DataFrame:
    """Rows over all partitions of a shuffle: texts are few bytes for the work they give, so that files' splits are too large."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def to_cut(elements: DataFrame) -> DataFrame:
    """Elements of kind text with non-blank text and without sentences, once per key."""
    bare = F.col("sentences").isNull() | (F.size("sentences") <= 0)
    whole_key = F.col("doc_id").isNotNull() & F.col("page").isNotNull() & F.col("idx").isNotNull()
    return elements.filter((F.col("kind") == "text") & F.col("text").rlike(r"(?U)\S") & bare & whole_key).select(*KEY, "text").dropDuplicates(KEY)


def _rate(ends: dict) -> float:
    """Ends of texts by weight at signs that end sentences nearly always; tokens with such a sign that seldom end a text (a
    name with an exclamation mark, a question that is quoted) are left out."""
    sure = [(e, w) for (level, name), (e, w, _) in ends.items() if level == "EU" and name[-1:] in "!?" + _WIDE and e > 0]
    pooled = 1.0
    for _ in range(3):
        pooled = sum(e for e, _ in sure) / max(1e-9, sum(w for _, w in sure)) if sure else 1.0
        sure = [(e, w) for e, w in sure if e / w >= 0.6 * pooled or e < 3]
    return min(3.0, max(0.5, pooled))


def _rate_of_table(total: DataFrame) -> float:
    """As _rate, over a table of counts."""
    sure = total.filter((F.col("level") == "EU") & F.substring("name", -1, 1).isin("", *"!?" + _WIDE) & (F.col("b") > 0))
    pooled = 1.0
    for _ in range(3):
        e, w = sure.agg(F.sum("b"), F.sum("n")).first()
        pooled = e / max(1e-9, w) if e is not None else 1.0
        sure = sure.filter((F.col("b") / F.col("n") >= 0.6 * pooled) | (F.col("b") < 3))
    return min(3.0, max(0.5, round(pooled, 9)))


def labelled_counts(elements: DataFrame, cut: DataFrame) -> DataFrame:
    """Counts of the left contexts at the labelled gaps of all elements of kind text that have sentences, once per key: those that
    stand in `cut`, as no other is asked for."""
    done = elements.filter((F.col("kind") == "text") & (F.size("sentences") > 1) & F.col("text").isNotNull()).select(*KEY, "text", "sentences")
    asked = materialize(cut.select("gaps").mapInPandas(_left_names, "level string, name string").distinct(), "p3-asked")
    counted = rows_once(done, KEY).select("text", "sentences").mapInPandas(_taught, _GRAM).join(small(asked), ["level", "name"], "left_semi")
    return materialize(counted.groupBy("level", "name").agg(*[F.sum(c).alias(c) for c in ("b", "n", "k")]), "p3-labelled")


def train(elements: DataFrame, cut: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame | None]:
    """The model of all texts in `cut` and of all elements that have sentences, and the table of the n-grams that it doesn't
    hold, if there are any. `cut` has texts, or their gaps if they are known."""
    cut = cut if "gaps" in cut.columns else _with_gaps(cut)
    taught = labelled_counts(elements, cut)
    ends, _, rest, rate = _counts(cut, None, None, None)
    model = Model(ends, rate)
    odds: dict[str, float] = {}
    for _ in range(rounds):
        ends, counts, rest, rate = _counts(cut, taught, model, rest)
        fresh = Model(ends, rate, counts)
        # an n-gram's share of sentence ends is known from the ends of texts; if the posteriors say less, because
        # what follows it is usual inside sentences after other n-grams, its odds are raised
        for (level, name), (b, n) in fresh.c.items():
            if level == "I" and n >= 30:
                want = n * fresh.ending("B", name)[0]
                odds[name] = min(16.0, odds.get(name, 1.0) * max(1.0, (want + 4 * b / n) / (b + 4 * b / n + 1e-9)))
        fresh.odds = dict(odds)
        model = fresh
    return model, rest


def _cut(model: Model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, p, i, packed, rare in zip(f.doc_id, f.page, f.idx, f.gaps, _rare(f)):
                found = marshal.loads(packed)
                ends = [g[0] for g, q in zip(found, _posteriors(model, found, rare)) if q > 0.5]
                rows += [(d, p, i, e) for e in sorted(set(ends))]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "idx", "sent_end"])

    return run


def sentence_ends(elements: DataFrame) -> DataFrame:
    """(doc_id, page, idx, sent_end) of each sentence unit of the elements that have text but no sentences; sent_end is the
    number of characters up to the unit's last non-blank one.

    Blank and null texts, and rows without a whole key, give no row; a text without any sign of an end is one unit; elements of other kinds, and those
    that have sentences, are left as they are. With no text at all the result is empty."""
    cut = _with_gaps(to_cut(elements))
    model, rest = train(elements, cut)
    return _spread(_with_rare(cut, model, rest)).mapInPandas(_cut(model), "doc_id bigint, page int, idx int, sent_end int")


def with_sentences(elements: DataFrame) -> DataFrame:
    """elements with sentences filled in where they were missing; all other rows and columns pass unchanged."""
    ends = sentence_ends(elements).groupBy(*KEY).agg(F.array_sort(F.collect_list("sent_end")).alias("_ends"))
    begin = lambda i: F.when(i > 0, F.element_at("_ends", i)).otherwise(F.lit(0))
    units = F.transform(F.col("_ends"), lambda e, i: F.regexp_replace(F.substring(F.col("text"), begin(i) + 1, e - begin(i)), r"(?U)^\s+|\s+\z", ""))
    joined = elements.join(ends, KEY, "left")
    return joined.withColumn("sentences", F.when(F.col("_ends").isNotNull(), units).otherwise(F.col("sentences"))).drop("_ends")
