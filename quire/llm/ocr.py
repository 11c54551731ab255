"""Marks of page layout and recognition in scanned texts: find the lines, and repair them into paragraphs.

Words are corrected by a noisy channel: a candidate's chance is that of the characters being confused so, times
that of the word after the one before. Both are estimated from the corpus: the n-grams from all texts, the
confusions from the scanned ones, where rare words that differ from frequent ones in one place show them.
Viterbi picks the best sequence of candidates of a line. Han text is decoded the same way, character by character.

Running headers are lines at a page's edge that come again, in nearly the same letters, on pages around it; page
numbers are short lines there whose number grows with the pages. The forms of lines found so are counted over the
corpus, and tell the rest.
"""

from __future__ import annotations

import math
import re
import string
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut

# Least share of all of its kind that a word, word pair or Han pair has to have to be kept, hence at most 1 / SIZE of each.
SIZE = 1e-5
# The same for the words that confusions are learned from.
LEARN = 5e-5
LEAST = 4
# Different words, or sightings in Han text, that a confusion has to be seen in.
SIGHTINGS = 3
# Sightings given to a word that was never seen.
UNSEEN = 0.05
EDGE = 3
REACH = (-2, -1, 1, 2)
FORM_SHARE = 0.9
# Digits and what they are often recognised as.
LIKE_DIGITS = str.maketrans("lI|OoSBZ", "11100582")
_D = r"[0-9lOoISB|]"
# Usual styles of page numbers, for pages without neighbours that show theirs.
PAGE_NUMBER = re.compile(
    rf"^\s*(?:P\S{{2,4}}\s+{_D}{{1,5}}(?:\s+\S{{2,3}}\s+{_D}{{1,5}})?|[Pp]\s?[.,]\s*{_D}{{1,5}}|S(?:eite|\.)\s*{_D}{{1,5}}(?:\s+von\s+{_D}{{1,5}})?|[\[(（【<{{]\s*{_D}{{1,5}}\s*[\])）】>}}]|[-–—―=·•~*/|]+\s*{_D}{{1,5}}\s*[-–—―=·•~*/|]+|\S?\s*{_D}{{1,5}}\s*页(?:\s*[,，/]?\s*共?\s*{_D}{{1,5}}\s*页)?|第\s*(?:{_D}{{1,5}}|[〇零一二三四五六七八九十百]+)\s*\S(?:\s*共\s*(?:{_D}{{1,5}}|[〇零一二三四五六七八九十百]+)\s*\S)?|{_D}{{1,5}}(?:\s*/\s*{_D}{{1,5}})?|[-–—·]?\s*[ivxlc]{{1,7}}\s*[-–—·]?|[-–—·]?\s*[IVXLC]{{1,7}}\s*[-–—·]?)\s*$"
)
NUMBER = re.compile(r"(?=[lOoISBZ|\divxcVXLC〇零一二三四五六七八九十百])(?:(?<![A-Za-zÀ-ɏ])[lOoISBZ|]*\d[\dlOoISBZ|]*(?![A-Za-zÀ-ɏ])|(?<!\w)[lO|]{2,4}(?!\w)|(?<!\w)[ivxlc]{1,7}(?!\w)|(?<!\w)[IVXLC]{1,7}(?!\w)|[〇零一二三四五六七八九十百]+(?=[\W页頁]|$))")
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
HAN_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0}
# Signs that a word may be cut with; the second ones only where the joined word is known.
HYPHENS = "-‐‑¬\xad–‒"
RARE_HYPHENS = "—―⁃−﹣－֊⸗᠆=~_"
ANY_HYPHEN = {*HYPHENS, *RARE_HYPHENS}
HYPHEN = re.compile(rf"([^\W\d_]+)[{HYPHENS}{RARE_HYPHENS}]\s*$")
# Words before which a prefix is left standing that shares the end of a later word.
SUSPENDED = {"und", "oder", "bzw", "sowie", "bis", "and", "or", "et", "ou", "to", "als", "beziehungsweise", "wie", "nor", "than", "versus", "soit", "ni"}
COMMON = 0.004
SENTENCE_END = re.compile(r"[.!?。！？；;，,…]['”’」）)]*\s*$")
TOKEN = re.compile(r"\S+")
HAN = re.compile("[一-鿿]")
WORD = re.compile(r"[^\W_一-鿿]+(?:[.,][^\W_一-鿿]+)*|[.;:?!]")
# Han characters and signs end a word wherever they stand.
_ENDS = "一-鿿，。；、？！：（）「」《》“”"
HAN_RUN = re.compile(f"[{_ENDS}]+")
PART = re.compile(rf"[^{_ENDS}\-‐‑'’]+")
LETTERS = re.compile(r"\s*([^\W\d_]+)")
BEFORE, AFTER = "([{«»“”\"'’‘„—–-", ".,;:?!)]}«»“”\"'’‘—–-‐‑¬\xad"
ZEROS = bytes.maketrans(b"123456789", b"000000000")
# Eleven letters that can't be part of a number: a line that has them is too much of a text for a page number.
_NUMERALS = sorted("零一二三四五六七八九十百")
_PLAIN = "abdefghjkmnpqrstuwyzADEFGHJKMNPQRTUWYß-öø-ÿ" + "".join(f"{chr(ord(a) + 1)}-{chr(ord(b) - 1)}" for a, b in zip(_NUMERALS, [*_NUMERALS[1:], "龦"]) if ord(b) > ord(a) + 1)
ELEVEN_LETTERS = re.compile(rf"(?:[{_PLAIN}][^{_PLAIN}]*+){{11}}")
# Numbers that are gathered before they are counted.
GATHERED = 1 << 20
# Han text is seen with all letters and digits as one.
ONE_SIGN = bytes.maketrans((_ASCII := (string.digits + string.ascii_letters).encode()), b"0" * len(_ASCII))


def translated(text: str, table: bytes) -> str:
    """A text with ASCII characters replaced; on bytes, as that is much faster where other characters occur."""
    return text.encode("utf-8", "surrogatepass").translate(table).decode("utf-8", "surrogatepass")


def has_han(text: str) -> bool:
    return not text.isascii() and HAN.search(text) is not None


def han_lines(text: str) -> list[str]:
    """The lines of a text that have Han characters, stripped, with all letters and digits as one."""
    return [x.strip() for x in translated(text, ONE_SIGN).split("\n") if HAN.search(x)]


def pieces(text: str) -> list[str]:
    """The tokens of a text as they stand between spaces, Han characters and their signs: those with words in them."""
    return (HAN_RUN.sub(" ", text) if has_han(text) else text).split()


class Found(dict):
    """Values of a function by argument; of the first `most` arguments they are kept."""

    def __init__(self, of: Callable, most: int = 1_000_000) -> None:
        self.of, self.most = of, most

    def __missing__(self, key):
        x = self.of(key)
        if len(self) < self.most:
            self[key] = x
        return x


class Numbers(dict):
    """Numbers of words, in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def scanned(lines: list[str]) -> bool:
    """Whether the lines are broken at a page's width: several, most about as long as the longest, many running on into the next."""
    own = [x.strip() for x in lines]
    sizes = sorted(len(x) for x in own if x)
    if len(sizes) < 4 or sizes[-1] > 160 or sizes[len(sizes) // 2] < 0.5 * sizes[-1]:
        return False
    on = sum(1 for x, y in zip(own, own[1:]) if x and y and not SENTENCE_END.search(x) and any(map(str.isalpha, x)))
    return on >= 0.3 * len(sizes)


def edge_lines(lines: list[str]) -> tuple[list[str], list[str]]:
    """The first and the last lines of a page that aren't blank: at most EDGE of each, from the edge inwards."""
    own = [x for x in lines if x.strip()]
    return own[:EDGE], own[: -EDGE - 1 : -1]


@lru_cache(maxsize=100_000)
def style(line: str) -> str:
    """A line with its numbers as '#' and its space squeezed."""
    return " ".join(NUMBER.sub("#", line.strip()).split())


def value(number: str) -> int | None:
    """The value of digits, misread ones included, of Roman or of Han numerals."""
    if (x := number.translate(LIKE_DIGITS)).isdigit() and not (number.isalpha() and set(number.lower()) <= ROMAN.keys() and number.islower()):
        return int(x) if len(x) < 10 else None
    if set(low := number.lower()) <= ROMAN.keys():
        n = [ROMAN[c] for c in low]
        return sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0]))
    if set(number) <= HAN_DIGITS.keys():
        return int("".join(str(HAN_DIGITS[c]) for c in number))
    total, now = 0, 0
    for c in number:
        if c in HAN_DIGITS:
            now = HAN_DIGITS[c]
        elif c in "十百":
            total, now = total + (now or 1) * (10 if c == "十" else 100), 0
        else:
            return None
    return total + now


def counts_on(line: str, other: str, pages: int | None) -> bool:
    """Whether two lines are of one style of page numbers, slightly misread or not; `pages` apart, or by an unknown number of pages."""
    x, y = style(line), style(other)
    if not numbered(x) or x != y and not (len(x) > 4 and nearly(x, y)):
        return False
    for a, b in zip(NUMBER.findall(line), NUMBER.findall(other)):
        v, w = value(a), value(b)
        if v is not None and w is not None and (w - v == pages if pages is not None else 0 < abs(w - v) < 100):
            return True
    return False


@lru_cache(maxsize=100_000)
def numbered(x: str) -> bool:
    """Whether a style may be that of a page number: short, and little but the number."""
    return "#" in x and len(x) <= 24 and sum(map(str.isalpha, x)) <= 10 and len(HAN.findall(x)) <= 4 and not re.search(r"[。；，]|[.,;]$|[^\W\d_]-#|\|.*\|", x)


def numbering(line: str) -> bool:
    """Whether a line may be a page number, by its style."""
    return not ELEVEN_LETTERS.search(line) and numbered(style(line))


@lru_cache(maxsize=100_000)
def folded(line: str) -> str:
    """A line without numbers, case and signs."""
    return " ".join(re.findall(r"[^\W_]+", NUMBER.sub(" ", line).lower()))


@lru_cache(maxsize=100_000)
def needed(line: str) -> int:
    """How often a line has to come again to be a header: once; more often if it is one word or ends like a sentence, never if it is too short or a row of a table."""
    x = folded(line)
    if line.count("|") > 1 or not (len(x) >= 8 or len(HAN.findall(x)) >= 4):
        return 1000
    return 1 + (" " not in x and not HAN.search(x)) + bool(SENTENCE_END.search(line))


def nearly(a: str, b: str) -> bool:
    """Whether two strings differ in at most two single places, or in one stretch of up to two characters; one end of them is the same."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 4 or a[:3] != b[:3] and a[-3:] != b[-3:]:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    s = next((i for i, (x, y) in enumerate(zip(reversed(a[p:]), reversed(b[p:]))) if x != y), min(len(a), len(b)) - p)
    if max(len(a), len(b)) - p - s <= 2:
        return True
    return len(a) == len(b) and len(a) >= 6 and sum(x != y for x, y in zip(a, b)) <= 2


def shape(line: str) -> str:
    """The form of a line: of Latin words the case and of numbers the place; of Han text the last two characters."""
    x = re.sub(r"^\S?\s*#\s\s+|\s\s+#\s*\S?$", "", NUMBER.sub("#", line.strip())).strip()
    if HAN.search(x):
        return "…" + x[-2:]
    return re.sub(r"\s+", " ", re.sub(r"[^\W\d_]+", lambda m: "a" if not m[0][0].isupper() else "A" if m[0].isupper() else "Aa", x))


# The first and the last lines of pages, from the edge inwards, by distance.
Edges = dict[int, tuple[list[str], list[str]]]


def judged(line: str, page: int, end: int, edges: Edges, forms: dict[str, str]) -> str:
    """'header', 'page_number' or 'body' for a line at the top (end 0) or bottom (end 1) of page `page`, by the edges of pages around it."""
    need, again = needed(line), 0
    if numbering(line):
        if any(counts_on(line, x, k - page) for k, sides in edges.items() if k != page for x in sides[end]):
            return "page_number"
        if len(style(line)) == 1 and any(len(x) < 40 and len(style(x)) > 1 and numbered(style(x)) and PAGE_NUMBER.match(x) for sides in edges.values() for x in sides[end]):
            return "body"
    elif need < 1000:
        fold, size = folded(line), len(line.strip())
        for k, sides in edges.items():
            if k == page:
                continue
            for x in sides[end]:
                # a number beside the header may come or go, with the space between
                if -16 < len(x.strip()) - size < 16 and ((f := folded(x)) == fold or -3 < len(f) - len(fold) < 3 and nearly(fold, f)):
                    again += 1
                    if again >= need:
                        return "header"
                    break
    return by_form(line, forms, [x for sides in edges.get(page, ()) for x in sides])


def marks(page: int, edges: Edges, forms: dict[str, str]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(line, kind) of the top and of the bottom of a page, from the edge inwards; behind the first body line all are body."""
    out: tuple[list, list] = ([], [])
    for end, lines in enumerate(edges[page]):
        kind = ""
        for x in lines:
            kind = kind if kind == "body" else judged(x, page, end, edges, forms)
            out[end].append((x, kind))
    return out


def first_body(page: int, end: int, edges: Edges, forms: dict[str, str]) -> str | None:
    """The first body line from the top (end 0) or bottom (end 1) of a page; None if there is no such page or it has no such line at its edge."""
    return next((x for x in edges[page][end] if judged(x, page, end, edges, forms) == "body"), None) if page in edges else None


def by_form(line: str, forms: dict[str, str], lines: Iterable[str] = ()) -> str:
    """The kind of a line by its form alone; a line as wide as the others around it is no header."""
    if PAGE_NUMBER.match(line) and re.search(r"\d|[ivxlcIVXLC]{1,7}\s*\W*$|[〇零一二三四五六七八九十百]", line) and not re.fullmatch(r"\s*[a-zA-Z]\s*", line):
        return "page_number"
    if not forms or SENTENCE_END.search(line) or (kind := forms.get(shape(line))) is None:
        return "body"
    return "body" if kind == "header" and len(line.strip()) > 0.9 * max((len(x.strip()) for x in lines), default=1000) else kind


def layout(lines: list[str], forms: dict[str, str], edges: Edges | None = None) -> list[str]:
    """'header', 'page_number', 'blank' or 'body' for each line of a scanned text; edges: those of the pages around it,
    None for a text that may have several pages itself."""
    kinds = ["body" if x.strip() else "blank" for x in lines]
    own = [i for i, k in enumerate(kinds) if k == "body"]
    if edges is not None:
        for at, found in zip((own[:EDGE], own[: -EDGE - 1 : -1]), marks(0, {**edges, 0: edge_lines(lines)}, forms)):
            for i, (_, kind) in zip(at, found):
                if kind != "body":
                    kinds[i] = kind
        return one_style(lines, kinds)
    width = sorted(len(lines[i].strip()) for i in own)[len(own) * 9 // 10]
    seen: dict[str, list[int]] = defaultdict(list)
    folds = {}
    for i in own:
        x = lines[i]
        if numbering(x):
            seen["#" + style(x)].append(i)
        elif len(x.strip()) < 0.95 * width or i == own[0]:
            if needed(x) < 1000:
                folds[i] = f = folded(x)
                for key in {f[:5], f[-5:]}:
                    seen[key].append(i)
    for i in own:
        x = lines[i]
        if i in folds:
            near = {j for key in (folds[i][:5], folds[i][-5:]) for j in seen[key] if abs(j - i) > EDGE and nearly(folds[i], folds[j])}
            kinds[i] = "header" if len(near) >= needed(x) + bool(SENTENCE_END.search(x)) else "body"
        elif numbering(x) and (len(style(x)) > 1 or i in (own[0], own[-1])) and any(counts_on(x, lines[j], None) for j in seen["#" + style(x)] if j != i):
            kinds[i] = "page_number"
        if kinds[i] == "body" and (len(x.strip()) < 0.9 * width or i == own[0]):
            kinds[i] = by_form(x, forms)
    return one_style(lines, kinds)


def one_style(lines: list[str], kinds: list[str]) -> list[str]:
    """kinds, where a number alone is no page number beside page numbers with more to them."""
    at = [i for i, k in enumerate(kinds) if k == "page_number"]
    if len({style(lines[i]) for i in at}) > 1:
        for i in at:
            if style(lines[i]) == "#":
                kinds[i] = "body"
    return kinds


@dataclass
class Language:
    """What the corpus shows: counts of frequent words, word pairs, Han pairs; confusions by what is seen, as (true, log chance); forms of lines."""

    words: dict[str, int]
    pairs: dict[tuple[str, str], int]
    han: dict[str, int]
    n_words: int
    size: int = 0
    confused: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    han_confused: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    forms: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        # filled as texts are examined, when the confusions are known
        self.known, self.threes, self.made = Found(self.sound), Found(self.doubtful), Found(self.candidates)
        self.han_signs: re.Pattern | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "threes", "made", "han_signs")}

    def __setstate__(self, state) -> None:
        self.__dict__ |= state
        self.__post_init__()

    def after(self, a: str, b: str) -> float:
        """log P(b | a), interpolated with the frequency of b."""
        alone = self.words.get(b, UNSEEN) / max(1, self.n_words)
        return math.log(0.6 * self.pairs.get((a, b), 0) / max(1, self.words.get(a, 1)) + 0.4 * alone)

    def candidates(self, word: str) -> list[tuple[str, float]]:
        """(known word, log chance) that a confusion turns into this one, or two into one that has signs in it, where
        so many such words are to be expected that this one can't be left as it is without a look at its neighbours."""
        got: dict[str, float] = {}
        todo, own = [(word, 0.0)], self.words.get(word, 0)
        for _ in range(2 if sum(not c.isalpha() for c in word) > 1 and not word.replace(".", "").isdigit() else 1):
            new = []
            for w, p in todo:
                for i in range(len(w)):
                    for n in (1, 2):
                        if i + n <= len(w):
                            new += [(w[:i] + true + w[i + n :], p + cost) for true, cost in self.confused.get(w[i : i + n], ())]
            for w, p in new:
                if w != word and self.words.get(w, 0) * math.exp(p) * 5 >= own:
                    got[w] = max(p, got.get(w, -99.0))
            todo = new
        return [(w, p) for w, p in sorted(got.items()) if w in self.words]

    def as_is(self, word: str, others: list[tuple[str, float]]) -> float:
        """log of the share of a word's sightings that confusions of the others don't explain."""
        own = self.words.get(word, UNSEEN)
        spared = max(UNSEEN, own - 2 * sum(self.words[w] * math.exp(p) for w, p in others))
        return math.log(min(1.0, spared / own))

    def doubtful(self, three: str) -> bool:
        """Whether the middle one of three characters, of which the others may be line ends, is nearly as likely or likelier another one."""
        a, c, b = three
        fit = lambda x: math.log(self.han.get(a + x, 0) + 0.2) * (a != "\n") + math.log(self.han.get(x + b, 0) + 0.2) * (b != "\n")
        return any(p + fit(true) - fit(c) > -1.0 for true, p in self.han_confused.get(c, ()))

    def sound(self, token: str) -> bool:
        """Whether no word of a token, as it stands between spaces, can be misread."""
        return not any(self.made[w] for w, _, _ in word_parts(token))


@lru_cache(maxsize=100_000)
def word_parts(token: str) -> list[tuple[str, int, int]]:
    """(normal form, start, end) of the words of a token: without signs around them, cut at hyphens, apostrophes and Han characters."""
    out = []
    for m in PART.finditer(token):
        a, b = m.span()
        while a < b and token[a] in BEFORE:
            a += 1
        while b > a and token[b - 1] in AFTER:
            b -= 1
        w = translated(token[a:b].lower(), ZEROS)
        # letters before a number in a code mean nothing; short words are like too many others
        if len(w) >= 3 or len(w) == 2 and not w.isalpha() and any(map(str.isalnum, w)):
            if not w.replace(".", "").isdigit():
                out.append((w, a, b))
    return out


def decode_words(line: str, lang: Language, first: str = "", last: str = "") -> tuple[str, bool]:
    """(corrected line, whether a word of it was misread). first and last: what the line's cut words have on the neighbouring lines."""
    if not (first or last) and all(map(lang.known.__getitem__, pieces(line))):
        return line, False
    tokens = line.split()
    if all(map(lang.known.__getitem__, tokens[bool(first) : len(tokens) - bool(last)])):
        ends = [first.lower() + w for w, _, _ in word_parts(tokens[0])[:1]] if first and tokens else []
        ends += [w + last.lower() for w, _, _ in word_parts(tokens[-1])[-1:]] if last and len(tokens) > bool(first) else []
        if (not last or len(tokens) > bool(first)) and not any(map(lang.made.__getitem__, ends)):
            return line, False
    spans: list[tuple[str, int, int, str, str]] = []
    matches = list(TOKEN.finditer(line))
    for n, m in enumerate(matches):
        parts = word_parts(m[0])
        for k, (w, a, b) in enumerate(parts):
            head = first.lower() if first and not n and not k and not re.search(r"\w", m[0][:a]) else ""
            tail = last.lower() if last and n == len(matches) - 1 and k == len(parts) - 1 and not re.search(r"\w", m[0][b:]) else ""
            spans.append((head + w + tail, m.start() + a, m.start() + b, head, tail))
    states: list[list[tuple[str, float]]] = []
    for w, a, b, head, tail in spans:
        others = lang.made[w]
        here = [(w, lang.as_is(w, others))]
        for c, p in others:
            k = next((i for i, (x, y) in enumerate(zip(c, w)) if x != y), min(len(c), len(w)))
            if len(head) <= k <= len(w) - len(tail):
                here.append((c, p))
        states.append(here)
    if all(len(s) == 1 for s in states):
        return line, False
    best: list[list[tuple[float, int]]] = []
    for n, here in enumerate(states):
        row = []
        for w, cost in here:
            if n == 0:
                row.append((cost + lang.after("", w), -1))
            else:
                row.append(max((best[n - 1][j][0] + lang.after(states[n - 1][j][0], w) + cost, j) for j in range(len(best[n - 1]))))
        best.append(row)
    i = max(range(len(best[-1])), key=lambda k: best[-1][k][0])
    out, misread = line, False
    for n in range(len(states) - 1, -1, -1):
        if i:
            misread = True
            w, a, b, head, tail = spans[n]
            new, own = states[n][i][0], line[a:b]
            new = new[len(head) : len(new) - len(tail)] if new.startswith(head) and new.endswith(tail) else own.lower()
            if re.search(r"\d", own) and not re.search(r"[^\W\d_]", new):  # a number: its own digits, the rest as the digits they look like
                new = own.translate(LIKE_DIGITS)
            out = out[:a] + (new.upper() if own.isupper() and len(own) > 1 else new[:1].upper() + new[1:] if own[:1].isupper() else new) + out[b:]
        i = best[n][i][1]
    return out, misread


def decode_han(line: str, lang: Language, before: str = "", behind: str = "") -> tuple[str, bool]:
    """(corrected line, whether a character was misread), by Viterbi over characters that are taken for one another.

    before and behind: the characters that the text has on both sides of the line.
    """
    if not lang.han_confused or not has_han(line):
        return line, False
    if lang.han_signs is None:
        lang.han_signs = re.compile("[" + "".join(map(re.escape, sorted(lang.han_confused))) + "]")
    if not lang.han_signs.search(line):
        return line, False
    a, b = len(line) - len(line.lstrip()), len(line.rstrip())
    run = line[a:b]
    text = translated(before[-1:] + run + behind[:1], ONE_SIGN)
    at = len(before[-1:])
    pair = lambda x, y: math.log(lang.han.get(x + y, 0) + 0.2)
    padded = "\n" + text + "\n"
    if not any(lang.threes[padded[m.start() + at : m.end() + at + 2]] for m in lang.han_signs.finditer(run)):
        return line, False
    states = [[(c, 0.0)] for c in text]
    for i, c in enumerate(run):
        states[at + i] += lang.han_confused.get(c, [])
    score: list[tuple[float, int]] = [(p + 0.0, -1) for _, p in states[0]]
    back: list[list[tuple[float, int]]] = [score]
    for n in range(1, len(states)):
        if len(states[n - 1]) == 1:
            x, s = states[n - 1][0][0], back[-1][0][0]
            back.append([(s + pair(x, c) + p, 0) for c, p in states[n]])
            continue
        score = [max((back[-1][j][0] + pair(states[n - 1][j][0], c) + p, -j) for j in range(len(states[n - 1]))) for c, p in states[n]]
        back.append([(s, -j) for s, j in score])
    i = max(range(len(back[-1])), key=lambda k: (back[-1][k][0], -k))
    new = list(run)
    misread = False
    for n in range(len(states) - 1, -1, -1):
        if i and at <= n < at + len(run):
            misread = True
            new[n - at] = states[n][i][0]
        i = back[n][i][1]
    return line[:a] + "".join(new) + line[b:], misread


def cut_word(line: str, following: str | None, lang: Language) -> bool:
    """Whether the last word of a body line is cut by a hyphen and goes on in the following body line.

    A prefix before a word like 'and' shares the end of a later word, unless the two make a known one.
    """
    if following is None or line.rstrip()[-1:] not in ANY_HYPHEN or not (m := HYPHEN.search(line)):
        return False
    word = LETTERS.match(following)
    if not word or HAN.search(m[1]) or HAN.search(word[1]):
        return False
    left, right = m[1].lower(), word[1].lower()
    known = left + right in lang.words
    if line.rstrip()[-1] in RARE_HYPHENS:
        return known
    if not known and (right in SUSPENDED or lang.words.get(right, 0) > COMMON * lang.n_words and left not in lang.words):
        return False
    return not (m[1].isupper() and len(m[1]) < 2 and not word[1].isupper())


def examine(text: str, lang: Language, edges: Edges | None = None) -> tuple[list[tuple[int, str]], list[str]]:
    """Defects (line_no, defect) of a scanned text, and its corrected body lines; a cut word's line ends with a NUL.

    edges: edge lines of the pages around this one, by distance; None where the text isn't one page of a file.
    A word cut between two pages is put whole at the end of the first.
    """
    lines = text.split("\n")
    kinds = layout(lines, lang.forms, edges)
    found = [(i + 1, k) for i, k in enumerate(kinds) if k in ("header", "page_number")]
    body = [i for i, k in enumerate(kinds) if k == "body"]
    following = before = None
    if edges:
        around = {**edges, 0: edge_lines(lines)}
        following, before = first_body(1, 0, around, lang.forms), first_body(-1, 1, around, lang.forms)
    repaired: list[str] = []
    joined = HYPHEN.search(before)[1] if before and body and cut_word(before, lines[body[0]], lang) else ""
    taken = bool(joined)
    for n, i in enumerate(body):
        line = lines[i]
        nxt = lines[body[n + 1]] if n + 1 < len(body) else following
        is_cut = cut_word(line, nxt, lang)
        tail = LETTERS.match(nxt)[1] if is_cut else ""
        fixed, bad = decode_words(line, lang, joined, tail)
        prev = lines[body[n - 1]].rstrip() if n else ""
        fixed, odd = decode_han(fixed, lang, prev, (nxt or "").lstrip())
        if is_cut:
            found.append((i + 1, "hyphen"))
        joined = HYPHEN.search(line)[1] if is_cut else ""
        if bad or odd:
            found.append((i + 1, "misread"))
        gap = n and i > body[n - 1] + 1 and any(kinds[j] == "blank" for j in range(body[n - 1] + 1, i)) and not any(kinds[j] in ("header", "page_number") for j in range(body[n - 1] + 1, i))
        if gap:
            repaired.append("")
        repaired.append(HYPHEN.sub(lambda m: m[1] + "\0", fixed) if is_cut else fixed)
    if repaired and repaired[-1].endswith("\0") and following:
        whole = decode_words(following, lang, joined)[0]
        repaired.append(TOKEN.search(whole)[0])
    if taken and repaired:
        word = TOKEN.search(repaired[0])
        repaired[0] = repaired[0][word.end() :] if word else ""
        if not repaired[0].strip():
            repaired.pop(0)
    return found, repaired


def paragraphs(lines: list[str]) -> str:
    """Body lines as continuous paragraphs: cut words joined, Han lines without a space between, others with one."""
    out: list[str] = []
    for x in lines:
        x = re.sub(r"\s+[-‐‑¬]$", "", x.strip())
        if not x:
            out.append("\n\n")
        elif not out or out[-1].endswith(("\n\n", "\x00")):
            out.append(x)
        else:
            between = "" if HAN.search(out[-1][-1:] + x[:1]) or re.search("[，。；？！、]$", out[-1]) else " "
            out.append(between + x)
    return re.sub(r"\n{3,}", "\n\n", "".join(out).replace("\x00", "")).strip()


class Tally:
    """Counts the words, word pairs and Han pairs of texts. They are gathered as numbers, which are sorted to be counted."""

    def __init__(self) -> None:
        self.ids = Numbers({"\n": 0})  # 0 stands between texts
        self.seen, self.lines, self.wide = array("q"), [], 0
        self.words, self.pairs, self.han = Counter(), Counter(), Counter()

    def __len__(self) -> int:
        return len(self.words) + len(self.pairs) + len(self.han)

    def add(self, text: str) -> None:
        if has_han(text):
            self.lines += (own := han_lines(text))
            self.wide += sum(map(len, own))
            text = HAN_RUN.sub(" ", text)
        self.seen.extend(map(self.ids.__getitem__, WORD.findall(translated(text.lower(), ZEROS))))
        self.seen.append(0)

    def count(self) -> None:
        """Sort and count what was gathered."""
        words = np.frombuffer(self.seen, np.int64)
        han = np.frombuffer("\n".join(self.lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        found, n = np.unique(words[words > 0], return_counts=True)
        for k, x in zip(found.tolist(), n.tolist()):
            self.words[k] += x
        for into, a, none in ((self.pairs, words, 0), (self.han, han, ord("\n"))):
            found, n = np.unique(((a[:-1] << 32) | a[1:])[(a[:-1] != none) & (a[1:] != none)], return_counts=True)
            for k, x in zip(found.tolist(), n.tolist()):
                into[k] += x
        self.seen, self.lines, self.wide = array("q"), [], 0

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The counts so far, as (kind, key, n); they begin anew."""
        word, low = list(self.ids), 0xFFFFFFFF
        for kind, seen, name in (("w", self.words, word.__getitem__), ("p", self.pairs, lambda k: word[k >> 32] + " " + word[k & low]), ("h", self.han, lambda k: chr(k >> 32) + chr(k & low))):
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(seen), pa.string()), pa.array(list(map(name, seen)), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["kind", "key", "n"])
        self.__init__()


def count_language(texts: DataFrame, share: float = SIZE) -> Language:
    """Language of all texts(text): one pass with counts per task, added up by Spark; only entries of at
    least `share` of all of their kind, and LEAST, are collected, hence at most 1 / share of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, size = Tally(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                size += len(text)
                seen.add(text)
                if len(seen.seen) + seen.wide > GATHERED:
                    seen.count()
                    if len(seen) > 300_000:
                        yield from seen.flush()
        seen.count()
        yield from seen.flush()
        yield pa.RecordBatch.from_arrays([pa.array(["s"]), pa.array([""]), pa.array([size], pa.int64())], names=["kind", "key", "n"])

    counts = cut(texts.where("length(text) > 0").select("text").mapInArrow(run, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    total = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(*(F.lit(x) for k in "whp" for x in (k, max(LEAST, int(share * total.get(k, 0))))))
    got: dict[str, dict[str, int]] = {"w": {}, "p": {}, "h": {}}
    for r in counts.where(F.col("n") >= least[F.col("kind")]).collect():
        got[r["kind"]][r["key"]] = r["n"]
    return Language(got["w"], {tuple(k.split(" ")): n for k, n in got["p"].items()}, got["h"], total.get("w", 0), total.get("s", 0))


# (kind, true, seen, place), weight
Event = tuple[tuple[str, str, str, str], float]


class Observer:
    """Sees in scanned lines what may be confusions: rare words one place from a frequent one, and Han characters that
    fit their neighbours badly where another fits well."""

    def __init__(self, lang: Language) -> None:
        self.lang = lang
        self.open: dict[tuple[str, str], list[tuple[str, int]]] = defaultdict(list)
        for w, n in lang.words.items():
            if n >= LEARN * lang.n_words and (len(w) >= 4 or w[0].isdigit() and len(w) > 1):
                for i in range(len(w)):
                    for k in (1, 2):
                        if i + k <= len(w):
                            self.open[w[:i], w[i + k :]].append((w[i : i + k], n))
        self.next: dict[str, dict[str, int]] = defaultdict(dict)
        for p, n in lang.han.items():
            self.next[p[0]][p[1]] = n
        self.rare = 20 * max(LEAST, int(SIZE * sum(lang.han.values())))
        # which pairs aren't rare: a table of the characters that are first and second in such
        often = [p for p, n in lang.han.items() if n >= self.rare]
        self.left, self.right = np.zeros(0x110000, np.uint16), np.zeros(0x110000, np.uint16)
        for k, into in ((0, self.left), (1, self.right)):
            own = [*map(ord, dict.fromkeys(p[k] for p in often))]
            into[own] = np.arange(1, len(own) + 1)
        self.often = np.zeros((self.left.max() + 1, self.right.max() + 1), bool)
        for a, b in often:
            self.often[self.left[ord(a)], self.right[ord(b)]] = True
        self.seen, self.parts = Found(self.of_word, 300_000), Found(self.of_token, 300_000)

    def of_words(self, text: str) -> Iterator[Event]:
        """The events of a text's words."""
        return chain.from_iterable(map(self.parts.__getitem__, pieces(text)))

    def of_token(self, token: str) -> list[Event]:
        """The events of those words of a token that may be misread."""
        own = self.lang.words
        return [e for w, _, _ in word_parts(token) if own.get(w, 0) < LEARN * 20 * self.lang.n_words for e in self.seen[w]]

    def of_word(self, w: str) -> list[Event]:
        """('word', true, seen, word) and a weight for each confusion that turns a much more frequent word into this one."""
        own, out = self.lang.words.get(w, 0), []
        for i in range(len(w)):
            for k in (1, 2):
                if i + k > len(w):
                    continue
                seen = w[i : i + k]
                for true, n in self.open.get((w[:i], w[i + k :]), ()):
                    # a letter more, a letter less, another last letter: words are so inflected
                    if true == seen or n < 20 * own or k + len(true) > 3 or k > 1 and true in seen or len(true) > 1 and seen in true or i + k == len(w) and seen.isalpha() and len(true) == 1 and not true.isdigit():
                        continue
                    out.append((("word", true, seen, w), float(n)))
        total = sum(x for _, x in out)
        return [(e, x / total) for e, x in out]

    def of_han(self, text: str) -> list[Event]:
        """('han', true, seen, neighbours) and a weight for the characters of a text's lines."""
        if not has_han(text):
            return []
        count, out = self.lang.han.get, []
        s = "\n".join(han_lines(text))
        codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = codes != ord("\n")
        rare = ~self.often[self.left[codes[:-1]], self.right[codes[1:]]] & inside[:-1] & inside[1:]
        for i in (np.flatnonzero(rare[:-1] & rare[1:]) + 1).tolist():
            if s[i] != "0":
                a, b = s[i - 1], s[i + 1]
                left, right = 20 * max(1, count(a + s[i], 0)), 20 * max(1, count(s[i] + b, 0))
                fit = {c: (x, y) for c, x in self.next[a].items() if x >= left and c != "0" and c != " " and (y := count(c + b, 0)) >= right}
                total = sum(x * y for x, y in fit.values())
                out += [(("han", c, s[i], a + b), x * y / total) for c, (x, y) in fit.items() if c != s[i]]
        return out


def learn_confusions(pages: DataFrame, lang: Language) -> None:
    """Fill in the confusions of `lang` from all scanned pages(text); those are kept that
    several different words show, or whose Han character does so often, and that have a ten-thousandth of all sightings; at most some 10,000 reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        eye = Observer(lang)
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(seen)
            made = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(4)), pa.array([seen[k] for k in keys], pa.float64())], names=["kind", "true", "seen", "place", "n"])
            seen.clear()
            return made

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen["size", "", "", ""] += len(text)
                for key, p in eye.of_words(text):
                    seen[key] += p
                for key, p in eye.of_han(text):
                    seen[key] += p
            if len(seen) > 200_000:
                yield flush()
        yield flush()

    events = pages.select("text").mapInArrow(run, "kind string, true string, seen string, place string, n double").groupBy("kind", "true", "seen", "place").agg(F.sum("n").alias("n"))
    sums = cut(events.groupBy("kind", "true", "seen").agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0.3, 1)).alias("places")))
    total = {r["kind"]: r["n"] for r in sums.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    least = F.greatest(F.lit(SIGHTINGS), F.create_map(*(F.lit(x) for k in ("word", "han", "size") for x in (k, 1e-4 * total.get(k, 0.0))))[F.col("kind")])
    words = sums.where((F.col("kind") == "word") & (F.col("n") >= least) & (F.col("places") >= SIGHTINGS))
    of_seen = sums.where("kind = 'han'").groupBy("seen").agg(F.sum("n").alias("all"), F.max("n").alias("top"), F.lit("han").alias("kind")).where(F.col("all") >= least)
    han = sums.join(F.broadcast(of_seen), ["kind", "seen"]).where("n >= 0.05 * top").select(*words.columns)
    rows = words.unionByName(han).collect()
    chances(lang, [(r["kind"], r["true"], r["seen"], r["n"]) for r in rows], total.get("size", 0.0) / max(1, lang.size))


def chances(lang: Language, sums: list[tuple[str, str, str, float]], share: float) -> None:
    """Set the confusions of `lang` from (kind, true, seen, sightings): the log of the share of a true character's places
    in scanned text, which is `share` of all."""
    places: Counter = Counter()
    for w, n in lang.words.items():
        for k in (1, 2):
            for i in range(len(w) - k + 1):
                places["word", w[i : i + k]] += n
    for p, n in lang.han.items():
        places["han", p[0]] += n
    top: dict[tuple[str, str], float] = defaultdict(float)
    for kind, _, seen, n in sums:
        top[kind, seen] = max(top[kind, seen], n)
    for kind, true, seen, n in sorted(sums):
        if n >= 0.05 * top[kind, seen]:
            into = lang.confused if kind == "word" else lang.han_confused
            into.setdefault(seen, []).append((true, math.log(min(0.2, n / max(n, share * places[kind, true])))))


def scanned_pages(records: DataFrame) -> DataFrame:
    """(record_table, record_id, text, paged, around) of the scanned texts of records(record_table, record_id, file_path, page_num, text).

    paged: whether the text is a page of a known file; around: first and last lines of the page itself and the pages up to two before and
    behind, each as "distance, form feed, first lines, form feed, last lines". Pages meet by a join on file and page number, so that no file is held in one task;
    of several records of one page, the neighbours see that of least id. Null, empty and other texts give no row.
    """
    shape_ = "record_table string, record_id bigint, file_path string, page_num int, text string, lines string"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [t.split("\n") for t in batch.column(4).to_pylist()]
            keep = [scanned(x) for x in split]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(["\f".join("\n".join(e) for e in edge_lines([y.replace("\f", "") for y in x])) for x, k in zip(split, keep) if k], pa.string())], names=["record_table", "record_id", "file_path", "page_num", "text", "lines"])

    rows = records.where("length(text) > 0").select("record_table", F.col("record_id").cast("bigint").alias("record_id"), "file_path", F.col("page_num").cast("int").alias("page_num"), "text")
    own = cut(rows.mapInArrow(look, shape_))
    key = ["record_table", "file_path", "page_num"]
    pages = own.where("file_path is not null and page_num is not null").groupBy(*key).agg(F.min_by("lines", F.struct("record_id", "lines")).alias("lines"))
    distances = F.explode(F.array(*(F.lit(k) for k in sorted({*REACH, 0})))).alias("distance")
    sides = pages.select(*key, "lines", distances).select("record_table", "file_path", (F.col("page_num") - F.col("distance")).alias("page_num"), F.concat_ws("\f", F.col("distance").cast("string"), "lines").alias("side"))
    around = sides.groupBy(*key).agg(F.sort_array(F.collect_list("side")).alias("around"))
    return own.drop("lines").join(around, key, "left").select("record_table", "record_id", "text", (F.col("file_path").isNotNull() & F.col("page_num").isNotNull()).alias("paged"), "around")


def _edges(sides: list[str] | None) -> Edges:
    out: Edges = {}
    for s in sides or ():
        distance, top, bottom = s.split("\f")
        out[int(distance)] = (top.split("\n"), bottom.split("\n"))
    return out


def learn_forms(pages: DataFrame, lang: Language) -> None:
    """Fill in the forms of `lang`: shapes of lines at page edges of which FORM_SHARE are headers or page numbers by the pages around them,
    and that at least five pages and a ten-thousandth of all such lines have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for sides in batch.column(0).to_pylist():
                edges = _edges(sides)
                for side in marks(0, edges, {}):
                    seen.update((shape(x), kind) for x, kind in side if not SENTENCE_END.search(x))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["shape", "kind", "n"])

    counts = cut(pages.where("size(around) > 1").select("around").mapInArrow(run, "shape string, kind string, n bigint").groupBy("shape", "kind").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    all_ = counts.groupBy("shape").agg(F.sum("n").alias("all"), F.max_by("kind", "n").alias("kind"), F.max("n").alias("n"))
    for r in all_.where((F.col("all") >= max(5, int(1e-4 * total))) & (F.col("n") >= FORM_SHARE * F.col("all")) & (F.col("kind") != "body")).collect():
        lang.forms[r["shape"]] = r["kind"]


def train(records: DataFrame, pages: DataFrame) -> Language:
    """Language of all records(text), with the confusions and forms of the scanned pages."""
    lang = count_language(records)
    learn_confusions(pages, lang)
    learn_forms(pages, lang)
    return lang


def defects(pages: DataFrame, lang: Language) -> DataFrame:
    """(record_table, record_id, line_no, defect) of scanned_pages; copied rows give theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for table, rid, text, paged, sides in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(table, rid, n, d) for n, d in examine(text, lang, _edges(sides) if paged else None)[0]]
            cols = list(zip(*out)) or [()] * 4
            types = [pa.string(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["record_table", "record_id", "line_no", "defect"])

    return pages.mapInArrow(run, "record_table string, record_id bigint, line_no int, defect string").distinct()


def repaired(pages: DataFrame, lang: Language) -> DataFrame:
    """(record_table, record_id, text) of scanned_pages: paragraphs without page marks, cut words joined, misread words corrected.

    A word that goes on on the next page of its file stands whole on the first of the two. Copied rows give theirs once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(t, i, paragraphs(examine(x, lang, _edges(sides) if paged else None)[1])) for t, i, x, paged, sides in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in ((0, pa.string()), (1, pa.int64()), (2, pa.string()))], names=["record_table", "record_id", "text"])

    return pages.mapInArrow(run, "record_table string, record_id bigint, text string").distinct()
