"""Garbled text from wrong decodings: find the fields, and restore them by minimum description length.

A chain is one wrong step undone: the text's characters are written as bytes of the encoding it was wrongly read
in, and the bytes read again in the right one. Every chain that applies is tried on the stretches it fits; the
description length of a stretch with some context is its zstandard-compressed size under the best of the
languages' dictionaries, plus a charge for characters the corpus doesn't have. The chain whose total, with its
own cost, is least wins, and the search goes on from there for texts garbled twice. Without a saving the text
is left unchanged; so it is where the words with the odd letters are as short to describe with letters of the same look.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.canonical import canonical
from quire.session import spread

SAMPLE_ROWS = 2000
SAMPLE_LENGTH = 4000
DICT_BYTES = 100_000
CONTEXT = 24
NOVEL = 4.0
STEPS = 3
CHAIN_COST = {"utf8": 2.0, "han": 5.0, "byte": 6.0}
MISREAD_AS = ["cp1252", "cp437", "cp850", "cp1251", "koi8_r", "mac_roman", "cp1250", "cp1253", "cp1254", "cp866", "iso8859_7", "iso8859_5", "cp1257", "cp1258", "cp852"]
# Encodings whose letters don't occur beside Latin ones in a word of any language.
OTHER_SCRIPT = ["cp437", "cp850", "cp1251", "koi8_r", "mac_roman", "cp866", "cp1253", "iso8859_7", "iso8859_5"]
MULTIBYTE = ["gb18030", "big5", "shift_jis", "euc_kr"]
# Frequent function words that tell the languages of the sample apart.
FUNCTION_WORDS = {"en": {"the", "of", "and", "was", "with", "in", "to"}, "fr": {"les", "des", "la", "ont", "le", "et", "une"}, "de": {"die", "der", "und", "das", "den", "mit", "nach"}}
HAN = re.compile("[一-鿿]+")
LOST = re.compile("�|锟斤|锟拷|斤拷")
HAN_RUN = re.compile(r"[€㐀-䶿一-鿿！-￮　-〿぀-ㄯΑ-ωЀ-ё©-·×÷Ā-ǿ˙-˙‐-➿가-힣]+")
FOREIGN_WORD = re.compile(r"(?<![^\W\d_])(?:[\u0370-\u03ff\u1f00-\u1fff]{2,}|[\u0400-\u052f]{2,}|[\u0530-\u058f]{2,}|[\u0590-\u05ff]{2,}|[\u0600-\u06ff]{2,}|[\u0900-\u0dff]{2,}|[\u0e00-\u0e7f]{2,}|[\u3040-\u30ff]{2,}|[\uac00-\ud7a3]{2,})(?![^\W\d_])")
MIXED_WORD = re.compile(r"(?=[^\W\d_]*[A-Za-z])(?=[^\s]*[^\x00-\xff])[^\s]{2,}")
HAN_IN_WORD = re.compile(r"[A-Za-z]+[一-鿿]+[A-Za-z]*|[一-鿿][a-z]{2,}")


@lru_cache(maxsize=None)
def byte_of(codec: str) -> dict[str, int]:
    """Character to byte of a one-byte encoding; where a byte has no character, the control character of its number."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
        if codec in ("cp1252", "cp1250", "cp1251", "cp1254"):
            out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=None)
def utf8_pattern(codec: str) -> re.Pattern:
    """Runs whose bytes in `codec` are whole characters of UTF-8."""
    table = byte_of(codec)
    cls = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in table.items() if lo <= b <= hi) + "]"
    c = cls(0x80, 0xBF)
    two = f"{cls(0xC2, 0xDF)}{c}"
    if codec == "cp1252":  # a no-break space is often made an ordinary one afterwards
        two += "|[ÃÂ] "
    return re.compile(f"(?:{two}|{cls(0xE0, 0xEF)}{c}{{2}}|{cls(0xF0, 0xF4)}{c}{{3}})+")


def _to_bytes(run: str, codec: str) -> bytes:
    table = byte_of(codec)
    return bytes(table.get(c) or (0xA0 if c == " " else ord(c)) for c in run)


@lru_cache(maxsize=None)
def high_pair() -> re.Pattern:
    """Two characters that may be the first bytes of UTF-8 in one of the one-byte encodings; a text without any such two has no stretch of it."""
    table = [(c, b) for codec in MISREAD_AS for c, b in byte_of(codec).items()]
    cls = lambda lo, hi: "[" + "".join(re.escape(c) for c in sorted({c for c, b in table if lo <= b <= hi})) + "]"
    return re.compile(f"{cls(0xC2, 0xF4)}{cls(0x80, 0xBF)}|[ÃÂ] ")


@lru_cache(maxsize=None)
def byte_letters() -> frozenset[str]:
    """The characters that a word read as one of OTHER_SCRIPT may have."""
    return frozenset(map(chr, range(256))) | {c for codec in OTHER_SCRIPT for c in byte_of(codec)}


@dataclass
class Seen:
    """A text with what the chains look for in it, found once for all of them."""

    text: str
    _pair: bool | None = None
    _han: list[re.Match] | None = None
    _high: list[re.Match] | None = None
    _mixed: list[tuple[int, int, str]] | None = None

    @property
    def pair(self) -> bool:
        if self._pair is None:
            self._pair = high_pair().search(self.text) is not None
        return self._pair

    @property
    def han(self) -> list[re.Match]:
        if self._han is None:
            self._han = list(HAN_RUN.finditer(self.text))
        return self._han

    @property
    def high(self) -> list[re.Match]:
        if self._high is None:
            self._high = list(HIGH_RUN.finditer(self.text))
        return self._high

    @property
    def mixed(self) -> list[tuple[int, int, str]]:
        """Words with a Latin letter among the first letters and a character above Latin-1, all of which an encoding of OTHER_SCRIPT may give."""
        if self._mixed is None:
            odd = lambda w: not w.isascii() and max(w) > "ÿ" and byte_letters().issuperset(w[-1:]) and MIXED_WORD.search(w)
            self._mixed = []
            if any(map(odd, self.text.split())):
                for t in re.finditer(r"\S+", self.text):
                    m = odd(t[0])
                    if m and byte_letters().issuperset(m[0]):
                        self._mixed.append((t.start() + m.start(), t.end(), m[0]))
        return self._mixed


Stretch = tuple[int, int, str]


@lru_cache(maxsize=None)
def high_pattern(codec: str) -> re.Pattern:
    """Runs of characters that the encoding has above ASCII."""
    return re.compile("[" + "".join(re.escape(c) for c in byte_of(codec)) + "]+")


def utf8_stretches(seen: Seen, codec: str) -> list[Stretch]:
    """UTF-8 that was read as a one-byte encoding. Most of a run of characters above ASCII has to fit, as chance fits only parts."""
    found: list[Stretch] = []
    if not seen.pair:
        return found
    text = seen.text
    for m in utf8_pattern(codec).finditer(text):
        try:
            found.append((m.start(), m.end(), _to_bytes(m[0], codec).decode("utf-8")))
        except UnicodeDecodeError:
            pass
    if not found:
        return found
    out, k = [], 0
    for m in high_pattern(codec).finditer(text):
        inside = []
        while k < len(found) and found[k][0] < m.end():
            if found[k][0] >= m.start():
                inside.append(found[k])
            k += 1
        if sum(min(e, m.end()) - s for s, e, _ in inside) >= 0.7 * (m.end() - m.start()):
            out += inside
    return out


@lru_cache(maxsize=200_000)
def begins_utf8(c: str, codec: str) -> bool:
    """Whether the bytes of a character may begin a text in UTF-8."""
    try:
        raw = c.encode(codec)
    except UnicodeEncodeError:
        return False
    return len(raw) == 1 and raw[0] < 0x80 or 0xC2 <= raw[0] <= 0xF4 and (len(raw) == 1 or 0x80 <= raw[1] <= 0xBF)


def han_stretches(seen: Seen, codec: str) -> list[Stretch]:
    """UTF-8 that was read as a two-byte encoding; the last byte of a run may be lost."""
    out, text = [], seen.text
    for m in seen.han:
        if not begins_utf8(text[m.start()], codec):
            continue
        around = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
        if m.end() - m.start() == 1 and not around.isascii():
            continue
        try:
            raw = m[0].encode(codec)
        except UnicodeEncodeError:
            continue
        try:
            out.append((m.start(), m.end(), raw.decode("utf-8")))
        except UnicodeDecodeError as e:
            if e.start >= 6 and e.start >= len(raw) - 3:
                out.append((m.start(), m.end(), raw[: e.start].decode("utf-8") + "�"))
    return out


HIGH_RUN = re.compile("[\x80-ÿ€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{4,}")


def two_byte_stretches(seen: Seen, codec: str) -> list[Stretch]:
    """A two-byte encoding that was read as a one-byte Western one."""
    out = []
    for m in seen.high:
        try:
            out.append((m.start(), m.end(), _to_bytes(m[0], "cp1252").decode(codec)))
        except UnicodeDecodeError:
            pass
    return out


def byte_stretches(seen: Seen, codec: str) -> list[Stretch]:
    """Western one-byte text that was read as another one-byte encoding, word by word."""
    table = byte_of(codec)
    out = []
    for a, b, word in seen.mixed:
        raw = [n if (n := table.get(c)) else ord(c) for c in word]
        if max(raw) < 256 and any(c in table and table[c] >= 0xC0 for c in word):
            try:
                out.append((a, b, bytes(raw).decode("cp1252")))
            except UnicodeDecodeError:
                pass
    return out


def han_word_stretches(seen: Seen, codec: str) -> list[Stretch]:
    """Western one-byte text that was read as a two-byte encoding."""
    out = []
    for m in HAN_IN_WORD.finditer(seen.text) if seen.han else ():
        try:
            out.append((m.start(), m.end(), m[0].encode(codec).decode("cp1252")))
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    return out


CHAINS = (
    [(f"utf-8 as {c}", "utf8", utf8_stretches, c) for c in MISREAD_AS]
    + [(f"utf-8 as {c}", "han", han_stretches, c) for c in MULTIBYTE]
    + [(f"{c} as cp1252", "han", two_byte_stretches, c) for c in MULTIBYTE]
    + [(f"cp1252 as {c}", "byte", byte_stretches, c) for c in OTHER_SCRIPT]
    + [("cp1252 as gb18030", "byte", han_word_stretches, "gb18030")]
)


@lru_cache(maxsize=None)
def _steps() -> frozenset[str]:
    return frozenset(c for codec in MISREAD_AS for c in byte_of(codec))


@dataclass
class Model:
    """Dictionaries by language, as raw content, and the characters that the sample has."""

    content: dict[str, bytes]
    alphabet: frozenset[str]
    _made: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"content": self.content, "alphabet": self.alphabet, "_made": []}

    def length(self, text: str) -> float:
        """Description length of a text in bytes."""
        if not self._made:
            for d in self.content.values():
                z = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                z.precompute_compress(level=6)
                self._made.append(zstandard.ZstdCompressor(dict_data=z, level=6, write_content_size=False, write_checksum=False, write_dict_id=False))
        raw = text.encode("utf-8", "surrogatepass")
        return min(len(c.compress(raw)) for c in self._made) + NOVEL * self._novel(text)

    def plausible(self, text: str) -> bool:
        """Whether most characters above ASCII are the corpus's, or such as a further wrong step makes."""
        high = [c for c in text if not c.isascii()]
        return sum(c in self.alphabet or c in _steps() for c in high) >= 0.6 * len(high)

    def _novel(self, text: str) -> int:
        """Characters the corpus doesn't have; a sound word of a script other than Latin and Han counts as one."""
        new = [i for i, c in enumerate(text) if not c.isascii() and c not in self.alphabet]
        if not new:
            return 0
        n, sound = len(new), 0
        for m in FOREIGN_WORD.finditer(text):
            w = m[0]
            if w.islower() or w.istitle() or w.isupper() or not any(c.islower() or c.isupper() for c in w):
                inside = sum(m.start() <= i < m.end() for i in new)
                sound += max(0, inside - 1)
        return n - sound


def language(text: str) -> str | None:
    """Language of a clean text of the sample; None where nothing tells."""
    if not text.isascii() and sum(map(len, HAN.findall(text))) > 0.3 * len(text):
        return "zh"
    words = text.lower().split()
    n = {k: sum(map(v.__contains__, words)) for k, v in FUNCTION_WORDS.items()}
    best = max(n, key=n.get)
    return best if n[best] >= 3 else None


def sound_language(t: str) -> str | None:
    """Language of a text without signs of garbling."""
    seen = Seen(t)
    if LOST.search(t) or re.search("[\x80-\x9f]", t) or any(utf8_stretches(seen, c) for c in MISREAD_AS[:6]):
        return None
    return language(t)


def count_characters(texts: Iterable[str]) -> Counter:
    """By language, the sound texts, as (language, ""), and those that have each character."""
    seen: Counter = Counter()
    for t in texts:
        if lang := sound_language(t):
            seen.update((lang, c) for c in {*t, ""})
    return seen


def train(texts: list[str], counts: Counter | None = None) -> Model:
    """A model of a sample; the alphabet is that of `counts`, of the sample itself if not given. Texts with signs of
    garbling, or with characters that are rare in their language, stay out of the dictionaries."""
    counts = count_characters(texts) if counts is None else counts
    groups: dict[str, list[str]] = {}
    for t in texts:
        if lang := sound_language(t):
            groups.setdefault(lang, []).append(t)
    usual: dict[str, set[str]] = {}
    for (lang, c), n in counts.items():
        if c and n >= max(2, counts[lang, ""] // 100):
            usual.setdefault(lang, set()).add(c)
    content = {}
    for lang, group in sorted(groups.items()):
        clean = [t for t in group if usual.get(lang, set()).issuperset(t)]
        sentences = dict.fromkeys(s for t in clean for s in re.split(r"(?<=[.。!?！？；])\s*|\n+", t) if s)
        content[lang] = " ".join(sentences).encode()[-DICT_BYTES:] or b"        "
    return Model(content or {"none": b"        "}, frozenset().union(*usual.values()))


def train_on(rows: DataFrame, key: str, text: str, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model whose alphabet is counted over all rows with 20 code points and more, and whose dictionaries are of at
    most `sample_rows` rows, those of least key hash, whose text has up to SAMPLE_LENGTH code points.

    That many rows of that length are collected, a fixed bound, and one number for each language and character;
    the dictionaries hold DICT_BYTES a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen.update(count_characters(batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "char", "n"])

    long = spread(rows.where(F.length(text) >= 20).select(text))
    counts = Counter({(r["lang"], r["char"]): r["n"] for r in long.mapInArrow(run, "lang string, char string, n bigint").groupBy("lang", "char").agg(F.sum("n").alias("n")).collect()})
    short = rows.where(F.length(text).between(20, SAMPLE_LENGTH)).select(F.xxhash64(key).alias("h"), F.col(text).alias("t"))
    return train([r["t"] for r in short.orderBy("h", "t").limit(sample_rows).collect()], counts)


def _windows(stretches: list[Stretch]) -> list[list[Stretch]]:
    out: list[list[Stretch]] = []
    for s in stretches:
        if out and s[0] - out[-1][-1][1] < 2 * CONTEXT and s[1] - out[-1][0][0] < 1000:
            out[-1].append(s)
        else:
            out.append([s])
    return out


def _put(text: str, stretches: list[Stretch], a: int, b: int) -> str:
    out, at = [], a
    for s, e, new in stretches:
        out += [text[at:s], new]
        at = e
    return "".join(out) + text[at:b]


def undo(text: str, model: Model) -> tuple[str, str] | None:
    """(text with the best chain undone, the chain's name), or None where no chain saves anything."""
    best: tuple[float, str, str] | None = None
    kept: dict[tuple[int, int, bool], float] = {}
    seen = Seen(text)
    for name, kind, find, codec in CHAINS:
        chosen: list[Stretch] = []
        saved = -CHAIN_COST[kind]
        for window in _windows([x for x in find(seen, codec) if model.plausible(x[2])]):
            a, b = max(0, window[0][0] - CONTEXT), min(len(text), window[-1][1] + CONTEXT)
            place = (a, b, kind == "byte")
            if place not in kept:
                kept[place] = model.length(text[a:b])
                if kind == "byte":  # letters that only look alike, and ligatures, are no garbling
                    kept[place] = min(kept[place], model.length(canonical(text[a:b])))
            gain = kept[place] - model.length(_put(text, window, a, b))
            if gain > 0:
                saved += gain
                chosen += window
        if chosen and saved > 0 and (best is None or saved > best[0]):
            best = (saved, _put(text, chosen, 0, len(text)), name)
    return best and best[1:]


def restore(text: str | None, model: Model) -> tuple[str, list[str]] | None:
    """(restored text, chains undone in order), or None for a text that isn't garbled.

    Where only lost characters tell, the list holds 'lost' and what can't be recovered stays as it is.
    """
    if text is None or text.isascii():
        return None
    now, chains = text, []
    for _ in range(STEPS):
        if (step := undo(now, model)) is None:
            break
        now, name = step
        chains.append(name)
    if LOST.search(text):
        chains.append("lost")
    return (now, chains) if chains else None


def garbled_fields(rows: DataFrame, key: str, fields: list[str], model: Model) -> DataFrame:
    """(key, field_name, restored, chains) of each garbled field; copied rows come out once.

    Null, empty and pure ASCII fields never reach Python. One pass over the rows, no shuffle but that
    for copied rows. The model is a fixed few hundred kilobytes in the task closure.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                if found := restore(text, model):
                    out.append((k, name, *found))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], batch.schema.field(0).type), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.string()), pa.array([r[3] for r in out], pa.list_(pa.string()))],
                names=["key", "field_name", "restored", "chains"],
            )

    kind = dict(rows.dtypes)[key]
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields)))
    long = rows.select(F.col(key).alias("key"), pairs.alias("x")).select("key", "x.field_name", "x.text").where(F.col("text").rlike(r"[^\x00-\x7f]"))
    return long.mapInArrow(run, f"key {kind}, field_name string, restored string, chains array<string>").distinct()
