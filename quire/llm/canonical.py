"""One consistent form for texts that look the same but differ in their characters."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut

# Letters of other scripts whose shape is that of a Latin letter.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Һ": "h", "Ӏ": "I", "Ԁ": "d",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "ո": "n", "ս": "u", "օ": "o", "հ": "h", "ց": "g", "զ": "q", "Տ": "S", "Օ": "O", "Լ": "L", "ɡ": "g", "ɑ": "a", "ı": "ı",
    "ſ": "s", "‚": ",", "∶": ":", "ꞌ": "'", "ʼ": "’", "′": "'", "∕": "/", "⁄": "/", "﹘": "—", "−": "-",
    "‐": "-", "‑": "-", "⁃": "-", "˗": "-", "﹣": "-", "۔": "-", "・": "·", "‧": "·", "･": "·", "∙": "·", "⋅": "·", "·": "·",
    "⺀": "⺀", "⻆": "角", "⻘": "青", "⺠": "民", "⻄": "西", "⻅": "见", "⻓": "长", "⻔": "门", "⻛": "风", "⻝": "食", "⻢": "马", "⻥": "鱼", "⻩": "黄", "⻬": "齐", "⻰": "龙", "⻚": "页", "⻋": "车",
}
# Decompositions of these kinds change what is seen, as x² to x2, so they are kept as they are.
VISIBLE = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>", "<font>")
IGNORABLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\x00-\x08\x0e-\x1f\x7f]+")
BLANK = regex.compile(r"[\p{Zs}\t]")
FULL_STOPS = {"。": "。", "｡": "。"}


class _Fold(dict):
    """Code point to its form, filled as code points are met; at most one entry per code point."""

    def __missing__(self, cp: int) -> str:
        ch = chr(cp)
        kind = unicodedata.decomposition(ch)
        if ch in FULL_STOPS:
            out = FULL_STOPS[ch]
        elif unicodedata.category(ch) == "Zs" or ch == "\t":
            out = " "
        elif kind.startswith(VISIBLE):
            out = ch
        else:
            out = unicodedata.normalize("NFKD", ch)
        out = "".join(LOOKALIKES.get(c, c) for c in out)
        self[cp] = out
        return out


_FOLD = _Fold()


def canonical(text: str, fold_case: bool = False) -> str:
    """The form of one text; equal for exactly the texts that look the same.

    Ends of lines become \\n, every space character one space of the usual width, characters that show
    nothing vanish, widths, ligatures, radicals and look-alike letters get their usual code point, and
    accents are composed again. Space at both ends shows nothing and is dropped. fold_case adds full
    case folding.
    """
    if text.isascii():
        out = IGNORABLE.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
        out = BLANK.sub(" ", out)
    else:
        out = IGNORABLE.sub("", text.replace("\r\n", "\n").replace("\r", "\n").replace(" ", "\n").replace(" ", "\n\n"))
        out = unicodedata.normalize("NFC", unicodedata.normalize("NFC", out).translate(_FOLD))
    out = out.strip()
    return unicodedata.normalize("NFC", out.casefold()) if fold_case else out


def canonical_column(col: Column | str, fold_case: bool = False) -> Column:
    """Column with the form of each text, worked out once per distinct value of a batch; null stays null."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map({t: canonical(t, fold_case) for t in texts.dropna().unique()})

    return form(col)


def with_canonical(df: DataFrame, text: str, out: str = "canonical", fold_case: bool = False) -> DataFrame:
    """df with a further column `out`, replaced where it exists."""
    return df.withColumn(out, canonical_column(F.col(text), fold_case))


def same_look_classes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row of `rows` that has a text: key, raw_hash, look_hash (128-bit digests).

    Null texts take no part; empty texts look like each other and like texts of invisible characters only.
    Copied rows come out once. Texts don't leave the map side: only digests are shuffled.
    """
    form = canonical_column(F.col(text))
    return (
        rows.where(F.col(text).isNotNull())
        .select(F.col(key).alias("key"), F.md5(F.col(text).cast("binary")).alias("raw_hash"), F.md5(form.cast("binary")).alias("look_hash"))
        .distinct()
    )


def same_look_pairs(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs key_a < key_b whose texts differ as stored but look the same.

    Forms are first paired as stored, and only then do the keys of both come in: so exact copies of one
    form, however many, never meet each other.
    """
    classes = cut(same_look_classes(rows, key, text))
    forms = classes.select("look_hash", "raw_hash").distinct()
    mixed = forms.groupBy("look_hash").agg(F.count("*").alias("n")).where("n > 1").select("look_hash")
    part = forms.join(mixed, "look_hash", "left_semi")
    pairs = part.toDF("look_hash", "raw_x").join(part.toDF("look_hash", "raw_y"), "look_hash").where("raw_x < raw_y").drop("look_hash")
    keys = classes.select("raw_hash", "key")
    near = pairs.join(keys.toDF("raw_x", "key_x"), "raw_x").join(keys.toDF("raw_y", "key_y"), "raw_y").where("key_x <> key_y")
    return near.select(F.least("key_x", "key_y").alias("key_a"), F.greatest("key_x", "key_y").alias("key_b")).distinct()
