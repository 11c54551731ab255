"""Column expressions for cleaning and measuring text; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

CONTROL = r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]"


def unify_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n|\r", "\n")


def drop_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def squeeze_blanks(c: Column) -> Column:
    return F.regexp_replace(c, "[ \t]+", " ")


def squeeze_blank_lines(c: Column) -> Column:
    """Runs of blank lines to one; a line of blanks only ends a run, so three newlines can remain."""
    return F.regexp_replace(c, "\n[ \t]*\n+", "\n\n")


def strip_lines(c: Column) -> Column:
    return F.regexp_replace(c, "(?md)^[ \t]+|[ \t]+$", "")


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_structure(c: Column) -> Column:
    """All structural steps in order; null gives an empty text."""
    steps = (unify_newlines, drop_control, squeeze_blanks, squeeze_blank_lines, strip_lines, strip)
    return reduce(lambda x, f: f(x), steps, F.coalesce(c, F.lit("")))


def join_hyphens(c: Column) -> Column:
    """Words cut at a line's end put together again."""
    tight = F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")
    return F.regexp_replace(tight, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")


def merge_lines(c: Column) -> Column:
    """Lines of a scan joined into paragraphs.

    A blank line ends a paragraph, and so does a line that ends a sentence or is followed by one that starts
    with an upper-case letter or a digit. Only the end of the line before and the start of the next
    decide, so no state is carried: the lines are zipped with those before them.
    """
    trimmed = F.transform(F.split(unify_newlines(c), "\n"), lambda x, i: F.struct(strip(x).alias("t"), i.alias("i")))
    lines = F.filter(trimmed, lambda x: x["t"] != "")
    before = F.concat(F.array(F.struct(F.lit("").alias("t"), F.lit(-1).alias("i"))), lines)
    glued = F.zip_with(
        lines,
        F.slice(before, 1, F.size(lines)),
        lambda x, y: F.when(y["i"] < 0, x["t"])
        .when((y["i"] + 1 != x["i"]) | y["t"].rlike(r"[.。!！?？;；:：]$") | x["t"].rlike(r"^[\p{Lu}\p{Nd}]"), F.concat(F.lit("\n\n"), x["t"]))
        .otherwise(F.concat(F.lit(" "), x["t"])),
    )
    text = squeeze_blanks(F.array_join(glued, ""))
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def plain_quotes(c: Column) -> Column:
    """Ligatures as letters, typographic quotes as straight ones."""
    quotes = F.translate(c, "“”‘’", "\"\"''")
    for form, letters in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        quotes = F.replace(quotes, F.lit(form), F.lit(letters))
    return quotes


def strip_bullets(c: Column) -> Column:
    """Without bullets and short ordinals at the start of a line."""
    return F.regexp_replace(c, r"(?m)^[ \t]*(?:[•●▪◦*·-]|\d{1,2}[.)])[ \t]+", "")


def drop_non_ascii(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7f]", "")


def drop_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{P}", "")


def simplified(spark: SparkSession, c: Column) -> Column:
    """Traditional characters as simplified ones, character by character, by the transliterator that Spark ships."""
    return F.translate(c, *_simplified_map(spark))


_maps: dict[str, tuple[str, str]] = {}


def _simplified_map(spark: SparkSession) -> tuple[str, str]:
    if "t2s" not in _maps:
        han = "".join(chr(x) for x in range(0x4E00, 0xA000))
        other = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified").transliterate(han)
        pairs = [(a, b) for a, b in zip(han, other) if a != b] if len(other) == len(han) else []
        _maps["t2s"] = "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
    return _maps["t2s"]


def quality_report(original: Column, cleaned: Column, min_length: int = 10, least_ratio: float = 0.1, most_replaced: float = 0.1) -> Column:
    """Struct of lengths, ratio, three checks, the verdict and the names of what failed."""
    a, b = F.length(F.coalesce(original, F.lit(""))), F.length(F.coalesce(cleaned, F.lit("")))
    ratio = F.when(a > 0, b / a).otherwise(F.lit(1.0))
    valid = F.when(b > 0, F.regexp_count(cleaned, F.lit("�")) / b <= most_replaced).otherwise(F.lit(True))
    long = b >= min_length
    kept = ratio >= least_ratio
    issues = F.filter(F.array(F.when(~long, F.lit("too short")), F.when(~kept, F.lit("over-cleaned")), F.when(~valid, F.lit("invalid characters"))), lambda x: x.isNotNull())
    return F.struct(a.alias("original_length"), b.alias("cleaned_length"), ratio.alias("length_ratio"), valid.alias("char_set_valid"), long.alias("min_length_check"), (long & kept & valid).alias("passed"), issues.alias("issues"))


def clean_with_report(c: Column, name: Column, steps: Callable[[Column], Column] = clean_structure, **limits) -> Column:
    """Struct of a cleaning's result: filename, original and cleaned text, report, success and error. A null text is an error with an empty result."""
    cleaned = F.when(c.isNull(), "").otherwise(steps(c))
    error = F.when(c.isNull(), "no text")
    return F.struct(F.coalesce(name, F.lit("")).alias("filename"), F.coalesce(c, F.lit("")).alias("original_text"), cleaned.alias("cleaned_text"), F.when(c.isNotNull(), quality_report(c, cleaned, **limits)).alias("quality_report"), c.isNotNull().alias("success"), error.alias("error"))


def tokens(c: Column) -> Column:
    """Runs of ASCII letters in lower case, then single Han characters, then runs of digits."""
    low = F.lower(c)
    return F.concat(F.regexp_extract_all(low, F.lit("[a-zA-Z]+"), F.lit(0)), F.regexp_extract_all(low, F.lit("[一-鿿]"), F.lit(0)), F.regexp_extract_all(low, F.lit("[0-9]+"), F.lit(0)))


def token_bag(c: Column) -> Column:
    """What `tokens` gives, in the order of the text, by one pass over it."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-zA-Z]+|[一-鿿]|[0-9]+"), F.lit(0))


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)
