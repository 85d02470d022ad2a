"""Text functions over string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates search terms: everything but letters, marks, digits and connectors.
NOT_A_TERM = "[^\\p{L}\\p{Mn}\\p{Nd}\\p{Pc}]+"


#: A character of a word, and a name of ASCII letters that is a whole word.
IN_WORD = "[\\p{L}\\p{Mn}\\p{Nd}\\p{Pc}]"
CAPITALIZED = f"(?<!{IN_WORD})[A-Z][a-z]++(?!{IN_WORD})"


#: A mail address, and the same for searches in Spark: the local part begins where a run of its characters or the last match does, so long runs are passed once.
EMAIL = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"
_EMAIL_SEARCHED = "(?:\\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"


def searched(pattern: str) -> str:
    """The pattern, or one with the same matches whose search takes time in proportion to the text."""
    if pattern == EMAIL:
        return _EMAIL_SEARCHED
    # a match within a run of digits would begin where the run does
    return "|".join(f"(?:\\G|(?<![0-9])){part}" if part.startswith("[0-9]+") else part for part in pattern.split("|", 1))


def capitalized(text: Column) -> Column:
    """The words of an ASCII capital and small letters, in order."""
    return F.regexp_extract_all(text, F.lit(CAPITALIZED), F.lit(0))


def terms(text: Column) -> Column:
    """Lower-case search terms of at least two characters, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_A_TERM), lambda x: F.char_length(x) >= 2)


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of the lower-case text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    grams = F.transform(F.sequence(F.lit(1), F.char_length(t) - 2), lambda i: F.substring(t, i, 3))
    return F.when(F.char_length(t) >= 3, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s++|(?<!\\s)\\s++$", "")


def sentences(text: Column, newlines: bool = True) -> Column:
    """Sentences, without the characters that end them; ``newlines`` end one too."""
    parts = F.split(F.coalesce(text, F.lit("")), "[.!?\n]" if newlines else "[.!?]")
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != ""))


def tokens_by_length(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters."""
    return F.floor(F.char_length(text) / 4).cast("int")


def tokens_by_words(text: Column) -> Column:
    """Estimated tokens: 1.3 for each word."""
    return (word_count(text) * F.lit(1.3)).cast("int")


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def normalized_hash(text: Column) -> Column:
    """Upper-case hash of the text in lower case, without outer blanks, with newlines alike."""
    plain = F.regexp_replace(stripped(F.lower(text)), "\r\n|\r", "\n")
    return F.upper(F.sha2(F.encode(plain, "utf-8"), 256))


def preview(text: Column, n: int = 100) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def running_sums(sizes: Column) -> Column:
    """The sum of the items before each item, in blocks of about the square root of their number.

    Appending copies what is there, so one long array would cost the square of its length.
    """
    from .vector import let

    none = F.array().cast("array<int>")

    def before(x: Column, start: Column) -> Column:
        step = lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(x, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def blocked(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int")), lambda i: F.slice(x, i * size + 1, size))
        total = lambda b: F.aggregate(b, F.lit(0), lambda acc, v: acc + v)
        return let(blocks, lambda own: F.flatten(F.zip_with(own, before(F.transform(own, total), F.lit(0)), before)))

    return let(sizes, lambda x: F.when(F.size(x) > 0, blocked(x)).otherwise(none))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points."""
    from .vector import let

    pattern = searched(pattern)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.char_length), F.lit(1), F.size(whole))
    steps = F.zip_with(whole, gaps, lambda w, gap: F.struct(w.alias("w"), gap.alias("gap"), (gap + F.char_length(w)).alias("step")))

    def placed(own: Column) -> Column:
        starts = running_sums(F.transform(own, lambda s: s["step"]))
        return F.zip_with(own, starts, lambda s, at: F.struct((at + s["gap"]).alias("start"), (at + s["step"]).alias("end"), s["w"].alias("value")))

    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), let(steps, placed)).otherwise(empty)
