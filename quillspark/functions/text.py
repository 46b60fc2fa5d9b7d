"""Column functions over text: lines, characters, tokens with their line numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What ends a line, for line numbers that count every Unicode line boundary.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# End of fixed values.

EXCERPT = 80


def lines(text: Column) -> Column:
    """The lines of a text at every Unicode line boundary; a last boundary starts no line, an empty text has none."""
    body = F.regexp_replace(text, rf"(?:{LINE_END})\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_END, -1))


def characters(text: Column) -> Column:
    """Code points as one-character strings."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def non_ascii(text: Column) -> Column:
    """Distinct characters beyond ASCII, sorted by code point."""
    found = F.array_distinct(characters(F.regexp_replace(text, r"[\x00-\x7f]+", "")))
    return F.transform(F.array_sort(F.transform(found, lambda c: F.struct(F.ascii(c).alias("code"), c.alias("c")))), lambda x: x["c"])


def filled(text: Column, width: int, fill: str) -> Column:
    """At least width characters, filled from the left; a longer text stays whole, where lpad would cut it."""
    return F.when(F.length(text) < width, F.lpad(text, width, fill)).otherwise(text)


def code_name(char: Column) -> Column:
    """U+ and at least four hexadecimal digits."""
    return F.concat(F.lit("U+"), filled(F.hex(F.ascii(char)), 4, "0"))


def excerpt(text: Column, n: int = EXCERPT) -> Column:
    return F.substring(strip(text), 1, n)


def strip(text: Column) -> Column:
    """Without white space at both ends, white space as Unicode has it."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value being evaluated once however often body uses it: higher-order functions don't share common parts."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """The sum of all numbers before each one. Blocks of about the square root of their number are summed by themselves, so no fold copies a long array at every step."""

    def before(part: Column, start: Column) -> Column:
        zero = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    def summed(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda n, v: n + v))
        return F.flatten(F.zip_with(parts, before(totals, F.lit(0)), before))

    return let(numbers, lambda own: F.when(F.size(own) < 8, before(own, F.lit(0))).otherwise(let(in_blocks(own), summed)))


def in_blocks(values: Column) -> Column:
    """An array that isn't empty, cut into blocks of about the square root of its size."""
    size = F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / size).cast("int") - 1), lambda k: F.slice(values, k * size + 1, size))


def newlines(part: Column) -> Column:
    return F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern, in order, as (line, token); lines are counted by newlines alone."""
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = lambda own: F.slice(F.split(text, pattern, -1), F.lit(1), F.size(own))
    empty = F.array().cast("array<struct<line:int,token:string>>")

    def lined(own: Column) -> Column:
        before = F.zip_with(gaps(own), own, lambda g, t: F.struct(newlines(g).alias("gap"), newlines(t).alias("own")))
        sums = let(before, lambda b: F.zip_with(running_sums(F.transform(b, lambda x: x["gap"] + x["own"])), b, lambda n, x: n + x["gap"] + 1))
        return F.zip_with(sums, own, lambda n, t: F.struct(n.alias("line"), t.alias("token")))

    return F.when(text.rlike(pattern), let(tokens, lined)).otherwise(empty)


def first_line_with(own: Column, needle: Column) -> Column:
    """Number of the first of these lines that contains the needle; null without one, or for an empty needle."""
    numbered = F.filter(F.transform(own, lambda line, i: F.when(F.contains(line, needle), i + 1)), lambda n: n.isNotNull())
    return F.when(needle != "", F.get(numbered, F.lit(0)))


def longest_word(context: Column) -> Column:
    """The longest word of letters with more than three, the first among equals; empty without one. Marks at its ends don't count."""
    words = F.transform(F.split(context, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"""^[.,;:!?"'()\[\]{}]+|[.,;:!?"'()\[\]{}]+$""", ""))
    real = F.filter(words, lambda w: (F.length(w) > 3) & w.rlike(r"^\p{L}+$"))
    return F.aggregate(real, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounded as binary floating point rounds: to the even neighbour at a tie."""
    return F.bround(x, digits)
