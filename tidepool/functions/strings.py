"""String helpers as column expressions; indexes are 0-based where noted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in r"\]^-[" else c for c in chars) + "]"


def tokenize_chars(s: Column, chars: str) -> Column:
    """Tokens between any of the characters, without empty ones."""
    return F.filter(F.split(s, _class(chars)), lambda t: t != "")


def tokenize_text(s: Column, text: str) -> Column:
    return F.filter(F.split(s, "\\Q" + text + "\\E"), lambda t: t != "")


def first_tokens(s: Column, chars: str, n: int) -> Column:
    return F.slice(tokenize_chars(s, chars), 1, n)


def count_tokens(s: Column, chars: str) -> Column:
    return F.size(tokenize_chars(s, chars)).cast("long")


def substring(s: Column, i: int, j: int) -> Column:
    """Characters i to j, 0-based, both included; j beyond the end is the end."""
    return F.substring(s, i + 1, j - i + 1)


def prefix_matches(a: Column, b: Column, case: bool = True) -> Column:
    """Whether the shorter of both begins the longer."""
    a, b = (a, b) if case else (F.upper(a), F.upper(b))
    return F.startswith(a, b) | F.startswith(b, a)


def starts_with(s: Column, text: str, case: bool = True) -> Column:
    return s.startswith(text) if case else F.upper(s).startswith(text.upper())


def ends_with(s: Column, text: str, case: bool = True) -> Column:
    return s.endswith(text) if case else F.upper(s).endswith(text.upper())


def equal_ci(a: Column, b: Column) -> Column:
    return F.upper(a) == F.upper(b)


def find_ci(s: Column, text: str) -> Column:
    """0-based place of the first occurrence in either case, -1 if there is none."""
    return F.locate(text.upper(), F.upper(s)) - 1


def alphanumeric(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9]", "")


def replace_chars(s: Column, chars: str, by: str = "") -> Column:
    """Each of the characters replaced by one, or deleted."""
    return F.translate(s, chars, by * len(chars))


def is_number(s: Column) -> Column:
    """Digits and commas with one point at most; the empty text counts."""
    return s.rlike(r"^[0-9,]*\.?[0-9,]*$")


def is_blank(s: Column) -> Column:
    return s.rlike(r"^[ \t\r\n]*$")


def integers(s: Column) -> Column:
    """All runs of digits as numbers (null where a run is too long for one)."""
    return F.transform(F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("bigint"))


def is_balanced(s: Column) -> Column:
    """Whether round, square and curly brackets close in order (a stack folded over the brackets)."""
    marks = F.split(F.regexp_replace(s, r"[^()\[\]{}]", ""), "")

    def step(stack: Column, c: Column) -> Column:
        top = F.substring(stack, -1, 1)
        pair = F.concat(top, c).isin("()", "[]", "{}")
        return F.when(pair, F.left(stack, F.length(stack) - 1)).otherwise(F.concat(stack, c))

    return F.aggregate(marks, F.lit(""), step) == ""


def to_base(n: Column, base: int) -> Column:
    return F.conv(n.cast("string"), 10, base)


def from_base(s: Column, base: int) -> Column:
    return F.conv(s, base, 10).cast("bigint")


def sort_texts(texts: Column) -> Column:
    """By length, then by bytes."""
    return F.transform(F.array_sort(F.transform(texts, lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))), lambda x: x["t"])


def position(texts: Column, text: Column) -> Column:
    """0-based place in a list, or its size."""
    at = F.array_position(texts, text)
    return F.when(at > 0, at - 1).otherwise(F.size(texts))


def interleave(a: Column, b: Column) -> Column:
    """Elements of two lists in turn; the longer one's rest follows."""
    return F.filter(F.flatten(F.zip_with(a, b, lambda x, y: F.array(x, y))), lambda x: x.isNotNull())


def batches(texts: Column, n: int) -> Column:
    """A list in n parts of nearly equal size."""
    size = F.greatest(F.ceil(F.size(texts) / n).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(texts, i * size + 1, size))
