"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Unicode treats as white space when text is
# stripped (tab to carriage return, the four separators, space, next line,
# no-break space and the general punctuation spaces).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: Column) -> Column:
    """Both ends stripped of white space, in one linear pass and without a regex."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def normalized(value: Column) -> Column:
    return F.lower(strip(value))


def is_blank(value: Column) -> Column:
    """True for text that is empty or only white space; null stays null."""
    return strip(value) == F.lit("")


def slug(value: Column) -> Column:
    """Lower-case words joined by single underscores."""
    kept = F.regexp_replace(normalized(value), r"(?U)[^\w\s-]", "")
    joined = F.regexp_replace(kept, r"(?U)[\s-]+", "_")
    return F.btrim(joined, F.lit("_"))


NUMBER = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf(inity)?)\z"


def plain_number(text: Column) -> Column:
    """Stripped text as double where it is a decimal number or ``inf``, else null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def to_number(value: Column) -> Column:
    """Text as double where it is written as a number, else null.

    Signs, exponents, ``inf`` and digit groups joined by single underscores
    are numbers; ``nan`` counts as missing; type suffixes are not numbers.
    """
    text = strip(value)
    joined = F.regexp_replace(text, r"(?<=[0-9])_(?=[0-9])", "")
    return plain_number(F.when(text.contains("_"), joined).otherwise(text))


def comma_count(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit(","), F.lit("")))


def word_count(value: Column) -> Column:
    """Number of white-space separated tokens; 0 for blank text."""
    return F.regexp_count(value, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def token_count(value: Column) -> Column:
    """Number of words and single punctuation marks."""
    return F.regexp_count(value, F.lit(r"(?U)\w+|[^\w\s]"))


def has_digit(value: Column) -> Column:
    return value.rlike(r"(?U)\d")


def list_items(value: Column, separators: str = ",") -> Column:
    """The trimmed items of a separated list."""
    return F.transform(F.split(value, f"[{separators}]"), strip)


def canonical_list(value: Column) -> Column:
    """Lists that differ only in separator, order, spacing or case, as one text.

    The separators are comma, bar and slash. Repeated items are kept, so lists
    with different numbers of items never become equal.
    """
    return F.array_join(F.array_sort(list_items(F.lower(value), ",|/")), ", ")
