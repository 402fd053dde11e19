"""Text normalization."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PUNCTUATION = r"[\[\](),;:]*+"


# The characters Unicode counts as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"[\t-\r \x{85}\p{Z}]"
_OTHER_SPACE = r"[\t-\r\x{85}\p{Z}&&[^ ]]"
# Every run of white space that is not already one plain space.
_SPACE_RUN = rf" *+{_OTHER_SPACE}{SPACE_CLASS}*+| {{2,}}+{SPACE_CLASS}*+"


def trim_space(text: Column) -> Column:
    """Cut Unicode white space from both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def normalize_source(text: Column) -> Column:
    """Lower-case name with every run of other characters turned into one dash."""
    dashed = F.regexp_replace(F.lower(trim_space(text)), r"[^a-z0-9._]++", "-")
    return F.btrim(dashed, F.lit("-"))


def normalize_message(text: Column) -> Column:
    """LF line ends, no blanks at line ends, no white space around the whole."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]++(?=\n)", "")
    several = F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r"))
    return trim_space(F.when(several, lines).otherwise(text))


def _at_most(limit: str) -> str:
    """Pattern of the numbers with as many digits as ``limit`` that do not exceed it."""
    branches = []
    for i, digit in enumerate(limit):
        if digit != "0":
            rest = len(limit) - i - 1
            branches.append(f"{limit[:i]}[0-{int(digit) - 1}][0-9]{{{rest}}}")
    return "(?:" + "|".join(branches + [limit]) + ")"


_INT64 = (
    r"(?:[+-]?0*[0-9]{1,18}"
    rf"|[+]?0*{_at_most(str(2**63 - 1))}"
    rf"|-0*{_at_most(str(2**63))})"
)
_NUMBER_TOKEN = rf"(^| ){_PUNCTUATION}(?=[+-]?[0-9]){_INT64}{_PUNCTUATION}(?= |$)"


def canonical_message(text: Column) -> Column:
    """Lower-case words joined by one space, with each word that is a 64-bit integer replaced by ``#``.

    Edge punctuation does not hide a number.  One regular expression pass instead of a per-word lambda,
    which keeps the expression in generated code.
    """
    words = F.btrim(F.regexp_replace(F.lower(text), _SPACE_RUN, " "), F.lit(" "))
    return F.regexp_replace(words, _NUMBER_TOKEN, "$1#")


def percent(part: Column, total: Column) -> Column:
    """Share in percent with one decimal, rounded half-even on the exact value of the double.

    The fraction is scaled by 2**60, where it is a whole number, so ties are seen exactly.
    """
    value = part.cast("double") * F.lit(100.0) / total.cast("double")
    whole = F.floor(value)
    scaled = ((value - whole) * F.lit(float(2**60))).cast("bigint").cast("decimal(20,0)") * F.lit(10).cast("decimal(2,0)")
    unit = F.lit(2**60).cast("decimal(20,0)")
    digit = F.floor(scaled / unit).cast("bigint")
    rest = (scaled % unit).cast("decimal(20,0)")
    half = F.lit(2**59).cast("decimal(20,0)")
    tenths = whole.cast("bigint") * 10 + digit
    tenths = tenths + F.when((rest > half) | ((rest == half) & (tenths % 2 == 1)), 1).otherwise(0)
    text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))
    return F.when(total == 0, "0.0%").otherwise(text)
