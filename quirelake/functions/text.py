"""Expressions on line texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, digits with superscripts, the marks that end a sentence, and the pattern of
#: page-number-like lines.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]"
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"
ENDS = ".:!?"
NUMERAL = r"^[\p{Nd}IVXLCDMivxlcdm.\-–—" + SPACE[1:-1] + r"]+$"


def strip(t: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(t, f"^{SPACE}+|{SPACE}+$", "")


def blank(t: Column) -> Column:
    return F.coalesce(strip(t) == "", F.lit(True))


def words(t: Column) -> Column:
    return F.filter(F.split(t, f"{SPACE}+"), lambda w: w != "")


def page_number_like(t: Column) -> Column:
    """Digits, roman numerals, dots, dashes and spaces alone."""
    return F.coalesce(t.rlike(NUMERAL), F.lit(False))


def text_features(t: Column, stripped: bool = False) -> dict[str, Column]:
    """Six numbers of a line: length, words, shares of digits and capitals, whether it is a numeral, whether it ends a sentence.

    The empty text ends a sentence: its last character is the empty string, which every string contains.
    """
    s = t if stripped else strip(F.coalesce(t, F.lit("")))
    n, alpha = F.length(s), F.regexp_count(s, F.lit(r"\p{L}"))
    flag = lambda c: c.cast("int").cast("double")
    return {
        "f_len": F.least(n, F.lit(80)) / F.lit(80.0),
        "f_words": F.least(F.size(words(s)), F.lit(20)) / F.lit(20.0),
        "f_digits": F.regexp_count(s, F.lit(DIGIT)) / F.greatest(F.lit(1), n),
        "f_upper": F.regexp_count(s, F.lit(r"\p{Lu}")) / F.greatest(F.lit(1), alpha),
        "f_numeral": flag(page_number_like(s)),
        "f_ends": flag((s == "") | F.right(s, F.lit(1)).isin(*ENDS)),
    }


def strip_suffix(path: Column) -> Column:
    """Without one of the result suffixes."""
    return F.regexp_replace(path, r"(\.alto\.xml|\.xml|\.txt)$", "")
