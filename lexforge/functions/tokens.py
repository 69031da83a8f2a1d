"""Scalar functions of the identifier pipeline, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where an identifier is split, what is taken out of it, and how long it must be.
CAMEL = r"((?<!(^|[A-Z]))(?=[A-Z])|(?<!^)(?=[A-Z][a-z]))|_"
DIGITS = r"(-?\d+)|(\+1)"
SHORTEST = 4
ONE_KIND = r"^(?:[aeiuo]*|(?!.*ng).[^aeyiuo]*)$"


def strip_digits(c: Column) -> Column:
    """Identifier without numbers."""
    return F.regexp_replace(c, DIGITS, "")


def camel_pieces(c: Column) -> Column:
    """Array of the pieces at humps and underscores, without empty and blank ones."""
    return F.filter(F.split(c, CAMEL), lambda p: F.trim(p) != "")


def one_kind_of_letter(c: Column) -> Column:
    """Only vowels, or a first character followed by no vowel and no "ng" anywhere; false for null and empty."""
    return F.coalesce((c != "") & F.lower(c).rlike(ONE_KIND), F.lit(False))


def is_number(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d+$"), F.lit(False))


def starts_with_number(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d"), F.lit(False))


def ends_with_number(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\d$"), F.lit(False))


def trim_numbers(c: Column) -> Column:
    """Without digits at either end."""
    return F.regexp_replace(F.regexp_replace(c, r"^\d+", ""), r"\d+$", "")


def is_throwable(c: Column) -> Column:
    """Names of exceptions; IOError is none."""
    return c.endswith("Exception") | c.isin("Throwable", "Error")


def long_enough(c: Column) -> Column:
    return F.length(c) >= SHORTEST


def single_piece(c: Column) -> Column:
    """No underscore but at the end."""
    return ~F.regexp_replace(c, "_+$", "").contains("_")


def accepted(c: Column) -> Column:
    """Identifier filter: long enough, not a throwable, and not one kind of letter unless underscores split it."""
    return long_enough(c) & ~(single_piece(c) & one_kind_of_letter(c)) & ~is_throwable(c)


def doc_path(c: Column) -> Column:
    """Part before the last #, or all."""
    return F.when(c.contains("#"), F.regexp_extract(c, "^(.*)#([^#]*)$", 1)).otherwise(c)


def doc_method(c: Column) -> Column:
    """Part after the last #, or nothing."""
    return F.when(c.contains("#"), F.regexp_extract(c, "^(.*)#([^#]*)$", 2)).otherwise(F.lit(""))


def doc_name(path: Column, method: Column) -> Column:
    """``path#method``, or the path alone if there is no method."""
    return F.when(F.coalesce(method, F.lit("")) == "", path).otherwise(F.concat(path, F.lit("#"), method))


def words_of(c: Column) -> Column:
    """Array of the runs of a-z in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
