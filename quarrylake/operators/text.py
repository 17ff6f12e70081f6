"""Cleaning and judging text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_markdown(c: Column) -> Column:
    """Without image comments, with at most one blank line in a row, trimmed."""
    bare = F.regexp_replace(c, r"<!-- *image *-->", "")
    return F.regexp_replace(F.regexp_replace(bare, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def unify_lines(c: Column) -> Column:
    """Line feeds for all line ends."""
    return F.regexp_replace(c, "\r\n?", "\n")


def message_problem(c: Column) -> Column:
    """What is wrong with an assistant's message: empty, revise, dump, repeated_count; null if nothing is."""
    text = F.trim(F.coalesce(c, F.lit("")))
    return (
        F.when(text == "", "empty").when(text.rlike(r"(?m)^REVISE\b"), "revise").when(text.rlike(r'^\{\s*"'), "dump")
        .when(text.rlike(r"\b([0-9]{4,})\b(?s:.*)\b\1\b(?s:.*)\b\1\b"), "repeated_count")
    )


def normalize_answer(c: Column) -> Column:
    """Lower case, plain dashes, quotes and spaces, without brackets; runs of spaces are one."""
    plain = F.translate(F.lower(c), "–—− «»[](){}", "---  \"\"")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def chunks(c: Column, size: int) -> Column:
    """The text in pieces of size characters; an empty text has none."""
    n = F.ceil(F.length(c) / F.lit(size)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def search_form(c: Column) -> Column:
    """Text as it is searched for: NFKC, case folded, ё as е, runs of white space as one space, trimmed; null stays null.

    Spark has no Unicode normalisation, so that step is an Arrow-batched function.
    """

    @F.pandas_udf("string")
    def folded(texts):  # noqa: ANN001, ANN202
        import unicodedata

        return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().replace("ё", "е").split()))

    return folded(c)


def nfc(c: Column) -> Column:
    """Unicode normal form C; null stays null."""

    @F.pandas_udf("string")
    def normal(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))

    return normal(c)
