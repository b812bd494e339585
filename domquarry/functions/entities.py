"""Escaping and unescaping of strings as column functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .references import LONGEST_NAME, WITH_SEMICOLON, number_of, of_name, of_number

_ESCAPES = (("&", "&amp;"), (" ", "&nbsp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"))
_NUMBER = re.compile(r"\s*(?:[xX]\s*(?:0[xX])?([0-9A-Fa-f]+)|([+-]?[0-9]+))\s*(;?)")


def html_escape(column: Column | str) -> Column:
    """Ampersand, no-break space, quote and the angle brackets, by built-in functions only."""
    column = F.col(column) if isinstance(column, str) else column
    for old, new in _ESCAPES:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def unescape(text: str | None) -> str | None:
    """Decodes references. A text whose last ampersand is its last character stays as it is."""
    if text is None or "&" not in text or text.rfind("&") == len(text) - 1:
        return text
    first, *pieces = text.split("&")
    out = [first]
    for piece in pieces:
        stop = piece.find(";", 1, LONGEST_NAME)
        value = WITH_SEMICOLON.get(piece[:stop]) if stop > 0 else None
        if value is not None:
            out += (value, piece[stop + 1 :])
        else:
            found = _decode("&" + piece)
            out += ("&", piece) if found is None else (found[0], piece[found[1] - 1 :])
    return "".join(out)


def _decode(piece: str) -> tuple[str, int] | None:
    """A reference at the beginning: what it stands for and how long it is."""
    lead = re.match(r"&\s*#", piece)
    if lead:
        number = _NUMBER.match(piece, lead.end())
        if not number:
            return None
        code = number_of(number.group(1), 16) if number.group(1) else number_of(number.group(2), 10)
        return of_number(code)[0], number.end() if number.group(3) else number.end(2 if number.group(2) else 1)
    found = of_name(piece, 1)
    return (found[0], found[1] + 1) if found else None


@F.pandas_udf(T.StringType())
def _unescape_udf(column: pd.Series) -> pd.Series:
    return column.map(unescape)


def html_unescape(column: Column | str) -> Column:
    """Python workers get null for a text without an ampersand: the function is taken out of any condition around it."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(_unescape_udf(F.when(F.contains(column, F.lit("&")), column)), column)


def register(spark: SparkSession) -> None:
    """SQL functions html_unescape and html_escape."""
    spark.udf.register("html_unescape", _unescape_udf)
    nested = "t"
    for old, new in _ESCAPES:
        nested = f"replace({nested}, '{old}', '{new}')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION html_escape(t STRING) RETURNS STRING RETURN {nested}")
