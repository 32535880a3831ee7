"""Codes of a rating in the notations of different hands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: other notations of the digits 0 to 9, each string in order
_DIGITS = ("０１２３４５６７８９", "٠١٢٣٤٥٦٧٨٩", "⓪①②③④⑤⑥⑦⑧⑨", "⁰¹²³⁴⁵⁶⁷⁸⁹", "₀₁₂₃₄₅₆₇₈₉")
FROM = "".join(_DIGITS) + "（）． 　"
TO = "0123456789" * len(_DIGITS) + "().  "


def code_of(column: Column | str, classes: int = 5) -> Column:
    """The whole number from 1 to `classes` (at most 9) that a text is, in whatever notation (`3`, ` 03 `, `3.0`, `3.`, `(3)`, full-width), else null."""
    v = F.col(column) if isinstance(column, str) else column
    number = rf"\+?0*([1-{classes}])(?:[.,]0*)?"
    # a bracket before asks for its own after, and none for none
    before = r"(?:\((?=[^()\[\]]*\)\s*$)|\[(?=[^()\[\]]*\]\s*$)|(?=[^()\[\]]*$))"
    digit = F.regexp_extract(F.translate(v, FROM, TO), rf"^\s*{before}\s*{number}\s*[)\]]?\s*$", 1)
    # most are plain digits, which need no pattern
    return F.when(v.isin(*(str(c) for c in range(1, classes + 1))), v.try_cast("tinyint")).otherwise(F.nullif(digit, F.lit("")).try_cast("tinyint"))
