"""Reproducible draws: the first bits of an MD5 over seed and counters, the same in any engine.

32 bits for up to 2^24 things and 60 bits for more, so none is drawn more than 1/256 more often than another; more than 2^52 are refused.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TooLargeError

WIDE, MOST = 1 << 24, 1 << 52


def _digits(n: int) -> int:
    """Hexadecimal digits of the MD5 to draw one of n things by."""
    if n > MOST:
        raise TooLargeError(f"a draw from more than {MOST}")
    return 8 if n <= WIDE else 15


def hash_draw(n: Column | int, *parts: Column | int | str) -> Column:
    """A whole number from 0 to n - 1 for the parts, joined by colons."""
    text = F.md5(F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)))
    first = lambda digits: F.conv(F.substring(text, 1, digits), 16, 10).cast("bigint")
    if not isinstance(n, Column):
        return first(_digits(n)) % F.lit(n)
    refused = F.raise_error(F.lit(f"a draw from more than {MOST}")).cast("bigint")
    return F.when(n <= WIDE, first(8) % n).when(n <= MOST, first(15) % n).when(n > MOST, refused)


def hash_number(n: int, *parts: int | str) -> int:
    """The same in Python."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[: _digits(n)], 16) % n
