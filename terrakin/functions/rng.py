"""Random numbers as a function of a key: the same in any order, on any machine, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def uniform(*key: Column | str | int) -> Column:
    """In [0, 1), from the first 32 bits of md5 of the key's parts, joined by ``|``."""
    text = F.concat_ws("|", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
