"""Text helpers used when building keys and cleaning names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def paste(*cols: Column, sep: str = " ") -> Column:
    """Join texts; a missing part is written as NA."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("NA")) for c in cols])


def remove_first(c: Column, literal: str) -> Column:
    """Remove the first occurrence of a literal piece of text."""
    at = F.instr(c, literal)
    before = F.substring(c, F.lit(1), at - 1)
    after = F.substring(c, at + len(literal), F.length(c))
    return F.when(at > 0, F.concat(before, after)).otherwise(c)


def remove_all(c: Column, literal: str) -> Column:
    return F.replace(c, F.lit(literal), F.lit(""))


def recode(c: Column, mapping: Mapping[str, str]) -> Column:
    """Replace listed values, leave the others as they are."""
    expr = c
    for old, new in mapping.items():
        expr = F.when(c == old, new).otherwise(expr)
    return expr


def categorise(c: Column, groups: Mapping[str, tuple[str, ...]]) -> Column:
    """Category of a value from lists of members; unlisted values are missing."""
    expr = F.lit(None).cast("string")
    for category, members in groups.items():
        expr = F.when(c.isin(list(members)), category).otherwise(expr)
    return expr


def split_part(c: Column, sep: str, parts: int, index: int) -> Column:
    """Piece ``index`` (from 0) after splitting into at most ``parts`` pieces."""
    return F.get(F.split(c, f"\\Q{sep}\\E", parts), F.lit(index))


def p_label(p: Column) -> Column:
    """p-value for print: '< 0.001' or four decimals."""
    return F.when(p < 0.001, "< 0.001").otherwise(F.bround(p, 4).cast("string"))


def level_order(c: Column, levels: Sequence[str]) -> Column:
    """Place of a value in an ordered list of levels, from 1; other values are missing."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), c)
    return F.nullif(place, F.lit(0)).cast("int")
