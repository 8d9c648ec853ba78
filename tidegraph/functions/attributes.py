"""Functions of attribute maps and ids."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F


def merge_attributes(base: Column, newer: Column) -> Column:
    """Union of two maps; on a common key the newer value wins."""
    return F.map_zip_with(base, newer, lambda _, old, new: F.coalesce(new, old))


def attributes_text(attributes: Column) -> Column:
    """A map as ``key=value;...`` sorted by key, for display and for comparing results."""
    pairs = F.transform(F.map_entries(attributes), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), ";")


def attributes_of(**values: Column) -> Column:
    """A map of the given columns; keys whose value is null are left out."""
    texts = {name: value.cast("string") for name, value in values.items()}
    whole = F.create_map(*[x for name, text in texts.items() for x in (F.lit(name), text)])
    # Filtering a map is slow, and most have nothing to leave out.
    missing = reduce(or_, [text.isNull() for text in texts.values()])
    return F.when(missing, F.map_filter(whole, lambda _, v: v.isNotNull())).otherwise(whole)


def other_end(src: Column, dst: Column, vertex: Column | int) -> Column:
    """The end of an edge that is not ``vertex``; a loop gives the vertex itself."""
    v = vertex if isinstance(vertex, Column) else F.lit(vertex)
    return F.when(dst == v, src).otherwise(dst)


def _hash_digits(digits: int, *parts: Column) -> Column:
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def surrogate_id(*parts: Column) -> Column:
    """A repeatable non-negative 60-bit id. Like random ids, two of many may coincide;
    use ``dense_index`` where ids must be distinct."""
    return _hash_digits(15, *parts)


def hashed_unit(*parts: Column) -> Column:
    """A repeatable number in [0, 1) that does not depend on how the rows are spread."""
    return _hash_digits(13, *parts).cast("double") / F.lit(float(16**13))
