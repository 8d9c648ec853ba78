"""The text form of a change log: ``time TAB action TAB entity TAB key:value TAB ...``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import ATTRIBUTES, CREATE, DELETE, EDGE, UPDATE, VERTEX

# Fixed forms of the format.
INSTANT_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?Z$"
ACTIONS = [CREATE, UPDATE, DELETE]


def serialize_instant(ts: Column) -> Column:
    """ISO-8601 in UTC with no, three or six digits of a second, as few as needed."""
    text = F.translate(ts.cast("string"), " ", "T")
    seconds = F.substring(text, 1, 19)
    fraction = F.rpad(F.substring(text, 21, 6), 6, "0")
    short = (
        F.when(fraction == "000000", seconds)
        .when(F.substring(fraction, 4, 3) == "000", F.concat(seconds, F.lit("."), F.substring(fraction, 1, 3)))
        .otherwise(F.concat(seconds, F.lit("."), fraction))
    )
    return F.concat(short, F.lit("Z"))


def parse_instant(text: Column) -> Column:
    """The TIMESTAMP_NTZ of an ISO-8601 UTC instant; null when it is none."""
    ok = F.coalesce(text.rlike(INSTANT_PATTERN), F.lit(False))
    return F.when(ok, F.regexp_replace(text, "Z$", "").try_cast("timestamp_ntz"))


def serialize_entity(entity_type: Column, id_: Column, src: Column, dst: Column) -> Column:
    """``VERTEX:id`` or ``EDGE:id:src:dst``."""
    return F.when(entity_type == VERTEX, F.concat_ws(":", entity_type, id_)).otherwise(
        F.concat_ws(":", entity_type, id_, src, dst)
    )


def parse_entity(text: Column) -> Column:
    """A struct (entity_type, id, src, dst); null when the text names no entity."""
    parts = F.split(text, ":")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("bigint")
    kind, size = F.get(parts, F.lit(0)), F.size(parts)
    vertex = (kind == VERTEX) & (size == 2) & number(1).isNotNull()
    edge = (
        (kind == EDGE)
        & (size == 4)
        & number(1).isNotNull()
        & number(2).isNotNull()
        & number(3).isNotNull()
    )
    none = F.lit(None).cast("bigint")
    return F.when(
        vertex,
        F.struct(kind.alias("entity_type"), number(1).alias("id"), none.alias("src"), none.alias("dst")),
    ).when(
        edge,
        F.struct(
            kind.alias("entity_type"), number(1).alias("id"), number(2).alias("src"), number(3).alias("dst")
        ),
    )


def parse_action(text: Column) -> Column:
    """The action, or null when the text is none of the three."""
    return F.when(text.isin(ACTIONS), text)


def serialize_attributes(attributes: Column) -> Column:
    """``key:value`` pairs joined by tabs, in key order; separators inside them are dropped."""
    clean = lambda c: F.translate(c, "\t:\n\r", "")
    pairs = F.transform(
        F.map_entries(attributes), lambda e: F.concat(clean(e["key"]), F.lit(":"), clean(e["value"]))
    )
    return F.array_join(F.array_sort(pairs), "\t")


def deserialize_attributes(pairs: Column) -> Column:
    """The map of an array of ``key:value`` texts; null when one of them is no such pair.

    A repeated key takes its last value.
    """
    split = F.transform(pairs, lambda p: F.split(p, ":"))
    ok = F.forall(split, lambda kv: (F.size(kv) == 2) & (F.get(kv, F.lit(0)) != ""))
    last = F.filter(
        split,
        lambda kv, i: ~F.exists(
            F.slice(split, i + 2, F.size(split)), lambda later: F.get(later, F.lit(0)) == F.get(kv, F.lit(0))
        ),
    )
    entries = F.transform(
        last, lambda kv: F.struct(F.get(kv, F.lit(0)).alias("key"), F.get(kv, F.lit(1)).alias("value"))
    )
    return F.when(ok, F.map_from_entries(entries).cast(ATTRIBUTES))


def serialize_log(
    ts: Column, action: Column, entity_type: Column, id_: Column, src: Column, dst: Column, attributes: Column
) -> Column:
    """One line of text for one entry; an entry without attributes has three fields."""
    head = F.concat_ws("\t", serialize_instant(ts), action, serialize_entity(entity_type, id_, src, dst))
    tail = serialize_attributes(attributes)
    return F.when(F.coalesce(tail, F.lit("")) == "", head).otherwise(F.concat_ws("\t", head, tail))
