"""Attributes as an ordered dictionary: column expressions over ``attrs``, an array of (name, value) in source order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAMES = "transform(attrs, a -> a.name)"


def attr_names() -> Column:
    return F.expr(_NAMES)


def attr_index(name: str) -> Column:
    """Place of an attribute from 0; null if there is none."""
    at = F.array_position(F.expr(_NAMES), name)
    return F.when(at > 0, (at - 1).cast("int"))


def attr_at(index: int) -> Column:
    """The (name, value) at that place; null beyond the end."""
    return F.get("attrs", F.lit(index))


def first_attr() -> Column:
    """Name of the first attribute, null without any."""
    return F.get("attrs", F.lit(0))["name"]


def last_attr() -> Column:
    return F.try_element_at("attrs", F.lit(-1))["name"]


def attrs_with(name: str, value: Column | str, index: int | None = None) -> Column:
    """attrs with the attribute set: it keeps its place if it is there, else it comes at ``index`` or at the end."""
    value = F.lit(value) if isinstance(value, str) else value
    new = F.array(F.struct(F.lit(name).alias("name"), value.alias("value")))
    again = F.transform("attrs", lambda a: F.struct(a["name"].alias("name"), F.when(a["name"] == name, value).otherwise(a["value"]).alias("value")))
    added = F.concat("attrs", new) if index is None else F.concat(F.slice("attrs", 1, index), new, F.slice("attrs", index + 1, F.greatest(F.size("attrs") - index, F.lit(0))))
    return F.when(F.exists("attrs", lambda a: a["name"] == name), again).otherwise(added)


def attrs_without(name: str) -> Column:
    return F.filter("attrs", lambda a: a["name"] != name)
