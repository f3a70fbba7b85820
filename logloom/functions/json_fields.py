"""Fields of a JSON log line, found by their usual names.

A line is read once into ``map<string, variant>``: the map keeps the members in document
order, the variant keeps the kind of each value (text, number, object, ...).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import SPACES
from .timestamps import epoch_ts, iso_ts

def json_members(line: Column) -> Column:
    """The line as an array of ``map<string, variant>``.

    It has exactly one element if the line is one valid JSON object: read as an array,
    trailing text after the object is an error and more objects are more elements.
    """
    trimmed = F.when(line.startswith("{") & line.endswith("}"), line).otherwise(F.btrim(line, F.lit(SPACES)))
    wrapped = F.concat(F.lit("["), trimmed, F.lit("]"))
    return F.from_json(wrapped, "array<map<string, variant>>", {"allowSingleQuotes": "false"})


def last_member_wins(members: str) -> Column:
    """Repeated keys in a map column: the last value, at the place of the first."""
    deduped = (
        f"map_from_arrays(array_distinct(map_keys({members})), transform(array_distinct(map_keys({members})), "
        f"k -> get(reverse(map_values({members})), array_position(reverse(map_keys({members})), k) - 1)))"
    )
    return F.expr(
        f"CASE WHEN size(array_distinct(map_keys({members}))) < size({members}) THEN {deduped} ELSE {members} END"
    )


def _first_alias(members: str, aliases: list[str]) -> str:
    return f"coalesce({', '.join(f"element_at({members}, '{a}')" for a in aliases)})"


def first_alias(members: str, aliases: list[str]) -> Column:
    """The value under the first alias that is present; a JSON null is a variant, not a SQL NULL."""
    return F.expr(_first_alias(members, aliases))


def nested_objects(members: str) -> Column:
    """The member values that are objects themselves, in document order."""
    return F.expr(
        f"filter(transform(map_values({members}), v -> try_cast(v AS MAP<STRING, VARIANT>)), o -> o IS NOT NULL)"
    )


def first_nested_alias(nested: str, aliases: list[str]) -> Column:
    """The same in the first nested object that has any of the aliases."""
    return F.expr(f"get(filter(transform({nested}, m -> {_first_alias('m', aliases)}), v -> v IS NOT NULL), 0)")


def json_text(value: Column, text: Column) -> Column:
    """A value as text, given its plain text: True / False, whole floats as 5.0, all else as printed."""
    boolean = text.isin("true", "false") & (F.schema_of_variant(value) == "BOOLEAN")
    whole = text.rlike(r"^-?[0-9]{1,18}\z") & F.schema_of_variant(value).startswith("DECIMAL")
    return F.when(boolean, F.initcap(text)).when(whole, F.concat(text, F.lit(".0"))).otherwise(text)


def json_ts(text: Column, kind: Column) -> Column:
    """Numbers (and booleans, as 0 and 1) are epoch seconds, texts are ISO 8601."""
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return (
        F.when(kind == "STRING", iso_ts(text))
        .when(number, epoch_ts(text.try_cast("double")))
        .when(kind == "BOOLEAN", epoch_ts((text == "true").cast("double")))
    )
