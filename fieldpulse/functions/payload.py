"""Reading free-form JSON payloads in document order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from fieldpulse.schemas import NON_FEATURE_KEYS

NUMBER_KINDS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE")
NO_ENTRIES = "array<struct<key:string,value:double>>"


def variant_map(text: Column) -> Column:
    """Keys in document order, values as VARIANT; NULL when the text is not an object."""
    return F.from_json(text, "map<string,variant>")


def text_map(text: Column) -> Column:
    """Keys in document order, values as raw text."""
    return F.from_json(text, "map<string,string>")


def _last_of_each_key(entries: Column) -> Column:
    """A repeated key counts once: at its first place, with its last value."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1))
    return F.when(F.size(keys) == F.size(entries), entries).otherwise(last)


def entries_of(document: Column) -> Column:
    """array<struct<key, value>> of a map in document order, every key once."""
    # through a one-element array, so that the map is computed once
    return F.get(F.transform(F.array(F.map_entries(document)), _last_of_each_key), F.lit(0))


def _typed_entries(document: Column) -> Column:
    """array<struct<key, value, kind>>: the kind of every value is looked up once."""
    return F.transform(
        entries_of(document),
        lambda e: F.struct(e["key"], e["value"], F.schema_of_variant(e["value"]).alias("kind")),
    )


def is_number(kind: Column) -> Column:
    """JSON numbers only: booleans and numeric strings do not count."""
    return kind.isin(*NUMBER_KINDS) | kind.startswith("DECIMAL")


def _number_entry(name: Column, value: Column) -> Column:
    return F.struct(name.alias("key"), F.try_variant_get(value, "$", "double").alias("value"))


def numeric_entries(payload: Column, skip: Iterable[str] = NON_FEATURE_KEYS) -> Column:
    """array<struct<key, value>> of the top-level numbers, in document order."""
    skip = tuple(skip)
    wanted = lambda e: is_number(e["kind"]) & (~e["key"].isin(*skip) if skip else F.lit(True))
    found = F.filter(_typed_entries(variant_map(payload)), wanted)
    return F.transform(found, lambda e: _number_entry(e["key"], e["value"]))


def nested_numeric_entries(payload: Column) -> Column:
    """As `numeric_entries`, nothing skipped, plus the numbers one object level down.

    A nested object is parsed again from its raw text, because a VARIANT object
    keeps its keys sorted and would lose the document order. The raw text of all
    keys is read once per payload, and only for payloads that hold an object.
    """
    empty = F.array().cast(NO_ENTRIES)
    raw = F.when(payload.rlike(r":\s*\{"), text_map(payload))

    def children(e: Column, texts: Column) -> Column:
        inner = F.filter(_typed_entries(variant_map(texts[e["key"]])), lambda c: is_number(c["kind"]))
        return F.transform(inner, lambda c: _number_entry(F.concat(e["key"], F.lit("."), c["key"]), c["value"]))

    def expand(e: Column, texts: Column) -> Column:
        return (
            F.when(is_number(e["kind"]), F.array(_number_entry(e["key"], e["value"])))
            .when(e["kind"].startswith("OBJECT"), F.coalesce(children(e, texts), empty))
            .otherwise(empty)
        )

    # a one-element array holds the raw texts, so that the lambda below does not parse them per entry
    expanded = F.transform(
        F.array(F.struct(variant_map(payload).alias("document"), raw.alias("texts"))),
        lambda p: F.flatten(F.transform(_typed_entries(p["document"]), lambda e: expand(e, p["texts"]))),
    )
    return F.get(expanded, F.lit(0))


def numeric_values(payload: Column, nested: bool = False) -> Column:
    """array<double> of the numbers of a payload; empty when it is not an object."""
    entries = nested_numeric_entries(payload) if nested else numeric_entries(payload)
    return F.coalesce(F.transform(entries, lambda e: e["value"]), F.array().cast("array<double>"))


def wrap_json(name: str, payload: Column) -> Column:
    """Log entries carry a JSON object inside its own key: {"payload": {...}}."""
    return F.concat(F.lit('{"' + name + '":'), F.coalesce(payload, F.lit("{}")), F.lit("}"))


def unwrap_json(name: str, text: Column) -> Column:
    return F.get_json_object(text, f"$.{name}")
