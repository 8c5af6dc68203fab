"""Strict reading of one JSON object held in a string column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from supportlake.functions.text import bind


# Closes the wrapping list below; no JSON text of ours contains it.
_END = "end-of-text-9f27"


def parsed(raw: Column) -> Column:
    """Variant of the text, NULL where it is not exactly one valid JSON value.

    Spark's parser stops after the first value and ignores what follows, so the
    text is read as the first of two list elements and the second must be ours.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(f',"{_END}"]')))
    closed = F.try_variant_get(listed, "$[1]", "string") == _END
    return F.when(closed, F.try_variant_get(listed, "$[0]", "variant"))


def read_object(raw: Column, build) -> Column:
    """``build(variant)`` with the text parsed once; the variant is NULL for bad JSON."""
    return bind(parsed(raw), build)


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def keys_are(raw: Column, *keys: str) -> Column:
    """Exactly these keys in the JSON text, none repeated."""
    listed = F.array(*map(F.lit, sorted(keys)))
    return F.coalesce(F.array_sort(F.json_object_keys(raw)) == listed, F.lit(False))


def kind(v: Column, path: str) -> Column:
    """Type name of a value: STRING, BOOLEAN, BIGINT, DECIMAL(..), DOUBLE, VOID, ... or NULL if absent."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def is_string(v: Column, path: str) -> Column:
    return F.coalesce(kind(v, path) == "STRING", F.lit(False))


def is_bool(v: Column, path: str) -> Column:
    return F.coalesce(kind(v, path) == "BOOLEAN", F.lit(False))


def is_number(v: Column, path: str) -> Column:
    return F.coalesce(kind(v, path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))


def value(v: Column, path: str, target: str) -> Column:
    return F.try_variant_get(v, path, target)
