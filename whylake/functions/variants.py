"""Tolerant access to JSON of changing shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """VARIANT of a JSON text, NULL when it is none."""
    return F.try_parse_json(text)


def text_at(value: Column, path: str) -> Column:
    """The string at ``path``; NULL when there is something else, so an object never turns into its JSON text."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))


def scalar_at(value: Column, path: str) -> Column:
    """A string, number or boolean as text."""
    found = F.try_variant_get(value, path, "variant")
    kind = F.schema_of_variant(found)
    nested = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
    return F.when(~nested, F.try_variant_get(found, "$", "string"))


def number_at(value: Column, path: str) -> Column:
    """A number as BIGINT; anything else counts as 0."""
    found = F.try_variant_get(value, path, "variant")
    numeric = F.regexp_like(F.schema_of_variant(found), F.lit("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"))
    return F.coalesce(F.when(numeric, F.try_variant_get(found, "$", "double").cast("bigint")), F.lit(0).cast("bigint"))


def flag_at(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, "boolean"), F.lit(False))


def items_at(value: Column, path: str) -> Column:
    """The array at ``path``, empty when there is none."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))
