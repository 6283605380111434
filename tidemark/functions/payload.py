"""Expressions over JSON bodies, read as VARIANT so that ``5`` and ``"5"`` stay different."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def body(text: Column | str) -> Column:
    return F.try_parse_json(F.col(text) if isinstance(text, str) else text)


def path(name: str) -> str:
    """Path of a top-level field, whatever characters its name has."""
    return f"$['{name}']" if '"' in name else f'$["{name}"]'


def field(variant: Column, name: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(variant, path(name), as_type)


def kind(variant: Column) -> Column:
    """``BIGINT``, ``STRING``, ``OBJECT``, ...; null when the field is absent."""
    return F.substring_index(F.substring_index(F.schema_of_variant(variant), "<", 1), "(", 1)


def is_object_text(text: Column | str) -> Column:
    """Whether a valid JSON text is an object, told by its first sign without a look inside."""
    return F.ltrim(text, F.lit(" \t\r\n")).startswith("{")


def is_number(variant: Column) -> Column:
    return names_number(kind(variant))


def names_number(kind_name: Column) -> Column:
    return kind_name.isin("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")


def number(variant: Column, name: str) -> Column:
    """A top-level field as double when it is a JSON number; text, booleans and nesting give null."""
    value = field(variant, name)
    return F.when(is_number(value), as_double(value))


def as_double(variant: Column) -> Column:
    return F.try_variant_get(variant, "$", "double")


def with_numbers(frame: DataFrame, names: Sequence[str], text: str = "payload_json") -> DataFrame:
    """Add the named numeric payload fields as double columns."""
    return (
        frame.withColumn("_body", body(text))
        .withColumns({name: number(F.col("_body"), name) for name in names})
        .drop("_body")
    )


def numeric_fields(frame: DataFrame, keep: Sequence[str], text: str = "payload_json") -> DataFrame:
    """One row per (row, numeric top-level field): ``keep`` columns, ``field``, ``value``."""
    return (
        frame.select(*keep, body(text).alias("_body"))
        .lateralJoin(
            frame.sparkSession.tvf.variant_explode(F.col("_body").outer()).select("key", "value")
        )
        .filter(F.col("key").isNotNull() & is_number(F.col("value")))
        .select(*keep, F.col("key").alias("field"), as_double(F.col("value")).alias("value"))
    )
