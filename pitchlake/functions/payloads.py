"""JSON payloads as VARIANT: fields by path and type, the shape of a column, and the hash of the text they came from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_payload(df: DataFrame, text: str, name: str = "payload") -> DataFrame:
    """Add the VARIANT of a JSON text and the SHA-256 of that very text.

    A VARIANT keeps values, not spelling (order of keys, spaces, forms of numbers), so evidence is hashed from the text.  Null
    stays null; text that is no JSON gives a null VARIANT and keeps its hash, so such rows can be told from missing ones.
    """
    return df.withColumns({name: F.try_parse_json(F.col(text)), f"{name}_sha256": F.sha2(F.col(text).cast("binary"), 256)})


def field(payload: Column, path: str, kind: str) -> Column:
    """The value at a path such as ``$.points.win`` or ``$.ranking[0]``; null where it is missing or not of that kind."""
    return F.try_variant_get(payload, path, kind)


def fields(df: DataFrame, wanted: Mapping[str, tuple[str, str]], name: str = "payload") -> DataFrame:
    """Add a column for each of ``wanted``, column to (path, kind)."""
    return df.withColumns({column: field(F.col(name), path, kind) for column, (path, kind) in wanted.items()})


def shapes(df: DataFrame, by: Sequence[str], name: str = "payload") -> DataFrame:
    """Per group the rows, those without a value, and one schema that fits all values (merged map-side)."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(name).isNull()).alias("without"), F.schema_of_variant_agg(F.col(name)).alias("shape")
    )
