"""Deterministic identifiers: UUID version 5 as a native Column expression."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespace of this library's identifiers; pass another one to reproduce foreign ids.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "canonical.pitchlake.invalid")

# Whitespace as stripped by the identifier contract: Unicode White_Space plus the four ASCII separators.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

# The five groups of a UUID in the first 32 digits of a SHA-1, without the version digit.
_LAYOUT = r"^(.{8})(.{4}).(.{3})(.{4})(.{12}).*$"


def strip(value: Column) -> Column:
    """Remove leading and trailing Unicode whitespace (``trim`` only drops spaces)."""
    return F.regexp_replace(value, _EDGE_SPACE, "")


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """RFC 4122 version-5 UUID of ``name`` as a 36-character lower-case string."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    # The variant nibble keeps its two low bits and gets the high bits 10; the version nibble becomes 5.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.regexp_replace(F.overlay(digest, variant, 17, 1), _LAYOUT, "$1-$2-5$3-$4-$5")


def _part(value: Column, what: str) -> Column:
    cleaned = F.lower(strip(value))
    return F.when(
        F.coalesce(F.length(cleaned), F.lit(0)) == 0,
        F.raise_error(F.lit(f"no id without a {what}: it is null or blank")).cast("string"),
    ).otherwise(cleaned)


def canonical_id(kind: str | Column, *parts: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """Stable id of ``kind`` and a key; several parts are joined with ``:`` first.

    Both sides are stripped and lower-cased; an empty side fails the query.
    """
    if isinstance(kind, str):
        if not kind.strip():
            raise ValueError(f"no id without a kind: {kind!r} is blank")
        kind_text = F.lit(kind.strip().lower())
    else:
        kind_text = _part(kind, "kind")
    texts = [p.cast("string") for p in parts]
    # concat, not concat_ws: a null part must make the whole key null, hence an error.
    joined = texts[0]
    for text in texts[1:]:
        joined = F.concat(joined, F.lit(":"), text)
    return uuid5(F.concat(kind_text, F.lit(":"), _part(joined, "key")), namespace)


def optional_id(kind: str, key: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """``canonical_id`` that leaves a null key null."""
    return F.when(key.isNotNull(), canonical_id(kind, key, namespace=namespace))
