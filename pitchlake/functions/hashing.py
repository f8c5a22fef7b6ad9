"""Content hashes: payloads, experiment configs and whole datasets."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, is_dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LANES = 16  # 16-bit lanes of a SHA-256 digest; a lane sum stays below 2**63 for 2**47 rows


def _digest(text: str | None, ascii_only: bool) -> str | None:
    if text is None:
        return None
    canonical = json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only)
    return hashlib.sha256(canonical.encode("utf-8")).hexdigest()


@F.pandas_udf(StringType())
def canonical_json_sha256(payload: pd.Series) -> pd.Series:
    """SHA-256 of JSON text with sorted keys and compact separators, non-ASCII kept.

    Works on the raw text: a parsed VARIANT or struct would already have changed number formats.
    """
    return payload.map(lambda text: _digest(text, False), na_action="ignore")


@F.pandas_udf(StringType())
def stable_json_sha256(payload: pd.Series) -> pd.Series:
    """As ``canonical_json_sha256`` with non-ASCII characters escaped (the config-digest form)."""
    return payload.map(lambda text: _digest(text, True), na_action="ignore")


def map_sha256(entries: Column) -> Column:
    """Same digest for a flat ``MAP<STRING,STRING>``, entirely in the JVM."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries)))), 256)


def _encoded(value: Any) -> Any:
    """Settings are flat; besides JSON's own types they hold dates and ids, and models are dataclasses of these."""
    if is_dataclass(value):
        return asdict(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    raise TypeError(f"no digest for a setting of type {type(value).__name__}")


def stable_hash(value: Any) -> str:
    """Digest of one driver-side value, e.g. an experiment config."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, default=_encoded)
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def dataset_digest(df: DataFrame, row_text: Column, groups: Sequence[str] = ()) -> DataFrame:
    """Order-independent digest of all rows per group: ``row_count`` and ``data_hash``.

    Each row's SHA-256 is cut into 16 lanes that are summed, so the aggregate combines map-side: a group
    of any size crosses the network as one row per task and is never sorted or gathered.  Duplicate rows
    count, reordering does not.
    """
    hashed = df.select(*groups, F.sha2(row_text, 256).alias("_h"))
    lanes = [
        F.sum(F.conv(F.substring("_h", 4 * i + 1, 4), 16, 10).cast("bigint")).alias(f"_lane{i}") for i in range(LANES)
    ]
    grouped = hashed.groupBy(*groups).agg(F.count(F.lit(1)).alias("row_count"), *lanes)
    text = F.concat_ws(":", F.col("row_count"), *[F.coalesce(F.col(f"_lane{i}"), F.lit(0)) for i in range(LANES)])
    return grouped.select(*groups, "row_count", F.sha2(text, 256).alias("data_hash"))


def match_row_text(
    match_id: str = "match_id",
    home: str = "home_club_id",
    away: str = "away_club_id",
    kickoff: str = "kickoff_at",
    observed: str = "result_observed_at",
    home_goals: str = "home_goals",
    away_goals: str = "away_goals",
) -> Column:
    """The seven columns of a historical match that identify its content, as one text."""
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    values = [F.col(c).cast("string") for c in (match_id, home, away)]
    values += [F.date_format(kickoff, stamp), F.date_format(observed, stamp)]
    values += [F.col(c).cast("string") for c in (home_goals, away_goals)]
    # Each value carries its length and a null has a mark of its own, so no two rows share a text.
    return F.concat(*[F.when(v.isNull(), "-").otherwise(F.concat(F.length(v).cast("string"), F.lit(":"), v)) for v in values])
