"""Name normalisation and string similarity."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_GAPS = re.compile(r"[^a-z0-9]+")


def fold_name(name: str) -> str:
    """One name in matching form: dotless/dotted i unified, marks dropped, folded, gaps to one space.

    Letters without a decomposition (such as the crossed l) become gaps.
    """
    if name.isascii():
        return _GAPS.sub(" ", name.lower()).strip()
    plain = unicodedata.normalize("NFKD", name.replace("ı", "i").replace("İ", "i"))
    plain = "".join(ch for ch in plain if not unicodedata.combining(ch))
    return _GAPS.sub(" ", plain.casefold()).strip()


@F.pandas_udf(StringType())
def _fold(names: pd.Series) -> pd.Series:
    distinct = {name: fold_name(name) for name in names.dropna().unique()}
    return names.map(distinct)


def normalize_name(name: Column) -> Column:
    """Matching form of a display name (Arrow batches: Spark has no NFKD)."""
    return _fold(name)
