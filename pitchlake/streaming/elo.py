"""Online Elo: ratings kept as keyed state, results applied in event-time order.

Waiting results lie in a map keyed by the millisecond of their instant and a running number, one timer a millisecond, so a timer reads and removes its own
results and no others.  Arriving rows are put there in parts of bounded size, so a worker holds a part of a batch, or the results of one millisecond.
State is one rating per club plus the results still waiting for the watermark, so it is bounded by clubs and by the lateness
allowed.  A result that arrives after the watermark passed it cannot be applied in order any more; it is emitted with a null
rating for the batch plan to pick up, never silently lost.  A row without a match only moves the watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pitchlake.functions import rates
from pitchlake.plans.models import EloModel

OUTPUT = "competition_key string, match_id string, club_id string, result_observed_at timestamp, rating double"
# Rows that wait in a worker before they are put into state.
PART_ROWS = 200_000


_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
# What is kept of a waiting result, in the order in which results count.
_KEPT = ["observed", "kickoff", "match_id", "home_club_id", "away_club_id", "actual"]


def _micros(instants: pd.Series) -> np.ndarray:
    """Microseconds since the epoch."""
    return instants.to_numpy("datetime64[us]").astype(np.int64)


def _both(home: list, away: list) -> list:
    """A value of the home club and one of the away club for each match, in turn."""
    return list(chain.from_iterable(zip(home, away, strict=True)))


class _EloProcessor(StatefulProcessor):
    def __init__(self, model: EloModel) -> None:
        self.model = model

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ratings = handle.getMapState("ratings", "club_id string", "rating double")
        # Parts of the results of one millisecond as JSON lists, a list for each column, numbered from 0; ``fires`` is when their timer fires.
        self.waiting = handle.getMapState("waiting", "fires bigint, part int", "results string")
        # The number of parts.
        self.parts = handle.getMapState("parts", "fires bigint", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        fresh: list[pd.DataFrame] = []
        for batch in rows:
            batch = batch[batch["match_id"].notna()]
            batch = batch.assign(observed=_micros(batch["result_observed_at"]), kickoff=_micros(batch["kickoff_at"]))
            late = batch["observed"] <= watermark * 1000
            if late.any():
                yield self._emitted(key, batch[late], np.nan)
            fresh.append(batch.loc[~late, _KEPT])
            if sum(map(len, fresh)) >= PART_ROWS:
                self._put(fresh)
                fresh = []
        self._put(fresh)

    def _put(self, fresh: list[pd.DataFrame]) -> None:
        """Let results wait for their timers."""
        if not fresh:
            return
        rows = pd.concat(fresh)
        for fires, own in rows.groupby(rows["observed"] // 1000 + 1):
            fires = int(fires)
            known = self.parts.getValue((fires,))
            part = known[0] if known else 0
            if not part:
                self.handle.registerTimer(fires)
            self.waiting.updateValue((fires, part), (json.dumps([own[c].tolist() for c in _KEPT]),))
            self.parts.updateValue((fires,), (part + 1,))

    def _emitted(self, key, matches: pd.DataFrame, ratings) -> pd.DataFrame:
        """Two rows for each match."""
        clubs = _both(matches["home_club_id"].tolist(), matches["away_club_id"].tolist())
        observed = np.repeat(matches["observed"].to_numpy(np.int64), 2).astype("datetime64[us]")
        ids = np.repeat(matches["match_id"].to_numpy(object), 2)
        return pd.DataFrame(dict(zip(_COLUMNS, (key[0], ids, clubs, observed, ratings), strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fires = expiredTimerInfo.getExpiryTimeInMs()
        results = []
        for part in range(self.parts.getValue((fires,))[0]):
            results.extend(zip(*json.loads(self.waiting.getValue((fires, part))[0]), strict=True))
            self.waiting.removeKey((fires, part))
        self.parts.removeKey((fires,))
        results.sort()
        ratings = {}
        for club in {c for r in results for c in r[3:5]}:
            known = self.ratings.getValue((club,))
            ratings[club] = known[0] if known else self.model.initial_rating
        advantage, factor = self.model.home_advantage, self.model.k_factor
        after = []
        for _, _, _, home, away, actual in results:
            gap = (ratings[home] + advantage) - ratings[away]
            delta = factor * (actual - 1.0 / (1.0 + 10.0 ** (-gap / 400.0)))
            ratings[home], ratings[away] = ratings[home] + delta, ratings[away] - delta
            after += (ratings[home], ratings[away])
        for club, rating in ratings.items():
            self.ratings.updateValue((club,), (rating,))
        yield self._emitted(key, pd.DataFrame(results, columns=_KEPT), after)

    def close(self) -> None:
        pass


def online_elo(results: DataFrame, model: EloModel = EloModel(), delay: str = "1 day") -> DataFrame:
    """Both clubs' ratings after each result, emitted once the watermark has passed it.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = results.select(
        F.col("competition_key").cast("string").alias("competition_key"),
        F.col("match_id").cast("string").alias("match_id"),
        F.col("home_club_id").cast("string").alias("home_club_id"),
        F.col("away_club_id").cast("string").alias("away_club_id"),
        F.col("kickoff_at").cast("timestamp").alias("kickoff_at"),
        F.col("result_observed_at").cast("timestamp").alias("result_observed_at"),
        rates.elo_actual_home(F.col("home_goals"), F.col("away_goals")).alias("actual"),
    )
    return (
        rows.withWatermark("result_observed_at", delay)
        .groupBy("competition_key")
        .transformWithStateInPandas(
            statefulProcessor=_EloProcessor(model), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime"
        )
    )
