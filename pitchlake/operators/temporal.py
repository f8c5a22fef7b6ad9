"""Known-at-time operators: revision history, prefix state and as-of joins.

None of them gathers a key's rows in one task.  Latest-row lookups are map-side combining aggregates;
running state is built in two steps, within a calendar bucket and across buckets, on rows that were first
collapsed to one per distinct instant.  The rows a window sorts together are therefore bounded by the
calendar (instants in a bucket, buckets in the history), however many source rows share the key; measured buckets
bound them where a key has very many instants a month.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import ceil
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions.timing import is_valid_at
from pitchlake.session import ensure_checkpoint_dir

# --- Revision history --------------------------------------------------------------------------------


def _pick_row(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, "_row.*")


def latest(revisions: DataFrame, fixture: str = "fixture_key", revision: str = "revision") -> DataFrame:
    """The highest revision of every fixture."""
    return _pick_row(revisions, [fixture], F.col(revision))


def latest_as_of(
    revisions: DataFrame,
    cutoff: Column,
    fixture: str = "fixture_key",
    revision: str = "revision",
    observed: str = "observed_at",
) -> DataFrame:
    """The highest *revision* among those observed at or before ``cutoff`` (inclusive)."""
    return latest(revisions.filter(F.col(observed) <= cutoff), fixture, revision)


def timeline(revisions: DataFrame, fixture: str = "fixture_key", revision: str = "revision") -> DataFrame:
    """All revisions, ordered by fixture and revision (a range sort, no per-fixture gathering)."""
    return revisions.orderBy(fixture, revision)


def timeline_faults(
    revisions: DataFrame,
    fixture: str = "fixture_key",
    revision: str = "revision",
    observed: str = "observed_at",
    participants: Sequence[str] = ("home_club_key", "away_club_key"),
) -> DataFrame:
    """Fixtures whose history breaks a rule, one row per ``(fixture, rule)``.

    Contiguity and constant participants are aggregates.  Time order pairs revision *n* with *n-1* by
    hashing ``(fixture, n)``, so one fixture's history spreads over all tasks; it is judged, as a broken
    numbering has no predecessor to compare with, only where numbering is contiguous.
    """
    per_number = revisions.groupBy(fixture, revision).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min(observed).alias("_observed"),
        *[F.min(p).alias(f"_min_{p}") for p in participants],
        *[F.max(p).alias(f"_max_{p}") for p in participants],
    )
    # Every revision also appears as the predecessor of the next number, and meets it there.
    shared = [f"_{end}_{p}" for p in participants for end in ("min", "max")]
    absent = [F.lit(None).cast(per_number.schema[c].dataType).alias(c) for c in shared]
    clock = per_number.schema["_observed"].dataType
    number = F.col(revision)
    own = F.struct(
        number.alias("_n"), F.col("_rows"), F.col("_observed").alias("_now"), F.lit(None).cast(clock).alias("_before"),
        *[F.col(c) for c in shared],
    )
    following = F.struct(
        (number + 1).cast(per_number.schema[revision].dataType).alias("_n"), F.lit(None).cast("bigint").alias("_rows"),
        F.lit(None).cast(clock).alias("_now"), F.col("_observed").alias("_before"), *absent,
    )
    paired = (
        per_number.select(fixture, F.inline(F.array(own, following)))
        .groupBy(fixture, "_n")
        .agg(*[F.max(c).alias(c) for c in ("_rows", "_now", "_before", *shared)])
    )
    present = F.col("_rows").isNotNull()
    first, last = F.min(F.when(present, F.col("_n"))), F.max(F.when(present, F.col("_n")))
    moved = F.lit(False)
    for p in participants:
        moved = moved | F.coalesce(F.min(f"_min_{p}") != F.max(f"_max_{p}"), F.lit(False))
    judged = paired.groupBy(fixture).agg(
        ((first != 1) | (last != F.count(F.when(present, 1))) | (F.max("_rows") != 1)).alias("_gaps"),
        moved.alias("_moved"),
        F.max(F.coalesce(F.col("_now") < F.col("_before"), F.lit(False))).alias("_back"),
    )
    rules = F.array_compact(
        F.array(
            F.when(F.col("_gaps"), F.lit("revisions_contiguous")),
            F.when(~F.col("_gaps") & F.col("_back"), F.lit("observed_non_decreasing")),
            F.when(F.col("_moved"), F.lit("participants_constant")),
        )
    )
    return judged.select(fixture, F.explode(rules).alias("rule_id"))


# --- Event state -------------------------------------------------------------------------------------


def event_state(
    events: DataFrame,
    valid_at: Column,
    known_at: Column,
    keys: Sequence[str] = ("entity_id", "event_type"),
    tie: str = "event_id",
) -> DataFrame:
    """Per key, the event in force at ``valid_at`` using only what was known at ``known_at``.

    Later validity wins, then later observation, then the higher ``tie``.
    """
    eligible = events.filter(
        (F.col("observed_at") <= known_at) & is_valid_at(F.col("valid_from"), F.col("valid_until"), valid_at)
    )
    return _pick_row(eligible, list(keys), F.struct("valid_from", "observed_at", tie))


# --- Prefix state ------------------------------------------------------------------------------------

_MERGE = {"sum": F.sum, "max": F.max}


def _running(instants: DataFrame, keys: list[str], at: str, merges: Mapping[str, str], buckets: Sequence[str]):
    """Inclusive running merge at the probes, from one row per ``(keys, at)``; buckets coarse to fine."""
    if not buckets:
        window = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return instants.withColumns({m: _MERGE[how](m).over(window) for m, how in merges.items()}).filter("_probe")

    bucket, *finer = buckets
    inner = _running(instants, [*keys, bucket], at, merges, finer)
    # The probe flag is part of the totals and used below, so both branches read one shuffle of `instants`.
    totals = instants.groupBy(*keys, bucket).agg(
        F.max("_probe").alias("_probed"), *[_MERGE[how](m).alias(m) for m, how in merges.items()]
    )
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, bucket, "_probed", *[_MERGE[how](m).over(before).alias(f"_c_{m}") for m, how in merges.items()]
    ).filter("_probed")
    joined = inner.join(carry.drop("_probed"), [*keys, bucket])
    combine = {
        m: F.coalesce(F.col(f"_c_{m}"), F.lit(0)) + F.coalesce(F.col(m), F.lit(0))
        if how == "sum"
        else F.greatest(F.col(f"_c_{m}"), F.col(m))
        for m, how in merges.items()
    }
    return joined.withColumns(combine).drop(*[f"_c_{m}" for m in merges])


def measured_buckets(instants: DataFrame, keys: Sequence[str], at: str, bucket_rows: int) -> DataFrame:
    """The rows with ``_bucket``, a number that grows with ``at`` within a key and that about ``bucket_rows`` rows share.

    The cuts are those of a range partitioning by key and instant, which samples the rows: a hot key is cut as often as its rows ask for, small
    keys share a bucket number.  The rows are checkpointed, so that a recomputed task cannot cut them differently.
    """
    if bucket_rows < 1:
        raise ValueError(f"bucket_rows is {bucket_rows}, below 1")
    spark = instants.sparkSession
    ensure_checkpoint_dir(spark)
    instants = instants.checkpoint()
    ranges = max(1, ceil(instants.count() / bucket_rows))
    return instants.repartitionByRange(ranges, *keys, at).withColumn("_bucket", F.spark_partition_id()).checkpoint()


def prefix_state(
    facts: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    at: str,
    measures: Mapping[str, tuple[str, Column]],
    bucket_days: Sequence[int] = (32,),
    bucket_rows: int | None = None,
) -> DataFrame:
    """What the facts up to and including each probe instant add up to.

    ``facts`` and ``probes`` share ``keys`` and the time column ``at``; a measure is ``("sum", column)`` or
    ``("max", column)``.  A struct under ``max`` must lead with the time column, which makes it "the last
    row".  Returns one row per distinct probe ``(keys, at)``; sums start at 0, maxima at null.  Rows with a
    null key or time match nothing.

    ``bucket_days`` are the widths, in days and coarse to fine, of the calendar buckets the running merge is
    split by; ``(32, 1)`` suits keys with many distinct instants a day.  With ``bucket_rows`` the buckets are measured instead
    (``measured_buckets``): about so many distinct instants each, wherever they lie, so that a key with a million instants in a
    month, or in a second, is spread too.  The result is the same.
    Cost: one exchange of distinct instants, one within buckets, and small ones on bucket totals; measured buckets are stored
    once more, cut by ranges.
    """
    keys = list(keys)
    merges = {name: how for name, (how, _) in measures.items()}
    fact_rows = facts.select(
        *keys, at, *[expr.alias(name) for name, (_, expr) in measures.items()], F.lit(False).alias("_probe")
    )
    probe_rows = probes.select(*keys, at, F.lit(True).alias("_probe"))
    rows = fact_rows.unionByName(probe_rows, allowMissingColumns=True)
    if bucket_rows is not None:
        bucket_days = ()
    buckets = [f"_bucket_{days}" for days in bucket_days]
    day = F.unix_date(F.col(at).cast("date"))
    rows = rows.withColumns({b: day - F.pmod(day, F.lit(days)) for b, days in zip(buckets, bucket_days)})
    # Stated here because joining on these columns implies it: both branches below then plan identically.
    rows = rows.filter(reduce(and_, [F.col(column).isNotNull() for column in (*keys, *buckets, at)]))
    instants = rows.groupBy(*keys, *buckets, at).agg(
        F.max("_probe").alias("_probe"), *[_MERGE[how](name).alias(name) for name, how in merges.items()]
    )
    if bucket_rows is not None:
        instants, buckets = measured_buckets(instants, keys, at, bucket_rows), ["_bucket"]
    state = _running(instants, keys, at, merges, buckets)
    return state.select(
        *keys, at, *[(F.coalesce(F.col(n), F.lit(0)) if how == "sum" else F.col(n)).alias(n) for n, how in merges.items()]
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: str,
    right_at: str,
    take: Sequence[str],
    tie: Sequence[str] = (),
    prefix: str = "",
    bucket_days: Sequence[int] = (32,),
) -> DataFrame:
    """Backward as-of join: each left row with the last right row at or before its instant, or nulls.

    Ties at one instant go to the smallest ``tie`` columns.  Right rows are first reduced to one per
    ``(keys, instant)`` and carried forward by ``prefix_state``; no pair of rows is ever formed.
    """
    keys = list(keys)
    payload = list(dict.fromkeys([*tie, *take]))
    per_instant = right.groupBy(*keys, right_at).agg(
        F.min_by(F.struct(*payload), F.struct(*tie) if tie else F.struct(*payload)).alias("_row")
    )
    facts = per_instant.withColumnRenamed(right_at, "_at")
    probes = left.select(*keys, F.col(left_at).alias("_at"))
    last = F.struct(F.col("_at").alias("at"), F.col("_row").alias("row"))
    state = prefix_state(facts, probes, keys, "_at", {"_last": ("max", last)}, bucket_days)
    found = state.select(
        *keys,
        F.col("_at").alias(left_at),
        F.col("_last.at").alias(f"{prefix}{right_at}"),
        *[F.col(f"_last.row.{c}").alias(f"{prefix}{c}") for c in take],
    )
    return left.join(found, [*keys, left_at], "left")


def last_before(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: str,
    right_at: str,
    take: Sequence[str],
    tie: Sequence[str] = (),
    prefix: str = "",
) -> DataFrame:
    """``asof_join`` for a left side with few instants per key, such as one match at a few lead times.

    Right rows cross the network once: they are joined on the key, cut at the instant and reduced in the same
    task.  A key with very many right rows is split by the adaptive skew join, and the reduction then combines
    the splits.  Pairs per key are its left instants times its right rows, hence the restriction.
    """
    keys = list(keys)
    epoch = F.lit("1970-01-01").cast(right.schema[right_at].dataType)
    rest = [c for c in dict.fromkeys([*tie, *take]) if c not in keys]
    rows = right.select(
        *keys,
        F.struct((epoch - F.col(right_at)).alias("_back"), *rest, F.col(right_at).alias("_at")).alias("_row"),
        F.col(right_at).alias("_right_at"),
    )
    probes = left.select(*keys, left_at)
    # Latest first, then the smallest tie columns: the minimum of (distance back, tie, ...).
    found = (
        probes.join(rows, keys)
        .filter(F.col("_right_at") <= F.col(left_at))
        .groupBy(*keys, left_at)
        .agg(F.min("_row").alias("_row"))
        .select(
            *keys,
            left_at,
            F.col("_row._at").alias(f"{prefix}{right_at}"),
            *[F.col(f"_row.{c}").alias(f"{prefix}{c}") for c in take],
        )
    )
    return left.join(found, [*keys, left_at], "left")
