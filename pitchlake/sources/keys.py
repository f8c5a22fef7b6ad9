"""Unique and foreign keys over a store of many runs: a batch meets only the runs that may hold its keys.

Every committed run carries bitmaps of the key buckets it has filled (2**20 buckets a key, 4 KB for 32,768 of them).  A batch makes its own;
a stored run is opened for a key only where the two share a bucket.  Bitmaps never miss a key, so the answer is exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.operators.quality import FOREIGN_KEYS, UNIQUE_KEYS

BUCKETS = 1 << 20
FAULTS = "table_name string, fault string, key_columns string, key string, occurrences long"
ENTRIES = "kind string, role string, place int, key string"
BITMAPS = "role string, bucket long, bits binary"


def _role(table: str, columns: tuple[str, ...]) -> str:
    return f"{table}({','.join(columns)})"


# Keys that a store must be able to look up: the unique ones and those that others refer to.
ROLES = {_role(t, c): (t, c) for t, c in [*UNIQUE_KEYS.items(), *((parent, (primary,)) for _, _, parent, primary in FOREIGN_KEYS)]}
# For each key that others refer to, the columns that do.
REFERENCES = {_role(p, (k,)): [(c, f) for c, f, parent, primary in FOREIGN_KEYS if (parent, primary) == (p, k)] for _, _, p, k in FOREIGN_KEYS}


def _key(columns: tuple[str, ...]) -> Column:
    """The key as a JSON array of texts; null if any part is."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return F.when(complete, F.to_json(F.array(*[F.col(c).cast("string") for c in columns])))


def _entries(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every key of every row: ``unique`` and ``primary`` ones under their own role, ``foreign`` ones under the role they refer to.

    ``place`` is that of the referring column among the role's ``REFERENCES``.
    """
    found = spark.createDataFrame([], ENTRIES)
    for table, rows in tables.items():
        own = [("unique", UNIQUE_KEYS[table], _role(table, UNIQUE_KEYS[table]), None)] if table in UNIQUE_KEYS else []
        own += [("primary", columns, role, None) for role, (owner, columns) in ROLES.items() if owner == table and columns != UNIQUE_KEYS.get(table)]
        own += [("foreign", (column,), role, place) for role, held in REFERENCES.items() for place, (child, column) in enumerate(held) if child == table]
        own = [o for o in own if set(o[1]) <= set(rows.columns)]
        if own:
            each = [
                F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), F.lit(place).cast("int").alias("place"), _key(columns).alias("key"))
                for kind, columns, role, place in own
            ]
            found = found.unionByName(rows.select(F.inline(F.array(*each))).where("key is not null"))
    return found


def _bitmaps(entries: DataFrame) -> DataFrame:
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS))
    return (
        entries.select("role", bucket.alias("b"))
        .groupBy("role", F.bitmap_bucket_number("b").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    )


def write_bitmaps(spark: SparkSession, path: str, tables: Mapping[str, DataFrame]) -> None:
    """The bitmaps of a run's rows."""
    _bitmaps(_entries(spark, tables).where("kind <> 'foreign'")).write.mode("overwrite").parquet(path)


def runs_that_may_hold(entries: DataFrame, bitmaps: DataFrame | None) -> dict[str, list[str]]:
    """For each role the runs whose bitmaps share a bucket with the entries: names of runs, never keys."""
    if bitmaps is None:
        return {}
    both = bitmaps.join(_bitmaps(entries).withColumnRenamed("bits", "asked"), ["role", "bucket"])
    each = both.select("role", "run", "bucket", F.explode(F.array("bits", "asked")).alias("bits"))
    met = each.groupBy("role", "run", "bucket").agg(
        F.sum(F.bitmap_count("bits")).alias("apart"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("together")
    )
    found = defaultdict(list)
    for row in met.where("together < apart").select("role", "run").distinct().orderBy("role", "run").collect():
        found[row["role"]].append(row["run"])
    return dict(found)


def _named(names: Mapping[str, tuple[str, str]], label: Column) -> list[Column]:
    """The table and the columns that a label stands for."""
    return [
        F.create_map(*[F.lit(x) for known, pair in names.items() for x in (known, pair[i])])[label].alias(name)
        for i, name in enumerate(("table_name", "key_columns"))
    ]


def key_faults(store, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Keys that the new rows of a batch may not have, before they are written.

    ``repeated``: a unique key on several rows of the batch; ``stored``: a unique key that a committed row already has; ``orphaned``: a
    foreign key that neither the batch nor the store knows.  ``occurrences`` counts the batch's rows.  Keys with a null part are exempt, and
    so are keys whose columns a table lacks.  ``tables`` holds only rows that are new.
    """
    kept = {name: rows.checkpoint() for name, rows in tables.items()}
    return reduce(DataFrame.unionByName, faults_by_kind(store, kept).values())


def faults_by_kind(store, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """``key_faults`` by fault, each a plan of its own over rows that must be the same whenever they are read."""
    spark = store.spark
    entries = _entries(spark, tables)
    asked = entries.where("kind <> 'primary'")
    held, unmarked = store.key_bitmaps()
    runs = runs_that_may_hold(asked, held)
    known = {}
    for role, (table, columns) in ROLES.items():
        near = [*runs.get(role, []), *unmarked]
        rows = store.read(table, near) if near else None
        if rows is not None and set(columns) <= set(rows.columns):
            known[role] = rows.select(F.lit(role).alias("role"), _key(columns).alias("key")).where("key is not null")

    # Either way rows are combined by role and key, and cross the network once for it.
    unique = entries.where("kind = 'unique'").groupBy("role", "key").agg(F.count(F.lit(1)).alias("occurrences"))
    owners = {role: (table, ",".join(columns)) for role, (table, columns) in ROLES.items()}
    unique = unique.select(*_named(owners, F.col("role")), "role", "key", "occurrences")
    faults = {"repeated": unique.where("occurrences > 1")}
    if known:
        faults["stored"] = unique.join(reduce(DataFrame.unionByName, known.values()), ["role", "key"], "left_semi")
    met = entries.where(F.col("role").isin(*REFERENCES))
    for role in REFERENCES.keys() & known.keys():
        met = met.unionByName(known[role].withColumn("kind", F.lit("known")), allowMissingColumns=True)
    places = range(max(map(len, REFERENCES.values())))
    alone = met.groupBy("role", "key").agg(
        F.bool_and(F.col("kind") == "foreign").alias("_alone"), *[F.count(F.when(F.col("place") == p, 1)).alias(f"_{p}") for p in places]
    ).where("_alone")
    columns = {f"{role}{place}": pair for role, held in REFERENCES.items() for place, pair in enumerate(held)}
    each = F.inline(F.array(*[F.struct(F.lit(p).alias("place"), F.col(f"_{p}").alias("occurrences")) for p in places]))
    referring = _named(columns, F.concat("role", F.col("place").cast("string")))
    faults["orphaned"] = alone.select("role", "key", each).where("occurrences > 0").select(*referring, "key", "occurrences")
    return {fault: rows.select("table_name", F.lit(fault).alias("fault"), "key_columns", "key", "occurrences") for fault, rows in faults.items()}
