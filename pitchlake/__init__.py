"""Bitemporal match history, entity resolution and forecast evaluation on Spark.

Every operator takes DataFrames and returns DataFrames.  The sub-packages are

* ``functions``  – Column expressions (ids, hashes, names, scores, rates)
* ``operators``  – DataFrame operators (quality rules, as-of state, resolution, ...)
* ``plans``      – composites (walk-forward backtests, canonical imports)
* ``sources``    – readers, ingest runs, table sinks
* ``streaming``  – Structured Streaming forms of ingest and live state
"""

__version__ = "0.1.0"
