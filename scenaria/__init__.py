"""scenaria — scenario and stimulus panel analytics as lazy Spark DataFrame jobs.

Layout
------
``sources``    CSV/Parquet readers with several null markers, preamble rows, sheet tables, indexed sinks.
``functions``  column expressions: strict / skip-null aggregates, first-match text edits, lenient casts, percentages.
``operators``  DataFrame -> DataFrame verbs: reshape, joins against dimensions, grouped statistics, ordering,
               first-per-key, interpolation.
``plans``      the derived result tables (stimulus, investment, GDP, shares, figure tables) and the bindings
               of their roles to the driver's test tables.
``streaming``  incremental refresh of the group totals over a growing fact folder.
"""

from scenaria.session import get_spark, scratch_path

__all__ = ["get_spark", "scratch_path"]
