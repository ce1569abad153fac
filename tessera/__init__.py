"""tessera: analytics operators written as plain Spark DataFrame code.

Every operator is a function ``DataFrame -> DataFrame`` built from
``pyspark.sql.functions`` so Catalyst can prune, push down and codegen it.
Use them through ``df.transform(op, ...)`` or call them directly.

Sub-packages
------------
sources    reading and writing tables, files and streams
functions  column expressions (bands, dates, tags, paths, ...)
operators  DataFrame operators (statistics, quality, joins, ranking,
           ledgers, KPIs, conversations, retrieval, ML)
streaming  Structured Streaming operators (cooldown alerts, dedup, live KPIs)
plans      bindings of the operators to the supplied tables and the
           registered queries with their SQL twins
"""

from tessera.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
