"""gustframe: station weather comfort analytics expressed as Spark DataFrame plans.

Every operator is a plain function ``DataFrame -> DataFrame`` built from
``pyspark.sql.functions`` expressions, so Catalyst sees the whole plan.
Sub-packages:

* ``sources``   -- table readers, raw text / JSON parsers, sinks
* ``functions`` -- column-level expressions (time, math, comfort formulas)
* ``operators`` -- frame, score, feature, quality, evaluation, monitoring, ML operators
* ``plans``     -- the named query catalog (Spark plan + DuckDB oracle) and checks
* ``streaming`` -- Structured Streaming jobs that reuse the batch operators
"""

__version__ = "0.1.0"
