"""wardcast: Spark DataFrame operators for clinical event marts and keyed
time-series regression.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from
``pyspark.sql.functions`` and joins/aggregates/windows that Catalyst plans;
Python runs only on small pre-aggregated rows (one row per series).
"""

__version__ = "0.1.0"
