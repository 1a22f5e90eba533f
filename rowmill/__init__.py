"""rowmill: Spark-native matrix analytics over feature-vector DataFrames.

Canonical frame: ``(id bigint, label, features array<double>)``. Operators
take and return DataFrames; data-sized work runs on executors, only
model-sized state (d x k) reaches the driver.
"""

__version__ = "0.1.0"
