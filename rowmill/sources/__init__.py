"""Sources and sinks: libsvm (Spark source and text job), labelled CSV,
Parquet row matrices, label/prediction text."""
from . import csv, libsvm, matrix  # noqa: F401
