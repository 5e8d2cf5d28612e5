"""pagemill: a PySpark-native engine for page-based desktop database files.

The package reads `.tps`, `.phd`, `.mod` and zip archives of them as Spark
DataFrames, lands, merges, profiles, reconciles and diffs their tables, and
writes tables back to the binary format.
"""

__version__ = "0.1.0"
