"""rillspark: incremental keyed dataflow and retrieval queries on PySpark."""
