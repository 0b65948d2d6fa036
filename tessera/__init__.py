"""A PySpark engine for text corpora and dense-vector collections."""
