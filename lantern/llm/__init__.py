"""Operators for training-data pipelines.  Nothing outside this package imports it.

Every operator takes and returns DataFrames; `queries.py` binds the ten of them to
the tables of a data folder.  Intermediate tables go through `tables.staged`, which
writes Parquet under the folder that `spark.checkpoint.dir` names.
"""
