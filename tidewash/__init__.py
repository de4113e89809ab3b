"""Cleaning and checking of tabular data on Spark.

Every public function takes DataFrames and returns DataFrames (or, for
schema-sized facts such as fences, small Python values). Import from the
subpackages: ``functions`` (column expressions and shared building blocks),
``operators`` (one table-level job each), ``sources`` (files and runs) and
``plans`` (whole cleaning jobs).
"""
