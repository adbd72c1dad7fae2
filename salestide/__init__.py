"""salestide: sales analytics as PySpark DataFrame jobs.

Operators are plain functions ``DataFrame -> DataFrame`` over the canonical
invoice-line columns (see ``salestide.sources.schema``), chainable with
``df.transform``.
"""
