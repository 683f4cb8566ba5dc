"""Operators of a training-data pipeline over text and vector tables.

Nothing else in the library imports this package; ``__spark_entry__.py`` adds
its queries when the package can be imported.
"""
