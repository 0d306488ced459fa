"""Geographic price analytics as Spark jobs.

Operators are plain ``DataFrame -> DataFrame`` functions with explicit column
names; :mod:`terrier.plans` binds them to the deed schema.
"""
