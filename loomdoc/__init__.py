"""Spark-native document, sequence and vector analytics.

Operators are plain functions ``DataFrame -> DataFrame`` or ``Column -> Column``; Catalyst owns the
plan from the first call.  ``operators`` holds relational and sequence operators, ``functions`` the
column expressions, ``sources`` the scans, ``plans`` the named queries with their SQL, ``streaming``
the Structured Streaming variants.  The optional subpackage ``llm`` adds text-corpus operators and
is never imported from here.
"""

__version__ = "0.2.0"
