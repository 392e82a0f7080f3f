"""valuelens: listing-valuation analytics as Spark DataFrame operators.

Every public operator is a plain function ``(DataFrame, params) -> DataFrame``
built on the public Spark SQL / ML / Structured Streaming APIs.
"""

__version__ = "0.1.0"
