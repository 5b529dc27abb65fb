"""Spark-native analytics for radio-channel measurement tables.

Every operator takes DataFrames in the logical schemas of :mod:`channelspark.schemas`
and returns a DataFrame; nothing is evaluated until the caller acts on the result.
"""

__version__ = "0.1.0"
