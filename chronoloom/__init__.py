"""chronoloom: time-series analytics and experiment statistics as Spark DataFrame operators."""

__version__ = "0.1.0"
