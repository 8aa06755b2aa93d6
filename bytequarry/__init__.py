"""bytequarry: a Spark-native engine for analysing large collections of blobs as tables."""

__version__ = "0.1.0"
