"""gleanframe: Spark-native sequencing, scoring, similarity and selection of large item collections."""

__version__ = "0.1.0"
