"""qaloom: Spark-native analytics for time-anchored video question answering."""

__version__ = "0.1.0"
