"""normgraph: a PySpark-native analytics engine for statutory knowledge graphs."""

__version__ = "0.1.0"
