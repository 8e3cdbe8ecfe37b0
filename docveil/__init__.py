"""docveil: a PySpark-native document inspection and corpus-preparation engine."""

__version__ = "0.1.0"
