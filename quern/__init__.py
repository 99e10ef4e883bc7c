"""quern: a PySpark-native engine for code-intelligence tables and training-data pipelines."""

__version__ = "0.1.0"
