"""benchloom: a PySpark-native engine for building and scoring multi-language code benchmarks."""

__version__ = "0.1.0"
