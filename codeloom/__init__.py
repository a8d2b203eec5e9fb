"""codeloom: DataFrame operators that measure source-code and text corpora on Spark."""

__version__ = "0.1.0"
