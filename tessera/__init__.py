"""tessera: a PySpark-native engine for preparing and measuring language-model corpora."""

__version__ = "0.1.0"
