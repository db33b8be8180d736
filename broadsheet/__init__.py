"""broadsheet: a PySpark-native analytics engine for document corpora such as digitised press archives."""

__version__ = "0.1.0"
