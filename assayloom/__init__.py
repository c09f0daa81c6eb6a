"""assayloom: a PySpark-native engine that recognises, audits and preprocesses feature x sample tables."""

__version__ = "0.1.0"
