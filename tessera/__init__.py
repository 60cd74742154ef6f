"""Tessera: a PySpark-native engine for snapshots of text collections."""
