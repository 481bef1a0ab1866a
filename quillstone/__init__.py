"""Quillstone: a PySpark-native engine for evidence-grounded document analytics."""
