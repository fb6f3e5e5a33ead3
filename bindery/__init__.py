"""Bindery: catalog hygiene, duplicate detection and consolidation planning on PySpark DataFrames."""
