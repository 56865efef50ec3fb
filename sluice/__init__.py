"""Spark-native tables kept up to date from ordered change logs.

Subpackages: ``functions`` (scalar column functions), ``sources`` (change-event
inputs), ``operators`` (collapse, assembly, deletes, layout, reconciliation),
``plans`` (the snapshot table format, publishing, maintenance planning) and
``streaming`` (continuous ingestion).  ``llm`` holds operators for preparing
training text; nothing else in the library imports it.
"""
