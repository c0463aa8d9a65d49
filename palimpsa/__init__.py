"""Palimpsa: a Spark-native engine for bitemporal, evidence-backed knowledge tables.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers and writers), ``plans`` (registered queries),
``streaming`` (change-stream operators) and ``llm`` (training-data operators).
"""
