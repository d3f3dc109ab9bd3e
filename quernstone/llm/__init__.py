"""Operators for training-data pipelines. Nothing outside this folder imports it, but the registration in __spark_entry__."""
