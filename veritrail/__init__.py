"""Veritrail: a Spark-native provenance, policy and receipt analytics engine."""

__version__ = "0.1.0"
