"""Spark-native interval-support screening, and text-corpus operators beside it."""
