"""Spark-native analysis of large collections of floppy-disc images."""
