"""Spark-native document analytics: cleaning, sectioning, chunking, retrieval,
evaluation, monitoring, integrity and scheduling as DataFrame transformations."""
