"""Spark-native analytics for field observations, rasters at points and question-answering corpora."""
