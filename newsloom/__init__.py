"""Spark-native analytics for news items: ingest, cleaning, curation, stories and their evaluation."""
