"""Spark-native enrichment, write-plan and corpus-preparation operators."""
